"""Element resolution: which node an action means, by a cascade of strategies, and help where none is found.

`actions(action_id, page_id, action)` may repeat themselves a million times on one page. What an action resolves to
depends on its page, type, element and value only, so each distinct request is resolved once and joined back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr, class_list, has_attr
from webloom.functions.css import match, simple
from webloom.functions.text import collapse_ws, contains_ci, non_empty, trim_js
from webloom.operators.extract import context, css_path, with_attrs
from webloom.operators.select import select_nodes
from webloom.plans.nodes import Dom, contained, is_hidden, with_ancestors, with_text
from webloom.plans.scale import hot_keys, merged, skew_join

# Strategies by priority.
STRATEGIES = {
    "DirectSelector": 100, "IdSelector": 90, "InputPattern": 70, "LinkStrategy": 65, "RoleBased": 60, "SingleElement": 40,
}
# Selectors tried in this order for inputs.
INPUT_PATTERNS = [
    "textarea", "[role=searchbox]", "[role=search] input", "[role=search] textarea", "textarea.gLFyf", "input[name=q]",
    'input[placeholder*="search" i]', 'textarea[placeholder*="search" i]', "#search", "#searchbox", "#searchInput",
    "#search-input", "input#search", "input#q",
]
TEXT_INPUTS = 'input[type="text"], textarea, input[type="search"]'
# What to suggest for selectors that mention a word.
SUGGESTIONS = {
    "input": ["textarea", "[role=searchbox]", "input[name=q]"],
    "button": ["[role=button]", "input[type=submit]", "button[type=submit]"],
}
# Stand-ins for two usual selectors.
PATTERN_MATCHES = {
    "input[type=text]": ["textarea", "[role=searchbox]", "[role=search] input", "input[name=q]"],
    "button[type=submit]": [
        '[role=button][aria-label*="search" i]', "button.search-button", "input[type=submit]", "[role=search] button",
    ],
}
# Fallback selectors by purpose, in order.
FALLBACKS = {
    "search-input": [
        'input[type="search"]', 'input[name="q"]', 'input[name*="search"]', 'input[placeholder*="search" i]',
        '[role="searchbox"]', ".search-input", ".searchbox", 'form[role="search"] input',
        "input.ytSearchboxComponentInput", 'input[name="search_query"]',
    ],
    "search-button": [
        'button[aria-label="Search"]', '[role="search"] button', "button.search-icon", "button.search-button",
        'button[type="submit"]', 'input[type="submit"]', ".ytSearchboxComponentSearchButton", '[aria-label*="search" i]',
    ],
    "submit-button": [
        'button[type="submit"]', 'input[type="submit"]', "button.submit", 'button[aria-label*="submit" i]',
        'button[aria-label*="sign in" i]', 'button[aria-label*="log in" i]', '[role="button"]:has-text("Submit")',
        '[role="button"]:has-text("Sign In")', '[role="button"]:has-text("Log In")',
    ],
    "navigation": [
        "nav a", ".navigation a", ".menu a", '[role="navigation"] a', '[role="menuitem"]', ".nav-link", ".menu-item",
    ],
    "general-input": [
        'input[type="text"]', "textarea", '[contenteditable="true"]', 'input:not([type="hidden"])', '[role="textbox"]',
    ],
    "general-button": ["button", '[role="button"]', "a.btn", 'input[type="button"]', ".button"],
}
MAX_SIMILAR, MAX_BUTTONS = 5, 10

def _hidden() -> Column:
    """Hidden by markup or kept from assistive technology; what is inside is hidden too."""
    return is_hidden() | F.coalesce(F.lower(attr("aria-hidden")) == "true", F.lit(False))


def _first_of(selectors: list[str], names: list[str]) -> Column:
    """Aggregate: the first selector in the list whose first match is visible, with that match."""
    options = []
    for i, (s, n) in enumerate(zip(selectors, names, strict=True)):
        first = F.min(F.when(F.col(n), F.struct("pos", "hidden")))
        options.append(F.when(~first["hidden"], F.struct(F.lit(i).alias("ord"), first["pos"].alias("pos"), F.lit(s).alias("selector"))))
    return F.coalesce(*options)


def _page_facts(dom: Dom) -> DataFrame:
    """Per page: the best input pattern, and the only link, text input and button."""
    names = {f"_i{i}": s for i, s in enumerate(INPUT_PATTERNS)}
    names |= {"_text_input": TEXT_INPUTS}
    flagged = match(with_ancestors(dom.nodes, {"hidden": is_hidden()}), names)
    only = lambda test: F.when(F.count(F.when(test, 1)) == 1, F.min(F.when(test, F.col("pos"))))
    return flagged.groupBy("page_id").agg(
        _first_of(INPUT_PATTERNS, list(names)[:-1]).alias("input_pattern"),
        only(F.col("tag") == "a").alias("only_link"),
        only(F.col("_text_input")).alias("only_input"),
        only(F.col("tag") == "button").alias("only_button"),
    )


def _spoken(elements: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Add `spoken`: each element's text with the alternative texts of the images in it, in document order."""
    is_element = F.coalesce(F.col("_element"), F.lit(False))
    marks = elements.select("page_id", "pos", F.lit(True).alias("_element"))
    inner = nodes.join(merged(marks), ["page_id", "pos"], "left")
    images = contained(inner, {"image": (is_element, F.col("tag").isin("img", "area"))})
    images = images.select("page_id", "outer_pos", "pos", attr("alt").alias("alt")).where("alt <> ''")
    lists = images.groupBy("page_id", F.col("outer_pos").alias("pos")).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").alias("at"), "alt"))).alias("_images"))
    rows = with_text(elements, docs).join(merged(lists), ["page_id", "pos"], "left").join(merged(docs.select("page_id", F.col("texts").alias("_texts"))), "page_id")
    between = lambda start, end: F.array_join(F.slice("_texts", start + 1, end - start), "")
    said = F.aggregate(
        "_images",
        F.struct(F.col("pos").cast("int").alias("at"), F.lit("").alias("said")),
        lambda acc, i: F.struct(i["at"].cast("int").alias("at"), F.concat(acc["said"], between(acc["at"], i["at"].cast("int")), F.lit(" "), i["alt"], F.lit(" ")).alias("said")),
        lambda acc: F.concat(acc["said"], between(acc["at"], F.col("end").cast("int"))),
    )
    return rows.select(*elements.columns, F.when(F.col("_images").isNull(), F.col("text")).otherwise(said).alias("spoken"))


def _labelled(elements: DataFrame, dom: Dom) -> DataFrame:
    """page_id, pos and `labels`: the texts that an element's aria-labelledby refers to, in that order."""
    ids = F.split(trim_js(attr("aria-labelledby")), r"\s+")
    asked = elements.where(F.contains(F.lower("raw"), F.lit("aria-labelledby"))).select("page_id", "pos", F.posexplode(ids).alias("place", "id"))
    named = dom.nodes.where(F.contains(F.lower("raw"), F.lit("id"))).select("*", attr("id").alias("id")).where("id <> ''")
    first = named.join(merged(asked.select("page_id", "id").distinct()), ["page_id", "id"], "left_semi")
    first = first.groupBy("page_id", "id").agg(F.min_by(F.struct("pos", "end", "tag", "raw"), "pos").alias("n")).select("page_id", "id", "n.*")
    label = non_empty(trim_js(attr("aria-label")))
    texts = with_text(first, dom.docs).select("page_id", "id", F.coalesce(label, collapse_ws("text")).alias("label"))
    found = asked.join(merged(texts), ["page_id", "id"])
    order = F.sort_array(F.collect_list(F.struct("place", "label")))
    return found.groupBy("page_id", "pos").agg(collapse_ws(F.array_join(F.transform(order, lambda x: x["label"]), " ")).alias("labels"))


def _named_controls(dom: Dom) -> DataFrame:
    """Links and buttons with their accessible names: what aria-labelledby refers to, else aria-label, else value,
    alternative text or content with the images in it, else title. Hidden ones have no role. Whether parts of the
    content are hidden does not matter."""
    tag = F.col("tag")
    kinds = F.lower(F.coalesce(attr("type"), F.lit("text")))
    button = (tag.isin("button", "summary")) | ((tag == "input") & kinds.isin("button", "submit", "reset", "image"))
    role = F.coalesce(attr("role"), F.lit(""))
    is_link = ((tag == "a") & has_attr("href") & (role == "")) | (role == "link")
    is_button = (button & (role == "")) | (role == "button")
    nodes = with_ancestors(dom.nodes, {"_hidden": _hidden()})
    picked = nodes.select("*", (is_link & ~F.col("_hidden")).alias("is_link"), (is_button & ~F.col("_hidden")).alias("is_button"), (tag == "a").alias("is_a"))
    picked = picked.where("is_link or is_button or is_a").drop("_hidden")
    rows = _spoken(picked, dom.nodes, dom.docs).join(merged(_labelled(picked, dom)), ["page_id", "pos"], "left")
    rows = with_attrs(rows)
    a = lambda name: non_empty(trim_js(F.try_element_at("attrs", F.lit(name))))
    own = F.when(F.col("tag") == "input", F.coalesce(a("value"), a("alt"))).otherwise(non_empty(collapse_ws("spoken")))
    name = F.coalesce(non_empty("labels"), a("aria-label"), own, a("title"), F.lit(""))
    return rows.select(
        "page_id", "pos", "is_link", "is_button", "is_a", name.alias("name"), F.try_element_at("attrs", F.lit("href")).alias("href")
    )


def _mentions(element: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(element), F.lit(word)), F.lit(False))


def _value_that_matters(action: str = "action") -> Column:
    """An action's value, where some strategy looks at it: texts typed into fields do not make requests differ."""
    named = _mentions(F.col(f"{action}.element"), "a[href") | _mentions(F.col(f"{action}.element"), "button")
    return F.when((F.col(f"{action}.type") == "click") & named, F.col(f"{action}.value"))


def _request_key(action: str = "action") -> Column:
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    fields = [F.col(f"{action}.type"), F.col(f"{action}.element"), _value_that_matters(action)]
    return F.concat_ws("\u0001", *[part(f) for f in fields])


def _can_handle() -> dict[str, Column]:
    """Which strategies apply to a request (columns type, element, value)."""
    element, kind = F.col("element"), F.col("type")
    given = F.coalesce(element != "", F.lit(False)) & ~F.coalesce(kind == "notes", F.lit(False))
    click, entry = F.coalesce(kind == "click", F.lit(False)), F.coalesce(kind == "input", F.lit(False))
    has_value = F.coalesce(F.col("value") != "", F.lit(False))
    return {
        "DirectSelector": given,
        "IdSelector": given & F.startswith(element, F.lit("#")) & (click | entry),
        "InputPattern": given & entry & _mentions(element, "input"),
        "LinkStrategy": given & click & _mentions(element, "a[href"),
        "RoleBased": given & click & has_value & _mentions(element, "button"),
        "SingleElement": given,
    }


def _resolve_requests(requests: DataFrame, dom: Dom) -> DataFrame:
    """requests(page_id, request, type, element, value) with pos, strategy, selector and trace."""
    hot = hot_keys(requests, "page_id")
    asked = requests.select("*", *[c.alias(f"_can_{n}") for n, c in _can_handle().items()])
    can = lambda n: F.col(f"_can_{n}")

    # By selector: the element itself, and an input's id with the kinds of element it may be on.
    id_forms = [F.concat(F.lit(p), F.col("element")) for p in ("input", "textarea", "[role=searchbox]")]
    by_id = can("InputPattern") & F.startswith("element", F.lit("#"))
    selectors = F.concat(
        F.when(can("DirectSelector"), F.array("element")).otherwise(F.array()),
        F.when(by_id, F.array(*id_forms)).otherwise(F.array()),
    )
    spread = asked.select("page_id", "request", F.posexplode(selectors).alias("ord", "selector"))
    found = select_nodes(spread, dom, hot)
    # An input is waited for until it is visible; the element that is asked for itself is not.
    unseen = with_ancestors(dom.nodes, {"unseen": is_hidden()}).where("unseen").select("page_id", F.col("pos").alias("first_pos"), "unseen")
    hit = F.when(F.col("first_pos").isNotNull() & ((F.col("ord") == 0) | F.col("unseen").isNull()), F.struct("ord", F.col("first_pos").alias("pos"), "selector"))
    by_selector = (
        spread.join(merged(found), ["page_id", "selector"])
        .join(merged(unseen), ["page_id", "first_pos"], "left")
        .groupBy("page_id", "request")
        .agg(
            F.min(F.when(F.col("ord") == 0, hit)).alias("direct"),
            F.min(F.when(F.col("ord") > 0, hit)).alias("input_id"),
            F.max(F.when(F.col("ord") == 0, F.col("match_count"))).alias("match_count"),
            F.max(F.when(F.col("ord") == 0, F.col("supported"))).alias("supported"),
        )
    )

    # By name or target: links and buttons of the page that the value or the quoted URL is part of.
    quoted = F.regexp_extract("element", r"""(?i)a\[href=["']([^"']+)["']\]""", 1)
    by_text = asked.where(can("LinkStrategy") | can("RoleBased")).select(
        "page_id",
        "request",
        F.nullif(collapse_ws("value"), F.lit("")).alias("want_name"),
        F.nullif(F.regexp_replace(quoted, "[()]", ""), F.lit("")).alias("want_href"),
    )
    controls = _named_controls(dom)
    named = F.coalesce(contains_ci("name", "want_name"), F.lit(False))
    linked = F.coalesce(F.col("is_a") & F.contains("href", F.col("want_href")), F.lit(False))
    by_text = (
        skew_join(by_text, controls, "page_id", "request", hot)
        .where(named | linked)
        .groupBy("page_id", "request")
        .agg(
            F.min(F.when(named & F.col("is_link"), F.col("pos"))).alias("link_by_name"),
            F.min(F.when(linked, F.col("pos"))).alias("link_by_href"),
            F.when(F.count(F.when(named & F.col("is_button"), 1)) == 1, F.min(F.when(named & F.col("is_button"), F.col("pos")))).alias(
                "button_by_name"
            ),
        )
    )

    joined = asked.join(merged(by_selector), ["page_id", "request"], "left").join(merged(by_text), ["page_id", "request"], "left")
    joined = skew_join(joined, _page_facts(dom), "page_id", "request", hot, "left")
    quote = lambda before, column, after: F.concat(F.lit(before), column, F.lit(after))
    at = lambda pos, selector: F.when(F.col(pos).isNotNull(), F.struct(F.col(pos).alias("pos"), selector.alias("selector")))
    url = F.regexp_extract("element", r"""(?i)a\[href=["']([^"']+)["']\]""", 1)
    hits = {
        "DirectSelector": F.when(F.col("direct").isNotNull(), F.struct("direct.pos", "direct.selector")),
        "IdSelector": F.when(F.col("direct").isNotNull(), F.struct("direct.pos", "direct.selector")),
        "InputPattern": F.coalesce(
            F.when(F.col("input_pattern").isNotNull(), F.struct("input_pattern.pos", "input_pattern.selector")),
            F.when(F.col("input_id").isNotNull(), F.struct("input_id.pos", "input_id.selector")),
        ),
        "LinkStrategy": F.coalesce(
            at("link_by_name", quote('link[text="', F.col("value"), '"]')),
            at("link_by_href", quote('a[href*="', url, '"]')),
            at("only_link", F.lit("single-link-fallback")),
        ),
        "RoleBased": at("button_by_name", quote('role=button[name="', F.col("value"), '"]')),
        "SingleElement": F.coalesce(
            F.when(F.col("type") == "input", at("only_input", F.lit("single-input-fallback"))),
            F.when(
                (F.col("type") == "click") & _mentions(F.col("element"), "button"),
                at("only_button", F.lit("single-button-fallback")),
            ),
        ),
    }
    tries = [
        F.when(
            can(n),
            F.struct(F.lit(p).alias("priority"), F.lit(n).alias("strategy"), hits[n].alias("hit")),
        )
        for n, p in STRATEGIES.items()
    ]
    tried = joined.select(
        *requests.columns, "match_count", "supported", F.array_compact(F.array(*tries)).alias("tries")
    )
    winner = F.get(F.filter("tries", lambda t: t["hit"].isNotNull()), F.lit(0))
    won = tried.select("*", winner.alias("winner"))
    # The cascade stops at its first hit.
    trace = F.transform(
        F.filter("tries", lambda t: t["priority"] >= F.coalesce(F.col("winner.priority"), F.lit(0))),
        lambda t: F.struct(t["priority"].alias("priority"), t["strategy"].alias("strategy"), t["hit"].isNotNull().alias("hit")),
    )
    return won.select(
        *requests.columns,
        F.col("winner.hit.pos").alias("pos"),
        F.col("winner.strategy").alias("strategy"),
        F.col("winner.hit.selector").alias("selector"),
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        (F.coalesce(F.col("element") != "", F.lit(False)) & ~F.coalesce("supported", F.lit(True))).alias("unsupported_selector"),
        trace.alias("trace"),
    )


def resolve_elements(actions: DataFrame, dom: Dom) -> DataFrame:
    """Actions with pos, strategy and selector of the element they mean (null where none), unsupported_selector, and
    the trace of strategies tried."""
    keyed = actions.withColumn("_request", _request_key())
    requests = keyed.select(
        "page_id", F.col("_request").alias("request"), "action.type", "action.element", _value_that_matters().alias("value")
    ).dropDuplicates(["page_id", "request"])
    resolved = _resolve_requests(requests, dom).select(
        "page_id", F.col("request").alias("_request"), "pos", "strategy", "selector", "unsupported_selector", "trace"
    )
    return keyed.join(merged(resolved), ["page_id", "_request"], "left").drop("_request")


def resolution_trace(resolved: DataFrame) -> DataFrame:
    """One row per action and strategy tried."""
    return resolved.select("action_id", "page_id", F.explode("trace").alias("t")).select("action_id", "page_id", "t.*")


def _existing(dom: Dom, selectors: list[str]) -> DataFrame:
    """Per page: those of the given selectors that match something, as an array in their order."""
    names = {f"_s{i}": s for i, s in enumerate(selectors)}
    flagged = match(dom.nodes, names)
    return flagged.groupBy("page_id").agg(
        F.array_compact(F.array(*[F.when(F.max(n), F.lit(s)) for n, s in names.items()])).alias("existing")
    )


def suggest_selectors(wanted: DataFrame, dom: Dom) -> DataFrame:
    """wanted(page_id, selector) with `suggestions`: alternatives for inputs and buttons that exist on the page."""
    return _suggest(wanted, dom, hot_keys(wanted, "page_id"))


def _suggest(wanted: DataFrame, dom: Dom, hot: DataFrame | None) -> DataFrame:
    known = [s for group in SUGGESTIONS.values() for s in group]
    joined = skew_join(wanted, _existing(dom, known), "page_id", "selector", hot, "left")
    parts = [
        F.when(F.contains("selector", F.lit(word)), F.array(*[F.lit(s) for s in group])).otherwise(F.array())
        for word, group in SUGGESTIONS.items()
    ]
    here = F.coalesce("existing", F.array().cast("array<string>"))
    offered = F.filter(F.concat(*parts).cast("array<string>"), lambda s: F.array_contains(here, s))
    return joined.select(*wanted.columns, F.coalesce(offered, F.array().cast("array<string>")).alias("suggestions"))


def element_exists(wanted: DataFrame, dom: Dom) -> DataFrame:
    """wanted(page_id, selector): exists, count, and a suggestion where nothing is found."""
    asked = wanted.select("page_id", "selector").distinct()
    requests = asked.select(
        "page_id", F.col("selector").alias("request"), F.lit("click").alias("type"), F.col("selector").alias("element"),
        F.lit(None).cast("string").alias("value"),
    )
    found = _resolve_requests(requests, dom).select("page_id", F.col("request").alias("selector"), "pos", "match_count", "unsupported_selector")
    offered = _suggest(found, dom, hot_keys(asked, "page_id"))
    exists = F.col("pos").isNotNull()
    count = F.when(exists, F.when(F.col("unsupported_selector"), F.lit(1)).otherwise(F.col("match_count"))).otherwise(0)
    hint = F.when(~exists & (F.size("suggestions") > 0), F.concat(F.lit("Try instead: "), F.array_join("suggestions", ", ")))
    return offered.select("page_id", "selector", exists.alias("exists"), count.cast("bigint").alias("count"), hint.alias("suggestion"))


def element_info(wanted: DataFrame, dom: Dom) -> DataFrame:
    """wanted(page_id, selector): found, count, and visibility, tag and text of the first match."""
    found = select_nodes(wanted, dom, hot_keys(wanted, "page_id"))
    nodes = context(dom.nodes).select("page_id", F.col("pos").alias("first_pos"), "end", "tag", "raw", "hidden")
    first = found.where("first_pos is not null").join(merged(nodes), ["page_id", "first_pos"])
    first = with_text(first.withColumnRenamed("first_pos", "pos"), dom.docs).select(
        "page_id", "selector", (~F.col("hidden")).alias("is_visible"), F.upper("tag").alias("tag_name"), F.left("text", F.lit(100)).alias("text")
    )
    return found.join(merged(first), ["page_id", "selector"], "left").select(
        "page_id",
        "selector",
        F.col("first_pos").isNotNull().alias("found"),
        F.col("match_count").cast("bigint").alias("count"),
        "is_visible",
        "tag_name",
        "text",
    )


def close_matches(wanted: DataFrame, dom: Dom, limit: int = MAX_SIMILAR) -> DataFrame:
    """For #x and .x selectors: the first elements whose id or class contains x."""
    asked = wanted.select("page_id", "selector").distinct().where(F.col("selector").rlike(r"^[#.]."))
    asked = asked.select("page_id", "selector", F.substring("selector", F.lit(2), F.length("selector")).alias("part"), F.startswith("selector", F.lit("#")).alias("by_id"))
    marked = dom.nodes.where(F.length("raw") > F.length("tag") + 2).select(
        "page_id", "pos", "end", "tag", "raw", attr("id").alias("node_id"), attr("class").alias("node_class")
    )
    marked = marked.where("node_id is not null or node_class is not null")
    held = F.when(F.col("by_id"), F.col("node_id")).otherwise(F.col("node_class"))
    near = skew_join(asked, marked, "page_id", "selector", hot_keys(asked, "page_id")).where(F.contains(held, F.col("part")))
    rank = F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("pos"))
    top = near.select("page_id", "selector", "pos", "end", "tag", "raw", rank.alias("rank")).where(F.col("rank") <= limit)
    rows = with_attrs(with_text(top, dom.docs))
    return rows.select(
        "page_id",
        "selector",
        "rank",
        F.upper("tag").alias("tag_name"),
        non_empty(F.try_element_at("attrs", F.lit("id"))).alias("id"),
        class_list(F.try_element_at("attrs", F.lit("class"))).alias("classes"),
        F.left("text", F.lit(50)).alias("text"),
    )


def visible_buttons(dom: Dom, limit: int = MAX_BUTTONS) -> DataFrame:
    """The first visible buttons of each page, as guidance."""
    picked = context(dom.nodes).where(simple('button, [role="button"], a.btn') & ~F.col("hidden"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    top = picked.select("page_id", "pos", "end", "tag", "raw", rank.alias("rank")).where(F.col("rank") <= limit)
    rows = with_attrs(with_text(top, dom.docs))
    return rows.select(
        "page_id",
        "rank",
        F.upper("tag").alias("tag_name"),
        non_empty(F.try_element_at("attrs", F.lit("id"))).alias("id"),
        class_list(F.try_element_at("attrs", F.lit("class"))).alias("classes"),
        non_empty(F.left(trim_js("text"), F.lit(50))).alias("text"),
        F.when(css_path() == F.col("tag"), F.upper("tag")).otherwise(css_path()).alias("selector"),
    )


def best_match(wanted: DataFrame, dom: Dom) -> DataFrame:
    """wanted(page_id, reference) with `match`: the reference if it selects something, a usual stand-in, or the element
    that scores highest by id, name, role and text."""
    asked = wanted.select("page_id", F.col("reference").alias("selector")).where("selector <> ''").distinct()
    hot = hot_keys(asked, "page_id")
    exact = select_nodes(asked, dom, hot).select("page_id", "selector", (F.col("match_count") > 0).alias("exact"))
    stand_ins = [s for group in PATTERN_MATCHES.values() for s in group]
    existing = _existing(dom, stand_ins)
    here = F.coalesce("existing", F.array().cast("array<string>"))
    patterns = [
        F.when(
            F.contains("selector", F.lit(pattern)),
            F.get(F.filter(F.array(*[F.lit(s) for s in group]), lambda s: F.array_contains(here, s)), F.lit(0)),
        )
        for pattern, group in PATTERN_MATCHES.items()
    ]
    known = skew_join(exact, existing, "page_id", "selector", hot, "left").select(
        "page_id", "selector", F.when(F.col("exact"), F.col("selector")).otherwise(F.coalesce(*patterns)).alias("known")
    )

    # Scores. Text alone gives one point, and then the first element holding it is always the root.
    ref = F.col("selector")
    left = known.where("known is null").select("page_id", "selector")
    marked = dom.nodes.where(F.length("raw") > F.length("tag") + 2)
    marked = marked.select("*", attr("id").alias("node_id"), attr("name").alias("node_name"), attr("role").alias("node_role"))
    marked = with_text(marked.where("node_id <> '' or node_name is not null or node_role is not null"), dom.docs)
    points = (
        F.when(F.contains("node_id", ref), 3).otherwise(0)
        + F.when(F.col("node_name") == ref, 2).otherwise(0)
        + F.when(F.col("node_role") == ref, 2).otherwise(0)
    )
    scored = skew_join(left, marked, "page_id", "selector", hot).select("*", points.alias("points")).where("points > 0")
    label = F.coalesce(
        F.concat(F.lit("#"), non_empty("node_id")),
        F.concat("tag", F.lit('[name="'), non_empty("node_name"), F.lit('"]')),
        F.concat(F.lit('[role="'), non_empty("node_role"), F.lit('"]')),
        F.col("tag"),
    )
    total = F.col("points") + F.when(contains_ci("text", ref), 1).otherwise(0)
    by_attrs = scored.groupBy("page_id", "selector").agg(F.min_by(label, F.struct(-total, F.col("pos"))).alias("by_attrs"))
    whole = dom.docs.select("page_id", F.array_join("texts", "").alias("page_text"))
    by_text = skew_join(left, whole, "page_id", "selector", hot).where(contains_ci("page_text", ref)).select("page_id", "selector", F.lit("html").alias("by_text"))
    keys = ["page_id", "selector"]
    return (
        known.join(merged(by_attrs), keys, "left")
        .join(merged(by_text), keys, "left")
        .select("page_id", F.col("selector").alias("reference"), F.coalesce("known", "by_attrs", "by_text").alias("match"))
    )


def fallback_purpose(kind, element, value) -> Column:
    """What an action's element is for, judged by its words."""
    kind, element, value = F.col(kind), F.col(element), F.col(value)
    has = lambda text, *words: reduce(or_, [_mentions(text, w) for w in words])
    click, entry = kind == "click", kind == "input"
    search = has(element, "search") | has(value, "search")
    return (
        F.when(entry & search, "search-input")
        .when(click & search, "search-button")
        .when(click & (has(element, "submit") | has(value, "submit", "sign in", "log in")), "submit-button")
        .when(click & has(element, "nav", "menu", "link"), "navigation")
        .when(entry, "general-input")
        .otherwise("general-button")
    )


def fallback_selectors(purpose) -> Column:
    """The selectors to try for a purpose, in order."""
    column = F.col(purpose) if isinstance(purpose, str) else purpose
    return F.coalesce(*[F.when(column == p, F.array(*[F.lit(s) for s in group])) for p, group in FALLBACKS.items()])


def _fallback_hits(dom: Dom) -> DataFrame:
    """Per page one struct per purpose: the first fallback that matches, and the first elements for a text search."""
    plain = sorted({s for group in FALLBACKS.values() for s in group if ":has-text" not in s})
    names = {f"_s{i}": s for i, s in enumerate(plain)}
    column = {s: n for n, s in names.items()}
    flagged = match(dom.nodes, {**names, "_role_button": '[role="button"]'})
    texts = with_text(flagged.where(F.col("_role_button")).select(*dom.nodes.columns), dom.docs)
    worded = [s for group in FALLBACKS.values() for s in group if ":has-text" in s]
    by_text = texts.groupBy("page_id").agg(
        *[F.min(F.when(simple(s), F.col("pos"))).alias(f"_t{i}") for i, s in enumerate(worded)]
    )
    firsts = flagged.groupBy("page_id").agg(*[F.min(F.when(F.col(n), F.col("pos"))).alias(n) for n in names])
    both = firsts.join(merged(by_text), "page_id", "left")
    place = {**column, **{s: f"_t{i}" for i, s in enumerate(worded)}}
    purposes = []
    for purpose, group in FALLBACKS.items():
        options = [
            F.when(F.col(place[s]).isNotNull(), F.struct(F.col(place[s]).alias("pos"), F.lit(s).alias("selector"))) for s in group
        ]
        purposes.append(F.coalesce(*options).alias(purpose))
    return both.select("page_id", *purposes)


def find_by_text(wanted: DataFrame, dom: Dom, mode: str = "reference") -> DataFrame:
    """wanted(page_id, text) with `pos` of a button or link for the text.

    `reference` keeps the original's selector list, in which only role=button elements are asked for their text, so
    the first button or link of any text wins; `intended` asks all of them.
    """
    asked = wanted.select("page_id", F.col("text").alias("want")).where("want <> ''").distinct()
    hot = hot_keys(asked, "page_id")
    tag = F.col("tag")
    controls = dom.nodes.where(tag.isin("button", "a") | simple('[role="button"]'))
    controls = with_text(controls, dom.docs).select("page_id", "pos", "tag", "text")
    worded = contains_ci(collapse_ws("text"), "want")
    first = worded if mode == "intended" else tag.isin("button", "a") | worded
    rank = F.when(first, 0).when(contains_ci("text", "want"), 1)
    if mode == "intended":
        hits = skew_join(asked, controls, "page_id", "want", hot).select("page_id", "want", "pos", rank.alias("rank")).where("rank is not null")
        found = hits.groupBy("page_id", "want").agg(F.min_by("pos", F.struct("rank", "pos")).alias("pos"))
    else:
        # Buttons and links need no comparison: the first one of the page stands for all of them.
        any_first = controls.where(tag.isin("button", "a")).groupBy("page_id").agg(F.min("pos").alias("any_pos"))
        roles = controls.where(~tag.isin("button", "a"))
        hits = skew_join(asked, roles, "page_id", "want", hot).select("page_id", "want", "pos", rank.alias("rank")).where("rank is not null")
        ranked = hits.groupBy("page_id", "want").agg(
            F.min(F.when(F.col("rank") == 0, F.col("pos"))).alias("worded_pos"), F.min("pos").alias("loose_pos")
        )
        found = asked.join(merged(any_first), "page_id", "left").join(merged(ranked), ["page_id", "want"], "left").select(
            "page_id", "want", F.coalesce(F.least("any_pos", "worded_pos"), F.col("loose_pos")).alias("pos")
        )
    return found.where("pos is not null").select("page_id", F.col("want").alias("text"), "pos")


def try_fallbacks(actions: DataFrame, dom: Dom, mode: str = "reference") -> DataFrame:
    """actions(action_id, page_id, action) with purpose, pos and selector of the fallback that is there, else of a
    button or link for the action's value or description."""
    purpose = fallback_purpose("action.type", "action.element", "action.value")
    text = F.coalesce(non_empty("action.value"), non_empty("action.description"))
    given = actions.where(F.col("action.element") != "").select("*", purpose.alias("purpose"), text.alias("text"))
    hits = _fallback_hits(dom)
    chosen = F.coalesce(*[F.when(F.col("purpose") == p, F.col(f"`{p}`")) for p in FALLBACKS])
    joined = skew_join(given, hits, "page_id", "action_id", hot_keys(actions, "page_id"), "left")
    joined = joined.select(*given.columns, chosen.alias("hit"))
    by_text = find_by_text(given.select("page_id", "text"), dom, mode).withColumnRenamed("pos", "text_pos")
    return joined.join(merged(by_text), ["page_id", "text"], "left").select(
        *actions.columns,
        "purpose",
        F.coalesce("hit.pos", "text_pos").alias("pos"),
        F.when(F.col("hit").isNotNull(), F.col("hit.selector"))
        .when(F.col("text_pos").isNotNull(), F.concat(F.lit("text="), "text"))
        .alias("selector"),
    )


