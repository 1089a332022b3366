"""Page snapshots: all extractors of a page in one row, and what is derived from that."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr
from webloom.functions.css import simple
from webloom.functions.text import collapse_ws, non_empty, trim_js, truncate
from webloom.operators import extract
from webloom.operators.extract import MAIN_CONTENT, MAIN_FALLBACK_LIMIT, MAIN_LIMIT, REGISTRY, RULES, context, with_attrs
from webloom.plans.nodes import Dom, contained, with_text
from webloom.plans.scale import worked_out

# The categories kept under `elements`; everything else goes to `content`.
ELEMENT_CATEGORIES = ["buttons", "inputs", "links", "landmarks"]
LITE = ["title", "url", *ELEMENT_CATEGORIES]
# Caps of the compact view.
MAX_CONTROLS, MAX_LISTS, MAX_FORMS, MAX_FORM_FIELDS, MAX_PAGINATION, MAX_SAMPLES = 30, 2, 3, 12, 2, 3

# The blocks of the compact view, in its order.
BLOCKS = ["lists", "controls", "pagination", "forms"]

_STRINGS = {"title", "metaDescription", "mainContent"}


def _string_rules(max_text: int | None) -> dict[str, tuple[Column, Column]]:
    limit = max_text or MAIN_FALLBACK_LIMIT
    return {
        "title": (F.col("tag") == "title", collapse_ws("text")),
        "metaDescription": (simple('meta[name="description"]'), trim_js(attr("content"))),
        "mainContent": (simple(MAIN_CONTENT), truncate(collapse_ws("text"), limit)),
    }


def _sorted_items(item: Column, keep: Column, order: list[Column]) -> Column:
    rows = F.sort_array(F.collect_list(F.when(keep, F.struct(*order, item.alias("item")))))
    return F.transform(rows, lambda r: r["item"])


def _one_pass(dom: Dom, names: list[str], max_text: int | None) -> DataFrame:
    """The extractors that look at single elements, all of them in one pass over the nodes."""
    strings = {n: r for n, r in _string_rules(max_text).items() if n in names}
    rules = {n: r for n, r in RULES.items() if n in names}
    tests = {n: r.test() for n, r in rules.items()} | {n: t for n, (t, _) in strings.items()}
    flagged = context(dom.nodes).select("*", *[t.alias(f"_is_{n}") for n, t in tests.items()])
    wanted = flagged.where(reduce(or_, [F.col(f"_is_{n}") for n in tests]))
    rows = with_attrs(with_text(wanted, dom.docs)).select(
        "page_id",
        "pos",
        *[F.when(F.col(f"_is_{n}"), F.struct(*r.fields())).alias(n) for n, r in rules.items()],
        *[F.when(F.col(f"_is_{n}"), value).alias(n) for n, (_, value) in strings.items()],
    )
    aggregates = []
    for n, rule in rules.items():
        keep = F.col(n).isNotNull() & rule.keep(lambda f, n=n: F.col(n)[f])
        item, order = F.col(n), [F.col("pos")]
        if n == "navigation":
            item = F.struct(F.col(n)["text"].alias("text"), F.col(n)["href"].alias("href"))
            in_ui = F.col(n)["is_navigation"]
            order = [in_ui.alias("ui"), F.when(~in_ui, -F.col(n)["score"]).alias("score"), F.col("pos")]
        aggregates.append(_sorted_items(item, keep, order).alias(n))
    for n in strings:
        first = F.min_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("pos")))
        aggregates.append(first.alias(n))
    return rows.groupBy("page_id").agg(*aggregates)


def extract_specific(dom: Dom, names: list[str], max_text: int | None = MAIN_LIMIT) -> DataFrame:
    """One row per page with one column per named extractor; unknown names are skipped."""
    names = [n for n in dict.fromkeys(names) if n in REGISTRY]
    # An extractor that was replaced is no longer part of the single pass.
    own = [n for n in names if REGISTRY[n] is extract.BUILT_IN.get(n)]
    single = [n for n in own if n in RULES or n in _STRINGS]
    out = dom.docs.select("page_id", "url")
    if single:
        out = out.join(_one_pass(dom, single, max_text), "page_id", "left")
    for name in names:
        if name in single or (name == "url" and name in own):
            continue
        rows = REGISTRY[name](dom)
        if "pos" not in rows.columns:
            value = [c for c in rows.columns if c != "page_id"][-1]
            given = rows.groupBy("page_id").agg(F.first(value).alias(name))
            out = (out.drop(name) if name == "url" else out).join(given, "page_id", "left")
            continue
        fields = [c for c in rows.columns if c not in ("page_id", "pos")]
        grouped = rows.groupBy("page_id").agg(
            _sorted_items(F.struct(*fields), F.lit(True), [F.col("pos")]).alias(name)
        )
        out = out.join(grouped, "page_id", "left")
    filled = []
    for name in names:
        if name == "url":
            continue
        empty = F.lit("") if name in _STRINGS else F.array()
        filled.append(F.coalesce(F.col(name), empty).alias(name))
    return out.select("page_id", "url", *filled)


def _diagnostic(name: str) -> Column:
    """success, result_type and result_size of one extractor: an empty array is a success, an empty string none."""
    value = F.col(name)
    if name == "navigation":
        # The extractor returns one block that holds the links.
        fields = (F.lit(True), F.lit("array"), F.lit("1"))
    elif name in _STRINGS or name == "url":
        some = F.coalesce(value != "", F.lit(False))
        fields = (
            some,
            F.when(some, F.lit("string")).otherwise(F.lit("none")),
            F.when(some, F.length(value)).otherwise(0).cast("string"),
        )
    else:
        fields = (F.lit(True), F.lit("array"), F.size(value).cast("string"))
    return F.struct(*[f.alias(n) for f, n in zip(fields, ("success", "result_type", "result_size"), strict=True)])


def diagnostics(flat: DataFrame, names: list[str]) -> Column:
    return F.create_map(*[c for n in names for c in (F.lit(n), _diagnostic(n))])


def snapshot(dom: Dom, names: list[str] | None = None, max_text: int | None = MAIN_LIMIT) -> DataFrame:
    """page_id, url, title, elements, content, diagnostic: one row per page."""
    names = [n for n in (names or list(REGISTRY)) if n in REGISTRY]
    flat = extract_specific(dom, [*names, "title"], max_text)
    elements = [
        (F.col(n) if n in names else F.array()).alias(n) for n in ELEMENT_CATEGORIES
    ]
    content = [F.col(n) for n in names if n not in ELEMENT_CATEGORIES]
    return flat.select(
        "page_id",
        "url",
        "title",
        F.struct(*elements).alias("elements"),
        F.struct(*content).alias("content"),
        diagnostics(flat, names).alias("diagnostic"),
    )


def snapshot_lite(dom: Dom) -> DataFrame:
    """Only the four element categories, title and url."""
    return snapshot(dom, LITE)


def snapshot_full(dom: Dom) -> DataFrame:
    """Everything, hidden elements included (they are never filtered, only marked)."""
    return snapshot(dom)


def snapshot_stats(snapshots: DataFrame) -> DataFrame:
    """Size of the serialised snapshot and number of frames."""
    whole = F.to_json(F.struct("url", "title", "elements", "content"))
    return snapshots.select(
        "page_id",
        F.octet_length(whole).cast("bigint").alias("size_bytes"),
        F.size("content.frames").cast("bigint").alias("frame_count"),
    )


def page_state(dom: Dom) -> DataFrame:
    """url, title and number of elements per category; pages without HTML get an error instead."""
    flat = extract_specific(dom, ["title", *ELEMENT_CATEGORIES])
    counts = [F.size(c).cast("bigint").alias(f"{c}_count") for c in ELEMENT_CATEGORIES]
    blank = dom.docs.select("page_id", "blank")
    return (
        flat.select("page_id", "url", "title", *counts)
        .join(blank, "page_id")
        .select(
            "page_id",
            "url",
            F.when(F.col("blank"), F.lit("Unknown")).otherwise(F.col("title")).alias("title"),
            *[F.when(~F.col("blank"), F.col(f"{c}_count")).alias(f"{c}_count") for c in ELEMENT_CATEGORIES],
            F.when(F.col("blank"), F.lit("Failed to extract page content")).alias("error"),
            F.col("blank").alias("is_navigating"),
        )
    )


def _body_children(nodes: DataFrame) -> DataFrame:
    """Number of elements directly under body. Without a body tag, everything but the head's content counts."""
    head_only = ["html", "head", "title", "meta", "link", "style", "script", "base", "body"]
    page = Window.partitionBy("page_id")
    body_pos = F.coalesce(F.min(F.when(F.col("tag") == "body", F.col("pos"))).over(page), F.lit(-1))
    before = page.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    below = nodes.select("page_id", "pos", "end", "tag", body_pos.alias("body_pos"))
    below = below.where("pos > body_pos").where(~F.col("tag").isin(head_only) | (F.col("body_pos") >= 0))
    covered = F.coalesce(F.max("end").over(before) > F.col("pos"), F.lit(False))
    return (
        below.select("page_id", covered.alias("covered"))
        .groupBy("page_id")
        .agg(F.count(F.when(~F.col("covered"), 1)).alias("body_children"))
    )


def empty_page_check(dom: Dom) -> DataFrame:
    """Pages without buttons, inputs or links, with the counts that help to see why."""
    flat = extract_specific(dom, ["title", "buttons", "inputs", "links", "frames"])
    sizes = F.size("buttons") + F.size("inputs") + F.size("links")
    bare = flat.where(sizes == 0).select("page_id", "url", "title", F.size("frames").cast("bigint").alias("iframe_count"))
    return bare.join(_body_children(dom.nodes), "page_id", "left").select(
        "page_id", "url", "title", "iframe_count", F.coalesce("body_children", F.lit(0)).cast("bigint").alias("body_children")
    )


# --- compact view ---------------------------------------------------------------------------------------------------


def _node_ref(name: Column) -> Column:
    """A reference to an element that can be found again."""
    return F.struct(
        F.concat(F.lit("n"), F.col("pos")).alias("ref_id"),
        extract.css_path().alias("selector"),
        F.lit("main").alias("frame_id"),
        F.coalesce(
            non_empty(F.try_element_at("attrs", F.lit("role"))),
            F.when(F.col("tag") == "a", F.lit("link")).otherwise(F.col("tag")),
        ).alias("role"),
        F.left(name, F.lit(extract.LINK_LIMIT)).alias("name"),
        F.col("target").alias("href"),
        (~F.col("hidden")).alias("visible"),
    )


def _top(rows: DataFrame, order: list, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
    return rows.select("*", rank.alias("rank")).where(F.col("rank") <= limit)


def _clickable(dom: Dom, anchors: bool = False) -> DataFrame:
    """Buttons and links with `name`, those without one left out. With `anchors`, every `a` element is there, and
    `clickable` tells which rows count."""
    test = simple(extract.BUTTONS) | simple(extract.LINKS)
    marked = context(dom.nodes).select("*", test.alias("clickable"))
    picked = with_attrs(with_text(marked.where(F.col("clickable") | (F.col("tag") == "a") if anchors else "clickable"), dom.docs))
    label = F.coalesce(
        non_empty(collapse_ws("text")),
        F.try_element_at("attrs", F.lit("value")),
        F.try_element_at("attrs", F.lit("aria-label")),
        F.lit(""),
    )
    named = worked_out(picked.select("page_id", "pos", "tag", "text", "hidden", "attrs", "target", "clickable", label.alias("name")))
    if anchors:
        return named.withColumn("clickable", F.col("clickable") & (F.col("name") != ""))
    return named.where("name <> ''")


def compact_controls(dom: Dom, limit: int = MAX_CONTROLS) -> DataFrame:
    """The first visible clickable elements of each page."""
    rows = _clickable(dom).where(~F.col("hidden")).select("page_id", "pos", _node_ref(F.col("name")).alias("control"))
    return _top(rows, ["pos"], limit).select("page_id", "pos", "rank", "control.*")


def compact_pagination(dom: Dom, limit: int = MAX_PAGINATION) -> DataFrame:
    """Likely page links: rel=next/prev before wording before page numbers."""
    rows = _clickable(dom).select("page_id", "pos", _pagination_kind().alias("kind"), _node_ref(F.col("name")).alias("control"))
    return _top(rows.where("kind is not null"), ["kind", "pos"], limit).select("page_id", "pos", "rank", "control.*")


def _pagination_kind() -> Column:
    word = F.lower("name")
    rel = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("rel")), F.lit("")))
    return (
        F.when(rel.rlike(r"\b(?:next|prev)\b"), 0)
        .when(word.rlike(r"^(?:next|previous|prev|older|newer|more|»|›|→|load more)\b|^[»›→]$"), 1)
        .when(word.rlike(r"^\d+$"), 2)
    )


def _link_blocks(dom: Dom) -> DataFrame:
    """Per page: the rows of `compact_controls` and `compact_pagination` as arrays, and the `link_chars` of `page_hints`,
    all from one pass over the nodes."""
    rows = _clickable(dom, anchors=True).select(
        "page_id", "pos", "clickable", "hidden", _pagination_kind().alias("kind"), _node_ref(F.col("name")).alias("control"),
        F.when(F.col("tag") == "a", F.length("text")).alias("chars"),
    )
    control, clickable = F.col("control"), F.col("clickable")
    return rows.groupBy("page_id").agg(
        F.slice(_sorted_items(control, clickable & ~F.col("hidden"), [F.col("pos")]), 1, MAX_CONTROLS).alias("controls"),
        F.slice(_sorted_items(control, clickable & F.col("kind").isNotNull(), [F.col("kind"), F.col("pos")]), 1, MAX_PAGINATION).alias("pagination"),
        F.sum("chars").alias("link_chars"),
    )


def compact_lists(dom: Dom, limit: int = MAX_LISTS) -> DataFrame:
    """The longest lists of each page with item count, a link selector if items hold links, and sample texts."""
    tag, dom = F.col("tag"), dom.having("ul", "ol")
    flagged = context(dom.nodes).where(tag.isin("ul", "ol", "li", "a"))
    flagged = flagged.select(*dom.nodes.columns, "in_nav")
    is_list = tag.isin("ul", "ol") & ~F.col("in_nav")
    parts = contained(flagged, {"item": (is_list, tag == "li"), "link": (is_list, tag == "a")}, outer=["raw"])
    parts = with_text(parts.drop("in_nav"), dom.docs)
    text = F.left(collapse_ws("text"), F.lit(extract.LINK_LIMIT))
    is_item = F.col("kind") == "item"
    item = F.struct("pos", text.alias("text"))
    lists = parts.groupBy("page_id", "outer_pos", F.col("outer.tag").alias("tag"), F.col("outer.raw").alias("raw")).agg(
        F.count(F.when(is_item, 1)).alias("item_count"),
        F.when(F.count(F.when(F.col("kind") == "link", 1)) > 0, F.lit("a")).alias("item_link_selector"),
        F.sort_array(F.collect_list(F.when(is_item & (text != ""), item))).alias("items"),
    )
    ranked = _top(lists.where("item_count > 1").withColumnRenamed("outer_pos", "pos"), [F.desc("item_count"), "pos"], limit)
    root = with_attrs(ranked)
    return root.select(
        "page_id",
        "pos",
        "rank",
        extract.css_path().alias("root"),
        "item_count",
        "item_link_selector",
        F.transform(F.slice("items", 1, MAX_SAMPLES), lambda i: i["text"]).alias("samples"),
    )


def compact_forms(dom: Dom, limit: int = MAX_FORMS, max_fields: int = MAX_FORM_FIELDS) -> DataFrame:
    rows = _top(extract.forms(dom), ["pos"], limit)
    return rows.select(
        "page_id", "pos", "rank", "id", "action", "method", F.slice("inputs", 1, max_fields).alias("fields"), "submit_text"
    )


def page_hints(dom: Dom) -> DataFrame:
    """Text per HTML character, and link text per text character."""
    links = with_text(dom.nodes.where("tag = 'a'"), dom.docs).groupBy("page_id").agg(
        F.sum(F.length("text")).alias("link_chars")
    )
    return _chars(dom).join(links, "page_id", "left").select("page_id", *_densities())


def _chars(dom: Dom) -> DataFrame:
    return dom.docs.select("page_id", F.col("html_length").alias("html_chars"), F.length(F.array_join("texts", "")).alias("chars"))


def _densities() -> list[Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0))), F.lit(0.0))
    return [ratio("chars", "html_chars").alias("text_density"), ratio("link_chars", "chars").alias("link_density")]


def form_blocks(dom: Dom, limit: int = MAX_FORMS, max_fields: int = MAX_FORM_FIELDS) -> DataFrame:
    """Forms as references that can be found again: the form, its labelled fields and its first submit control.

    Fields and labels are those of `extract.forms`; a form without submit control has a null `submit`.
    """
    kind, own = F.col("kind"), lambda key: non_empty(F.try_element_at("attrs", F.lit(key)))
    wording = F.coalesce(non_empty(trim_js("text")), own("value"), F.lit("Submit"))
    name = F.coalesce(own("aria-label"), F.when(kind == "submit", wording), own("placeholder"), own("name"), F.lit(""))
    top = _top(extract.forms(dom, _node_ref(name)), ["pos"], limit)
    fields = F.zip_with("input_refs", "inputs", lambda ref, i: F.struct(non_empty(i["label"]).alias("label"), ref.alias("input")))
    return top.select(
        "page_id", "pos", "rank", F.col("form_ref").alias("form"), F.slice(fields, 1, max_fields).alias("fields"), F.col("submit_ref").alias("submit")
    )


def _with_blocks(out: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Adds each part's rows as one array per page, in the order of their rank; empty where a page has none."""
    for name, rows in parts.items():
        fields = [c for c in rows.columns if c not in ("page_id", "pos", "rank")]
        grouped = rows.groupBy("page_id").agg(_sorted_items(F.struct(*fields), F.lit(True), [F.col("rank")]).alias(name))
        out = out.join(grouped, "page_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def _with_hints(out: DataFrame, dom: Dom) -> DataFrame:
    """Adds controls, pagination and the densities of `page_hints`; the arrays are empty where a page has none."""
    rows = out.join(_link_blocks(dom), "page_id", "left").join(_chars(dom), "page_id")
    filled = [F.coalesce(name, F.array()).alias(name) for name in ("controls", "pagination")]
    return rows.select(*out.columns, *filled, *_densities())


def compact_snapshot(dom: Dom) -> DataFrame:
    """url, title, headings, lists, controls, pagination, forms and hints, each within its cap."""
    out = extract_specific(dom, ["title", "headings"]).select(
        "page_id", "url", "title", F.transform("headings", lambda h: h["text"]).alias("headings")
    )
    rows = _with_hints(_with_blocks(out, {"lists": compact_lists(dom), "forms": compact_forms(dom)}), dom)
    return rows.select("page_id", "url", "title", "headings", *BLOCKS, F.struct("text_density", "link_density").alias("hints"))


def model_snapshot(dom: Dom) -> DataFrame:
    """page_id, compact, ref_map and stats: the compact view with references throughout, and where each leads.

    A reference is named after its element's place in the page, so an element that stands in several blocks has one
    reference. `ref_map` holds every reference of the view once, with the selector and frame to look in.
    """
    out = extract_specific(dom, ["title", "headings", "frames"]).select(
        "page_id", "url", "title", F.transform("headings", lambda h: h["text"]).alias("headings"), F.size("frames").cast("bigint").alias("frame_count")
    )
    root = F.struct(F.concat(F.lit("n"), F.col("pos")).alias("ref_id"), F.col("root").alias("selector"), F.lit("main").alias("frame_id"), F.lit("list").alias("role"))
    parts = {"lists": compact_lists(dom).withColumn("root", root), "forms": form_blocks(dom)}
    entry = lambda ref: F.struct(ref["ref_id"].alias("key"), F.struct(ref["selector"].alias("selector"), ref["frame_id"].alias("frame_id")).alias("value"))
    used = [
        F.transform("lists", lambda block: entry(block["root"])),
        F.transform("controls", entry),
        F.transform("pagination", entry),
        F.transform("forms", lambda block: entry(block["form"])),
        F.flatten(F.transform("forms", lambda block: F.transform(block["fields"], lambda field: entry(field["input"])))),
        F.transform(F.filter("forms", lambda block: block["submit"].isNotNull()), lambda block: entry(block["submit"])),
    ]
    compact = F.struct("url", "title", "headings", *BLOCKS, F.struct("text_density", "link_density").alias("hints"))
    rows = _with_hints(_with_blocks(out, parts), dom)
    rows = rows.select("page_id", compact.alias("compact"), F.map_from_entries(F.array_distinct(F.concat(*used))).alias("ref_map"), "frame_count")
    size = F.octet_length(F.to_json("compact")).cast("bigint")
    return rows.select("page_id", "compact", "ref_map", F.struct(size.alias("size_bytes"), "frame_count").alias("stats"))
