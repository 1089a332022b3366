"""Selectors that are data: which elements of a page a selector column means.

Supported: type, `*`, #id, .class, [a] with = ^= $= *= ~= |= and the i flag, :not(list of compounds), :has-text(...), lists,
and the combinators descendant, child (>), next sibling (+) and later sibling (~). Names may hold backslash escapes of
single characters. A selector that says anything else is reported as not supported, never half understood.

A selector is compiled by column expressions into alternatives, each a chain of compounds. Every compound looks its
candidates up by the rarest kind of part it has, so it meets only nodes that share that part. Chains are then joined
structurally, step by step: a descendant by the running maximum of ends of what matched the step before, a child by the
same among elements one level higher, a sibling among those of one parent. What is sorted are the candidates of one page
and selector; nodes are never compared with nodes, nor all nodes with all requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr_map, class_list
from webloom.functions.text import collapse_ws, contains_ci
from webloom.plans.nodes import Dom, with_family
from webloom.plans.scale import merged, skew_join

_NAME = r"(?:[\w\-\x{80}-\x{10FFFF}]++|\\[^0-9a-fA-F\s])++"
_TAG = r"[a-zA-Z][\w\-]*+|\*"
_VALUE = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^\]\s"']++"""
_ATTR = rf"\[\s*+{_NAME}\s*+(?:[\^$*~|]?=\s*+(?:{_VALUE})\s*+[iIsS]?\s*+)?\]"
_TEST = rf"#{_NAME}|\.{_NAME}|{_ATTR}"
_INNER = rf"(?=[^\s,)])(?:{_TAG})?(?:{_TEST})*+"
_NOT = rf":not\(\s*+{_INNER}(?:\s*+,\s*+{_INNER})*+\s*+\)"
_TEXT = r""":has-text\(\s*+(?:"[^"]*+"|'[^']*+'|[^"'()]++)\s*+\)"""
_PART = rf"{_TEST}|{_NOT}|{_TEXT}"
_COMPOUND = rf"(?=[^\s>+~,])(?:{_TAG})?(?:{_PART})*+"
_STEP = rf"\s*+[>+~]\s*+|\s++(?![,>+~])"
_CHAIN = rf"{_COMPOUND}(?:(?:{_STEP}){_COMPOUND})*"
_LIST = rf"^\s*+{_CHAIN}(?:\s*+,\s*+{_CHAIN})*\s*+$"


def supported_selector(selector) -> Column:
    column = F.col(selector) if isinstance(selector, str) else selector
    return column.rlike(_LIST)


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(1 if group == 0 else group))


def _plain(name: Column) -> Column:
    return F.regexp_replace(name, r"\\(.)", "$1")


def _test(p: Column) -> Column:
    """One test as a struct: attribute name, operator, value, and whether case matters not."""
    inner = rf"""^\[\s*+({_NAME})\s*+(?:([\^$*~|]?=)\s*+({_VALUE})\s*+([iIsS])?\s*+)?\]$"""
    group = lambda i: F.regexp_extract(p, inner, i)
    kind = F.when(p.startswith("#"), F.lit("id")).when(p.startswith("."), F.lit("class"))
    rest = F.substring(p, F.lit(2), F.length(p))
    value = F.regexp_replace(group(3), r"""^["']|["']$""", "")
    return F.struct(
        F.coalesce(kind, F.lower(_plain(group(1)))).alias("name"),
        F.when(p.startswith("#"), F.lit("=")).when(p.startswith("."), F.lit("~=")).otherwise(group(2)).alias("op"),
        _plain(F.when(kind.isNotNull(), rest).otherwise(value)).alias("value"),
        (F.lower(group(4)) == "i").alias("ci"),
    )


def _simple(compound: Column) -> list[Column]:
    """Tag and tests of a compound without pseudo-classes."""
    tag = F.lower(F.regexp_extract(compound, rf"^({_TAG})", 1))
    rest = F.substring(compound, F.length(tag) + 1, F.length(compound))
    return [tag.alias("tag"), F.transform(_all(rest, _TEST), _test).alias("parts")]


def _compiled(compound: Column) -> Column:
    """A compound as a struct: tag, parts, what it must not be, and texts it must hold."""
    tag = F.regexp_extract(compound, rf"^({_TAG})", 1)
    rest = F.substring(compound, F.length(tag) + 1, F.length(compound))
    parts = _all(rest, _PART)
    tests = F.filter(parts, lambda p: ~p.startswith(":"))
    nots = F.filter(parts, lambda p: p.startswith(":not"))
    inner = F.flatten(F.transform(nots, lambda p: _all(F.regexp_replace(p, r"^:not\(\s*+|\s*+\)$", ""), _INNER)))
    texts = F.filter(parts, lambda p: p.startswith(":has-text"))
    bare = F.transform(texts, lambda p: collapse_ws(F.regexp_replace(p, r"""^:has-text\(\s*+["']?|["']?\s*+\)$""", "")))
    return F.struct(
        F.lower(tag).alias("tag"),
        F.transform(tests, _test).alias("parts"),
        F.transform(F.filter(inner, lambda c: c != ""), lambda c: F.struct(*_simple(c))).alias("nots"),
        bare.alias("texts"),
    )


_LINKS = rf"({_STEP}|^)({_COMPOUND})"


def _chains(asked: DataFrame) -> DataFrame:
    """asked(page_id, selector) with one row per alternative: alt and chain."""
    chains = F.posexplode(_all(F.trim(F.col("selector")), _CHAIN)).alias("alt", "chain")
    return asked.where(supported_selector("selector")).select("page_id", "selector", chains)


def compiled(asked: DataFrame) -> DataFrame:
    """asked(page_id, selector) as one row per alternative and step: alt, step, last, link (how it hangs on the step
    before: '', '>', '+', '~') and compound. Selectors that are not supported have no row."""
    chain = F.col("chain")
    steps = F.zip_with(_all(chain, _LINKS, 1), _all(chain, _LINKS, 2), lambda link, c: F.struct(F.trim(link).alias("link"), c.alias("c")))
    rows = _chains(asked).select("page_id", "selector", "alt", F.posexplode(steps).alias("step", "s"), (F.size(steps) - 1).alias("last"))
    return rows.select("page_id", "selector", "alt", "step", "last", "s.link", _compiled(F.col("s.c")).alias("compound"))


def _holds(part: Column, attrs: Column) -> Column:
    """Does a node with these attributes pass one test?"""
    have = F.try_element_at(attrs, part["name"])
    have = F.when(part["ci"], F.lower(have)).otherwise(have)
    want = F.when(part["ci"], F.lower(part["value"])).otherwise(part["value"])
    some = want != ""
    return F.coalesce(
        F.when(part["op"] == "", have.isNotNull())
        .when(part["op"] == "=", have == want)
        .when(part["op"] == "~=", F.array_contains(class_list(have), want))
        .when(part["op"] == "|=", (have == want) | F.startswith(have, F.concat(want, F.lit("-"))))
        .when(part["op"] == "^=", some & F.startswith(have, want))
        .when(part["op"] == "$=", some & F.endswith(have, want))
        .when(part["op"] == "*=", some & F.contains(have, want)),
        F.lit(False),
    )


def _passes(tests: Column, tag: Column, attrs: Column) -> Column:
    return (tests["tag"].isin("", "*") | (tests["tag"] == tag)) & F.forall(tests["parts"], lambda p: _holds(p, attrs))


def _features(nodes: DataFrame) -> DataFrame:
    """What a compound can be looked up by: one row per node and tag, class, attribute, and attribute value."""
    kept = [c for c in nodes.columns if c != "raw"]
    mapped = nodes.select(*kept, attr_map().alias("attrs"))
    entries = F.map_entries("attrs")
    keys = F.concat(
        F.array(F.col("tag"), F.lit("*")),
        F.transform(entries, lambda e: F.concat(F.lit("["), e["key"], F.lit("]"))),
        F.transform(entries, lambda e: F.concat(F.lit("["), e["key"], F.lit("="), e["value"], F.lit("]"))),
        F.transform(class_list(F.try_element_at("attrs", F.lit("class"))), lambda c: F.concat(F.lit("."), c)),
    )
    return mapped.select(*kept, "attrs", F.explode(F.array_distinct(keys)).alias("feature"))


def _feature(compound: Column) -> Column:
    """The rarest kind of part that a compound has."""

    def key_of(test, text) -> Column:
        found = F.get(F.filter(compound["parts"], lambda p: test(p) & ~p["ci"]), F.lit(0))
        return F.when(found.isNotNull(), text(found))

    exact = key_of(lambda p: p["op"] == "=", lambda p: F.concat(F.lit("["), p["name"], F.lit("="), p["value"], F.lit("]")))
    named = key_of(lambda p: (p["op"] == "~=") & (p["name"] == "class"), lambda p: F.concat(F.lit("."), p["value"]))
    first = F.get(compound["parts"], F.lit(0))
    present = F.when(first.isNotNull(), F.concat(F.lit("["), first["name"], F.lit("]")))
    return F.coalesce(exact, named, present, F.nullif(compound["tag"], F.lit("")), F.lit("*"))


_KEY = ["page_id", "selector", "alt"]


def _linked(rows: DataFrame, step: int, child: bool, sibling: bool) -> DataFrame:
    """Settle `ok` for the candidates of a step: does each hang on a row that was ok in the step before?

    All steps are rows of one table, in the same partitions and mostly the same order, so a step costs no shuffle.
    """
    here, mark = F.col("step") == step, (F.col("step") == step - 1) & F.col("ok")
    link, pos = F.col("link"), F.col("pos")

    def before(*keys) -> Window:
        # Of rows with equal pos the later step comes first: an element hangs on no row of its own.
        return Window.partitionBy(*_KEY, *keys).orderBy("pos", F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)

    end = F.when(mark, F.col("end"))
    fits = F.when(link == "", F.max(end).over(before()) > pos)
    if child:
        # Of the elements around one, the parent is the one that is a level higher.
        level = F.when(here, F.col("depth") - 1).otherwise(F.col("depth"))
        rows = rows.withColumn("_level", level)
        fits = fits.when(link == ">", F.max(end).over(before("_level")) > pos)
    if sibling:
        latest = F.max(F.when(mark, pos)).over(before("parent"))
        fits = fits.when(link == "+", latest == F.col("previous")).when(link == "~", latest.isNotNull())
    return rows.withColumn("ok", F.when(here, F.coalesce(fits, F.lit(False))).otherwise(F.col("ok"))).drop("_level")


def matches(wanted: DataFrame, dom: Dom, hot: DataFrame | None = None) -> DataFrame:
    """For `wanted(page_id, selector)`: page_id, selector and pos of every element that a selector means, once each.

    How many steps the longest chain has, and whether any looks at parents, siblings or texts, is read off the requests
    first: plans for plain selectors stay small. `hot` are pages with very many requests (see `hot_keys`).
    """
    asked = wanted.where("selector is not null").select("page_id", "selector").distinct()
    links = _all(F.col("chain"), _LINKS, 1)
    has = lambda *signs: F.max(F.exists("links", lambda x: F.trim(x).isin(*signs)))
    shapes = _chains(asked.select("selector").distinct().withColumn("page_id", F.lit(0))).select(links.alias("links"), F.contains("selector", F.lit(":has-text")).alias("worded"))
    longest, child, sibling, worded = shapes.agg(F.max(F.size("links")), has(">"), has("+", "~"), F.max("worded")).first()

    nodes = dom.nodes.join(merged(asked.select("page_id").distinct()), "page_id", "left_semi")
    nodes = with_family(nodes) if child or sibling else nodes
    keyed = compiled(asked).withColumn("feature", _feature(F.col("compound")))
    found = skew_join(keyed, _features(nodes), "page_id", "selector", hot, also=["feature"])
    compound, tag, attrs = F.col("compound"), F.col("tag"), F.col("attrs")
    hits = found.where(_passes(compound, tag, attrs) & ~F.exists(compound["nots"], lambda n: _passes(n, tag, attrs)))
    if worded:
        hits = hits.join(merged(dom.docs.select("page_id", "texts")), "page_id")
        text = collapse_ws(F.array_join(F.slice("texts", F.col("pos") + 1, F.col("end") - F.col("pos")), ""))
        said = F.forall("compound.texts", lambda t: contains_ci(text, t))
        hits = hits.where(F.when(F.size("compound.texts") == 0, True).otherwise(said))
    family = ["depth", "parent", "previous"] if child or sibling else []
    rows = hits.select(*_KEY, "step", "last", "link", "pos", "end", *family, (F.col("step") == 0).alias("ok"))
    for step in range(1, longest or 0):
        rows = _linked(rows, step, child, sibling)
    # Alternatives may mean the same element.
    return rows.where("ok and step = last").select("page_id", "selector", "pos").distinct()


def select_nodes(wanted: DataFrame, dom: Dom, hot: DataFrame | None = None) -> DataFrame:
    """For `wanted(page_id, selector)`: first_pos and match_count of each distinct selector, and whether it is supported."""
    asked = wanted.where("selector is not null").select("page_id", "selector").distinct()
    counted = matches(asked, dom, hot).groupBy("page_id", "selector").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("match_count")
    )
    return asked.join(merged(counted), ["page_id", "selector"], "left").select(
        "page_id",
        "selector",
        "first_pos",
        F.coalesce("match_count", F.lit(0)).alias("match_count"),
        supported_selector("selector").alias("supported"),
    )
