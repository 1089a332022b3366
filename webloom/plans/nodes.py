"""The node table: one row per element of a page, derived with built-in expressions.

`pages(page_id, url, html)` is hash-partitioned by `page_id` once, before the HTML is cut up. Every
later window, aggregate and join is keyed by `page_id`, so it reuses that partitioning: turning a page
into nodes costs one exchange of the cleaned page, never one of the tokens. `page_id` must be unique.

Positions count tags: row `pos` is the page's tag number `pos` and owns the run of text that follows it.
An element covers the runs `pos .. end - 1`, so its text is a slice of the page's array of runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr, has_attr
from webloom.functions.text import SEAM, built_once, decode_runs, trim_js
from webloom.functions.url import resolve_url
from webloom.plans.scale import merged

_IN_TAG = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_TAG = rf"<(?:/?[a-zA-Z]{_IN_TAG}|[!?/][^>]*+)>"
_TOKEN = rf"({_TAG})((?:[^<]++|<(?!{_TAG[1:]}))*+)"
# Comments and the seam character go; script, style and noscript keep their tags and lose their body.
_DROPPED = rf"(?is)\x01|<!--.*?(?:-->|\z)|(<(script|style|noscript)\b{_IN_TAG}>).*?(</\2\s*+>|\z)"

# Element names from the HTML standard.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
SVG_LEAF_TAGS = ["path", "circle", "ellipse", "line", "polygon", "polyline", "rect", "stop", "use", "image"]
# Start tags that end an open paragraph.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
]
# Families whose members may leave out their end tag. A member is ended by the next tag of its
# family, in the same container, whose rank is at most its own. Containers rank 0 and count when they close.
FAMILIES = {
    "list": {"ul": 0, "ol": 0, "menu": 0, "li": 1},
    "table": {"table": 0, "thead": 1, "tbody": 1, "tfoot": 1, "tr": 2, "td": 3, "th": 3},
    "dl": {"dl": 0, "dt": 1, "dd": 1},
    "select": {"select": 0, "optgroup": 1, "option": 2},
}

# A tag weighs this much besides its text, and the pages of one partition this much together.
TAG_BYTES, PARTITION_BYTES = 100, 16 << 20


def clean_html(html) -> Column:
    """HTML without comments and script bodies, led by an empty declaration that owns any leading text."""
    return F.concat(F.lit("<!>"), F.regexp_replace(html, _DROPPED, "$1$3"))


def _family(tag: Column) -> Column:
    out = None
    for name, ranks in FAMILIES.items():
        hit = tag.isin(list(ranks))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def _rank(tag: Column) -> Column:
    out = None
    for rank in range(4):
        tags = [t for ranks in FAMILIES.values() for t, r in ranks.items() if r == rank]
        out = F.when(tag.isin(tags), rank) if out is None else out.when(tag.isin(tags), rank)
    return out


@dataclass(frozen=True)
class Dom:
    """Nodes of a set of pages together with the page-level rows that hold their text.

    nodes: page_id, pos, end, tag, raw
    docs:  page_id, url, base (what its links are relative to), html_length, blank, texts (decoded run per tag), tokens
           (raw tag and run)
    """

    nodes: DataFrame
    docs: DataFrame
    #: page_id and cleaned HTML as they come out of the exchange, where this was parsed rather than loaded.
    bodies: DataFrame | None = None

    def having(self, *tags: str) -> Dom:
        """For work that begins with elements of some tags: pages whose HTML mentions none of them have no nodes here,
        and are not cut up either. The exchange is the one that all work on the pages shares."""
        if self.bodies is None:
            return self
        return Dom(_with_ends(_tokens(self.bodies, rf"(?i)<(?:{'|'.join(tags)})[\s/>]")), self.docs, self.bodies)

    def save(self, path: str) -> None:
        """Write both tables, so that many later jobs skip the parsing."""
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")

    @staticmethod
    def load(spark, path: str) -> Dom:
        """Read saved tables back, partitioned by page again (one exchange each)."""
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes, docs = (spark.read.parquet(f"{path}/{name}").repartition(partitions, "page_id") for name in ("nodes", "docs"))
        return Dom(nodes, docs)

    def save_tables(self, name: str, buckets: int) -> None:
        """Write both as catalog tables bucketed by page: reading them back needs no exchange at all."""
        for part, rows in (("nodes", self.nodes), ("docs", self.docs)):
            writer = rows.write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id")
            writer.saveAsTable(f"{name}_{part}")

    @staticmethod
    def from_tables(spark, name: str) -> Dom:
        return Dom(spark.table(f"{name}_nodes"), spark.table(f"{name}_docs"))


def partitions_for(pages: DataFrame) -> int:
    """Into how many partitions to deal pages: a task sorts all tags of its pages several times, so what it holds is
    bounded by their number and by their text, whatever the size of the table. One job over the pages weighs them."""
    html = F.col("html")
    tags = F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))
    weight = pages.agg(F.sum((F.octet_length(html) + TAG_BYTES * tags).cast("bigint"))).first()[0] or 0
    return max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-weight // PARTITION_BYTES))


def parse(pages: DataFrame, partitions: int | None = None) -> Dom:
    """Nodes and text runs of `pages(page_id, url, html)`.

    `partitions` defaults to what the pages weigh, spark.sql.shuffle.partitions at least (see `partitions_for`). It is
    given to Spark as a number because the sizes that adaptive execution sees are those of the HTML, while the work is
    that of its many more tokens: merging small partitions here would idle cores.
    """
    partitions = partitions or partitions_for(pages)
    # URL, HTML and two facts about it travel as one string: nodes and docs then need the very same exchange, which
    # Spark reuses, and the stored HTML is read once.
    html = F.coalesce("html", F.lit(""))
    head = [
        F.replace(F.coalesce("url", F.lit("")), F.lit(SEAM), F.lit("")),
        F.length(html).cast("string"),
        F.when(trim_js(html) == "", F.lit("blank")).otherwise(F.lit("")),
    ]
    envelope = F.concat_ws(SEAM, *head, clean_html(html))
    packed = pages.where("page_id is not null").select("page_id", envelope.alias("packed"))
    packed = packed.repartition(partitions, "page_id")
    field = lambda n: F.substring_index(F.substring_index("packed", SEAM, n), SEAM, -1)
    body = F.substring("packed", F.length(F.substring_index("packed", SEAM, 3)) + 2, F.length("packed"))
    docs = packed.select(
        "page_id",
        field(1).alias("url"),
        field(2).cast("int").alias("html_length"),
        (field(3) == "blank").alias("blank"),
        F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(2)).alias("runs"),
        F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0)).alias("tokens"),
        body.rlike(r"(?i)<base[\s/]").alias("has_base"),
    )
    # The first base element with a target; few pages have one.
    bases = F.filter("tokens", lambda t: t.rlike(r"(?is)^<base[\s/][^>]*?\bhref\s*="))
    docs = docs.withColumn("base_raw", F.when(F.col("has_base"), F.get(bases, F.lit(0))))
    base = F.when(F.col("base_raw").isNull(), F.col("url")).otherwise(F.coalesce(resolve_url(attr("href", "base_raw"), "url"), F.col("url")))
    docs = docs.select("page_id", "url", base.alias("base"), "html_length", "blank", decode_runs("runs").alias("texts"), "tokens")
    bodies = packed.select("page_id", body.alias("body"))
    return Dom(_with_ends(_tokens(bodies)), docs, bodies)


def _tokens(bodies: DataFrame, mentioned: str | None = None) -> DataFrame:
    """One row per start or end tag, of the pages that match `mentioned`; step is 1, -1, or 0 for tags that never hold
    content."""
    tags = F.regexp_extract_all("body", F.lit(_TOKEN), F.lit(1))
    if mentioned:
        # Not a filter: that would move below the exchange, which could then not be shared.
        tags = F.when(F.col("body").rlike(mentioned), tags).otherwise(F.array().cast("array<string>"))
    # The outer form of explode: the plain one adds a filter that would run the pattern a second time.
    rows = bodies.select("page_id", tags.alias("tags")).select(
        "page_id", F.size("tags").alias("page_end"), F.posexplode_outer("tags").alias("pos", "raw")
    )
    named = rows.where(F.col("raw").rlike("^</?+[a-zA-Z]")).select(
        "*", F.lower(F.regexp_extract("raw", r"^</?+([a-zA-Z][^\s/>]*+)", 1)).alias("tag")
    )
    leaf = F.col("tag").isin(VOID_TAGS) | (F.col("tag").isin(SVG_LEAF_TAGS) & F.endswith("raw", F.lit("/>")))
    return named.select("*", F.when(leaf, 0).when(F.startswith("raw", F.lit("</")), -1).otherwise(1).alias("step"))


def _with_ends(tokens: DataFrame) -> DataFrame:
    """Start tags with `end`: their own end tag, an implied end, or the end of what encloses them."""
    base = ["page_id", "page_end", "pos", "raw", "tag", "step"]

    # Nesting level per tag name, so a forgotten </b> cannot shift the levels of <nav>. Start and end tag of an
    # element get the same level, and within (tag, level) they alternate.
    by_tag = Window.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    leveled = tokens.select(*base, (F.sum("step").over(by_tag) + F.when(F.col("step") < 0, 1).otherwise(0)).alias("level"))
    by_level = Window.partitionBy("page_id", "tag", "level").orderBy("pos")
    paired = leveled.select(
        *base,
        F.when(F.col("step") > 0, F.lead("pos").over(by_level)).alias("own_end"),
        ((F.col("step") < 0) & (F.coalesce(F.lag("step").over(by_level), F.lit(0)) > 0)).alias("closes"),
        _family(F.col("tag")).alias("family"),
        _rank(F.col("tag")).alias("rank"),
    )

    # Depth among paired tags, container level of each family, and the next tag that ends a paragraph.
    running = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    move = F.when(F.col("own_end").isNotNull(), 1).when(F.col("closes"), -1).otherwise(0)
    depth = F.sum(move).over(running) + F.when(F.col("closes"), 1).otherwise(0)
    closing = F.when(F.col("step") < 0, 1).otherwise(0)
    scope = None
    for family in FAMILIES:
        mine = F.col("family") == family
        open_now = F.sum(F.when(mine & (F.col("rank") == 0), F.col("step")).otherwise(0)).over(running)
        level = open_now + F.when(F.col("rank") == 0, closing).otherwise(0)
        scope = F.when(mine, level) if scope is None else scope.when(mine, level)
    block = (F.col("step") >= 0) & F.col("tag").isin(BLOCK_TAGS)
    placed = paired.withColumn("block_pos", F.when(block, F.col("pos"))).select(
        *base,
        "own_end",
        "closes",
        "family",
        "rank",
        depth.alias("depth"),
        scope.alias("scope"),
        F.expr("lead(block_pos) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)").alias("next_block"),
    )

    # Within one container of a family: the next tag that ends a member of rank r.
    ends_member = F.col("family").isNotNull() & ((F.col("rank") > 0) | (F.col("step") < 0))
    member_end = None
    for rank in (1, 2, 3):
        placed = placed.withColumn(f"end_{rank}", F.when(ends_member & (F.col("rank") <= rank), F.col("pos")))
        follows = F.expr(f"lead(end_{rank}) IGNORE NULLS OVER (PARTITION BY page_id, family, scope ORDER BY pos)")
        mine = F.col("rank") == rank
        member_end = F.when(mine, follows) if member_end is None else member_end.when(mine, follows)
    implied = F.when(F.col("tag") == "p", F.col("next_block")).otherwise(member_end)
    ended = placed.select(
        *base, "closes", "depth", F.least("own_end", F.when(F.col("step") > 0, implied)).alias("known_end"), "own_end"
    ).withColumn("close_pos", F.when(F.col("closes"), F.col("pos")))

    # What has no end tag of its own cannot outlast the element around it.
    outer_end = F.expr("lead(close_pos) IGNORE NULLS OVER (PARTITION BY page_id, depth ORDER BY pos)")
    end = (
        F.when(F.col("step") == 0, F.col("pos"))
        .when(F.col("own_end").isNotNull(), F.col("known_end"))
        .otherwise(F.least("known_end", F.coalesce(outer_end, F.col("page_end"))))
    )
    return ended.select("page_id", "pos", end.alias("end"), "tag", "raw").where(~F.startswith("raw", F.lit("</")))


def with_text(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the page's `url` and `base` and each element's textContent as `text`."""
    runs = docs.select("page_id", F.col("url").alias("_url"), F.col("base").alias("_base"), F.col("texts").alias("_texts"))
    text = F.array_join(F.slice("_texts", F.col("pos") + 1, F.col("end") - F.col("pos")), "")
    return elements.join(merged(runs), "page_id").select(*elements.columns, F.col("_url").alias("url"), F.col("_base").alias("base"), text.alias("text"))


def with_html(elements: DataFrame, docs: DataFrame) -> DataFrame:
    """Add each element's inner HTML as `html`."""
    tokens = docs.select("page_id", F.col("tokens").alias("_tokens"))
    own = F.substring(F.get("_tokens", F.col("pos")), F.length("raw") + 1, F.length(F.get("_tokens", F.col("pos"))))
    rest = F.array_join(F.slice("_tokens", F.col("pos") + 2, F.greatest(F.col("end") - F.col("pos") - 1, F.lit(0))), "")
    html = F.when(F.col("end") > F.col("pos"), F.concat(own, rest)).otherwise("")
    return elements.join(merged(tokens), "page_id").select(*elements.columns, html.alias("html"))


def with_ancestors(nodes: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Add one boolean per test: does the element or one of its ancestors pass it (`closest`)?

    An ancestor is an earlier element that is still open here, so a running maximum of ends decides it.
    """
    running = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    flags = []
    for name, test in tests.items():
        here = F.coalesce(test, F.lit(False))
        reach = F.max(F.when(here, F.col("end"))).over(running)
        flags.append((here | F.coalesce(reach > F.col("pos"), F.lit(False))).alias(name))
    return nodes.select(*nodes.columns, *flags)


def with_family(nodes: DataFrame) -> DataFrame:
    """Add `depth` (how many elements are open where each one starts), `parent` and `previous`: the positions of the
    innermost element around it and of the sibling before it.

    The parent is the latest element of one depth less, if that is still open; where tags are misnested there may be
    none. Sorts within the page, no pairs.
    """
    columns = nodes.columns
    spans = F.col("end") > F.col("pos")
    event = lambda at, step, own: F.struct(F.col(at).alias("at"), F.lit(step).alias("step"), F.lit(own).alias("own"))
    opened = F.array(event("end", -1, False), event("pos", 1, True))
    events = nodes.select("*", F.explode(F.when(spans, opened).otherwise(F.array(event("pos", 0, True)))).alias("e"))
    # What ends here is closed before the next element starts.
    running = Window.partitionBy("page_id").orderBy("e.at", "e.own", "pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = events.select("*", F.coalesce(F.sum("e.step").over(running), F.lit(0)).alias("_depth")).where("e.own").drop("e")
    # Every element stands at its own depth to be found, and one depth above to find its parent.
    role = lambda depth, asks: F.struct(depth.alias("depth"), F.lit(asks).alias("asks"))
    roles = F.array(role(F.col("_depth"), False), role(F.col("_depth") - 1, True))
    both = placed.withColumn("_role", F.explode(roles))
    above = Window.partitionBy("page_id", "_role.depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(~F.col("_role.asks"), F.struct("pos", "end")), True).over(above)
    found = both.select(*columns, F.col("_depth").cast("int").alias("depth"), "_role", latest.alias("_outer")).where("_role.asks")
    parent = F.when(F.col("_outer.end") > F.col("pos"), F.col("_outer.pos"))
    siblings = Window.partitionBy("page_id", "parent").orderBy("pos")
    return found.select(*columns, "depth", parent.alias("parent")).select("*", F.lag("pos").over(siblings).alias("previous"))


@built_once
def is_hidden() -> Column:
    """Hidden by its own markup: the attribute, or inline display/visibility. No layout is computed."""
    style = F.lower(F.coalesce(attr("style"), F.lit("")))
    by_style = style.rlike(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
    low = F.lower("raw")
    return F.when(F.contains(low, F.lit("hidden")) | F.contains(low, F.lit("none")), has_attr("hidden") | by_style).otherwise(False)


def has_attributes() -> Column:
    """Cheap test that spares bare tags the attribute patterns."""
    return F.length("raw") > F.length("tag") + 2


def contained(
    nodes: DataFrame,
    pairs: dict[str, tuple[Column, Column]],
    outer: list[str] | None = None,
    alone: dict[str, Column] | None = None,
) -> DataFrame:
    """Containment join. Each named pair holds a test for outer and one for inner elements; the result has one row
    per inner element and each outer element it lies in: `kind` (the pair's name), `outer_pos`, `outer` (a struct
    of the outer element's tag and the columns asked for) and the inner element's columns. `alone` adds one row per
    element that passes, as its own outer element.

    Elements of one tag nest properly, so an inner element at depth d lies in the latest outer element of each depth
    1..d. Looking those up costs sorts within the page and yields only results; comparing positions instead would
    test every outer against every inner element of the page.
    """
    columns = [c for c in nodes.columns if c != "page_id"]
    payload = F.struct(*["tag", *(outer or [])])
    no_payload = F.lit(None)
    spans = F.col("end") > F.col("pos")

    def probe(kind: str, tags: str) -> Column:
        return F.transform(tags, lambda tag: event(kind, tag, "pos", 1, 0, no_payload, True))

    def event(kind: str, outer_tag: Column, at: str, order: int, step: int, outer: Column, inner: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            outer_tag.alias("outer_tag"),
            F.col(at).alias("at"),
            F.lit(order).alias("order"),
            F.lit(step).alias("step"),
            outer.alias("outer"),
            *[(F.col(c) if inner else F.lit(None)).alias(f"_{c}") for c in columns],
        )

    # Tests become columns first: they are needed several times each.
    tests = {}
    for n, (kind, (is_outer, is_inner)) in enumerate(pairs.items()):
        tests[f"_outer{n}"] = F.coalesce(is_outer & spans, F.lit(False))
        tests[f"_inner{n}"] = F.coalesce(is_inner, F.lit(False))
    for n, test in enumerate((alone or {}).values()):
        tests[f"_alone{n}"] = F.coalesce(test, F.lit(False))
    keep = None
    for name in tests:
        keep = F.col(name) if keep is None else keep | F.col(name)
    page = Window.partitionBy("page_id")
    outer_tags = [
        F.collect_set(F.when(F.col(f"_outer{n}"), F.col("tag"))).over(page).alias(f"_tags{n}") for n in range(len(pairs))
    ]
    marked = nodes.select("*", *[test.alias(name) for name, test in tests.items()]).where(keep)
    marked = marked.select("*", *outer_tags)

    events = []
    for n, kind in enumerate(pairs):
        tag = F.col("tag")
        events.append(
            F.when(
                F.col(f"_outer{n}"),
                F.array(
                    event(kind, tag, "pos", 2, 1, payload, False), event(kind, tag, "end", 0, -1, no_payload, False)
                ),
            )
        )
        events.append(F.when(F.col(f"_inner{n}"), probe(kind, f"_tags{n}")))
    for n, kind in enumerate(alone or {}):
        events.append(F.when(F.col(f"_alone{n}"), F.array(event(kind, F.col("tag"), "pos", 3, 0, payload, True))))
    flat = marked.select("page_id", F.explode_outer(F.flatten(F.array_compact(F.array(*events)))).alias("e"))
    flat = flat.where("e is not null").select("page_id", "e.*")

    by_tag = Window.partitionBy("page_id", "kind", "outer_tag").orderBy("at", "order")
    depth = F.sum("step").over(by_tag.rowsBetween(Window.unboundedPreceding, 0))
    leveled = flat.select("*", depth.alias("depth")).where("step >= 0 and (depth > 0 or order = 3)")
    levels = F.when((F.col("step") == 0) & (F.col("order") == 1), F.sequence(F.lit(1), F.col("depth").cast("int"))).otherwise(
        F.array(F.col("depth").cast("int"))
    )
    spread = leveled.select("*", F.explode_outer(levels).alias("level"))
    by_level = Window.partitionBy("page_id", "kind", "outer_tag", "level").orderBy("at", "order")
    found = F.struct(F.col("at").alias("pos"), F.col("outer").alias("row"))
    latest = F.last(F.when(F.col("order") >= 2, found), True).over(
        by_level.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        spread.select("page_id", "kind", "step", latest.alias("found"), *[f"_{c}" for c in columns])
        .where("step = 0")
        .select(
            "page_id",
            "kind",
            F.col("found.pos").alias("outer_pos"),
            F.col("found.row").alias("outer"),
            *[F.col(f"_{c}").alias(c) for c in columns],
        )
    )
