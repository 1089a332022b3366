"""Links as a graph over stored pages: discovery, crawl depth and pagination."""

from __future__ import annotations

import itertools
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.css import match
from webloom.functions.text import trim_js
from webloom.functions.url import hostname, pathname, resolve_url
from webloom.operators.extract import context, link_score, with_attrs
from webloom.plans.nodes import Dom, with_text
from webloom.plans.scale import cut, first_rows, worked_out

DEFAULT_LINKS = [{"selector": "a[href]", "attribute": "href", "follow": True}]


def without_fragment(url) -> Column:
    """The URL that identifies a page: its fragment does not matter."""
    return F.regexp_replace(url, "#.*$", "")


def link_rows(dom: Dom, spec: dict[str, Any] | None = None) -> DataFrame:
    """Every link a spec's link selectors find: page_id, page_url, pos, url, text, follow, priority."""
    spec = spec or {}
    links = (spec.get("selectors") or {}).get("links") or DEFAULT_LINKS
    names = {f"_l{i}": link["selector"] for i, link in enumerate(links)}
    flagged = match(context(dom.nodes), names).where(" or ".join(names))
    rows = with_attrs(with_text(flagged, dom.docs))
    found = [
        F.when(
            F.col(name),
            F.struct(
                resolve_url(F.try_element_at("attrs", F.lit(link["attribute"].lower())), "base").alias("url"),
                F.lit(link.get("filter")).cast("string").alias("filter"),
                F.lit(bool(link.get("follow", False))).alias("follow"),
            ),
        )
        for name, link in zip(names, links, strict=True)
    ]
    spread = rows.select(
        "page_id",
        F.col("url").alias("page_url"),
        "pos",
        trim_js("text").alias("text"),
        link_score().alias("priority"),
        # The outer form of explode: the plain one adds a filter that would resolve every link a second time.
        F.explode_outer(F.array_compact(F.array(*found))).alias("link"),
    ).select("page_id", "page_url", "pos", "link.url", "text", "link.follow", "priority", "link.filter")
    passes = F.col("filter").isNull() | F.rlike("url", F.col("filter"))
    return spread.where(passes & F.col("url").rlike("(?i)^https?://")).drop("filter")


def allowed(links: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Links within the allowed domains and outside the excluded paths."""
    navigation = spec.get("navigation") or {}
    domains = [d.lower() for d in navigation.get("allowedDomains") or []]
    if domains:
        links = links.where(hostname("url").isin(domains))
    for path in navigation.get("excludedPaths") or []:
        links = links.where(~F.startswith(pathname("url"), F.lit(path)))
    return links


def discover_links(dom: Dom, spec: dict[str, Any] | None = None, visited: DataFrame | None = None) -> DataFrame:
    """The frontier: each new URL once, with its best priority and the text of its first link."""
    spec = spec or {}
    links = allowed(link_rows(dom, spec), spec).withColumn("url", without_fragment("url"))
    frontier = links.groupBy("url").agg(
        F.min_by("text", F.struct("page_id", "pos")).alias("text"),
        F.max("follow").alias("follow"),
        F.max("priority").alias("priority"),
    )
    if visited is not None:
        frontier = frontier.join(visited.select(without_fragment("url").alias("url")), "url", "left_anti")
    return frontier


def crawl(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Breadth-first depth of URLs over `edges(source, target)` from `seeds(url)`: up to `max_depth`, or until nothing
    new is reached. Depth 0 is the seeds alone.

    Each round joins only the newest URLs with the edges and writes its result down, so the plan does not grow with
    depth and a lost executor costs one round.
    """
    edges = cut(edges.select("source", "target").where("source <> target").distinct())
    reached = cut(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    newest = reached
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        targets = edges.join(newest.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url"))
        newest = cut(targets.distinct().join(reached, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
    return reached


def crawl_pages(pages: DataFrame, dom: Dom, seeds: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Depth of stored pages reached from the seeds along the links a spec follows."""
    links = allowed(link_rows(dom, spec), spec)
    navigation = spec.get("navigation") or {}
    if navigation.get("followLinks") is False:
        links = links.where(F.lit(False))
    stored = pages.select("page_id", without_fragment("url").alias("url"))
    edges = links.where("follow").select(
        without_fragment("page_url").alias("source"), without_fragment("url").alias("target")
    )
    edges = edges.join(stored.select(F.col("url").alias("target")), "target", "left_semi")
    depths = crawl(edges, seeds.select(without_fragment("url").alias("url")), navigation.get("maxDepth"))
    return stored.join(depths, "url").select("page_id", "url", "depth")


def next_pages(dom: Dom, selector: str) -> DataFrame:
    """page_id, url and the target of each page's first next-button."""
    buttons = match(dom.nodes, {"_next": selector}).where("_next")
    first = worked_out(with_attrs(with_text(buttons, dom.docs)).select("page_id", "pos", "target"))
    chosen = first.where("target is not null").groupBy("page_id").agg(F.min_by("target", "pos").alias("next_url"))
    return dom.docs.select("page_id", "url").join(chosen, "page_id", "left")


def page_chain(dom: Dom, selector: str, max_pages: int | None = None) -> DataFrame:
    """Position of each page in its chain of next-buttons, counted from 1, with the chain's first page.

    Distances double every round (each page points to its predecessor's predecessor), so a chain of n pages takes
    about log2(n) rounds. Pages on a loop have no first page; they come out with null.
    """
    pages = next_pages(dom, selector).select(
        "page_id", "next_url", without_fragment("url").alias("url"), without_fragment("next_url").alias("_next")
    )
    pages = cut(pages)
    before = (
        pages.where("_next <> url")
        .groupBy(F.col("_next").alias("url"))
        .agg(F.min_by("url", "page_id").alias("back"))
    )
    hops = cut(
        pages.select("url")
        .distinct()
        .join(before, "url", "left")
        .select("url", "back", F.col("url").alias("root"), F.when(F.col("back").isNull(), 0).otherwise(1).alias("steps"))
    )
    # Rows that have reached their first page (root, steps away) leave the joins; the others know the page `back`, steps
    # away, and take over what that page knows.
    done, active = hops.where("back is null"), hops.where("back is not null")
    reach, total = 1, hops.count()
    while reach < total and not active.isEmpty():
        known = done.unionByName(active).select(
            F.col("url").alias("back"), F.col("back").alias("_back"), "root", F.col("steps").alias("_steps")
        )
        moved = cut(
            active.select("url", "back", "steps")
            .join(known, "back")
            .select("url", F.col("_back").alias("back"), "root", (F.col("steps") + F.col("_steps")).alias("steps"))
        )
        done, active = done.unionByName(moved.where("back is null")), moved.where("back is not null")
        reach *= 2
    place = done.unionByName(active).select(
        "url",
        F.when(F.col("back").isNull(), F.col("root")).alias("first_url"),
        F.when(F.col("back").isNull(), F.col("steps") + 1).alias("position"),
    )
    out = pages.join(place, "url").select("page_id", "url", "next_url", "first_url", "position")
    return out.where(F.col("position") <= max_pages) if max_pages else out


def start_url(spec: dict[str, Any]) -> str:
    """Where a spec starts: baseUrl and startPath, which is / if none is given."""
    target = spec["target"]
    return target["baseUrl"].rstrip("/") + (target.get("startPath") or "/")


def pagination_edges(pages: DataFrame, dom: Dom, spec: dict[str, Any]) -> DataFrame:
    """source and target of the next pages a spec's pagination leads to: by its next-button, or by page numbers in URLs.

    The strategy decides; without one, a next-button is used if the spec names one. Strategies that need a browser lead
    nowhere.
    """
    button = ((spec.get("selectors") or {}).get("pagination") or {}).get("nextButton")
    strategy = (spec.get("pagination") or {}).get("strategy") or ("next-button" if button else None)
    none = pages.select(F.col("url").alias("source"), F.col("url").alias("target")).where(F.lit(False))
    if strategy == "next-button" and button:
        found = next_pages(dom, button).select(F.col("url").alias("source"), F.col("next_url").alias("target"))
    elif strategy == "url-pattern":
        found = url_page_numbers(pages).select(F.col("url").alias("source"), F.col("next_url").alias("target"))
    else:
        return none
    return found.where("target is not null")


def _jumps(following: DataFrame, longest: int) -> list[DataFrame]:
    """Where 1, 2, 4, ... next pages lead: (source, target) tables up to runs of `longest` pages."""
    jump, jumps = cut(following), []
    while not jump.isEmpty():
        jumps.append(jump)
        if 2 ** len(jumps) >= longest:
            break
        onward = jump.select(F.col("source").alias("target"), F.col("target").alias("_on"))
        jump = cut(jump.join(onward, "target").select("source", F.col("_on").alias("target")))
    return jumps


def walk(pages: DataFrame, dom: Dom, spec: dict[str, Any]) -> DataFrame:
    """The stored pages that a `multi` spec visits: page_id, url, round and number, from its start page on.

    From a page the visit goes on along the run of next pages (pagination) and, unless followLinks is false, along the
    links that the spec's link selectors let one follow. A page counts if some way leads to it with at most maxDepth
    links and, since the last link, at most `selectors.pagination.maxPages` pages of one run. `round` is the least
    number of links to it, `number` its place in the run it was then found in. Of all pages found, target.maxPages keeps
    the first by round, number and page_id; no round is begun once that many are there.

    A round costs one join for the links and, for runs of n pages, about log2(n) joins: next pages are followed in
    steps of 1, 2, 4, ... Pages that are stored but not reached are not visited, nor are targets that are not stored;
    a start page that is not stored reaches nothing. Of stored pages with one URL (fragments aside) all are visited.
    """
    navigation, target = spec.get("navigation") or {}, spec.get("target") or {}
    max_depth, max_pages = navigation.get("maxDepth"), target.get("maxPages")
    run = ((spec.get("selectors") or {}).get("pagination") or {}).get("maxPages")
    clean = lambda c: without_fragment(c).alias(c)
    stored = cut(pages.select("page_id", clean("url")))
    known = stored.select(F.col("url").alias("target")).distinct()

    def within(found: DataFrame) -> DataFrame:
        return found.select(clean("source"), clean("target")).where("source <> target").join(known, "target", "left_semi")

    following = allowed(pagination_edges(pages, dom, spec).withColumn("url", F.col("target")), spec)
    # Of stored pages with one URL the least target counts, so that a page has one next page.
    following = within(following).groupBy("source").agg(F.min("target").alias("target"))
    jumps = _jumps(following, min(stored.count(), run or stored.count()))
    links = None
    if (spec.get("selectors") or {}).get("links") and navigation.get("followLinks") is not False:
        found = allowed(link_rows(dom, spec), spec).where("follow")
        links = cut(within(found.select(F.col("page_url").alias("source"), F.col("url").alias("target"))).distinct())

    def runs(pages: DataFrame) -> DataFrame:
        """Pages (url, number) with those that follow them in their runs. Each step uses the pages twice, so they are
        written down: plans of n steps would hold 2 ** n copies of the first one."""
        for k, jump in enumerate(jumps):
            pages = cut(pages)
            further = pages.withColumnRenamed("url", "source").join(jump, "source")
            further = further.select(F.col("target").alias("url"), (F.col("number") + 2**k).alias("number"))
            further = further.where(F.col("number") <= run) if run is not None else further
            pages = pages.unionByName(further).groupBy("url").agg(F.min("number").alias("number"))
        return pages

    start = stored.where(F.col("url") == F.lit(start_url(spec))).select("url").distinct()
    newest = cut(runs(start.withColumn("number", F.lit(1))).withColumn("round", F.lit(0)))
    reached = newest
    for turn in itertools.count(1):
        done = links is None or newest.isEmpty() or (max_depth is not None and turn > max_depth)
        if done or (max_pages is not None and reached.select("url").distinct().join(stored, "url").count() >= max_pages):
            break
        step = links.join(newest.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url"), F.lit(1).alias("number"))
        # A page that was there already matters again only if more of its run is now within bounds.
        better = F.col("r.url") == F.col("s.url")
        better = better & (F.col("r.number") <= F.col("s.number")) if run is not None else better
        new = runs(step.distinct()).alias("s").join(reached.alias("r"), better, "left_anti")
        newest = cut(new.select("url", "number", F.lit(turn).alias("round")))
        reached = reached.unionByName(newest)
    first = reached.groupBy("url").agg(F.min(F.struct("round", "number")).alias("first"))
    visited = stored.join(first, "url").select("page_id", "url", "first.round", "first.number")
    return first_rows(visited, ["round", "number", "page_id"], max_pages) if max_pages is not None else visited


def url_page_numbers(pages: DataFrame, parameter: str = "page") -> DataFrame:
    """Pages that carry their number in the URL: series, number, and whether the next number is stored too. A number
    beyond 64 bits is none.

    The next page is looked up by (series, number), so one long series does not end up in one task.
    """
    query, path = rf"[?&]{parameter}=(\d+)(?=&|#|$)", rf"/{parameter}/(\d+)(?=[/?#]|$)"
    bare = without_fragment("url")
    number = F.coalesce(
        F.regexp_extract("url", query, 1).try_cast("bigint"), F.regexp_extract("url", path, 1).try_cast("bigint")
    )
    series = F.regexp_replace(
        F.regexp_replace(bare, rf"([?&]){parameter}=\d+(?=&|$)", f"$1{parameter}=*"),
        rf"/{parameter}/\d+(?=[/?]|$)",
        f"/{parameter}/*",
    )
    numbered = pages.select("page_id", "url", series.alias("series"), number.alias("page_number")).where(
        "page_number is not null"
    )
    following = numbered.groupBy("series", (F.col("page_number") - 1).alias("page_number")).agg(
        F.min("url").alias("next_url")
    )
    return numbered.join(following, ["series", "page_number"], "left").select(
        "page_id", "url", "series", "page_number", F.col("next_url").isNotNull().alias("has_next_page"), "next_url"
    )
