import csv
import glob
import json

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from webloom.operators import crawl, scrape
from webloom.plans.nodes import parse
from webloom.plans.scale import first_rows
from webloom.sources.pages import read_pages
from webloom.sources.sinks import OutputWriter
from webloom.sources.spec import SpecError, load_spec, normal_spec, parse_spec, warnings

BASIC = {"selectors": {"container": ".c", "fields": {"t": {"selector": ".t", "type": "text"}}}}


def with_fields(fields, **more):
    return normal_spec({"selectors": {"container": ".c", "fields": fields}, **more})


def test_both_dialects_come_out_the_same():
    spec = normal_spec(
        {"selectors": {"itemRoot": "a", "fields": [{"name": "title", "selector": ":scope"}, {"name": "href", "selector": ":scope", "attr": "href"}]}}
    )
    assert spec["selectors"]["container"] == "a"
    assert spec["selectors"]["fields"] == {
        "title": {"selector": ":scope", "type": "text"},
        "href": {"selector": ":scope", "attribute": "href", "type": "attribute"},
    }


@pytest.mark.parametrize(
    "raw",
    [
        {}, {**BASIC, "colour": 1}, {"selectors": {"fields": {}}}, {**BASIC, "target": {"baseURL": "x"}},
        {"selectors": {"container": "a", "fields": {"t": {"selector": "b", "type": "colour"}}}},
        {**BASIC, "pagination": {"strategy": "magic"}}, {**BASIC, "validation": {"constraints": {"t": {"between": 1}}}},
    ],
)
def test_bad_specs_are_refused(raw):
    with pytest.raises(SpecError):
        normal_spec(raw)


def test_loading(tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(BASIC))
    assert load_spec(str(path)) == normal_spec(BASIC)
    for bad in ("s.txt", "missing.json"):
        with pytest.raises(SpecError):
            load_spec(str(tmp_path / bad))
    with pytest.raises(SpecError):
        parse_spec("{", "json")
    with pytest.raises(SpecError):
        parse_spec("{}", "toml")
    spec = normal_spec({**BASIC, "output": {"groupBy": "category"}, "navigation": {"type": "flow"}, "pagination": {"strategy": "load-more"}})
    assert len(warnings(spec)) == 3


def test_field_types_transforms_and_errors(dom_of):
    html = """<div class=c><b class=t> 1,234.5 EUR </b><i class=n>7</i><time>2024-05-06</time><a href="x">l</a><img src="/i.png">
    <p class=h>x<u>y</u></p></div><div class=c><i class=n>seven</i><b class=t></b></div>"""
    spec = with_fields(
        {
            "price": {"selector": ".t", "type": "number", "transform": "extractCurrency"},
            "n": {"selector": ".n", "type": "number", "required": True},
            "d": {"selector": "time", "type": "date"},
            "u": {"selector": "a", "type": "url"},
            "i": {"selector": "img", "type": "image"},
            "h": {"selector": ".h", "type": "html"},
            "k": {"selector": ":scope", "type": "attribute", "attribute": "class"},
            "f": {"selector": ".t", "type": "text", "fallback": "none"},
        },
        validation={"dataTypes": {"price": "number", "f": "boolean"}, "constraints": {"price": {"min": 2000}, "k": {"enum": ["c"]}}},
    )
    rows = scrape.scraped(dom_of(("http://a.b/p/", html)), spec).orderBy("pos").collect()
    first, second = rows[0].data, rows[1].data
    assert (first.price, first.n, str(first.d), first.u, first.i, first.h, first.k, first.f) == (
        1234.5, 7.0, "2024-05-06 00:00:00", "http://a.b/p/x", "http://a.b/i.png", "x<u>y</u>", "c", "1,234.5 EUR",
    )
    assert (second.price, second.n, second.f) == (None, None, "none")
    kinds = [[(e.type, e.field, e.message) for e in r.errors] for r in rows]
    assert kinds[0] == [("validation", "price", "price is out of bounds"), ("validation", "f", "f is not a boolean")]
    assert kinds[1] == [
        ("extraction", "n", "n is not a number"), ("validation", "n", "n is required"), ("validation", "f", "f is not a boolean"),
    ]


def test_nested_containers_share_their_fields(dom_of):
    dom = dom_of("<div class=c><b class=t>outer</b><div class=c><b class=t>inner</b></div></div>")
    rows = scrape.scraped(dom, normal_spec(BASIC)).orderBy("pos").collect()
    assert [r.data.t for r in rows] == ["outer", "inner"]


def items(spark):
    rows = [(1, 1, 'a "q", b', None), (1, 2, "line\nbreak", 2.5), (2, 1, "", 0.0)]
    return spark.createDataFrame(rows, "page_id bigint, pos int, text string, n double")


def test_jsonl_and_csv(spark, tmp_path):
    target = {"directory": str(tmp_path), "filename": "out"}
    path = OutputWriter(target).write(items(spark))
    assert path.endswith("out.jsonl")
    assert sorted(rows_of(spark.read.schema("page_id bigint, pos int, text string, n double").json(path))) == sorted(rows_of(items(spark)))
    path = OutputWriter({**target, "format": "csv"}).write(items(spark).coalesce(1))
    with open(glob.glob(f"{path}/part-*")[0], newline="") as f:
        table = list(csv.reader(f))
    assert table == [["page_id", "pos", "text", "n"], ["1", "1", 'a "q", b', ""], ["1", "2", "line\nbreak", "2.5"], ["2", "1", "", "0.0"]]


def test_json_document(spark, tmp_path):
    summary = spark.createDataFrame([(2, 3)], "page_count int, item_count int")
    writer = OutputWriter({"directory": str(tmp_path), "filename": "r_{timestamp}", "format": "json"})
    path = writer.write(items(spark), summary)
    document = json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))))
    assert document["metadata"] == {"page_count": 2, "item_count": 3}
    assert [(d["page_id"], d["pos"]) for d in document["data"]] == [(1, 1), (1, 2), (2, 1)]
    assert "{timestamp}" not in path
    empty = writer.write(items(spark).limit(0))
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{empty}/part-*")))) == {"data": []}


def document(path):
    return json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{path}/part-*"))))


def test_json_document_with_nulls_and_equal_places(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1, "a"), (None, 1, "b"), (2, None, "c"), (2, None, "c")], "page_id bigint, pos int, text string").repartition(3)
    path = OutputWriter({"directory": str(tmp_path), "filename": "n", "format": "json"}).write(rows)
    assert sorted(d["text"] for d in document(path)["data"]) == ["a", "b", "c", "c"]


def test_metadata_goes_where_it_is_asked_for(spark, tmp_path):
    summary = spark.createDataFrame([(2, 3)], "page_count int, item_count int")
    target = {"directory": str(tmp_path), "filename": "m"}
    assert "metadata" not in document(OutputWriter({**target, "format": "json", "includeMetadata": False}).write(items(spark), summary))
    assert "metadata" in document(OutputWriter({**target, "format": "json", "includeMetadata": True}).write(items(spark), summary))
    path = OutputWriter({**target, "includeMetadata": True}).write(items(spark), summary)
    assert rows_of(spark.read.json(f"{path}.metadata.json").select("page_count", "item_count")) == [(2, 3)]
    path = OutputWriter({**target, "format": "csv"}).write(items(spark), summary)
    assert not glob.glob(f"{path}.metadata.json")


def test_defaults_and_grouping(spark, tmp_path):
    writer = OutputWriter()
    assert writer.path.startswith("data/scrape_") and writer.path.endswith(".jsonl")
    with pytest.raises(ValueError):
        OutputWriter({"format": "xml"})
    path = OutputWriter({"directory": str(tmp_path), "filename": "g", "groupBy": "page_id"}).write(items(spark))
    assert len(glob.glob(f"{path}/page_id=*")) == 2


def test_crawl_ignores_loops_and_stops_at_depth(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("a", "a"), ("x", "y")] + [("a", "b")] * 50
    edges = spark.createDataFrame(edges, "source string, target string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert sorted(rows_of(crawl.crawl(edges, seeds, 2))) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(rows_of(crawl.crawl(edges, seeds, 9))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_page_chain_with_a_loop(dom_of):
    pages = [(f"http://a.b/{i}", f'<a class=next href="/{i + 1}">n</a>' if i < 5 else "") for i in range(6)]
    loop = [("http://l.o/1", '<a class=next href="/2">n</a>'), ("http://l.o/2", '<a class=next href="/1">n</a>')]
    rows = rows_of(crawl.page_chain(dom_of(*pages, *loop), ".next").select("url", "first_url", "position"), "page_id")
    assert rows == [(f"http://a.b/{i}", "http://a.b/0", i + 1) for i in range(6)] + [("http://l.o/1", None, None), ("http://l.o/2", None, None)]
    assert crawl.page_chain(dom_of(*pages), ".next", max_pages=2).count() == 2


def test_discovery_filters(spark, dom_of):
    dom = dom_of(("http://a.b/", '<a href="/1#x">one</a><a href="/1">again</a><a href="/cart/2">no</a><a href="http://c.d/">out</a><a href="/seen">s</a>'))
    spec = {"navigation": {"allowedDomains": ["A.b"], "excludedPaths": ["/cart"]}}
    visited = spark.createDataFrame([("http://a.b/seen#y",)], "url string")
    assert rows_of(crawl.discover_links(dom, spec, visited).select("url", "text", "follow")) == [("http://a.b/1", "one", True)]


def test_single_page_and_reading(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/s", "<p class=c>"), (2, "http://a.b/t", "<p class=c>"), (3, "http://z.z/s", "")], "page_id bigint, url string, html string")
    spec = {"target": {"baseUrl": "http://a.b", "startPath": "/s"}, "navigation": {"type": "single"}}
    assert rows_of(scrape.select_pages(pages, spec).select("page_id")) == [(1,)]
    pages.write.json(str(tmp_path / "j"))
    assert sorted(rows_of(read_pages(spark, str(tmp_path / "j"), "json"))) == sorted(rows_of(pages))
    (tmp_path / "x.html").write_text("<b>\n</b>")
    assert read_pages(spark, str(tmp_path / "x.html"), "text").first().html == "<b>\n</b>"
    assert parse(read_pages(spark, str(tmp_path / "x.html"), "text")).nodes.count() == 1


SITE = {"target": {"baseUrl": "http://a.b", "startPath": "/l/1"}, "navigation": {"type": "multi"}}


def site(spark, *pages):
    return spark.createDataFrame([(i, f"http://a.b{url}", html) for i, (url, html) in enumerate(pages)], "page_id bigint, url string, html string")


def walked(pages, spec):
    return {r.url.removeprefix("http://a.b"): (r.round, r.number) for r in crawl.walk(pages, parse(pages), normal_spec({**BASIC, **spec})).collect()}


def following(n, more=""):
    return f'<a class=next href="/l/{n}#x">n</a>{more}'


def test_walk_follows_runs_and_links(spark):
    # A run of 1..9 that ends in a loop, a link from 3 to another run, a page nobody leads to, and a target not stored.
    run = [(f"/l/{n}", following(n + 1 if n < 9 else 4, '<a class=go href="/m/1">m</a>' if n == 3 else "")) for n in range(1, 10)]
    other = [("/m/1", '<a class=next href="/m/2">n</a>'), ("/m/2", '<a class=next href="/m/3">n</a><a class=go href="/gone">g</a>'), ("/m/3", '<a class=go href="/l/9">l</a><a class=go href="/cart">c</a>'), ("/cart", ""), ("/alone", "")]
    pages = site(spark, *run, *other)
    button = {"container": ".c", "pagination": {"nextButton": ".next"}}
    links = {**button, "links": [{"selector": ".go", "attribute": "href", "follow": True}]}
    assert walked(pages, {**SITE, "selectors": button}) == {f"/l/{n}": (0, n) for n in range(1, 10)}
    everywhere = {**SITE, "selectors": links, "navigation": {"type": "multi", "excludedPaths": ["/cart"]}}
    assert walked(pages, everywhere) == {f"/l/{n}": (0, n) for n in range(1, 10)} | {f"/m/{n}": (1, n) for n in (1, 2, 3)}
    # Runs of at most two pages: 3 is out of reach, and so is its link.
    short = {**SITE, "selectors": {**links, "pagination": {"nextButton": ".next", "maxPages": 2}}}
    assert walked(pages, short) == {"/l/1": (0, 1), "/l/2": (0, 2)}
    # A run of three from 1; from m/1 a new run begins, and m/3 leads back into the middle of the first.
    three = {**SITE, "selectors": {**links, "pagination": {"nextButton": ".next", "maxPages": 3}}}
    assert walked(pages, three) == {"/l/1": (0, 1), "/l/2": (0, 2), "/l/3": (0, 3), "/m/1": (1, 1), "/m/2": (1, 2), "/m/3": (1, 3), "/l/9": (2, 1), "/l/4": (2, 2), "/l/5": (2, 3), "/cart": (2, 1)}
    assert set(walked(pages, {**three, "navigation": {"type": "multi", "maxDepth": 1}})) == {"/l/1", "/l/2", "/l/3", "/m/1", "/m/2", "/m/3"}
    assert set(walked(pages, {**three, "navigation": {"type": "multi", "maxDepth": 0}})) == {"/l/1", "/l/2", "/l/3"}
    assert set(walked(pages, {**three, "navigation": {"type": "multi", "followLinks": False}})) == {"/l/1", "/l/2", "/l/3"}
    limited = {**everywhere, "target": {**SITE["target"], "maxPages": 4}}
    assert walked(pages, limited) == {f"/l/{n}": (0, n) for n in range(1, 5)}
    assert walked(pages, {**everywhere, "target": {**SITE["target"], "maxPages": 0}}) == {}
    assert walked(pages, {**everywhere, "target": {"baseUrl": "http://a.b", "startPath": "/nowhere"}}) == {}
    # Without pagination and links only the start page.
    assert walked(pages, {**SITE, "selectors": {"container": ".c"}}) == {"/l/1": (0, 1)}


def test_walk_by_numbers_and_items_of_visited_pages(spark):
    pages = site(spark, *[(f"/list?page={n}", f"<p class=c><b class=t>{n}</b></p><p class=c></p>") for n in (1, 2, 3, 5)], ("/other", "<p class=c></p>"))
    spec = {"target": {"baseUrl": "http://a.b", "startPath": "/list?page=2"}, "navigation": {"type": "multi"}, "pagination": {"strategy": "url-pattern"}}
    spec = normal_spec({**BASIC, **spec})
    found, _ = scrape.scrape(pages, spec, partitions=3)
    assert rows_of(found.select("page_id", "data.t"), "page_id", "pos") == [(1, "2"), (1, None), (2, "3"), (2, None)]
    assert len(warnings(normal_spec({**BASIC, "pagination": {"strategy": "next-button"}}))) == 1
    with pytest.raises(SpecError):
        normal_spec({"selectors": {"container": "a", "pagination": {"button": "b"}}})


def test_long_run_takes_few_rounds(spark):
    """A run of 200 pages is followed in steps of 1, 2, 4, ...: eight tables of steps."""
    chain = spark.range(200).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    assert len(crawl._jumps(chain, 1000)) == 8
    assert len(crawl._jumps(chain, 5)) == 3


def test_plans_of_long_runs_stay_small(spark, monkeypatch):
    """A run of 70 pages takes seven steps; a step's plan holds one join and no copies of the steps before."""
    pages = site(spark, *[(f"/list?page={n}", "") for n in range(70)])
    spec = {"target": {"baseUrl": "http://a.b", "startPath": "/list?page=2"}, "navigation": {"type": "multi"}, "pagination": {"strategy": "url-pattern"}}
    joins, cut = [], crawl.cut

    def recorded(df):
        joins.append(df._jdf.queryExecution().analyzed().toString().count("Join "))
        return cut(df)

    monkeypatch.setattr(crawl, "cut", recorded)
    visited = crawl.walk(pages, parse(pages, 2), normal_spec({**BASIC, **spec}))
    assert sorted(r.number for r in visited.select("number").collect()) == list(range(1, 69))
    assert max(joins) <= 2


@pytest.mark.parametrize("n", [0, 1, 7, 500, 5000])
def test_first_rows(spark, n):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), (F.col("id") % 5).alias("b"))
    got = sorted(rows_of(first_rows(rows, ["b", "a"], n)), key=lambda r: (r[1], r[0]))
    assert got == sorted(rows_of(rows), key=lambda r: (r[1], r[0]))[:n]


def test_limits_sort_no_pages(spark):
    """maxPages ranks ids, and no plan limits or sorts pages as a whole."""
    pages = site(spark, *[(f"/{n}", "<p class=c>x</p>" * 3) for n in range(40)])
    spec = normal_spec({**BASIC, "target": {"baseUrl": "http://a.b", "maxPages": 7, "maxItems": 10}})
    chosen = scrape.select_pages(pages, spec)
    assert sorted(r.page_id for r in chosen.collect()) == list(range(7))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan
    found, _ = scrape.scrape(pages, spec)
    assert rows_of(found.select("page_id"), "page_id", "pos") == [(0,), (0,), (0,), (1,), (1,), (1,), (2,), (2,), (2,), (3,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan


def test_fields_are_read_without_pairs(dom_of):
    """No join of containers with nodes, and no row per container and field."""
    dom = dom_of("<div class=c><b class=t>x</b></div><b class=t>outside</b><div class=c></div>")
    rows = scrape.scraped(dom, with_fields({"t": {"selector": ".t", "type": "text"}, "u": {"selector": ".c .t", "type": "text"}}))
    assert [tuple(r.data) for r in rows.orderBy("pos").collect()] == [("x", "x"), (None, None)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("Generate") == 1
