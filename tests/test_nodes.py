from html.parser import HTMLParser

import pytest
from conftest import DATA, rows_of
from pyspark.sql import functions as F

from webloom.functions.css import match, parse_selector
from webloom.plans.nodes import contained, is_hidden, parse, with_ancestors, with_html, with_text


def texts(dom, *tags):
    rows = with_text(dom.nodes.where(F.col("tag").isin(*tags)), dom.docs)
    return [(r.tag, r.text) for r in rows.orderBy("page_id", "pos").collect()]


def test_implied_ends_and_nested_lists(dom_of):
    dom = dom_of("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<div>z</div>")
    assert texts(dom, "li", "p", "ul") == [("ul", "abc"), ("li", "a"), ("li", "bc"), ("ul", "c"), ("li", "c"), ("p", "x"), ("p", "y")]


def test_nested_tables(dom_of):
    dom = dom_of("<table><tr><td>1<td>2<tr><td>3<table><tr><td>n</table><td>4</table>after")
    assert texts(dom, "td") == [("td", "1"), ("td", "2"), ("td", "3n"), ("td", "n"), ("td", "4")]
    assert texts(dom, "table") == [("table", "123n4"), ("table", "n")]


def test_recovery(dom_of):
    dom = dom_of("lead<div>a</span></div></div> < 5 <b>bold<nav>n</nav><a title='a>b'>t</a>")
    assert texts(dom, "div", "b", "nav", "a") == [("div", "a"), ("b", "boldnt"), ("nav", "n"), ("a", "t")]


def test_an_unclosed_tag_ends_with_what_encloses_it(dom_of):
    assert texts(dom_of("<div><b>x</div>y"), "b") == [("b", "x")]


def test_scripts_comments_and_empty_pages(dom_of):
    dom = dom_of('<script>var t="</p><p>";</script><!-- <p>no</p> --><p>yes<script>x<', None, "", "plain")
    assert texts(dom, "p") == [("p", "yes")]
    assert dom.nodes.groupBy("page_id").count().collect() == dom.nodes.where("page_id = 1").groupBy("page_id").count().collect()
    assert "".join(dom.docs.where("page_id = 4").first().texts) == "plain"


def test_void_elements_hold_nothing(dom_of):
    assert texts(dom_of("<p>a<br>b<img src=x>c</p>"), "br", "img", "p") == [("p", "abc"), ("br", ""), ("img", "")]


def test_inner_html(dom_of):
    dom = dom_of("<div>a<b class=x>c</b>d</div><br>")
    rows = with_html(dom.nodes, dom.docs)
    assert rows_of(rows.select("tag", "html"), "pos") == [("div", "a<b class=x>c</b>d"), ("b", "c"), ("br", "")]


class Texts(HTMLParser):
    """Texts of elements that have an end tag, by an independent parser."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.skip = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("h1", "title", "a", "nav", "article"):
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        if self.open and self.open[-1][0] == tag:
            tag, parts = self.open.pop()
            self.found.append((tag, "".join(parts)))

    def handle_data(self, data):
        if not self.skip:
            for _, parts in self.open:
                parts.append(data)


def test_same_texts_as_an_independent_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    expected = []
    for row in pages.collect():
        parser = Texts()
        parser.feed(row.html)
        expected += [(row.page_id, *t) for t in parser.found]
    dom = parse(pages)
    got = with_text(dom.nodes.where("tag in ('h1', 'title', 'a', 'nav', 'article')"), dom.docs)
    assert sorted(rows_of(got.select("page_id", "tag", "text"))) == sorted(expected)


def test_hidden_is_inherited(dom_of):
    dom = dom_of('<div style="DISPLAY : none"><p>a</p></div><p hidden>b<i>c</i></p><p style="color:red">d</p><u aria-hidden=x>e</u>')
    rows = with_ancestors(dom.nodes, {"hidden": is_hidden()}).select("tag", "hidden", "pos")
    assert [r[:2] for r in rows_of(rows, "pos")] == [("div", True), ("p", True), ("p", True), ("i", True), ("p", False), ("u", False)]


def test_containment_against_brute_force(dom_of):
    html = "<ul><li>1<ul><li>2</ul><ol><li>3<ul><li>4</ul></ol><li>5</ul><ol><li>6</ol><li>7"
    dom = dom_of(html, html + "<ul><li>8</ul>")
    tag = F.col("tag")
    got = contained(dom.nodes, {"item": (tag.isin("ul", "ol"), tag == "li")}).select("page_id", "outer_pos", "pos")
    nodes = dom.nodes.collect()
    expected = [
        (o.page_id, o.pos, i.pos)
        for o in nodes for i in nodes
        if o.tag in ("ul", "ol") and i.tag == "li" and o.page_id == i.page_id and o.pos < i.pos < o.end
    ]
    assert sorted(rows_of(got)) == sorted(expected)


def test_containment_with_crossing_tags(dom_of):
    dom = dom_of("<div class=c><span class=c></div><i>x</i></span>")
    is_c = F.col("raw").contains("class=c")
    got = contained(dom.nodes, {"x": (is_c, F.col("tag") == "i")}).select("outer.tag")
    assert rows_of(got) == [("span",)]


def test_selectors(dom_of):
    dom = dom_of(
        '<form role=search><input name=q placeholder="My SEARCH" type=text></form><nav><ul><li><a class="btn big" href="/p/1">x</a>'
        '</ul></nav><a href="#t" id=t>y</a><input type="hidden"><p class="my-button">z</p>'
    )
    selectors = {
        "a": "nav a", "b": 'a[href^="/p/"]', "c": "a:not([href^='#'])", "d": '[role=search] input, textarea',
        "e": 'input[placeholder*="search" i]', "f": "a.btn.big", "g": '[class*="button"]', "h": "#t", "i": "ul li a", "j": "li nav",
        "k": 'input:not([type="hidden"])', "l": '[href$="1"]', "m": "body a",
    }
    flags = match(dom.nodes, selectors)
    hits = {n: sorted(r.pos for r in flags.where(n).collect()) for n in selectors}
    at = {n: [r.pos for r in dom.nodes.where(f"tag = '{n}'").orderBy("pos").collect()] for n in ("a", "input", "p")}
    a, i, p = at["a"], at["input"], at["p"]
    assert hits == {
        "a": a[:1], "b": a[:1], "c": a[:1], "d": i[:1], "e": i[:1], "f": a[:1], "g": p, "h": a[1:], "i": a[:1], "j": [],
        "k": i[:1], "l": a[:1], "m": [],
    }


@pytest.mark.parametrize("bad", ["a > b", "", "a,,b", "a::before", ":nth-child(2)", "a,"])
def test_unknown_selectors_are_refused(bad):
    with pytest.raises(ValueError):
        parse_selector(bad)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_of_pages_serves_everything(spark):
    from webloom.operators import extract

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for rows in (extract.links(parse(pages)), extract.tables(parse(pages)), extract.forms(parse(pages))):
        plan = plan_of(rows)
        assert "Python" not in plan and "Pandas" not in plan
        hashes = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert hashes and all("REPARTITION_BY_NUM" in line for line in hashes)


def test_pages_are_filtered_before_parsing(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    plan = plan_of(parse(pages).nodes.where("page_id = 3"))
    assert "EqualTo(page_id,3)" in plan


def test_results_do_not_depend_on_partitions(spark):
    from webloom.operators import extract

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    one, many = (extract.navigation(parse(pages, n)) for n in (1, 64))
    assert sorted(rows_of(one)) == sorted(rows_of(many))


def test_saved_nodes(spark, dom_of, tmp_path):
    from webloom.operators import extract
    from webloom.plans.nodes import Dom

    dom = dom_of('<a href="/x">t</a>')
    dom.save(str(tmp_path))
    assert rows_of(extract.links(Dom.load(spark, str(tmp_path)))) == rows_of(extract.links(dom))


def test_bucketed_tables_are_read_without_exchange(spark, tmp_path):
    from webloom.operators import extract
    from webloom.plans.nodes import Dom

    spark.sql(f"CREATE DATABASE IF NOT EXISTS saved LOCATION '{tmp_path}'")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    parse(pages).save_tables("saved.site", 4)
    try:
        links = extract.links(Dom.from_tables(spark, "saved.site"))
        assert "Exchange hashpartitioning" not in plan_of(links)
        assert sorted(rows_of(links)) == sorted(rows_of(extract.links(parse(pages))))
    finally:
        spark.sql("DROP DATABASE saved CASCADE")


def test_skewed_join(spark):
    from webloom.plans.scale import hot_keys, skew_join

    left = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 7) AS k", "cast(id AS string) AS r")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c")], "k bigint, v string")
    assert hot_keys(left, "k") is None
    hot = hot_keys(left, "k", max_rows=500)
    assert rows_of(hot.select("k")) == [(0,)]
    for how in ("inner", "left"):
        got = skew_join(left, right, "k", "r", hot, how)
        assert sorted(rows_of(got.select("k", "r", "v")), key=str) == sorted(rows_of(left.join(right, "k", how).select("k", "r", "v")), key=str)


def test_seam_characters_in_pages_do_no_harm(dom_of):
    assert texts(dom_of(("http://a\u0001b/", "<p>a\u0001b</p><p>c</p>")), "p") == [("p", "ab"), ("p", "c")]


def test_pages_without_a_tag_are_not_cut_up(dom_of):
    dom = dom_of("<p>a<TABLE><tr><td>x</table>", "<p>tablet</p><stable></stable>", "<table/>", "<!-- <table> --><p>", "", "<p title='<table>'>b")
    kept = dom.having("table").nodes
    assert {r.page_id for r in kept.collect()} == {1, 3, 6}
    same = lambda nodes: sorted(map(tuple, nodes.where("page_id in (1, 3, 6)").collect()))
    assert same(kept) == same(dom.nodes)
    both = kept.select("page_id").unionByName(dom.nodes.select("page_id"))
    both.collect()
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1


def test_partitions_grow_with_the_pages(spark, monkeypatch):
    """What one task sorts is bounded by the tags and the text of its pages, not by the size of the table over a fixed number."""
    monkeypatch.setattr("webloom.plans.nodes.PARTITION_BYTES", 2_000, raising=False)
    dealt = lambda n: parse(spark.range(n).select(F.col("id").alias("page_id"), F.lit("http://a.example").alias("url"), F.repeat(F.lit("<p>x"), 20).alias("html")))
    assert dealt(0).bodies.rdd.getNumPartitions() == dealt(1).bodies.rdd.getNumPartitions() == 4
    few, many = dealt(50), dealt(200)
    assert many.bodies.rdd.getNumPartitions() == 4 * few.bodies.rdd.getNumPartitions() == 208
    assert many.nodes.count() == 4000
