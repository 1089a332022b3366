from conftest import rows_of
from pyspark.sql import functions as F

from webloom.operators import crawl, extract, snapshot
from webloom.plans.nodes import parse

PAGE = """<html><head><title> A  b </title><meta name=description content=" hi &amp; you "></head><body>
<nav><a href="/n">nav link</a><ul><li>1<li>2</ul></nav>
<main id=m role="main"><h2> Head </h2><h3></h3><ul><li>a<li>b<ul><li>c</ul></ul><ol><li>only</ol>
<a class="btn primary" href="../x?y=1#z">A long text that exceeds twenty</a><a href="https://o.com"><img src=i.png width=0>im</a>
<a href="#frag">frag</a><a href="mailto:x@y">mail</a>
<table><caption>C</caption><tr><th>h1<th>h2<tr><td>1<td>2<tr><td>3<table><tr><td>n</table></table><table></table></main>
<form id=f action="/go" method=post><label for=q>Query</label><input id=q name=q placeholder="search" required>
<label>Wrap <select name=s><option>x<option selected value=v>y</select></label><textarea name=t>zz</textarea>
<input type=hidden name=h value=1><input type=checkbox name=c><input type=submit value="Send"></form>
<button>Go</button><div role=button aria-label="Lab" style="display:none"></div><img src="a.png" alt=al width=10 height=20>
<span role=img aria-label=star></span><iframe src=f.html width=0></iframe></body></html>"""


def page(dom_of):
    return dom_of(("http://EX.com/a/b/c.html", PAGE), ("http://x.y/z", None))


def test_strings(dom_of):
    dom = page(dom_of)
    assert rows_of(extract.title(dom), "page_id") == [(1, "A b"), (2, "")]
    assert rows_of(extract.meta_description(dom), "page_id") == [(1, "hi & you"), (2, "")]
    text = rows_of(extract.main_content(dom, max_text=4), "page_id")
    assert text == [(1, "Head..."), (2, "")]


def test_links(dom_of):
    rows = rows_of(extract.links(page(dom_of)).select("text", "href", "is_external"), "pos")
    assert rows == [
        ("nav link", "http://ex.com/n", False),
        ("A long text that exceeds twenty", "http://ex.com/a/x?y=1#z", False),
        ("im", "https://o.com/", True),
    ]


def test_navigation_keeps_fragments_and_orders_by_score(dom_of):
    rows = rows_of(extract.navigation(page(dom_of), with_score=True).select("rank", "text", "score"), "rank")
    assert rows == [
        (1, "A long text that exceeds twenty", 17), (2, "im", 12), (3, "frag", 10), (4, "mail", 10), (5, "nav link", 0),
    ]


def test_buttons(dom_of):
    rows = rows_of(extract.buttons(page(dom_of)).select("tag_name", "text", "is_visible", "role", "selector"), "pos")
    assert rows == [
        ("a", "A long text that exceeds twenty", True, "button", ".btn"), ("input", "Send", True, "button", "input"),
        ("button", "Go", True, "button", "button"), ("div", "Lab", False, "button", "div"),
    ]


def test_inputs(dom_of):
    rows = rows_of(extract.inputs(page(dom_of)).select("tag_name", "type", "label", "value"), "pos")
    assert rows == [
        ("input", "input", "Query", None), ("select", "select", "", "v"), ("textarea", "textarea", "", "zz"),
        ("input", "checkbox", "", "on"),
    ]


def test_tables_and_lists(dom_of):
    dom = page(dom_of)
    rows = rows_of(extract.tables(dom).select("headers", "rows", "caption"), "pos")
    assert rows == [(["h1", "h2"], [["1", "2"], ["3n", "n"], ["n"]], "C"), (None, [["n"]], None), (None, [], None)]
    assert rows_of(extract.lists(dom).select("type", "items")) == [("ul", ["a", "bc", "c"])]


def test_forms(dom_of):
    form = extract.forms(page(dom_of)).first()
    assert (form.id, form.action, form.method, form.submit_text) == ("f", "/go", "POST", "Send")
    assert [(i.type, i.name, i.required, i.label) for i in form.inputs] == [
        ("input", "q", True, "Query"), ("select", "s", False, "Wrap"), ("textarea", "t", False, None),
        ("hidden", "h", False, None), ("checkbox", "c", False, None), ("submit", None, False, None),
    ]


def test_media_headings_landmarks(dom_of):
    dom = page(dom_of)
    assert rows_of(extract.images(dom).select("src", "width", "aria_label"), "pos") == [("a.png", 10, None), (None, None, "star")]
    assert rows_of(extract.frames(dom).select("src", "width", "is_visible")) == [("f.html", "0", False)]
    assert rows_of(extract.headings(dom).select("level", "text")) == [(2, "Head")]
    assert rows_of(extract.landmarks(dom).select("tag_name", "role", "id"), "pos") == [("nav", "nav", ""), ("main", "main", "m")]


def test_limits(dom_of):
    dom = dom_of(*[f"<h1>{'h' * n}</h1><a href=/x>{'a' * m}</a><nav>{'n' * k}</nav>" for n, m, k in ((200, 100, 150), (201, 101, 151))])
    length = lambda df, c: [len(r[0]) for r in df.orderBy("page_id").select(c).collect()]
    assert length(extract.headings(dom), "text") == [200, 203]
    assert length(extract.links(dom), "text") == [100, 103]
    assert length(extract.landmarks(dom), "content") == [150, 150]


def test_snapshot_routes_and_diagnoses(dom_of):
    snap = {r.page_id: r for r in snapshot.snapshot(page(dom_of)).collect()}
    assert [len(snap[1].elements[c]) for c in snapshot.ELEMENT_CATEGORIES] == [4, 4, 3, 2]
    assert [len(snap[2].elements[c]) for c in snapshot.ELEMENT_CATEGORIES] == [0, 0, 0, 0]
    assert [link.text for link in snap[1].content.navigation][0] == "A long text that exceeds twenty"
    assert snap[2].diagnostic["links"].asDict() == {"success": True, "result_type": "array", "result_size": "0"}
    assert snap[2].diagnostic["title"].asDict() == {"success": False, "result_type": "none", "result_size": "0"}
    assert len(snap[1].diagnostic) == 15
    lite = snapshot.snapshot_lite(page(dom_of)).first()
    assert set(lite.content.asDict()) == {"title", "url"}


def test_registry(dom_of):
    def bold(dom):
        return dom.nodes.where("tag = 'b'").select("page_id", "pos", F.lit("bold").alias("kind"))

    extract.register("bold", bold)
    try:
        flat = snapshot.extract_specific(dom_of("<b>x</b><b>y</b>"), ["bold", "unknown"]).first()
        assert [b.kind for b in flat.bold] == ["bold", "bold"] and "bold" in extract.applicable()
    finally:
        del extract.REGISTRY["bold"]


def test_page_state_and_empty_pages(spark, dom_of):
    rows = [(1, "http://a.b/", PAGE), (2, "http://a.b/2", "  "), (3, "http://a.b/3", "<p>1<p>2<div>3</div><iframe></iframe>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    state = rows_of(snapshot.page_state(parse(pages)).select("title", "links_count", "error", "is_navigating"), "page_id")
    assert state == [("A b", 3, None, False), ("Unknown", None, "Failed to extract page content", True), ("", 0, None, False)]
    empty = rows_of(snapshot.empty_page_check(parse(pages)).select("page_id", "iframe_count", "body_children"), "page_id")
    assert empty == [(2, 0, 0), (3, 1, 4)]


def test_compact_caps(spark):
    html = "".join(f'<a href="/{i}">link {i}</a>' for i in range(40)) + '<a rel=next href="/n">go on</a><a href="/2">2</a><a href="/3">3</a>'
    pages = spark.createDataFrame([(1, "http://a.b/", html)], "page_id bigint, url string, html string")
    snap = snapshot.compact_snapshot(parse(pages)).first()
    assert len(snap.controls) == 30 and snap.controls[0].ref_id == "n1"
    assert [p.name for p in snap.pagination] == ["go on", "2"]
    assert 0 < snap.hints.text_density < 1 and snap.hints.link_density == 1.0


def test_model_snapshot_references(dom_of):
    html = (
        '<ul id="u"><li><a href="/1">one</a><li><a href="/2">two</a></ul><a rel=next href="/n">next</a><iframe src="/f"></iframe>'
        '<form id="f"><label for="q">Query</label><input id="q" name="q"><label>Kind <select name="k"><option>a</select></label>'
        '<textarea class="big note" placeholder="Say"></textarea><button type="submit">Go</button></form><form><input name="lone"></form>'
    )
    dom = dom_of(html, "<p>nothing here</p>", ("http://example.com/", None))
    full, bare, none = snapshot.model_snapshot(dom).orderBy("page_id").collect()
    first, second = full.compact.forms
    assert (first.form.selector, first.submit.selector, first.submit.name) == ("#f", "button", "Go")
    assert [(f.label, f.input.selector, f.input.name) for f in first.fields] == [("Query", "#q", "q"), ("Kind", "select", "k"), (None, ".big", "Say")]
    assert second.form.selector == "form" and second.submit is None and [f.input.name for f in second.fields] == ["lone"]
    assert [b.root.selector for b in full.compact.lists] == ["#u"]
    refs = [b.root for b in full.compact.lists] + full.compact.controls + full.compact.pagination
    refs += [r for b in full.compact.forms for r in (b.form, b.submit, *[f.input for f in b.fields]) if r is not None]
    assert {k: tuple(v) for k, v in full.ref_map.items()} == {r.ref_id: (r.selector, "main") for r in refs}
    # The button stands among the controls and in its form, the next link among the controls and the pagination.
    assert len(refs) == len(full.ref_map) + 2
    assert [c.ref_id for c in full.compact.controls if c.name in ("Go", "next")] == [full.compact.pagination[0].ref_id, first.submit.ref_id]
    # Each reference leads to one element, named by its place.
    places = {r.pos: r.tag for r in dom.nodes.where("page_id = 1").collect()}
    assert {places[int(k[1:])] for k in full.ref_map} == {"ul", "a", "form", "input", "select", "textarea", "button"}
    assert full.stats.frame_count == 1 and full.stats.size_bytes > 0
    assert bare.ref_map == {} and bare.compact.forms == [] and none.ref_map == {}


def test_stream_of_pages(spark, tmp_path):
    from webloom.streaming.incremental import extract_stream, page_stream

    for i in (1, 2):
        rows = [(i, "http://a.b/", f'<a href="/{i}">t</a>')]
        spark.createDataFrame(rows, "page_id bigint, url string, html string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = page_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    extract_stream(stream, extract.links, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("href")
    assert sorted(rows_of(got)) == [("http://a.b/1",), ("http://a.b/2",)]


def test_base_of_relative_targets(dom_of):
    html = '<head><base target=_top><base href="http://z.com/q/"><base href="http://no.com/"></head><a href="x">one</a><a href="/y">two</a><a href="http://e.com/">three</a>'
    dom = dom_of(("http://e.com/a/b", html), ("http://e.com/a/b", '<base href="sub/"><a href="x">one</a>'), ("http://e.com/a/b", "<!-- <base href='http://c.com/'> --><a href=x>one</a>"))
    rows = rows_of(extract.links(dom).select("page_id", "href", "is_external"), "page_id", "pos")
    assert rows == [
        (1, "http://z.com/q/x", True), (1, "http://z.com/y", True), (1, "http://e.com/", False), (2, "http://e.com/a/sub/x", False), (3, "http://e.com/a/x", False),
    ]
    assert [r.href for r in extract.navigation(dom).where("page_id = 2").collect()] == ["http://e.com/a/sub/x"]


def test_length_of_navigation_texts_in_utf_16(dom_of):
    found = extract.navigation(dom_of('<a href="/1">\U0001f600</a><a href="/2">x</a><a href="/3">é</a><a href="/4">ab</a>'))
    assert sorted(r.text for r in found.collect()) == sorted(["\U0001f600", "ab"])


def test_replaced_extractors_count_in_snapshots(dom_of, monkeypatch):
    monkeypatch.setattr(extract, "REGISTRY", dict(extract.REGISTRY))
    monkeypatch.setattr(snapshot, "REGISTRY", extract.REGISTRY)
    dom = dom_of("<title>T</title><h1>One</h1><h2>Two</h2>")
    extract.register("headings", lambda dom: extract.headings(dom).where("level = 2"))
    extract.register("title", lambda dom: dom.docs.select("page_id", F.lit("mine").alias("title")))
    row = snapshot.snapshot(dom, ["title", "headings"]).first()
    assert row.title == "mine" and [h.text for h in row.content.headings] == ["Two"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_worked_out_once(dom_of):
    """A filter on what a link leads to must not read its attributes again in the join before it."""
    dom = dom_of('<a href="/x">x</a><a rel=next href="/y">y</a>')
    for rows in (extract.links(dom), crawl.link_rows(dom), crawl.next_pages(dom, "[rel=next]"), snapshot.compact_pagination(dom)):
        assert optimized(rows).count("map_from_entries") == 1


def test_snapshots_share_a_pass_over_the_nodes(dom_of):
    """One for single elements, one for links and controls, one for lists, one for forms."""
    dom = dom_of("<p>x")
    for rows in (snapshot.compact_snapshot(dom), snapshot.model_snapshot(dom)):
        assert optimized(rows).count("Generate posexplode") <= 4


def test_compact_snapshot_is_made_of_its_parts(dom_of):
    many = "".join(f'<a href="/{i}">{i}</a>' for i in range(40))
    dom = dom_of(
        f'<a>no target</a><a href="/n" rel="prev">back</a><div hidden><button>Hidden</button><a href="/h">next</a></div>{many}<button></button><a href="/e"> </a>',
        "<button>Only</button><p>text</p>", "<a>bare &amp; </a>rest", "",
    )
    whole = snapshot.compact_snapshot(dom)
    for name, rows in (("controls", snapshot.compact_controls(dom)), ("pagination", snapshot.compact_pagination(dom))):
        blocks = whole.select("page_id", F.posexplode(name).alias("at", "c")).select("page_id", (F.col("at") + 1).alias("rank"), "c.*")
        assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, rows.drop("pos").collect())) != []
    hints = whole.select("page_id", "hints.text_density", "hints.link_density")
    assert sorted(map(tuple, hints.collect())) == sorted(map(tuple, snapshot.page_hints(dom).collect()))
