import html

from conftest import rows_of
from pyspark.sql import functions as F

from webloom.functions.attrs import attr, attr_map, class_list, has_attr
from webloom.functions.text import collapse_ws, decode_entities, trim_js, truncate
from webloom.functions.url import escape_css, hostname, is_external, pathname, resolve_url, valid_url

ENTITIES = [
    "&amp;&lt;&euro;&#8364;&#x20AC;&nbsp;x&foo;&copy 2020&ampx", "plain", "&", "&&amp", "&#0;&#xD800;&#128;&#99999999;",
    "&NotEqualTilde;|&equals;|&fjlig;", "", "&amp;lt;", "a&b=c&lt", "&notit; &not &notin;", "&x; &ampamp;",
]


def test_entities_match_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in ENTITIES], "t string").select(decode_entities("t"))
    assert [r[0] for r in df.collect()] == [html.unescape(t) for t in ENTITIES]


def test_entities_in_attributes_need_a_semicolon(spark):
    df = spark.createDataFrame([("/?a=1&copy=2&amp;b=&lt",)], "t string").select(decode_entities("t", attribute=True))
    assert df.first()[0] == "/?a=1&copy=2&b=&lt"


def test_white_space_is_that_of_javascript(spark):
    df = spark.createDataFrame([(" ﻿ a  \n b\t　",)], "t string")
    assert rows_of(df.select(trim_js("t"), collapse_ws("t"))) == [("a  \n b", "a b")]


def test_truncate_edges(spark):
    df = spark.createDataFrame([("x" * 100,), ("x" * 101,), ("",), (None,)], "t string").select(truncate("t", 100))
    assert [r[0] for r in df.collect()] == ["x" * 100, "x" * 100 + "...", "", ""]


def test_attributes(spark):
    raw = """<a Title="a>b" HREF='/x?a=1&amp;b=2' data-href="no" href="second" checked value=un"q class="b  btn">"""
    df = spark.createDataFrame([(raw,), ("<a>",), ("<a href>",), ("<input value=\"it's\"/>",)], "raw string")
    got = rows_of(df.select(attr("title"), attr("href"), has_attr("checked"), attr("value")))
    assert got[0] == ("a>b", "/x?a=1&b=2", True, 'un"q')
    assert got[1] == (None, None, False, None)
    assert got[2][1] == ""
    assert got[3][3] == "it's"
    full = df.select(attr_map().alias("m")).first()["m"]
    assert full == {"title": "a>b", "href": "/x?a=1&b=2", "data-href": "no", "checked": "", "value": 'un"q', "class": "b  btn"}
    assert df.select(class_list(attr("class"))).first()[0] == ["b", "btn"]


def test_huge_tags_do_not_overflow_the_matcher(spark):
    many = "<div " + "a='1' " * 100_000 + "id=x>"
    df = spark.createDataFrame([(many,), ("<" + "a" * 400_000 + ">",)], "raw string").select(attr("id"))
    assert [r[0] for r in df.collect()] == ["x", None]


def test_resolve_url(spark):
    base = "http://EX.com/a/b/c.html?q=1#f"
    cases = {
        "/x": "http://ex.com/x", "y": "http://ex.com/a/b/y", "../z?k=v#t": "http://ex.com/a/z?k=v#t",
        "//o.org": "http://o.org/", "?p=2": "http://ex.com/a/b/c.html?p=2", "#top": "http://ex.com/a/b/c.html?q=1#top",
        "": "http://ex.com/a/b/c.html?q=1", "HTTPS://O.org/./a/../b/.": "https://o.org/b/", "mailto:a@b": "mailto:a@b",
        " /für du ": "http://ex.com/f%C3%BCr%20du", "../../../..": "http://ex.com/", "javascript:go()": "javascript:go()",
    }
    df = spark.createDataFrame([(h, base) for h in cases], "h string, b string").select("h", resolve_url("h", "b"))
    assert dict(rows_of(df)) == cases
    assert spark.createDataFrame([("x", "")], "h string, b string").select(resolve_url("h", "b")).first()[0] is None


def test_valid_url_and_parts(spark):
    good = ["http://a.b", "https://u@a.b:80/x?y#z", "mailto:x", "http:a.b", "http://[::1]/"]
    bad = ["/x", "a.b", "", "http://", "http://a b/", "http://a:x/", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "u string").select(valid_url("u"))
    assert [r[0] for r in df.collect()] == [True] * len(good) + [False] * len(bad)
    df = spark.createDataFrame([("http://u@A.b:8/p/q?x#y",), ("http://a.b",)], "u string")
    assert rows_of(df.select(hostname("u"), pathname("u"))) == [("a.b", "/p/q"), ("a.b", "/")]
    assert df.select(is_external(F.lit("https://a.B/z"), "u")).first()[0] is False


def test_escape_css(spark):
    assert spark.range(1).select(escape_css(F.lit("it's \\ \"q\""))).first()[0] == "it\\'s \\\\ \"q\""


def test_css_escapes(spark):
    pairs = [("plain", "plain"), ("it's \\ \"x\"", "it\\'s \\\\ \"x\""), ("é/x", "\\E9/x"), ("éa", "\\E9 a"), ("é 1", "\\E9  1"), ("日本", "\\65E5\\672C"), ("\U0001f600!", "\\1F600!"), ("a\tb", "a\\9 b"), ("", "")]
    rows = spark.createDataFrame(pairs, "text string, want string")
    assert [r.got for r in rows.select(escape_css("text").alias("got")).collect()] == [want for _, want in pairs]
