"""Long values, large numbers and missing limits: nothing is cut or left out."""

import pytest

from webloom.functions.text import decode_entities
from webloom.functions.url import valid_url
from webloom.operators.crawl import crawl, url_page_numbers
from webloom.operators.scrape import select_pages


def test_long_references_and_texts(spark):
    texts = ["&#" + "0" * 50 + "65;", "&ampx" + "y" * ((1 << 20) + 5)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_entities("t").alias("t")).collect()
    assert rows[0].t == "A"
    assert rows[1].t == "&x" + "y" * ((1 << 20) + 5)


def test_large_page_numbers(spark):
    pages = spark.createDataFrame([(1, "http://e.com/l?page=12345678901"), (2, "http://e.com/l?page=12345678902")], "page_id bigint, url string")
    found = {r.page_id: (r.page_number, r.has_next_page) for r in url_page_numbers(pages).collect()}
    assert found == {1: (12345678901, True), 2: (12345678902, False)}


@pytest.mark.parametrize("limit,reached", [(None, 5), (0, 1), (2, 3)])
def test_depth_is_unlimited_unless_given(spark, limit, reached):
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(4)], "source string, target string")
    seeds = spark.createDataFrame([("u0",)], "url string")
    assert crawl(edges, seeds, limit).count() == reached


def test_no_pages_are_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://e.com/", "<p>")], "page_id bigint, url string, html string")
    assert select_pages(pages, {"target": {"maxPages": 0}}).count() == 0
    assert select_pages(pages, {"target": {}}).count() == 1


def test_ports(spark):
    urls = ["http://e.com:99999/", "http://e.com:65535/", "http://e.com:065536/", "http://e.com:/", "http://e.com:00080/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(valid_url("u").alias("v")).collect()
    assert [r.v for r in rows] == [False, True, False, True, True]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from webloom.plans.scale import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
