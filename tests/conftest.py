import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webloom.plans.nodes import parse  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("webloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def dom_of(spark):
    """Parse literal pages given as HTML strings or (url, html) pairs, numbered from 1."""

    def build(*pages):
        rows = []
        for i, page in enumerate(pages, 1):
            url, html = page if isinstance(page, tuple) else ("http://example.com/a/b.html", page)
            rows.append((i, url, html))
        return parse(spark.createDataFrame(rows, "page_id bigint, url string, html string"))

    return build


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
