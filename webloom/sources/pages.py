"""Stored pages as input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """`pages(page_id, url, html)` from parquet, JSON lines, or a folder of HTML files.

    HTML files get their path as URL and a hash of it as page_id.
    """
    if format == "text":
        files = spark.read.text(path, wholetext=True)
        name = F.col("_metadata.file_path")
        return files.select(F.xxhash64(name).alias("page_id"), name.alias("url"), F.col("value").alias("html"))
    if format == "json":
        return spark.read.schema("page_id bigint, url string, html string").json(path)
    return spark.read.format(format).load(path).select("page_id", "url", "html")
