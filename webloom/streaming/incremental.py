"""Pages that keep arriving: the batch operators, run per micro-batch.

Parsing uses row-ordered windows, which streams do not have, so each micro-batch is parsed as a table of its own; a page
never spans two batches. Files written per batch carry the batch number, so a batch that runs again replaces its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.plans.nodes import Dom, parse

PAGE_SCHEMA = "page_id bigint, url string, html string"


def page_stream(
    spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int | None = None, more: str | None = None
) -> DataFrame:
    """Stored pages as a stream of files; `more` names further columns, such as `fetched_at timestamp`."""
    reader = spark.readStream.format(format).schema(PAGE_SCHEMA + (f", {more}" if more else ""))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def extract_stream(
    pages: DataFrame,
    extractor: Callable[[Dom], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
    partitions: int | None = None,
    latest_by: str | None = None,
) -> StreamingQuery:
    """Run an extractor over every micro-batch of pages and append its rows below `out`.

    Of several versions of a page in one batch the one with the greatest `latest_by` counts, say the time it was
    fetched; among equals, or without such a column, the one that sorts last, in every run the same. Pages without id
    are left out, as `parse` does. `partitions` as for `parse`.
    """
    order = [F.col(latest_by).alias("at")] if latest_by else []

    def write(batch: DataFrame, number: int) -> None:
        versions = batch.where("page_id is not null").groupBy("page_id").agg(F.max(F.struct(*order, "url", "html")).alias("page"))
        rows = extractor(parse(versions.select("page_id", "page.url", "page.html"), partitions))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
