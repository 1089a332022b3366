"""Writing results as jsonl, json or csv folders."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.plans.scale import cut

FORMATS = ("json", "jsonl", "csv")


class OutputWriter:
    """Writes `directory/filename.format`, which is a folder of part files."""

    def __init__(self, target: dict[str, Any] | None = None):
        target = target or {}
        now = int(time.time() * 1000)
        self.format = target.get("format") or "jsonl"
        if self.format not in FORMATS:
            raise ValueError(f"unknown format: {self.format}")
        name = (target.get("filename") or f"scrape_{now}").replace("{timestamp}", str(now))
        self.path = f"{target.get('directory') or 'data'}/{name}.{self.format}"
        self.group_by = target.get("groupBy")
        # Unless a target says otherwise, metadata goes where it can: into a json document.
        self.metadata = target.get("includeMetadata")

    def write(self, rows: DataFrame, summary: DataFrame | None = None, order: list[str] | None = None) -> str:
        """Write the rows. A json document also holds the one-row summary, unless includeMetadata is false, and is sorted
        by `order` (nulls first; rows that are equal there in any order); jsonl and csv keep whatever order the rows
        have, and the summary goes to a folder beside them, `.metadata.json`, if includeMetadata is true."""
        if self.metadata and summary is not None and self.format != "json":
            summary.write.mode("overwrite").json(f"{self.path}.metadata.json")
        if self.format == "json":
            self._write_document(rows, None if self.metadata is False else summary, order or ["page_id", "pos"])
        elif self.format == "jsonl":
            self._writer(rows).json(self.path)
        else:
            options = {"header": True, "escape": '"', "nullValue": "", "emptyValue": ""}
            self._writer(flat(rows)).options(**options).csv(self.path)
        return self.path

    def _writer(self, rows: DataFrame):
        writer = rows.write.mode("overwrite")
        if self.group_by and self.group_by in rows.columns:
            writer = writer.partitionBy(self.group_by)
        return writer

    def _write_document(self, rows: DataFrame, summary: DataFrame | None, order: list[str]) -> None:
        """The part files, read one after the other, are one JSON document; no task ever holds all of it."""
        spark = rows.sparkSession
        pretty = F.to_json(F.struct(*rows.columns), {"pretty": "true"})
        # Sorted and written down once; ids grow from part to part, so the least one marks the first row.
        lines = cut(rows.orderBy(*order).select(pretty.alias("row")).withColumn("at", F.monotonically_increasing_id()))
        first = lines.agg(F.min("at")).first()[0]
        body = lines.select(F.concat(F.when(F.col("at") == F.lit(first), F.lit("")).otherwise(F.lit(",")), "row").alias("value"))
        opening = spark.range(0, 1, 1, 1).select(F.lit('{"data": [').alias("value"))
        if summary is None:
            closing = spark.range(0, 1, 1, 1).select(F.lit("]}").alias("value"))
        else:
            row = F.to_json(F.struct(*summary.columns), {"pretty": "true"})
            closing = summary.select(F.concat(F.lit('], "metadata": '), row, F.lit("}")).alias("value"))
        opening.unionByName(body).unionByName(closing).write.mode("overwrite").text(self.path)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text; csv has no other way to hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return rows.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema]
    )
