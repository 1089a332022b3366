"""Proportional stratified interleaving of rows into shards.

Method: the rows of each source are ranked in a seeded random order; rank r of n gets the fractional rank
(2r - 1) / 2n. All rows sorted by fractional rank interleave the sources in proportion, so any cut of that order matches
the mixture. Cuts at equal counts give shards of sizes at most one apart.

Both rankings are made in ranges (of the random order, of the fractional rank) that are counted first: a range's rows
are numbered by themselves and shifted by what comes before. No task holds a whole source or shard.

Defined results: null sources form one source; null texts have 0 bytes; rows with equal or null doc_id are ordered by
their text's hash, and rows that are equal in all of these are interchangeable. An empty table gives no rows. Extra
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of a range that is numbered by one task.
RANGE_ROWS = 5_000
SEED = 17


def _numbered(rows: DataFrame, key: list[str], range_of: str, order: list, name: str) -> DataFrame:
    """Number the rows of each key from 0 in the order of ranges and, within a range, of `order`."""
    local = F.row_number().over(Window.partitionBy(*key, range_of).orderBy(*order)) - 1
    sizes = rows.groupBy(*key, range_of).agg(F.count("*").alias("_size"))
    # One row per range here, so even a hot key's ranges are few.
    before = Window.partitionBy(*key).orderBy(range_of).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return rows.withColumn("_local", local).join(starts, [*key, range_of]).withColumn(name, F.col("_local") + F.col("_start")).drop("_local", "_start")


def interleave(docs: DataFrame, shards: int, seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard (from 0) and slot (from 0 within the shard) for every row."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
        F.col("source").isNull().alias("_null"),
        (F.length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_random"),
    )
    total = docs.count()
    ranges = max(1, -(-total // range_rows))
    spread = F.conv(F.substring("_random", 1, 9), 16, 10).cast("bigint")
    rows = rows.withColumn("_range", F.shiftright(spread * ranges, 36))
    key, order = ["_name", "_null"], ["_random", "doc_id", "text_crc32", "size"]
    ranked = _numbered(rows, key, "_range", order, "_rank").drop("_range")
    counts = rows.groupBy(*key).agg(F.count("*").alias("_of"))
    ranked = ranked.join(counts, key).withColumn("_fraction", (2 * F.col("_rank") + 1) / (2 * F.col("_of")))
    ranked = ranked.withColumn("_range", F.floor(F.col("_fraction") * ranges).cast("bigint")).withColumn("_all", F.lit(0))
    placed = _numbered(ranked, ["_all"], "_range", ["_fraction", "_random", "_null", "_name", "doc_id", "text_crc32", "size"], "_at")
    # Shard s takes the places from ceil(s * total / shards) on; whole numbers throughout.
    shard = F.expr(f"_at * {shards} div {max(1, total)}")
    slot = F.expr(f"_at - (shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")


def op6_shards(spark, sf_dir):
    rows = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
