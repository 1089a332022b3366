"""Helpers that keep plans whole and balanced on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rows of one key that a single sort may hold; keys with more are cut into ranges of about this size.
MAX_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as `spark.checkpoint.dir` names it.

    Only a session in one process may do without: it gets a temporary folder. A cluster that names none is an error,
    since each executor would write to its own disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="webloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: shorter lineage and fixed values."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `cut`, but as a Parquet table: columns that a later step does not use are not read again.

    The files stay in the shared folder, whose owner removes them with the checkpoints.
    """
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def merged(rows: DataFrame) -> DataFrame:
    """One side of a join on rows that come from pages: joined by sorting, never sent whole through the driver.

    Spark guesses the size of nodes, runs and requests from the stored table, which is many times smaller, and so takes
    millions of them for a table to broadcast.
    """
    return rows.hint("merge")


def worked_out(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The same rows, whose columns later filters do not work out a second time.

    A filter on a column moves below the projection that makes it, into the join before that, and works it out there as
    well. It cannot move below a generator, so the columns go through one that yields one row for each; `key` passes
    beside it and keeps its partitioning.
    """
    others = [c for c in rows.columns if c != key]
    boxed = rows.select(key, F.explode_outer(F.array(F.struct(*others))).alias("_row"))
    return boxed.select(*[c if c == key else f"_row.{c}" for c in rows.columns])


def range_cuts(rows: DataFrame, key: list[str], order: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """For keys with more than `max_rows` rows: `cuts`, the values of `order` at which to cut them into ranges.

    Cuts are approximate quantiles, so no range is much larger than `max_rows` whatever the key's share of the data.
    They come from sketches and are therefore written down; a task that runs again must not see others.
    """
    counts = rows.groupBy(*key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_rows)
    hot = rows.select(*key, order).join(counts, key)
    # 1,000 quantiles per hot key: a range holds max_rows or a thousandth of its key, whichever is more.
    points = hot.groupBy(*key).agg(
        F.max(F.ceil(F.col("_rows") / F.lit(max_rows))).alias("_share"),
        F.percentile_approx(order, [i / 1000 for i in range(1, 1000)], 10_000).alias("_points"),
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(1000) / F.col("_share"))).cast("int")
    chosen = F.array_distinct(F.filter("_points", lambda _, i: (i + 1) % step == 0))
    return cut(points.select(*key, chosen.alias("cuts")))


def number_rows(
    rows: DataFrame, key: list[str], order: str, name: str = "seq", max_rows: int = MAX_ROWS, then: list[str] | None = None
) -> DataFrame:
    """Number the rows of each key from 0 by `order`, a number, and the columns of `then`, together unique within the key.

    Hot keys are cut into ranges that are numbered apart and then shifted by the sizes of the ranges before; no task
    sorts a whole hot key.
    """
    cuts = range_cuts(rows, key, order, max_rows)
    within = [order, *(then or [])]
    if cuts.isEmpty():
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(*within)) - 1).cast("bigint"))
    part = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(order))), F.lit(0))
    parts = rows.join(cuts, key, "left").withColumn("_part", part).drop("cuts")
    sizes = parts.groupBy(*key, "_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*key, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*within)) - 1
    return (
        parts.withColumn("_local", local)
        .join(offsets, [*key, "_part"])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_part", "_local", "_before")
    )


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first `n` rows by the columns of `order` (nulls first), without a sort of all of them in one task.

    The rows are dealt into ranges of the order and written down; the ranges are counted, those that fit are taken
    whole, and only the one where `n` falls is numbered. Give it keys rather than wide rows where that is possible.
    Which of rows that are equal in all of `order` come first is not defined; make the order unique.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # One row per range.
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = sizes.select("_range", (F.lit(n) - before).alias("_left"), "_size").where("_left > 0")
    whole = ranged.join(left.where("_left >= _size").select("_range"), "_range", "left_semi")
    part = ranged.join(left.where("_left < _size").select("_range", "_left"), "_range")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return whole.drop("_range").unionByName(part.withColumn("_number", number).where("_number <= _left").drop("_range", "_left", "_number"))


def hot_keys(rows: DataFrame, key: str, max_rows: int = MAX_ROWS) -> DataFrame | None:
    """Keys with more than `max_rows` rows and the number of parts each should be dealt out over; None without any."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > max_rows)
    hot = cut(counts.select(key, F.ceil(F.col("_rows") / max_rows).cast("int").alias("_parts")))
    return None if hot.isEmpty() else hot


def skew_join(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, hot: DataFrame | None, how: str = "inner", also: list[str] | None = None
) -> DataFrame:
    """Join on `key` (and the columns of `also`) when one key may own a large share of `left`. Left rows of a hot key are
    dealt out by `spread_by` over its parts, and its right rows are copied to each part; other keys are joined as usual.

    Without hot keys this is the plain join, which leaves the partitioning of `right` alone. `hot` may come from any
    rows that include `left`.
    """
    if hot is None:
        return left.join(merged(right), [key, *(also or [])], how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("_parts").join(merged(copied.drop("_parts")), [key, *(also or []), "_part"], how).drop("_part")


def with_previous(
    rows: DataFrame, key: list[str], seq: str, payload: Column, back: int, name: str = "previous", block: int = 65_536
) -> DataFrame:
    """Add the payloads of the `back` rows before each row, latest first, as an array.

    `seq` numbers a key's rows 0, 1, 2, ... Each key is cut into blocks of positions, and the last rows of a block
    are also sent to the next one; so a key with a third of all rows still spreads over the cluster.
    """
    here = F.floor(F.col(seq) / block)
    spill = F.col(seq) % block >= block - back
    places = F.when(spill, F.array(F.struct(here.alias("block"), F.lit(True).alias("own")), F.struct((here + 1).alias("block"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(here.alias("block"), F.lit(True).alias("own")))
    )
    spread = rows.withColumn("_place", F.explode(places)).withColumn("_payload", payload)
    spread = spread.select(*rows.columns, "_payload", F.col("_place.block").alias("_block"), F.col("_place.own").alias("_own"))
    window = Window.partitionBy(*key, "_block").orderBy(seq)
    lags = F.array_compact(F.array(*[F.lag("_payload", i).over(window) for i in range(1, back + 1)]))
    return spread.withColumn(name, lags).where("_own").drop("_payload", "_block", "_own")
