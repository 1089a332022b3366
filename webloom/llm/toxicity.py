"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Method: each text becomes the set of hashed words, pairs of neighbours and pairs with one word between. FTRL-proximal
gives every coordinate its own rate and, by its L1 term, leaves most weights exactly zero; the rest is compact (at most
2**BITS numbers, whatever the data) and goes to all tasks with the scoring function.

Learning uses a bounded, documented sample (MAX_EXAMPLES) of labelled rows, chosen by a hash of doc_id; scoring covers
every row.

Defined results: a null or empty text is scored by the intercept alone. Rows without label, with a null label or null
doc_id teach nothing (a null doc_id is not held out either); several labels of one document count as toxic if one of them does. Without any example every
score is 0. Repeated rows are scored row by row; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import chained, freed, freeing, remainder, rows_of, word_ids

BITS = 20
MAX_EXAMPLES = 20_000
EPOCHS = 5
#: Rate, smoothing of the rate, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
_SLICES = 1 << 20
#: ASCII punctuation becomes space, so that a word is the same before a comma.
_BARE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Distinct hashed features of a text: words, pairs of neighbours, and pairs with one word between."""
    ids = word_ids(text.translate(_BARE))
    found = [chained([ids], 1)]
    found += [chained([ids[:-step], ids[step:]], 1 + step) for step in (1, 2) if len(ids) > step]
    return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int32))


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (places and values) and the intercept, from examples in the given order.

    The intercept is a coordinate like the others but without L1.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(at):
        over = np.maximum(np.abs(z[at]) - l1[at], 0.0)
        return -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, label in examples:
            at = np.append(at, size)
            w = weights(at)
            wrong = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = n[at] + wrong * wrong
            z[at] += wrong - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    every = weights(np.arange(size + 1))
    at = np.flatnonzero(every[:size])
    return at.astype(np.int32), every[at], float(every[size])


class Model:
    """Weights for all tasks."""

    def __init__(self, at: np.ndarray, values: np.ndarray, intercept: float):
        self.at, self.values, self.intercept = at, values.astype(np.float32), intercept
        self._dense = None

    def __getstate__(self):
        return {**self.__dict__, "_dense": None}

    def score(self, text: str | None) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.values
        total = self.intercept + float(self._dense[features((text or "").encode())].sum(dtype=np.float64))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit on the labelled rows for which `learn` (over doc_id) holds, or on a sample of them of about `max_examples`.

    The sample's ids are few (see the bound), so they go to the texts and no text is shuffled but the sample.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    marked = marked.where(F.lit(True) if learn is None else learn)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Ids are spread over the slices by a hash, so the sample has about this size and is the same in every run.
    share = min(_SLICES, int(_SLICES * max_examples / max(1, marked.count())))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES)) < share)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    examples = texts.join(F.broadcast(chosen), "doc_id")

    def hashed(batches):
        for batch in rows_of(batches):
            found = [features(text.encode()).tobytes() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])
        freed()

    def fitted(table: pa.Table) -> pa.Table:
        # An order that has nothing to do with the ids, the same in every run.
        order = np.argsort(chained([table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)]), kind="stable")
        rows = list(zip(table.column("found").to_pylist(), table.column("toxic").to_pylist(), strict=True))
        at, values, intercept = fit([(np.frombuffer(rows[i][0], np.int32), int(rows[i][1] > 0)) for i in order])
        return pa.table({"at": [at.tobytes()], "weights": [values.tobytes()], "intercept": [intercept]}, schema=pa.schema([("at", pa.binary()), ("weights", pa.binary()), ("intercept", pa.float64())]))

    rows = examples.mapInArrow(hashed, "doc_id bigint, toxic int, found binary")
    # One group, bounded by max_examples.
    model = rows.groupBy(F.lit(0).alias("one")).applyInArrow(freeing(fitted), "at binary, weights binary, intercept double").collect()
    if not model:
        return Model(np.zeros(0, np.int32), np.zeros(0), -35.0)
    return Model(np.frombuffer(model[0][0], np.int32), np.frombuffer(model[0][1], np.float64), model[0][2])


def scorer(model: Model):
    """A column function: the probability that a text is toxic."""

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        scores = pd.Series([model.score(text) for text in texts], dtype="float64")
        freed()
        return scores

    return toxicity


def _learn() -> Column:
    return remainder(F.col("doc_id"), 5) != 0


def op9_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    score = scorer(train(docs, labels, _learn()))
    rows = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def stage(spark, docs, sf_dir):
    """Documents without those that are rather toxic than not."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _learn())
    return docs.where(scorer(model)(docs["text"]) < 0.5)
