"""Language of a text by rank order: its most frequent n-grams against those of each language.

Method (out-of-place distance): a language's profile is its KEPT most frequent letter n-grams (one to three letters,
with word edges), most frequent first, ties by n-gram. A text's profile is made alike. The distance adds up, over the
text's n-grams, how many places apart they stand in both profiles, or KEPT if the language lacks one. The nearest
language wins, the first by name among equals.

Profiles are counted over all texts that may teach. The words of a partition are counted first and cut into n-grams
once per distinct word.

Defined results: a null text or one without letters is `und` with score 0, and so is any text if there is no language
to choose from. The score is the share by which the nearest language is closer than the farthest possible one. Rows
with null language teach nothing; repeated rows count and are answered each; extra columns are not looked at.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import remainder, rows_of

KEPT = 300
_WORDS = regex.compile(r"\p{L}+").findall
_EDGE = 1  # stands for a word's edge; no letter has this number
_DISTINCT = 100_000  # words held at a time while counting
_SHIFT = np.uint64(21)


def _codes(words: list[str]) -> np.ndarray:
    """Code points of the words with one edge before, between and after them."""
    text = "\x01" + "\x01".join(words) + "\x01"
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _grams(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of one to three characters as numbers, and the place at which each begins. None spans an edge."""
    letter = a != _EDGE
    pairs = (a[:-1] << _SHIFT) | a[1:]
    triples = (pairs[:-1] << _SHIFT) | a[2:]
    one, three = np.flatnonzero(letter), np.flatnonzero(letter[1:-1])
    return np.concatenate([a[one], pairs, triples[three]]), np.concatenate([one, np.arange(len(pairs)), three])


def _top(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.lexsort((grams, -counts))[:KEPT]]


def profile(text: str) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first; none without a letter."""
    words = _WORDS(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    return _top(*np.unique(_grams(_codes(words))[0], return_counts=True))


def _counted(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of distinct words and how often they occur, given how often each word does."""
    codes = _codes(list(words))
    lengths = np.fromiter((len(word) + 1 for word in words), np.int64, len(words))
    weights = np.repeat(np.fromiter(words.values(), np.float64, len(words)), lengths)
    grams, at = _grams(codes)
    found, places = np.unique(grams, return_inverse=True)
    # An n-gram that begins with an edge belongs to the word after it.
    return found, np.bincount(places, weights[np.minimum(at, len(weights) - 1)]).astype(np.int64)


def profiles(taught: DataFrame) -> dict[str, np.ndarray]:
    """Profiles of the languages in (lang, text): at most KEPT n-grams per language reach the driver."""

    def counted(batches):
        held: dict[str, Counter] = {}
        for batch in rows_of(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(_WORDS(text.lower()))
            if sum(map(len, held.values())) > _DISTINCT:
                yield from _emitted(held)
                held = {}
        yield from _emitted(held)

    rows = taught.select("lang", "text").dropna().mapInArrow(counted, "lang string, gram bigint, n bigint")
    sums = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Partial aggregates of bounded size choose the top: no task sorts a whole language.
    rank = F.row_number().over(_by_count())
    best = sums.withColumn("rank", rank).where(F.col("rank") <= KEPT)
    found: dict[str, list] = {}
    for lang, gram, _ in sorted(best.select("lang", "gram", "rank").collect(), key=lambda r: (r[0], r[2])):
        found.setdefault(lang, []).append(gram)
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in found.items()}


def _by_count():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


def _emitted(held: dict[str, Counter]):
    for lang, words in held.items():
        if words:
            grams, counts = _counted(words)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


class Judge:
    """All languages' profiles as one table: n-grams sorted, and each one's rank in every language."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(by_lang)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *by_lang.values()]))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, by_lang[lang]), k] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(text or "")
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        apart = np.where(ranks < 0, KEPT, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1.0 - apart[best] / (KEPT * len(own)))


def predictor(judge: Judge):
    @F.pandas_udf("lang_pred string, score double")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge.predict(text) for text in texts], columns=["lang_pred", "score"])

    return language


def op7_langid(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder(F.col("doc_id"), 4) == 2
    judge = Judge(profiles(docs.where(~held_out)))
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), predictor(judge)("text").alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
