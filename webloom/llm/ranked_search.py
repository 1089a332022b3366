"""Ranked lexical search: the best texts for each of a set of queries, by weighted term frequencies.

Method: term at a time with limited accumulators. The texts' postings for the queries' terms are written once, in
segments of many texts each. A segment takes a query's terms from the rarest to the most frequent. A term may open an
accumulator for each text that holds it, until the largest that the remaining terms can still add no longer reaches the
k-th best score so far; from then on the accumulators that exist, and could still get among the best, are updated
exactly and no other is opened. A task carries its k best rows per query from segment to segment, so its bound starts
high; the best rows of all tasks are ranked at the end.

A text's score is exact, in whole numbers: the sum over the query's distinct terms of
w * (1000000000 * tf div (1000 * tf + 8 * m)), where w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and
m = 10 + 90 * n * N div L. N: texts with a term; L: all terms; n: the text's terms; df: texts with the term.

The queries go to all tasks in blocks of about BLOCK_TERMS query terms, each block over all texts, so what a task holds
of them does not grow with their number.

Defined results: terms are runs of ASCII letters, digits and all characters beyond ASCII; A-Z counts as a-z. Null and
empty texts have no terms, are found by nothing and do not count in N. Queries that share an item_id (or have none) are
one query with the terms of all. Rows of texts are told apart row by row; equal scores are ordered by doc_id, null last.
Queries without terms, or whose terms no text holds, get no row; nor does anything if either table is empty. Extra
columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.words import rows_of
from webloom.plans.scale import stored

K = 10
BLOCK_TERMS = 200_000
#: A segment ends when it has so many postings or texts.
SEGMENT_POSTINGS, SEGMENT_TEXTS = 500_000, 32_768
#: Groups of tasks whose best rows are ranked first, before those of the groups are.
PARTS = 32
_NULL = (1 << 63) - 1  # a null doc_id, which comes last
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_SEGMENT = "texts bigint, tokens bigint, docs binary, lengths binary, terms binary, starts binary, places binary, tfs binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split(b" ")


def _counted(text: bytes) -> Counter:
    counts = Counter(terms_of(text))
    counts.pop(b"", None)
    return counts


class _Segment:
    """Postings of some texts: for each term the places of texts and its frequency there."""

    def __init__(self):
        self.docs, self.lengths, self.place, self.term, self.tf = [], [], [], [], []
        self.texts = self.tokens = 0

    def add(self, doc: int, counts: Counter, known: dict[bytes, int]) -> None:
        n = counts.total()
        if not n:
            return
        self.texts += 1
        self.tokens += n
        own = [(known[t], c) for t, c in counts.items() if t in known]
        if own:
            self.place += [len(self.docs)] * len(own)
            self.term += [t for t, _ in own]
            self.tf += [c for _, c in own]
            self.docs.append(doc)
            self.lengths.append(n)

    @property
    def full(self) -> bool:
        return len(self.tf) >= SEGMENT_POSTINGS or self.texts >= SEGMENT_TEXTS

    def packed(self) -> pa.RecordBatch:
        term = np.array(self.term, np.int32)
        order = np.argsort(term, kind="stable")
        terms, starts = np.unique(term[order], return_index=True)
        parts = {"docs": np.array(self.docs, np.int64), "lengths": np.array(self.lengths, np.int64), "terms": terms.astype(np.int32)}
        parts |= {"starts": np.append(starts, len(term)).astype(np.int64), "places": np.array(self.place, np.int32)[order], "tfs": np.array(self.tf, np.int32)[order]}
        columns = [pa.array([self.texts], pa.int64()), pa.array([self.tokens], pa.int64())]
        columns += [pa.array([part.tobytes()], pa.binary()) for part in parts.values()]
        return pa.RecordBatch.from_arrays(columns, names=["texts", "tokens", *parts])


def _postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Segments of the texts' postings for the known terms, and how many texts and terms they stand for."""

    def packed(rows):
        segment = _Segment()
        for batch in rows_of(rows, 128):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                segment.add(_NULL if doc is None else doc, _counted(text), known)
                if segment.full:
                    yield segment.packed()
                    segment = _Segment()
        if segment.texts:
            yield segment.packed()

    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(packed, _SEGMENT)


def _frequencies(segments: DataFrame, n_terms: int) -> np.ndarray:
    """The number of texts that hold each term: at most BLOCK_TERMS numbers."""

    def summed(rows):
        df = np.zeros(n_terms, np.int64)
        for batch in rows:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                df[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(starts, np.int64))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["term", "df"])

    rows = segments.select("terms", "starts").mapInArrow(summed, "term bigint, df bigint")
    df = np.zeros(n_terms, np.int64)
    for term, n in rows.groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def weights(df: np.ndarray, texts: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * texts + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Searcher:
    """Runs queries over segments, keeping the best rows of each query. Queries are arrays of term numbers."""

    def __init__(self, queries: list[np.ndarray], df: np.ndarray, texts: int, tokens: int, k: int):
        self.weights, self.texts, self.tokens, self.k = weights(df, texts), texts, tokens, k
        # The rarest first; equally rare ones by number, so that every task takes the same order.
        self.queries = [q[np.lexsort((q, df[q]))] for q in queries]
        # (score, -doc_id), the worst of the k best first.
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]

    def add(self, docs, lengths, terms, starts, places, tfs) -> None:
        """Search a segment."""
        tfs = tfs.astype(np.int64)
        m = 10 + 90 * lengths * self.texts // self.tokens
        gain = np.repeat(self.weights[terms], np.diff(starts)) * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[places]))
        most = np.maximum.reduceat(gain, starts[:-1]) if len(terms) else gain
        for number, query in enumerate(self.queries):
            spot = np.minimum(np.searchsorted(terms, query), len(terms) - 1)
            own = spot[terms[spot] == query] if len(terms) else spot[:0]
            if len(own):
                self._query(number, docs, [(places[starts[i] : starts[i + 1]], gain[starts[i] : starts[i + 1]]) for i in own], most[own])

    def _floor(self, floor: int, scores: np.ndarray) -> int:
        """The k-th best of the scores, or the bound there was if that is higher."""
        at = len(scores) - self.k
        return floor if at < 0 else max(floor, int(np.partition(scores, at)[at]))

    def _query(self, number: int, docs: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> None:
        best = self.best[number]
        # left[i]: the most that the terms from i on can add to a text.
        left = np.append(np.cumsum(most[::-1])[::-1], 0)
        floor = best[0][0] if len(best) == self.k else 0
        sums = np.zeros(len(docs), np.int64)
        opened = 0
        # A text without accumulator can get left[opened] at most; if that equals the k-th best, doc_id may decide.
        while opened < len(lists) and left[opened] >= max(floor, 1):
            place, gain = lists[opened]
            sums[place] += gain
            opened += 1
            # No partial score is above left[0] - left[opened], so before that the bound cannot close the list.
            if left[0] >= 2 * left[opened]:
                floor = self._floor(floor, sums)
        alive = np.flatnonzero(sums)
        score = sums[alive]
        for i in range(opened, len(lists)):
            # Survivors that cannot get among the best any more are dropped, the others updated exactly.
            fine = score + left[i] >= floor
            alive, score = alive[fine], score[fine]
            place, gain = lists[i]
            spot = np.minimum(np.searchsorted(place, alive), len(place) - 1)
            score = score + np.where(place[spot] == alive, gain[spot], 0)
            floor = self._floor(floor, score)
        fine = score >= self._floor(floor, score)
        for own, doc in zip(score[fine].tolist(), docs[alive[fine]].tolist(), strict=True):
            if len(best) < self.k:
                heapq.heappush(best, (own, -doc))
            elif (own, -doc) > best[0]:
                heapq.heapreplace(best, (own, -doc))


def _ranked(segments: DataFrame, queries: list[tuple[int | None, np.ndarray]], df: np.ndarray, texts: int, tokens: int, k: int) -> DataFrame:
    """The k best rows of each query in each task."""

    def searched(rows):
        searcher = Searcher([q for _, q in queries], df, texts, tokens, k)
        kinds = {"docs": np.int64, "lengths": np.int64, "terms": np.int32, "starts": np.int64, "places": np.int32, "tfs": np.int32}
        for batch in rows:
            for row in batch.to_pylist():
                searcher.add(*[np.frombuffer(row[c], kind) for c, kind in kinds.items()])
        for (item, _), best in zip(queries, searcher.best, strict=True):
            if best:
                ids = [None if doc == -_NULL else -doc for _, doc in best]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(best), pa.int64()), pa.array(ids, pa.int64()), pa.array([s for s, _ in best], pa.int64())], names=["item_id", "doc_id", "score"])

    rows = segments.select("docs", "lengths", "terms", "starts", "places", "tfs").mapInArrow(searched, "item_id bigint, doc_id bigint, score bigint")
    return rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))


def _query_terms(items: DataFrame) -> DataFrame:
    """item_id and the sorted distinct terms of its texts."""

    def split(rows):
        for batch in rows_of(rows):
            found = [sorted(_counted(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    each = texts.mapInArrow(split, "item_id bigint, terms array<binary>")
    return each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: for each item the k best of all texts with a score above 0.

    Items of one block share the pass over the texts.     """
    terms = stored(_query_terms(items), "query-terms")
    size = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // block_terms))
    found = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        rows = _block(docs, [(r["item_id"], list(map(bytes, r["terms"]))) for r in own], k)
        found = rows if found is None else found.unionAll(rows)
    # In two turns, since the best rows of all tasks grow with the data.
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for key in (["item_id", "part"], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    known = {term: number for number, term in enumerate(sorted({t for _, terms in items for t in terms}))}
    segments = stored(_postings(docs, known), "segments")
    totals = segments.agg(F.sum("texts"), F.sum("tokens")).first()
    queries = [(item, np.array([known[t] for t in terms], np.int32)) for item, terms in items]
    texts, tokens = (totals[0] or 0), (totals[1] or 0)
    return _ranked(segments, queries, _frequencies(segments, len(known)), texts, tokens, k)


def op11_ranked_search(spark, sf_dir):
    return search(*(spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark")))


_SQL_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))"

SQL = f"""
WITH words AS (SELECT doc_id, n_row, {_SQL_TERMS} AS term FROM (SELECT *, row_number() OVER () AS n_row FROM documents)),
postings AS (SELECT doc_id, n_row, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT n_row, sum(tf)::BIGINT AS n FROM postings GROUP BY n_row),
totals AS (SELECT count(*) AS texts, sum(n)::BIGINT AS tokens FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(texts) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
asked AS (SELECT DISTINCT item_id, {_SQL_TERMS} AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, n_row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * texts) // tokens))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (n_row), totals GROUP BY item_id, doc_id, n_row)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {K}
"""
