"""Language-model scoring with a hierarchical Pitman-Yor model.

Model. Words are drawn in restaurants: one per context (the word before, or the start of a text), however rare, all
with one parent, the restaurant without context, above a uniform distribution over the known words and one unknown. In
each restaurant customers (tokens) sit at tables by the Chinese-restaurant rule with discount, and each table is a
customer of the parent. Seatings are resampled by Gibbs sweeps: all customers of a word in a restaurant leave and are
seated again given everyone else. SAMPLES sweeps after BURN_IN are averaged: what a word's own customers weigh in a
restaurant, what a new table weighs there, and the word's probability without context. The logarithm of the
probability that these give is the score.

How it runs. A chunk of texts, bounded in rows and bytes, tells its distinct pairs of context and word apart and asks
for each once; its training texts' counts go along. Everything about a word lives in one bucket of words, whatever the
contexts, so a bucket sweeps by itself and knows its words' parent counts exactly. Words that make up more than 1 / HOT
of all tokens (at most HOT words) would fill a bucket: their pairs are dealt out by the context instead. All seatings
are drawn anew at once from those of the sweep before, each without its own customers; sums that reach beyond the
bucket are estimated during the sweeps: over all words and for hot words from the bucket's share, the tables of a
restaurant from those seen and its number of customers (exact for the CONTEXTS most frequent words, else the largest
in one of CELLS cells of words). After the sweeps the true totals are summed: those of a restaurant in the bucket of
its word, the rest on the driver. They give proper probabilities. A bucket answers a chunk with packed rows: what its
pairs weigh, and for each word its count, probability without context and new tables as a context. The chunk, which
wrote down its tokens, adds up its texts. So rows are counted by chunks and buckets, and no text
or token travels by itself.

Defined results: a null or empty text is one end token. Without training text the base is uniform. Rows with null
doc_id are not held out. Equal rows are scored each. A very long text is a chunk by itself. Extra columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import freed, freeing, mixed, remainder, repeated, rows_of, word_ids
from webloom.plans.scale import merged, stored

#: Frequent words, which travel as numbers of two bytes when they are contexts; cells of counts; the share of hot words.
CONTEXTS, CELLS, HOT = 60_000, 1 << 22, 1024
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Training tokens that a bucket of words stands for, and the rows and bytes of a chunk of texts.
BUCKET_TOKENS = 3_000_000
CHUNK_ROWS, CHUNK_BYTES = 4096, 8_000_000
#: The end of a text as a word; no word holds a line break.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
#: The context that texts begin in, and the numbers that stand for it and for words that are not frequent.
START = np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
_STARTS, _RARE = 65_534, 65_535
#: In estimates of a restaurant's tables, the customers' worth of what is common among restaurants of its size.
_PRIOR = 8.0
_SOME = 1 << 16  # cells of a row on their way to the driver
_SINGLY = 32  # customers of a word seated one by one; the following in growing blocks


def _tokens(text: bytes) -> np.ndarray:
    return np.append(word_ids(text), END)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, after their size; the high bytes of most are alike."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


class Vocabulary:
    """The frequent words and the hot words, both sorted, and about how often each word stands in training texts."""

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, hot: np.ndarray, cells: bytes):
        order = np.argsort(contexts)
        self.contexts, self.counts, self.hot, self.cells = contexts[order], counts[order], np.sort(hot), cells
        # The more frequent, the smaller the number, so that most have the same high byte.
        self.by_number = np.lexsort((self.contexts, -self.counts))
        self.number_of = np.argsort(self.by_number)

    @staticmethod
    def _find(known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        return np.where(known[at] == ids, at, -1)

    def hot_of(self, ids: np.ndarray) -> np.ndarray:
        return self._find(self.hot, ids)

    def numbers(self, ids: np.ndarray) -> np.ndarray:
        """The two bytes that stand for each context."""
        at = self._find(self.contexts, ids)
        number = np.where(at >= 0, self.number_of[at], _RARE) if len(self.contexts) else _RARE
        return np.where(ids == START, _STARTS, number).astype(np.uint16)

    def ids(self, numbers: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The contexts that numbers stand for; `rare` holds those without."""
        known = np.append(self.contexts[self.by_number], START)
        ids = known[np.minimum(numbers, len(known) - 1)]
        ids[numbers == _RARE] = rare
        return ids

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """How often each word stands in training texts, for words that are not frequent an estimate."""
        at = self._find(self.contexts, ids)
        cells = np.frombuffer(self.cells, np.uint8)
        about = 2.0 ** (cells[(ids % np.uint64(CELLS)).astype(np.int64)] / 8) if len(cells) else np.ones(len(ids))
        return np.where(at >= 0, self.counts[at], about) if len(self.counts) else about


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, int]:
    """From the training rows of (doc_id, held_out, text): the vocabulary and the number of all tokens.

    Words are counted exactly, however thinly they are spread over the data.
    """

    def counted(batches):
        tokens = (_tokens(text) for batch in rows_of(batches) for text in batch.column("text").to_pylist())
        for ids, counts, seen in repeated(tokens, None):
            ids, counts = np.append(ids.view(np.int64), 0), np.append(counts, seen).astype(np.int64)
            total = np.zeros(len(ids), bool)
            total[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(total)], names=["id", "n", "total"])
        freed()

    def packed(table: pa.Table) -> pa.Table:
        held = np.zeros(_SOME, np.uint8)
        levels = np.minimum(np.rint(8 * np.log2(table.column("n").to_numpy())), 255).astype(np.uint8)
        np.maximum.at(held, table.column("cell").to_numpy() % _SOME, levels)
        return pa.table({"part": table.column("part")[:1], "held": pa.array([held.tobytes()], pa.binary())})

    sums = docs.where("NOT held_out").select("text").mapInArrow(counted, "id bigint, n bigint, total boolean").groupBy("id", "total").agg(F.sum("n").alias("n"))
    sums = stored(sums, "word-counts")
    size = int(sums.where("total").agg(F.sum("n")).first()[0] or 0)
    known = sums.where("NOT total")
    # As many frequent words as have numbers, whole classes of equally frequent ones.
    often = known.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    fit = np.cumsum(often.column("words").to_numpy()) <= CONTEXTS
    least = int(often.column("n").to_numpy()[fit][-1]) if fit.any() else size + 1
    top = known.where(F.col("n") >= least).select("id", "n").toArrow()
    ids, n = top.column("id").to_numpy().view(np.uint64), top.column("n").to_numpy()
    cell = F.pmod("id", F.lit(CELLS).cast("bigint"))
    # A cell without any stands for words that are met once.
    rare = known.where((F.col("n") < least) & (F.col("n") > 1)).select(cell.alias("cell"), "n")
    rows = rare.withColumn("part", F.floor(F.col("cell") / _SOME)).groupBy("part").applyInArrow(freeing(packed), "part bigint, held binary").collect()
    parts = {row.part: bytes(row.held) for row in rows}
    cells = b"".join(parts.get(k, bytes(_SOME)) for k in range(CELLS // _SOME)) if parts else b""
    often = known.where(F.col("n") * HOT > size).select("id").toArrow()
    return Vocabulary(ids, n, often.column("id").to_numpy().view(np.uint64), cells), size


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most CHUNK_ROWS texts and about CHUNK_BYTES, or a single longer text."""
    for batch in rows_of(batches, CHUNK_ROWS):
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)


_EVENTS = pa.schema([
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("times", pa.binary()), ("context", pa.binary()), ("rare", pa.binary()), ("counts", pa.binary()),
    ("tokens", pa.binary()), ("buckets", pa.binary()), ("lengths", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
])
_EVENT_TYPES = "bucket int, chunk bigint, ids binary, times binary, context binary, rare binary, counts binary, tokens binary, buckets binary, lengths binary, doc_ids array<bigint>, held_out array<boolean>"


def _bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(ids) % np.uint64(buckets)).astype(np.int64)


def _pairs(word: np.ndarray, lengths: np.ndarray, own: np.ndarray, hot: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The distinct pairs of a chunk in the order of its questions, as bucket, word and context, and the pair of each token.

    `word` is the number of each token's word, and `own` the bucket of each word; the start of a text has the next number.
    """
    before = np.roll(word, 1)
    before[np.cumsum(lengths) - lengths] = len(own)
    n = len(own) + 1
    codes = np.where(hot[word], np.append(own, _bucket_of(START[None], buckets))[before], own[word])
    codes = (codes * n + word) * n + before
    del before
    codes, pairs = np.unique(codes, return_inverse=True)
    return codes // (n * n), (codes // n % n).astype(np.int32), (codes % n).astype(np.int32), pairs.astype(np.uint32)


def _events(docs: DataFrame, words: Vocabulary, buckets: int) -> DataFrame:
    """What chunks ask and teach, by bucket, and the chunks themselves, packed.

    Per chunk and bucket: the distinct words, in how many contexts each stands, those contexts, and how often each pair
    stands in training texts. Per chunk a row without bucket: the tokens as numbers of words, the buckets of those (and
    as many more for hot ones), from which the order of the questions follows, and the length and ids of the texts.
    Chunks are numbered within this table, so it must be written down.
    """

    def packed(rows):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(_chunks(rows)):
            chunk = task << 33 | number
            texts = [_tokens(text) for text in batch.column("text").to_pylist()]
            lengths = np.array([len(t) for t in texts])
            train = np.repeat(~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool), lengths)
            ids, word, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
            del texts
            # The more frequent, the smaller the number.
            order = np.argsort(-times, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, word = ids[order], rank[word]
            own, hot = _bucket_of(ids, buckets), words.hot_of(ids) >= 0
            bucket, asked, context, pairs = _pairs(word, lengths, own, hot, buckets)
            counts = np.bincount(pairs, train, len(bucket)).astype(np.uint32)
            del train, pairs, order, rank
            contexts = np.append(ids, START)
            numbers = words.numbers(contexts)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            out = []
            for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                if i < j:
                    which, times = np.unique(asked[i:j], return_counts=True)
                    at = numbers[context[i:j]]
                    row = {"ids": ids[which], "times": times.astype(np.uint32), "context": at, "rare": contexts[context[i:j]][at == _RARE], "counts": counts[i:j]}
                    out.append({"bucket": b, "chunk": chunk} | {c: _pack(v) for c, v in row.items()})
            out.append({
                "chunk": chunk, "tokens": _pack(word.astype(np.uint32)), "buckets": _pack((own + buckets * hot).astype(np.uint32)), "lengths": _pack(lengths.astype(np.uint32)),
                "doc_ids": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(),
            })
            del word, bucket, asked, context, counts
            yield pa.RecordBatch.from_pylist(out, schema=_EVENTS)
            del out
            pa.default_memory_pool().release_unused()
        freed()

    return docs.mapInArrow(packed, _EVENT_TYPES)


def seated(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, grown: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables after seating the customers of each word, `new` being the weight of a new table while they have none.

    With k customers at t tables a new table weighs a = new + grown * t, and the next customer takes one with
    probability a / (a + k - discount * t). Customers from number _SINGLY on come in blocks of an eighth of those seated.
    """
    order = np.argsort(-customers, kind="stable")
    c, a, more = customers[order], new[order], np.broadcast_to(grown, new.shape)[order]
    t = (c > 0).astype(np.float64)
    k, most = 1, int(c[0]) if len(c) else 0
    while k < most:
        n = int(np.searchsorted(-c, -k, side="left"))  # those with more than k customers
        step = 1 if k < _SINGLY else k // 8
        weight = a[:n] + more[:n] * t[:n]
        p = weight / (weight + k - discount * t[:n])
        t[:n] += rng.random(n) < p if step == 1 else rng.binomial(np.minimum(step, c[:n] - k), np.minimum(p, 1.0))
        k += step
    found = np.empty(len(c))
    found[order] = t
    return found


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip((once + 1) / (once + 2 * twice + 2), 0.1, 0.95))


def _bucket(table: pa.Table, vocabulary: Vocabulary, buckets: int) -> dict:
    """Counts and sampled seatings of a bucket's words, and the pairs that each chunk asks for."""
    of = lambda c, kind: [_unpack(v, kind) for v in table.column(c).to_pylist()]
    ids, times, numbers = of("ids", np.uint64), of("times", np.uint32), of("context", np.uint16)
    chunks = np.array(table.column("chunk").to_pylist(), np.int64)
    n_words, n_pairs = np.array([len(x) for x in ids], np.int32), np.array([len(x) for x in numbers], np.int32)
    words, asked = np.unique(np.concatenate(ids), return_inverse=True)
    times, asked = np.concatenate(times), asked.astype(np.int32)
    contexts, place = np.unique(vocabulary.ids(np.concatenate(numbers), np.concatenate(of("rare", np.uint64))), return_inverse=True)
    del ids, numbers
    pairs, pair = np.unique(np.repeat(asked, times).astype(np.int64) * len(contexts) + place, return_inverse=True)
    pair = pair.astype(np.int32)
    word, place = np.divmod(pairs, len(contexts))
    del pairs
    c = np.bincount(pair, np.concatenate(of("counts", np.uint32)), len(word)).astype(np.int64)
    total, customers = (np.bincount(at, c, n).astype(np.int64) for at, n in ((word, len(words)), (place, len(contexts))))
    rng = np.random.default_rng(int(table.column("bucket")[0].as_py()))
    hot = vocabulary.hot_of(words) >= 0
    # Of a hot word this is one bucket's share; of the sums over all words so are the other words.
    share, rest = np.where(hot, float(buckets), 1.0), np.where(hot, 1.0, float(buckets))
    d, d1 = _discount(c), _discount(total[~hot])
    uniform = 1.0 / (buckets * max(1, int((total[~hot] > 0).sum())) + 1)
    about = np.where(contexts == START, buckets * customers, np.maximum(vocabulary.counts_of(contexts), customers))
    size = np.log2(np.maximum(about, 1.0)).astype(np.int64)
    tables, tables1 = (c > 0).astype(np.float64), (total > 0).astype(np.float64)
    seats, samples = np.zeros(len(c)), []
    for sweep in range(BURN_IN + SAMPLES):
        # Everyone else, as a pair's customers see it: the restaurant and the parent without the pair's own tables.
        here = np.bincount(place, tables, len(contexts))
        common = np.bincount(size, here) / np.maximum(np.bincount(size, customers), 1.0)
        elsewhere = (about - customers) * (here + _PRIOR * common[size]) / (customers + _PRIOR)
        others = STRENGTH + d * np.maximum((here + elsewhere)[place] - tables, 0.0)
        sent = np.bincount(word, tables, len(words)) * share
        left = sent[word] - tables
        weight1 = STRENGTH + d1 * (rest * tables1).sum()
        parent = (left - d1 * np.minimum(tables1[word], left) + weight1 * uniform) / np.maximum(STRENGTH + (rest * sent).sum() - tables, STRENGTH)
        tables = seated(c, others * parent, d, rng, d * parent)
        sent = np.bincount(word, tables, len(words))
        tables1 = seated((sent * share).astype(np.int64), (weight1 - d1 * tables1) * uniform, d1, rng, d1 * uniform)
        if sweep >= BURN_IN:
            seats += tables
            samples.append((sent, d1 * tables1))
    kept = {"chunks": chunks, "n_words": n_words, "n_pairs": n_pairs, "times": times, "pair": pair}
    # Customers of the pairs and their tables in all samples; with the discount they tell what they weigh.
    kept["seated"], kept["seats"], kept["discount"] = c.astype(np.uint32), seats.astype(np.uint32), np.array([d])
    # The words, and which of them each chunk asks for, in its order; then what they weigh in the parent, per sample.
    kept |= {"words": words, "asked": asked, "total": total}
    kept["parent"] = np.stack([s - t for s, t in samples]).astype(np.float32)
    # Restaurants: customers and tables.
    mine = np.flatnonzero(customers)
    kept["contexts"] = np.diff(contexts[mine], prepend=np.uint64(0))
    kept["customers"], kept["filled"] = customers[mine], np.bincount(place, seats, len(contexts))[mine].astype(np.int64)
    # Sums over the other words, and the hot words' own: number, tokens, tables sent, and what the parent's weigh.
    sums = [total[~hot].sum(), (total[~hot] > 0).sum()] + [x for s, t in samples for x in (s[~hot].sum(), t[~hot].sum())]
    own = np.zeros((1 + 2 * SAMPLES, len(vocabulary.hot)))
    own[:, vocabulary.hot_of(words[hot])] = np.stack([total[hot], *[x[hot] for pair in samples for x in pair]])
    kept["sums"] = np.concatenate([np.array(sums, np.float64), own.ravel()])
    return kept


_KEPT = {
    "chunks": np.int64, "n_words": np.int32, "n_pairs": np.int32, "times": np.uint32, "pair": np.int32, "seated": np.uint32, "seats": np.uint32, "discount": np.float64, "words": np.uint64, "asked": np.int32,
    "total": np.int64, "parent": np.float32, "contexts": np.uint64, "customers": np.int64, "filled": np.int64, "sums": np.float64,
}


class Totals:
    """Sums over all buckets: what makes the buckets' numbers probabilities."""

    def __init__(self, sums: np.ndarray, buckets: int):
        plain, own = sums[: 2 + 2 * SAMPLES], sums[2 + 2 * SAMPLES :].reshape(1 + 2 * SAMPLES, -1)
        self.hot_counts = own[0].astype(np.int64)
        sent, mass = own[1::2], np.minimum(own[2::2] / buckets, own[1::2])  # each bucket estimated the whole of it
        self.tokens, self.known = int(plain[0]) + int(self.hot_counts.sum()), int(plain[1]) + int((self.hot_counts > 0).sum())
        self.sent, self.mass1 = plain[2::2] + sent.sum(axis=1), plain[3::2] + mass.sum(axis=1)
        self.hot_parents = self.parents(sent - mass)

    def parents(self, own: np.ndarray) -> np.ndarray:
        """Probability of each word without context, averaged over the samples."""
        uniform = 1.0 / (self.known + 1)
        return ((own + (STRENGTH + self.mass1[:, None]) * uniform) / (STRENGTH + self.sent[:, None])).mean(axis=0)


def _totals(state: DataFrame, buckets: int, n_hot: int) -> Totals:
    rows = state.select("sums").toArrow().column("sums").to_pylist()
    return Totals(sum((_unpack(v, np.float64) for v in rows), np.zeros(2 + 2 * SAMPLES + (1 + 2 * SAMPLES) * n_hot)), buckets)


def _restaurants(state: DataFrame, buckets: int) -> DataFrame:
    """bucket, contexts (sorted), customers and mass (what a new table weighs): the restaurants of a bucket's words, summed over all buckets."""
    names = ("contexts", "customers", "filled")

    def dealt(batches):
        for batch in rows_of(batches, 1):
            ids, customers, filled = (_unpack(batch.column(c)[0].as_py(), _KEPT[c]) for c in names)
            ids = np.cumsum(ids, dtype=np.uint64)
            bucket = _bucket_of(ids, buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [(b, order[i:j]) for b, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]
            columns = [[_pack(np.diff(ids[at], prepend=np.uint64(0))) for _, at in parts], *[[_pack(x[at]) for _, at in parts] for x in (customers, filled)]]
            columns = [pa.array([b for b, _ in parts], pa.int32()), *[pa.array(c, pa.binary()) for c in columns], pa.array([batch.column("discount")[0].as_py()] * len(parts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", *names, "discount"])
        freed()

    def summed(table: pa.Table) -> pa.Table:
        ids, customers, filled, discount = ([_unpack(v, _KEPT[c]) for v in table.column(c).to_pylist()] for c in (*names, "discount"))
        ids, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in ids]), return_inverse=True)
        mass = np.bincount(at, np.concatenate([x * d / SAMPLES for x, d in zip(filled, discount, strict=True)]), len(ids))
        columns = {"contexts": ids, "customers": np.bincount(at, np.concatenate(customers), len(ids)).astype(np.int64), "mass": mass}
        return pa.table({"bucket": table.column("bucket")[:1], **{c: pa.array([_pack(v)], pa.binary()) for c, v in columns.items()}})

    rows = state.select("bucket", *names, "discount").mapInArrow(dealt, "bucket int, contexts binary, customers binary, filled binary, discount binary")
    return rows.groupBy("bucket").applyInArrow(freeing(summed), "bucket int, contexts binary, customers binary, mass binary")


def _looked_up(restaurants: dict | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers and mass of the restaurants of these words; none have neither."""
    known = _unpack(restaurants["contexts"], np.uint64) if restaurants["contexts"] is not None else np.zeros(0, np.uint64)
    at = Vocabulary._find(known, ids)
    if not len(known):
        return np.zeros(len(ids), np.int64), np.zeros(len(ids))
    return tuple(np.where(at >= 0, _unpack(restaurants[c], kind)[at], 0) for c, kind in (("customers", np.int64), ("mass", np.float64)))


def _of_hot(restaurants: DataFrame, words: Vocabulary, buckets: int) -> dict[int, tuple[int, float]]:
    """Customers and mass of the hot words' restaurants and of that where texts begin."""
    wanted = np.append(words.hot, START)

    def found(batches):
        for batch in rows_of(batches, 1):
            own = wanted[_bucket_of(wanted, buckets) == batch.column("bucket")[0].as_py()]
            customers, mass = _looked_up(batch.to_pylist()[0], own)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(customers), pa.array(mass)], names=["id", "customers", "mass"])

    rows = restaurants.mapInArrow(found, "id bigint, customers bigint, mass double").collect()
    return {row.id & (1 << 64) - 1: (row.customers, row.mass) for row in rows}


def _weights(state: DataFrame) -> DataFrame:
    """chunk, bucket, and for the chunk's questions in their order: customers and tables of the pairs, and the number of pairs per word."""

    def answered(batches):
        for batch in rows_of(batches, 1):
            kept = {c: _unpack(batch.column(c)[0].as_py(), _KEPT[c]) for c in ("chunks", "n_words", "n_pairs", "times", "pair", "seated", "seats")}
            words, pairs = (np.append(0, np.cumsum(kept[c], dtype=np.int64)) for c in ("n_words", "n_pairs"))
            for i in range(0, len(kept["chunks"]), 64):
                some = range(i, min(i + 64, len(kept["chunks"])))
                asked = [kept["pair"][pairs[k] : pairs[k + 1]] for k in some]
                columns = [*[[_pack(kept[c][own]) for own in asked] for c in ("seated", "seats")], [_pack(kept["times"][words[k] : words[k + 1]]) for k in some]]
                columns.append([batch.column("discount")[0].as_py()] * len(some))
                ids = [pa.array(kept["chunks"][i : i + 64]), pa.array([batch.column("bucket")[0].as_py()] * len(some), pa.int32())]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, pa.binary()) for c in columns]], names=["chunk", "bucket", "seated", "seats", "times", "discount"])
            del kept
            pa.default_memory_pool().release_unused()
        freed()

    asked = state.select("bucket", "chunks", "n_words", "n_pairs", "times", "pair", "seated", "seats", "discount")
    return asked.mapInArrow(answered, "chunk bigint, bucket int, seated binary, seats binary, times binary, discount binary")


def _words_asked(state: DataFrame, restaurants: DataFrame, words: Vocabulary, totals: Totals, of_hot: dict) -> DataFrame:
    """chunk, bucket, and for the words that the chunk asks for: count, probability without context, and mass as a context."""
    hot_mass = np.array([of_hot.get(int(w), (0, 0.0))[1] for w in words.hot])

    def answered(batches):
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            kept = {c: _unpack(row[c], _KEPT[c]) for c in ("chunks", "n_words", "words", "asked", "total", "parent")}
            total, parent = kept["total"], totals.parents(kept["parent"].reshape(SAMPLES, -1))
            mass, hot = _looked_up(row, kept["words"])[1], words.hot_of(kept["words"])
            at = np.flatnonzero(hot >= 0)
            total[at], parent[at], mass[at] = totals.hot_counts[hot[at]], totals.hot_parents[hot[at]], hot_mass[hot[at]]
            starts = np.append(0, np.cumsum(kept["n_words"], dtype=np.int64))
            for i in range(0, len(kept["chunks"]), 64):
                some = range(i, min(i + 64, len(kept["chunks"])))
                asked = [kept["asked"][starts[k] : starts[k + 1]] for k in some]
                columns = [[_pack(values[own]) for own in asked] for values in (total, parent.astype(np.float32), mass.astype(np.float32))]
                ids = [pa.array(kept["chunks"][i : i + 64]), pa.array([row["bucket"]] * len(some), pa.int32())]
                yield pa.RecordBatch.from_arrays([*ids, *[pa.array(c, pa.binary()) for c in columns]], names=["chunk", "bucket", "totals", "parents", "masses"])
            del kept, row
            pa.default_memory_pool().release_unused()
        freed()

    own = state.select("bucket", "chunks", "n_words", "words", "asked", "total", "parent").join(merged(restaurants), "bucket", "left")
    return own.mapInArrow(answered, "chunk bigint, bucket int, totals binary, parents binary, masses binary")


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; held-out rows teach nothing."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words, size = vocabulary(rows)
    # Held-out rows ask as well; training tokens stand for how many there are.
    buckets = max(1, -(-size // BUCKET_TOKENS))

    def fitted(table: pa.Table) -> pa.Table:
        kept = _bucket(table, words, buckets)
        pa.default_memory_pool().release_unused()
        return pa.table({"bucket": table.column("bucket")[:1], **{c: pa.array([_pack(kept[c].ravel())], pa.binary()) for c in _KEPT}})

    events = stored(_events(rows, words, buckets), "questions")
    asked = events.where("bucket IS NOT NULL").select("bucket", "chunk", "ids", "times", "context", "rare", "counts")
    state = stored(asked.groupBy("bucket").applyInArrow(freeing(fitted), "bucket int, " + ", ".join(f"{c} binary" for c in _KEPT)), "seatings")
    totals = _totals(state, buckets, len(words.hot))
    restaurants = stored(_restaurants(state, buckets), "restaurants")
    of_hot = _of_hot(restaurants, words, buckets)
    begun, begun_mass = of_hot.get(int(START), (0, 0.0))
    smallest = float(np.log10(max(1.0, totals.tokens + totals.known + 1.0)))
    tokens = totals.tokens

    def scored(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")  # the row without bucket comes last
        chunk = table.slice(table.num_rows - 1).to_pylist()[0]
        kinds = (("seated", np.uint32), ("seats", np.uint32), ("discount", np.float64), ("times", np.uint32), ("totals", np.int64), ("parents", np.float32), ("masses", np.float32))
        seated, seats, d, times, total, parent, mass = ([_unpack(v, kind) for v in table.column(c).to_pylist() if v is not None] for c, kind in kinds)
        direct = np.concatenate([x - one * y / SAMPLES for x, y, one in zip(seated, seats, d, strict=True)])
        times, total, parent, mass = map(np.concatenate, (times, total, parent, mass))
        del seated, seats
        lengths, own = _unpack(chunk["lengths"], np.uint32).astype(np.int64), _unpack(chunk["buckets"], np.uint32).astype(np.int64)
        pairs = _pairs(_unpack(chunk["tokens"], np.uint32).astype(np.int64), lengths, own % buckets, own >= buckets, buckets)[-1]
        doc = np.repeat(np.arange(len(lengths)), lengths)
        # A hot word counts as another one in each bucket.
        word = np.repeat(np.arange(len(total)), times)[pairs]
        before = np.roll(word, 1)
        before[np.cumsum(lengths) - lengths] = len(total)
        # A word is a context as often as it stands in training texts.
        new, customers = STRENGTH + np.append(mass, begun_mass).astype(np.float64), STRENGTH + np.append(total, begun)
        logs = np.log10((direct[pairs] + new[before] * parent[word]) / customers[before])
        base, known, found = (np.bincount(doc, x, len(lengths)) for x in (np.log10(total[word] + 1.0), total[word] > 0, logs))
        columns = [pa.array(chunk["doc_ids"], pa.int64()), pa.array(chunk["held_out"], pa.bool_()), lengths, known.astype(np.int64), np.full(len(lengths), tokens, np.int64), base - lengths * smallest, found]
        return pa.table(dict(zip(("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"), columns, strict=True)))

    chunks = events.where("bucket IS NULL").select("chunk", "tokens", "buckets", "lengths", "doc_ids", "held_out")
    met = _weights(state).unionByName(_words_asked(state, restaurants, words, totals, of_hot), allowMissingColumns=True).unionByName(chunks, allowMissingColumns=True)
    return met.groupBy("chunk").applyInArrow(freeing(scored), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op8_pitman_yor(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 7) == 2)
