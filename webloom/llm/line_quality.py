"""Quality of texts from the quality of their lines, by a linear-chain conditional random field.

Method: every line is good or bad. A line's potential sums weights over binned features of the line itself, of the one
before and of the one after; a transition matrix links neighbouring labels. Labels exist for documents only: a good
document has only good lines, a bad one has at least one bad line, and the likelihood of that is climbed directly
(both probabilities come out of the same chain). Forward-backward gives each line's marginal probability; its mean,
weighted by the lines' lengths, goes through a logistic curve fitted on the same sample and is the document's quality.

With two labels, forward and backward messages are one number a line, the odds of good to bad. The chains of a batch
are run side by side, position by position.

Learning uses a bounded, documented sample: labelled documents of at most MAX_LINES lines, about MAX_EXAMPLES of them,
chosen by a hash of doc_id. Scoring covers every line of every row. The model is a few kilobytes.

Defined results: a null or empty text is one empty line and gets a score like any other. Rows without label, with a null
label or null doc_id teach nothing; several labels of one document count as good if one of them does; of rows that share
a labelled doc_id the one with the least hash teaches. Without any example every score is 0.5. Repeated rows are scored
row by row; extra columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import chained, remainder, rows_of

MAX_EXAMPLES, MAX_LINES = 12_000, 2_000
STEPS, L2 = 120, 1.0
#: From this probability on a document counts as good.
GOOD = 0.7
_SLICES = 1 << 20

# Binned features of a line; a bin beyond the last stands for "there is no such neighbour".
_BINS = 12
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\v\f",
    "stop": b".,",
    "bar": b"|",
    "shout": b"!?",
    "sign": b"#$%&*+-/:;<=>@[\\]^_`{}~\"'()",
    "other": bytes(range(128, 256)),
}
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _k
_SHARES = (0.0, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8)
FEATURES = (*_CLASSES, "length", "words", "distinct", "word_length", "repeats", "first", "last", "place")


@dataclass
class Lines:
    """The lines of some documents: bins (lines x features), weights, and the number of lines of each document."""

    bins: np.ndarray
    weight: np.ndarray
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])[:-1]

    @staticmethod
    def joined(parts: list[Lines]) -> Lines:
        return Lines(*[np.concatenate([getattr(p, name) for p in parts]) for name in ("bins", "weight", "counts")])


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(_SHARES, part / np.maximum(whole, 1), side="right") - 1


def _log(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1).astype(np.int64), _BINS - 1)


def lines_of(texts: list[bytes]) -> Lines:
    """The binned features of all lines of the texts."""
    split = [text.split(b"\n") for text in texts]
    counts = np.array([len(own) for own in split], np.int64)
    if not len(counts):
        return Lines(np.zeros((0, len(FEATURES)), np.uint8), np.zeros(0), counts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    length = ends - starts
    kind = _CLASS[raw]
    found = {name: np.add.reduceat(kind == k, starts, dtype=np.int64) for k, name in enumerate(_CLASSES)}
    words = [line.split() for own in split for line in own]
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    distinct = np.fromiter((len(set(own)) for own in words), np.int64, len(words))
    repeats = np.concatenate([_repeats(own) for own in split])
    letters = found["upper"] + found["lower"] + found["other"]
    bins = {name: _share(found[name], length) for name in _CLASSES}
    bins["upper"] = _share(found["upper"], letters)
    bins["length"], bins["words"], bins["repeats"] = _log(length), _log(n_words), _log(repeats - 1)
    bins["distinct"] = _share(distinct, n_words)
    bins["word_length"] = np.minimum((length - n_words + 1) // np.maximum(n_words, 1), _BINS - 1)
    bins["first"], bins["last"] = kind[starts], kind[np.maximum(ends - 1, starts)]
    opening, closing = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
    at = np.cumsum(counts)
    opening[at - counts] = 1
    closing[at - 1] = 2
    bins["place"] = opening + closing
    return Lines(np.stack([bins[name] for name in FEATURES], axis=1).astype(np.uint8), np.maximum(length, 1).astype(np.float64), counts)


def _repeats(lines: list[bytes]) -> np.ndarray:
    if len(lines) == 1:
        return np.ones(1, np.int64)
    seen = Counter(lines)
    return np.fromiter((seen[line] for line in lines), np.int64, len(lines))


@dataclass
class Field:
    """Weights of the line itself, the one before and the one after, of transitions, and of the final curve."""

    tables: np.ndarray = field(default_factory=lambda: np.zeros((3, len(FEATURES), _BINS + 1)))
    #: Log potentials of (bad, bad), (bad, good), (good, bad), (good, good).
    links: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (0.0, 0.0)

    def quality(self, lines: Lines) -> np.ndarray:
        """The probability of each document to be good."""
        if not len(lines.counts):
            return np.zeros(0)
        return _sigmoid(self.curve[0] + self.curve[1] * _mean(lines, chains(self.potentials(_cells(lines)), self.links, lines).good))

    def potentials(self, cells: np.ndarray) -> np.ndarray:
        return np.clip(self.tables.ravel()[cells].sum(axis=1), -30, 30)

    def marginals(self, lines: Lines) -> np.ndarray:
        """The probability of each line to be good."""
        return chains(self.potentials(_cells(lines)), self.links, lines).good


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _cells(lines: Lines) -> np.ndarray:
    """For each line the places of its weights in the flat tables."""
    n, width = lines.bins.shape
    none = np.full((1, width), _BINS, np.int64)
    own = lines.bins.astype(np.int64)
    before, after = np.concatenate([none, own])[:n], np.concatenate([own, none])[1:]
    before[lines.starts] = _BINS
    after[lines.starts + lines.counts - 1] = _BINS
    base = np.arange(width) * (_BINS + 1)
    size = width * (_BINS + 1)
    return np.concatenate([own + base, before + base + size, after + base + 2 * size], axis=1)


@dataclass
class Chains:
    """Marginals: of lines to be good, of pairs (from the second line of a document on), and log P(all lines good)."""

    good: np.ndarray
    pairs: np.ndarray
    all_good: np.ndarray


def chains(potential: np.ndarray, links: np.ndarray, lines: Lines) -> Chains:
    """Forward-backward over all documents side by side, in odds of good to bad (as logarithms)."""
    order = np.argsort(-lines.counts, kind="stable")
    counts, starts = lines.counts[order], lines.starts[order]
    # How many documents have a line at each position.
    active = np.searchsorted(-counts, -np.arange(int(counts[0]) if len(counts) else 0), side="left")
    (bb, bg), (gb, gg) = links
    forward, backward = potential.copy(), np.zeros(len(potential))
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(bg, gg + r) - np.logaddexp(bb, gb + r)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        r = potential[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(gb, gg + r) - np.logaddexp(bb, bg + r)
    good = _sigmoid(forward + backward)
    # The odds of (good, good) and so on for each line with one before it.
    later = np.ones(len(potential), bool)
    later[lines.starts] = False
    at = np.flatnonzero(later)
    left, right = forward[at - 1], potential[at] + backward[at]
    logs = np.stack([np.full(len(at), bb), bg + right, gb + left, gg + left + right], axis=1)
    pairs = np.exp(logs - logs.max(axis=1, keepdims=True))
    pairs /= pairs.sum(axis=1, keepdims=True)
    # P(all good) = P(first good) * product of P(next good | this one good).
    step = np.zeros(len(potential))
    step[lines.starts] = -np.logaddexp(0, -(forward + backward)[lines.starts])
    step[at] = -np.logaddexp(0, gb - gg - right)
    return Chains(good, pairs, np.add.reduceat(step, lines.starts) if len(step) else step)


def _mean(lines: Lines, good: np.ndarray) -> np.ndarray:
    """Log odds of the length-weighted mean of the marginals."""
    mean = np.add.reduceat(good * lines.weight, lines.starts) / np.add.reduceat(lines.weight, lines.starts)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def gradient(model: Field, lines: Lines, cells: np.ndarray, label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the documents' labels, and its slopes by the tables and the links.

    With A = P(all lines good), a good document gives log A and a bad one log(1 - A). The slope of log A is what an
    all-good labelling counts less what the model expects; that of log(1 - A) is the same times -A / (1 - A).
    """
    found = chains(model.potentials(cells), model.links, lines)
    a = np.minimum(found.all_good, -1e-9)
    rest = np.log(-np.expm1(a))
    factor = np.where(label > 0, 1.0, -np.exp(a - rest))
    each = np.repeat(factor, lines.counts)
    slope = each * (1 - found.good)
    tables = np.bincount(cells.ravel(), np.repeat(slope, cells.shape[1]), minlength=model.tables.size).reshape(model.tables.shape)
    later = np.ones(len(each), bool)
    later[lines.starts] = False
    links = np.array([0.0, 0.0, 0.0, 1.0]) - found.pairs
    return float(np.where(label > 0, a, rest).sum()), tables, (each[later, None] * links).sum(axis=0).reshape(2, 2)


def fit(lines: Lines, label: np.ndarray, steps: int = STEPS) -> Field:
    """Climb the likelihood less an L2 term, by quasi-Newton steps over the last slopes, halved until they climb."""
    model = Field()
    if not len(label):
        return model
    cells, size = _cells(lines), model.tables.size

    def unpacked(w: np.ndarray) -> Field:
        return Field(w[:size].reshape(model.tables.shape), w[size:].reshape(2, 2))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, tables, links = gradient(unpacked(w), lines, cells, label)
        return 0.5 * L2 * float(w @ w) - value, L2 * w - np.append(tables, links)

    w = np.zeros(size + 4)
    value, slope = loss(w)
    history: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move = -_newton(slope, history)
        # The first move has no history to take its length from.
        length = 1.0 if history else 1.0 / max(1.0, float(np.abs(slope).sum()))
        while length > 1e-12:
            new = w + length * move
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * length * float(slope @ move):
                break
            length /= 2
        else:
            break
        step, change = new - w, new_slope - slope
        if float(step @ change) > 1e-10:
            history = [*history[-9:], (step, change)]
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        w, value, slope = new, new_value, new_slope
        if done:
            break
    model = unpacked(w)
    model.curve = _curve(_mean(lines, model.marginals(lines)), label)
    return model


def _newton(slope: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse curvature that the steps and changes of slope in `history` tell of."""
    q, used = slope.copy(), []
    for step, change in reversed(history):
        share = float(step @ q) / float(step @ change)
        q -= share * change
        used.append(share)
    if history:
        step, change = history[-1]
        q *= float(step @ change) / float(change @ change)
    for (step, change), share in zip(history, reversed(used), strict=True):
        q += step * (share - float(change @ q) / float(step @ change))
    return q


def _curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a slight pull to (0, 1)."""
    w = np.array([0.0, 1.0])
    pull = np.array([1e-3, 1.0])
    design = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(30):
        p = _sigmoid(design @ w)
        slope = design.T @ (label - p) - pull * (w - [0.0, 1.0])
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(pull), slope)
    return float(w[0]), max(float(w[1]), 0.0)


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_examples: int = MAX_EXAMPLES) -> Field:
    """Fit on the labelled documents for which `learn` (over doc_id) holds, or on a sample of them (see above).

    The sample's ids are few (see the bound), so they go to the texts and no text is shuffled, only binned lines.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    marked = marked.where(F.lit(True) if learn is None else learn)
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Ids are spread over the slices by a hash, so the sample has about this size and is the same in every run.
    share = min(_SLICES, int(_SLICES * max_examples / max(1, marked.count())))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES)) < share)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    examples = texts.join(F.broadcast(chosen), "doc_id")

    def binned(batches):
        for batch in rows_of(batches):
            texts = batch.column("text").to_pylist()
            fine = [k for k, text in enumerate(texts) if text.count(b"\n") < MAX_LINES]
            found = [lines_of([texts[k]]) for k in fine]
            columns = [batch.column("doc_id").take(fine), batch.column("quality").take(fine)]
            columns += [pa.array([f.bins.tobytes() for f in found], pa.binary()), pa.array([f.weight.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "quality", "bins", "weight"])

    def fitted(table: pa.Table) -> pa.Table:
        # An order that has nothing to do with how the rows came, the same in every run.
        order = np.argsort(chained([table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64)]), kind="stable")
        rows = table.select(["bins", "weight"]).to_pylist()
        parts = []
        for i in order:
            bins = np.frombuffer(rows[i]["bins"], np.uint8).reshape(-1, len(FEATURES))
            parts.append(Lines(bins, np.frombuffer(rows[i]["weight"], np.float64), np.array([len(bins)], np.int64)))
        label = (table.column("quality").to_numpy()[order] > 0).astype(np.float64)
        return pa.table({"model": [pickle.dumps(fit(Lines.joined(parts), label))]}, schema=pa.schema([("model", pa.binary())]))

    rows = examples.mapInArrow(binned, "doc_id bigint, quality int, bins binary, weight binary")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("bins"), "quality", "bins", "weight")).alias("row"))
    one = one.select("doc_id", "row.quality", "row.bins", "row.weight")
    # One group, bounded by the sample.
    model = one.groupBy(F.lit(0).alias("one")).applyInArrow(fitted, "model binary").collect()
    return pickle.loads(model[0][0]) if model else Field()


def score(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, n_lines and n_bad (lines that are rather bad than good) for every row."""

    def batches(rows):
        for batch in rows_of(rows, 128):
            lines = lines_of(batch.column("text").to_pylist())
            bad = np.add.reduceat((model.marginals(lines) < 0.5).astype(np.int64), lines.starts) if len(lines.counts) else lines.counts
            columns = [batch.column("doc_id"), pa.array(model.quality(lines)), pa.array(lines.counts), pa.array(bad)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_lines", "n_bad"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(batches, "doc_id bigint, score double, n_lines bigint, n_bad bigint")


def op13_line_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    rows = score(docs, train(docs, labels, ~held_out))
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_lines", "n_bad")
