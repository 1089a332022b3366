"""Line deduplication: lines that many documents share stay in one of them.

Method: every line long enough gets a 128-bit hash. All distinct hashes are dealt into shards; each shard becomes a minimal
perfect hash (levels of bit arrays, a key's place being its rank among the set bits) that indexes arrays of
fingerprints, counts of documents and keepers. Documents send only hashes to the shards' arrays, which decide by the
counts, and get back which of their lines go; no line is joined with a line. A shard whose hashes are asked for often is
copied, so that a line held by a third of all documents is looked up in many tasks.

A line's key is the line without ASCII white space at both ends and with A-Z in lower case. A key of at least
`min_chars` code points found in at least `min_docs` documents loses all its lines except in the largest doc_id that
holds it.

Defined results: a null or empty text is one empty line. Rows with equal doc_id count as one document and decide alike,
so all of them keep what the largest doc_id keeps. A null doc_id is smaller than any other. Columns other than doc_id and
text are handed through, whatever their names; n_lines and n_dropped replace columns of that name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import freed, freeing, mixed, rows_of
from webloom.plans.scale import stored

MIN_CHARS, MIN_DOCS = 40, 5
KEYS_PER_SHARD = 200_000
PROBES_PER_TASK = 100_000
_LEVELS = 48


class MinimalHash:
    """Numbers distinct 64-bit keys from 0 without gaps, at about 3 bits a key.

    On each level the keys left set a bit of an array twice their number; those that met no other are done, the others
    go to the next level. Keys left after the last level, which take equal hashes, get no number (-1).
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @staticmethod
    def build(keys: np.ndarray) -> MinimalHash:
        sizes, levels, left = [], [], keys
        while len(left) and len(sizes) < _LEVELS:
            size = 2 * len(left) + 1
            at = MinimalHash._places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return MinimalHash(np.array(sizes, np.int64), np.concatenate([np.zeros(0, bool), *levels]))

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; a key that was not built in gets any number or -1."""
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts, strict=True)):
            at = start + self._places(keys[left], level, int(size))
            hit = self.bits[at]
            found[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return found


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """A 128-bit hash for each line that counts, None for the others."""
    keys = (line.strip().lower() for line in text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and len(k.decode("utf-8", "replace")) >= min_chars else None for k in keys]


def _hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and the two halves of the hash, once for each distinct line of a document."""

    def hashed(batches):
        for batch in rows_of(batches):
            ids, found = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = set(keys_of(text, min_chars)) - {None}
                ids += [doc] * len(own)
                found += own
            halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "high", "low"])
        freed()

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(hashed, "doc_id bigint, high bigint, low bigint")


def _arrays(lines: DataFrame) -> DataFrame:
    """One row per shard: the levels of its hash and what they index."""

    def built(table: pa.Table) -> pa.Table:
        high, low, n, keeper = (table.column(c).to_numpy() for c in ("high", "low", "n", "keeper"))
        index = MinimalHash.build(high.view(np.uint64))
        place = index.find(high.view(np.uint64))
        placed, rest = place >= 0, np.flatnonzero(place < 0)
        # Equal upper halves, if they ever occur, follow behind and are compared one by one.
        order = np.concatenate([np.flatnonzero(placed)[np.argsort(place[placed])], rest])
        row = {"shard": table.column("shard")[0].as_py(), "sizes": index.sizes.tobytes(), "bits": np.packbits(index.bits).tobytes(), "behind": rest.size}
        row |= {"high": high[rest].tobytes(), "fingerprints": low[order].tobytes(), "counts": n[order].tobytes(), "keepers": keeper[order].tobytes()}
        return pa.Table.from_pylist([row], schema=pa.schema([(c, pa.int64() if c in ("shard", "behind") else pa.binary()) for c in row]))

    schema = "shard bigint, sizes binary, bits binary, behind bigint, high binary, fingerprints binary, counts binary, keepers binary"
    return lines.groupBy("shard").applyInArrow(freeing(built), schema)


def _probed(probes: pa.Table, arrays: pa.Table, min_docs: int) -> pa.Table:
    """The probes whose line goes: doc_id and the line's hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.binary())])
    if not arrays.num_rows or not probes.num_rows:
        return schema.empty_table()
    row = arrays.to_pylist()[0]
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    fingerprints, counts, keepers = (np.frombuffer(row[c], np.int64) for c in ("fingerprints", "counts", "keepers"))
    high, low = probes.column("high").to_numpy(), probes.column("low").to_numpy()
    place = MinimalHash(sizes, bits).find(high.view(np.uint64))
    for k, own in enumerate(np.frombuffer(row["high"], np.int64)):
        at = len(fingerprints) - row["behind"] + k
        place[(high == own) & (low == fingerprints[at])] = at
    doc = probes.column("doc_id").fill_null(_NONE).to_numpy()
    found = place >= 0
    found[found] = fingerprints[place[found]] == low[found]
    found[found] = (counts[place[found]] >= min_docs) & (keepers[place[found]] != doc[found])
    lines = np.stack([high[found], low[found]], axis=1).astype(">i8").tobytes()
    ids = pa.array(doc[found], mask=doc[found] == _NONE)
    return pa.table([ids, pa.array([lines[i : i + 16] for i in range(0, len(lines), 16)], pa.binary())], schema=schema)


_NONE = -(1 << 63)  # a null doc_id


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with `text` without the lines that go, and n_lines (before) and n_dropped."""
    hashes = _hashes(docs, min_chars)
    doc = F.coalesce("doc_id", F.lit(_NONE))
    counts = hashes.groupBy("high", "low").agg(F.count_distinct(doc).alias("n"), F.max(doc).alias("keeper"))
    lines = stored(counts, "line-counts")
    shards = max(1, -(-lines.count() // KEYS_PER_SHARD))
    shard = F.pmod(F.col("high"), F.lit(shards)).alias("shard")
    lines = lines.select("*", shard)
    # How many copies of a shard's arrays it takes, so that each answers about PROBES_PER_TASK probes.
    copies = lines.groupBy("shard").agg(F.ceil(F.sum("n") / PROBES_PER_TASK).alias("copies"))
    arrays = _arrays(lines).join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    asks = hashes.select("*", shard).join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "low"), F.col("copies"))).drop("copies")
    key = ["shard", "copy"]
    gone = asks.groupBy(*key).cogroup(arrays.groupBy(*key)).applyInArrow(lambda probes, own: _probed(probes, own, min_docs), "doc_id bigint, line binary")
    gone = gone.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_set("line").alias("_gone"))

    @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
    def kept(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        rows = []
        for text, drop in zip(texts, drops, strict=True):
            lines = text.split(b"\n")
            if drop is None or not len(drop):
                rows.append((text, len(lines), 0))
                continue
            drop = set(map(bytes, drop))
            stay = [line for line, key in zip(lines, keys_of(text, min_chars), strict=True) if key not in drop]
            rows.append((b"\n".join(stay), len(lines), len(lines) - len(stay)))
        found = pd.DataFrame([(t.decode("utf-8", "replace"), n, d) for t, n, d in rows], columns=["text", "n_lines", "n_dropped"])
        del rows
        freed()
        return found

    packed = docs.select(F.struct("*").alias("_row"))
    joined = packed.join(gone, F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_of")), "left")
    found = joined.select("_row", kept(F.coalesce("_row.text", F.lit("")).cast("binary"), "_gone").alias("_new"))
    own = [F.col("_new.text").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return found.select(*own, "_new.n_lines", "_new.n_dropped")


def op2_line_dedup(spark, sf_dir):
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def stage(spark, docs, sf_dir):
    return dedup_lines(docs).select(*docs.columns)


#: Stripped white space and the lower case of A-Z in DuckDB.
SQL_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT doc_id, line, i, {SQL_KEY} AS key FROM numbered),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN often USING (key) GROUP BY doc_id
"""
