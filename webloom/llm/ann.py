"""Approximate nearest neighbours by learned partitions.

Method. On a bounded sample (SAMPLE vectors, chosen by a hash of the id) the exact neighbour graph is built and cut into
balanced parts: vectors start at their nearest of spread centres and then move to the part that most of their
neighbours are in, as long as no part exceeds its quota. A small softmax classifier learns the parts that a vector's
neighbours lie in. Every vector of the table is then put into its most probable part, every query goes to its most
probable parts, and those are searched exactly in double precision. How many parts a query visits is chosen on the
sample: the fewest that find RECALL of the true neighbours of held-out vectors.

Equal vectors are one entry with their `k + 1` smallest ids, which is all that a query can need; so copies cannot fill
a part. Parts are cut into blocks of at most BLOCK rows, and queries meet candidates block by block.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Rows
that share an id are one candidate each. With fewer than k candidates a query gets all that were found. Vectors of
another length than most are treated as not comparable and take no part. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.scale import stored

SAMPLE = 6_000
PART_ROWS = 400  # of the sample
NEAR = 10  # neighbours in the graph
RECALL = 0.97
BLOCK = 4_096


class Router:
    """Softmax over parts, from unit vectors: one hidden layer."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], visits: int):
        self.layers, self.visits = layers, visits

    def hidden(self, x: np.ndarray) -> np.ndarray:
        (w, b), _ = self.layers
        return np.maximum(x @ w + b, 0.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.layers[1][0] + self.layers[1][1]

    def parts(self, x: np.ndarray, several: bool) -> np.ndarray:
        """The most probable part of each vector, or the `visits` most probable ones."""
        scores = self.scores(x)
        return np.argsort(-scores, axis=1, kind="stable")[:, : self.visits if several else 1]


def _balanced(near: np.ndarray, unit: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut the neighbour graph into parts of at most 1.2 times the mean size, with few edges between them."""
    n, quota = len(unit), int(1.2 * len(unit) / parts) + 1
    centres = unit[rng.choice(n, parts, replace=False)]
    label = np.zeros(n, np.int64)
    for _ in range(8):
        liked = unit @ centres.T
        label = _filled(liked, quota)
        for k in range(parts):
            if (label == k).any():
                centres[k] = unit[label == k].mean(axis=0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    for _ in range(6):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), label[near].ravel()), 1.0)
        np.add.at(votes, (near.ravel(), np.repeat(label, near.shape[1])), 1.0)
        label = _filled(votes + 0.5 * (unit @ centres.T), quota)
    return label


def _filled(liked: np.ndarray, quota: int) -> np.ndarray:
    """Each row's best column with room left; rows with the clearest choice go first."""
    label, room = np.full(len(liked), -1), np.full(liked.shape[1], quota)
    order = np.argsort(-liked.max(axis=1), kind="stable")
    ranked = np.argsort(-liked, axis=1, kind="stable")
    for i in order:
        for k in ranked[i]:
            if room[k]:
                label[i], room[k] = k, room[k] - 1
                break
    return label


def fit(vectors: np.ndarray, k: int, seed: int = 5) -> Router:
    """Partition the sample's neighbour graph, train the router, and choose how many parts to visit."""
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    parts = max(1, len(unit) // PART_ROWS)
    if parts == 1:
        return Router([(np.zeros((unit.shape[1], 1)), np.zeros(1)), (np.zeros((1, 1)), np.zeros(1))], 1)
    alike = unit @ unit.T
    np.fill_diagonal(alike, -2.0)
    near = np.argsort(-alike, axis=1)[:, :NEAR]
    label = _balanced(near, unit, parts, rng)
    held = np.arange(len(unit)) % 5 == 0
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.repeat(np.arange(len(unit)), NEAR), label[near].ravel()), 0.5 / NEAR)
    target[np.arange(len(unit)), label] += 0.5
    width = 128
    layers = [rng.normal(0, unit.shape[1] ** -0.5, (unit.shape[1], width)), np.zeros(width), rng.normal(0, width**-0.5, (width, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    train, step = np.flatnonzero(~held), 0
    for epoch in range(30):
        order = rng.permutation(train)
        for i in range(0, len(order), 128):
            rows, step = order[i : i + 128], step + 1
            x, (w, b, v, c) = unit[rows] * 4, layers
            h = np.maximum(x @ w + b, 0.0)
            z = h @ v + c
            p = np.exp(z - z.max(axis=1, keepdims=True))
            dz = (p / p.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (dz @ v.T) * (h > 0)
            for j, grad in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
                first[j] = 0.9 * first[j] + 0.1 * grad
                second[j] = 0.999 * second[j] + 0.001 * grad * grad
                layers[j] -= 0.003 / (1 + epoch / 10) * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    router = Router([(layers[0] * 4, layers[1]), (layers[2], layers[3])], 1)
    # As in the search: candidates lie in their most probable part, held-out queries visit several.
    order = np.argsort(-router.scores(unit), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    queries = np.flatnonzero(held)
    visited = np.sort(rank[queries[:, None], order[near[queries, :k], 0]].ravel())
    router.visits = int(visited[min(len(visited) - 1, int(np.ceil(RECALL * len(visited))))]) + 1
    return router


def _usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision, each scaled by a power of two to at most 1.

    Such a factor is exact and no cosine depends on it, but squares of any finite numbers stay finite.
    """
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(array):
        return values.reshape(0, 0)
    rows = values.reshape(len(array), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def nearest(vectors: DataFrame, queries: Column, k: int = 5, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which `queries` (over vec_id) holds."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vec).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    widest = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if widest is None:
        return empty
    rows = rows.where(F.size("vector") == widest["width"])
    # Spark keeps the first rows of each group where they are read, before any shuffle.
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    # -0.0 is 0.0; the text of the numbers, hashed, stands for the vector.
    key = F.sha2(F.to_json(F.struct(F.transform("vector", lambda x: x + F.lit(0.0)).alias("v"))), 256)
    copies = rows.withColumn("key", key).withColumn("copy", first).where(F.col("copy") <= k + 1)
    entries = stored(copies.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")).select("ids", "vector"), "entries")
    size = entries.count()
    slices = 1 << 20
    sample = entries.where(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(slices)) < min(slices, slices * SAMPLE // max(1, size)))

    def fitted(table: pa.Table) -> pa.Table:
        import pickle

        order = np.argsort([ids[0] for ids in table.column("ids").to_pylist()])
        router = fit(_matrix(table.column("vector"))[order], k)
        return pa.table({"router": pa.array([pickle.dumps(router)], pa.binary())})

    import pickle

    made = sample.groupBy(F.lit(0).alias("one")).applyInArrow(fitted, "router binary").collect()
    router = pickle.loads(made[0][0]) if made else Router([(np.zeros((widest["width"], 1)), np.zeros(1)), (np.zeros((1, 1)), np.zeros(1))], 1)

    def routed(several):
        def batches(rows):
            for batch in rows:
                x = _matrix(batch.column("vector"))
                if not len(x):
                    continue
                parts = router.parts(x / np.linalg.norm(x, axis=1, keepdims=True), several)
                which = np.repeat(np.arange(len(x)), parts.shape[1])
                taken = batch.take(pa.array(which))
                yield pa.RecordBatch.from_arrays([pa.array(parts.ravel().astype(np.int32)), *taken.columns], names=["part", *batch.schema.names])

        return batches

    candidates = stored(entries.mapInArrow(routed(False), "part int, ids array<bigint>, vector array<double>"), "parts")
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(routed(True), "part int, query_id bigint, vector array<double>")

    def blocked(df, kind, id_of):
        """One row per block: its ids and vectors, at most about BLOCK rows."""
        counts = df.groupBy("part").agg(F.ceil(F.count("*") / (BLOCK // 2)).alias("blocks"))
        dealt = df.join(counts, "part").withColumn("block", F.pmod(F.xxhash64(id_of), F.col("blocks")))
        id_type = dict(df.dtypes)[kind]

        def packed(table: pa.Table) -> pa.Table:
            x = _matrix(table.column("vector"))
            ids = table.column(kind).to_pylist()
            return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), kind: [ids], f"{kind}_x": pa.array([x.tobytes()], pa.binary())}, schema=pa.schema([("part", pa.int32()), (kind, pa.list_(pa.list_(pa.int64()) if id_type.startswith("array") else pa.int64())), (f"{kind}_x", pa.binary())]))

        return dealt.select("part", "block", kind, "vector").groupBy("part", "block").applyInArrow(packed, f"part int, {kind} array<{id_type}>, {kind}_x binary")

    def searched(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                query, ids = row["query_id"], row["ids"]
                q = np.frombuffer(row["query_id_x"]).reshape(len(query), -1)
                x = np.frombuffer(row["ids_x"]).reshape(len(ids), -1)
                nq, nx = (np.sqrt((m * m).sum(axis=1)) for m in (q, x))
                alike = (q @ x.T) / nq[:, None] / nx
                take = min(k + 1, len(ids))
                least = np.partition(alike, len(ids) - take, axis=1)[:, len(ids) - take] - 1e-9
                out = []
                for j, own in enumerate(query):
                    at = np.flatnonzero(alike[j] >= least[j])
                    # The same sum for the same two vectors, wherever they stand: ties stay ties.
                    score = (q[j] * x[at]).sum(axis=1) / (nq[j] * nx[at])
                    found = sorted((-s, v) for a, s in zip(at, score, strict=True) for v in ids[a] if v != own)[:k]
                    out += [(own, v, -s) for s, v in found]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    met = blocked(asked, "query_id", "query_id").join(blocked(candidates, "ids", F.col("ids")[0]), "part")
    found = met.select("query_id", "query_id_x", "ids", "ids_x").mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
