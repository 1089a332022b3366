"""N-gram Jaccard join with vertical partitioning, and its connected components.

Method. The grams (word shingles) of all texts get one global order: by the number of texts that hold them, rarest
first, then by hash. Equal sets are one class, known by the sum of its grams' hashes. Two classes can only reach the
similarity if they share a gram among their first |set| - ceil(share * |set|) + 1 in that order, so such prefixes give
the candidates; a class whose prefix is all its own has none. The numbers are counted in buckets of gram hashes, which
chunks of texts ask and which answer with a byte per gram. Grams frequent in the whole data are told apart beforehand
and come last. Another order, by hash, is cut into fragments: each candidate pair's common grams are counted fragment by
fragment and summed.

A gram's place in both sets bounds what they share if it is the first gram that they share: itself and what follows
it in either. A pair that can link passes this bound at its first common gram, so a pair and a gram that fail it are not
looked at, nor is a class in a list where even the smallest member would fail with it. Pairs that are left are looked at
in sketches first: a bit for each cell of hashes says whether it holds an odd number of a set's grams, so the number of
different bits bounds how far two sets differ.

Components need no full list of pairs. In every list of classes that share a prefix gram, all are first compared with
one leader, that with the fewest grams before this one, and what links becomes one component. Members outside the
leader's component are compared with more leaders of the list (TURNS in all), up to LEADERS each. The last turn takes
exactly those pairs of a list that still lie in different components. It knows all prefix grams they share down to the
last that passes the bound, and so how much they can share at all, and compares those that may reach the similarity. So
no link between different texts is lost, while a group of many near copies costs about one comparison per copy.

Lists of grams that are not frequent are made in buckets from packed arrays; those of frequent grams, of any length, by
aggregates and joins that Spark can split.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and is its own
component. Texts shorter than a shingle are one gram. Equal doc_ids are one vertex. Rows with null doc_id have a null
component. Repeated rows are answered each. Extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.words import freed, freeing, mixed, repeated, rows_of, shingles, word_ids
from webloom.plans.scale import stored

SIZE = 5
#: The similarity as a fraction: 80 / 100.
SHARE, OF = 80, 100
FRAGMENTS = 4
#: A gram that makes up more than 1 / HEAVY_SHARE of all is put last; so there are at most HEAVY_SHARE of them. One
#: found at most HEAVY_LEAST times fits a bucket anyway.
HEAVY_SHARE, HEAVY_LEAST = 1 << 20, 50_000
#: Turns with leaders, and leaders per list in the turns after the first.
TURNS, LEADERS = 2, 32
#: Grams of a bucket where texts are counted, of a chunk that asks for counts, and prefix grams of a bucket of lists.
LEVEL_GRAMS, CHUNK_GRAMS, BUCKET_GRAMS = 2_000_000, 2_000_000, 1_000_000
#: What is known of the texts of a chunk: identities, sizes, and how many of their grams are not frequent.
_KNOWN = ("nodes", "sizes", "lights")
#: Bits of a set's sketch, as powers of two: four per gram within these limits.
LEAST_BITS, MOST_BITS = 6, 13


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def heavy_grams(docs: DataFrame, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Grams that are frequent in the whole data, sorted, and their counts."""

    def counted(batches):
        sets = (shingles(word_ids(text), size) for batch in rows_of(batches) for text in batch.column("text").to_pylist())
        for grams, counts, seen in repeated(sets, HEAVY_SHARE, 1 << 22):
            grams, counts = np.append(grams.view(np.int64), 0), np.append(counts, seen)
            total = np.zeros(len(grams), bool)
            total[-1] = True
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts.astype(np.int64)), pa.array(total)], names=["gram", "n", "total"])
        freed()

    sums = _texts(docs).select("text").mapInArrow(counted, "gram bigint, n bigint, total boolean").groupBy("gram", "total").agg(F.sum("n").alias("n"))
    sums = stored(sums, "gram-counts")
    total = sums.where("total").first()
    least = max(HEAVY_LEAST, (total["n"] if total else 0) // HEAVY_SHARE)
    rows = sums.where(~F.col("total") & (F.col("n") > least)).select("gram", "n").toArrow()
    grams, counts = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def _identity(grams: np.ndarray) -> int:
    """A set's identity: the sum of its hashes, equal for equal sets."""
    return int(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(grams) else 0


def _light(own: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Marks the grams that are not frequent in the whole data."""
    if not len(heavy) or not len(own):
        return np.ones(len(own), bool)
    return heavy[np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)] != own


def _reach(n: int) -> int:
    """Grams of the prefix of a set of n."""
    return n - -(-SHARE * n // OF) + 1 if n else 0


def _sets(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], size: int) -> DataFrame:
    """doc_id, n, node (the set's identity), the number of frequent grams, and those of its prefix."""
    grams, counts = heavy

    def batches(rows):
        for batch in rows_of(rows):
            n, node, number, rest = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(word_ids(text), size)
                n.append(len(own))
                node.append(_identity(own))
                often = own[~_light(own, grams)]
                number.append(len(often))
                order = np.argsort(counts[np.searchsorted(grams, often)], kind="stable")
                often = often[order][: max(0, _reach(len(own)) - (len(own) - len(often)))]
                rest.append(often.view(np.int64).tolist() if len(often) else None)
            columns = [*(pa.array(x, pa.int64()) for x in (n, node, number)), pa.array(rest, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n", "node", "often", "heavy"])
        freed()

    return _texts(docs).mapInArrow(batches, "doc_id bigint, n bigint, node bigint, often bigint, heavy array<bigint>")


def _bucketed(own: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each gram, and the grams' order by bucket."""
    bucket = (mixed(own) % np.uint64(buckets)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _planes(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: the high bytes of small numbers stand together, which the shuffle compresses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _levels(docs: DataFrame, heavy: np.ndarray, buckets: int, size: int) -> DataFrame:
    """node, buckets, levels: how many texts hold each gram of a class, as a byte, in the order of `_bucketed`.

    Chunks of texts ask each bucket for the levels of their grams and get them back in their own order, so a gram costs
    half of its hash on the way there and a byte on the way back; the texts' identities travel once. Copies within a
    chunk ask once, those in other chunks count again, which changes the order but the same for all sets.

    A level is a rounded logarithm, 0 for a gram that one text alone holds. It is a function of the gram's bucket and
    the lower half of its hash, so it orders all sets alike even where two grams share both. Buckets where every level
    of the class is 0 are left out, and so are classes with enough grams of level 0 to fill the prefix. Classes that are
    in several chunks have equal rows for each.

    A chunk is known by what it holds. Should a task that runs again see its texts in another order, the numbers of
    grams asked and answered differ, and the job fails rather than mix them up.
    """

    def chunk(nodes: list[int], ns: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(own) for own in grams])
        own, text = np.concatenate(grams), np.repeat(np.arange(len(grams)), lengths)
        bucket, order = _bucketed(own, buckets)
        halves, text = own[order].astype(np.uint32), text[order]
        held, ends = np.unique(bucket, return_counts=True)
        ends = np.cumsum(ends)
        parts = list(zip([0, *ends[:-1]], ends, strict=True))
        runs = [_runs(text[a:b]) for a, b in parts]
        known = np.array(nodes, np.int64), np.array(ns, np.uint32), lengths.astype(np.uint32)
        name = xxhash.xxh3_64_intdigest(known[0].tobytes())
        columns = [
            pa.array(np.full(len(held), name, np.uint64).view(np.int64)),
            pa.array(held, pa.int64()),
            pa.array([halves[a:b].tobytes() for a, b in parts], pa.binary()),
            pa.array([_planes(np.diff(texts, prepend=0).astype(np.uint32)) for texts, _ in runs], pa.binary()),
            pa.array([_planes(number) for _, number in runs], pa.binary()),
            *(pa.array([value.tobytes()] + [None] * (len(held) - 1), pa.binary()) for value in known),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", "halves", "gaps", "ns", *_KNOWN])

    def packed(batches):
        seen: set[int] = set()
        nodes, ns, grams, held = [], [], [], 0
        for batch in rows_of(batches):
            for text in batch.column("text").to_pylist():
                own = shingles(word_ids(text), size)
                node, light = _identity(own), own[_light(own, heavy)]
                if not len(light) or node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                ns.append(len(own))
                grams.append(light)
                held += len(light)
                if held >= CHUNK_GRAMS:
                    yield chunk(nodes, ns, grams)
                    nodes, ns, grams, held = [], [], [], 0
                    seen.clear()
        if grams:
            yield chunk(nodes, ns, grams)
        seen.clear()
        freed()

    def counted(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(v, np.uint32) for v in table.column("halves").to_pylist()]
        _, place, texts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        level = np.minimum(np.rint(8 * np.log2(texts)), 255).astype(np.uint8)[place]
        answers, at = [], 0
        for own, gaps, ns in zip(asked, table.column("gaps").to_pylist(), table.column("ns").to_pylist(), strict=True):
            mine, at = level[at : at + len(own)], at + len(own)
            text, number = np.cumsum(_numbers(gaps, np.uint32), dtype=np.uint32), _numbers(ns, np.uint32)
            kept = np.add.reduceat((mine > 0).astype(np.int64), np.cumsum(number, dtype=np.int64) - number) > 0
            answers.append((len(own), _planes(text[kept]), _planes(number[kept]), mine[np.repeat(kept, number)].tobytes()))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*answers, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
        names = ["asked", "texts", "ns", "levels", "chunk", "bucket", *_KNOWN]
        return pa.Table.from_arrays([*columns, table.column("chunk"), table.column("bucket"), *(table.column(c) for c in _KNOWN)], names=names)

    def gathered(table: pa.Table) -> pa.Table:
        # Chunks that hold the same texts in the same order have the same answers.
        table = table.take(pa.array(np.unique(table.column("bucket").to_numpy(), return_index=True)[1]))
        known = [next((v for v in table.column(c).to_pylist() if v is not None), b"") for c in _KNOWN]
        node, n, light = (np.frombuffer(v, kind).astype(np.int64) for v, kind in zip(known, (np.int64, np.uint32, np.uint32), strict=True))
        if light.sum() != sum(table.column("asked").to_pylist()):
            raise RuntimeError("a task that ran again read its texts in another order")
        pieces = [[_numbers(v, np.uint32) for v in table.column(c).to_pylist()] for c in ("texts", "ns")]
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(part) for part in pieces[0]])
        texts, ns = map(np.concatenate, pieces)
        level = np.frombuffer(b"".join(table.column("levels").to_pylist()), np.uint8)
        order = np.lexsort((bucket, texts))
        level, texts, ns, bucket = level[_moved(ns, order)], texts[order], ns[order], bucket[order].astype(np.int32)
        shared = np.bincount(np.repeat(texts, ns)[level > 0], minlength=len(node))
        wanted = np.flatnonzero(light - shared < n - (SHARE * n + OF - 1) // OF + 1)
        runs = np.searchsorted(texts, wanted), np.searchsorted(texts, wanted, "right")
        at = np.append(0, np.cumsum(ns, dtype=np.int64))
        return pa.table({
            "node": pa.array(node[wanted], pa.int64()),
            "buckets": pa.array([bucket[a:b].tobytes() for a, b in zip(*runs, strict=True)], pa.binary()),
            "levels": pa.array([level[at[a] : at[b]].tobytes() for a, b in zip(*runs, strict=True)], pa.binary()),
        })

    names = ", ".join(f"{c} binary" for c in _KNOWN)
    rows = _texts(docs).where("doc_id IS NOT NULL").select("text").mapInArrow(packed, f"chunk bigint, bucket bigint, halves binary, gaps binary, ns binary, {names}")
    met = rows.groupBy("bucket").applyInArrow(freeing(counted), f"asked bigint, texts binary, ns binary, levels binary, chunk bigint, bucket bigint, {names}")
    return met.groupBy("chunk").applyInArrow(freeing(gathered), "node bigint, buckets binary, levels binary")


def _moved(ns: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the elements of runs of these lengths come from when the runs are put into another order."""
    lengths = ns.astype(np.int64)
    starts, moved = np.cumsum(lengths) - lengths, lengths[order]
    return np.repeat(starts[order] - (np.cumsum(moved) - moved), moved) + np.arange(moved.sum())


def _runs(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring equal values as one value and its number."""
    starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
    return nodes[starts], np.diff(np.append(starts, len(nodes))).astype(np.uint32)


def _prefixes(docs: DataFrame, classes: DataFrame, heavy: np.ndarray, size: int) -> DataFrame:
    """node, n, the packed grams of its prefix that other classes hold too, frequent ones left out, and `after`: how many
    grams follow the first of them in the order.

    The rarest grams come first. A class with enough grams of its own to fill the prefix has no partner and no row.
    """
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // LEVEL_GRAMS))
    wanted = _levels(docs, heavy, buckets, size).dropDuplicates(["node"]).join(classes, "node")
    wanted = stored(wanted.select("doc_id", F.col("node").alias("wanted"), "buckets", "levels"), "shared")
    texts = _texts(docs).join(wanted.select("doc_id"), "doc_id", "left_semi")

    def chosen(batches):
        for batch in rows_of(batches):
            node, n, light, after, sketch = [], [], [], [], []
            for text, asked, held, levels in zip(*(batch.column(c).to_pylist() for c in ("text", "wanted", "buckets", "levels")), strict=True):
                own = shingles(word_ids(text), size)
                if _identity(own) != asked:  # another text of the same doc_id
                    continue
                rest = own[_light(own, heavy)]
                bucket, order = _bucketed(rest, buckets)
                level = np.zeros(len(rest), np.uint8)
                level[order[np.isin(bucket[order], np.frombuffer(held, np.int32))]] = np.frombuffer(levels, np.uint8)
                prefix = np.argsort(level, kind="stable")[: _reach(len(own))]
                first = prefix[level[prefix] > 0]
                after.append(len(own) - (len(prefix) - len(first)) - 1)
                node.append(asked)
                n.append(len(own))
                light.append(rest[first].tobytes())
                sketch.append(_sketch(own))
            columns = [*(pa.array(x, pa.int64()) for x in (node, n, after)), *(pa.array(x, pa.binary()) for x in (light, sketch))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "after", "light", "sketch"])
        freed()

    return stored(texts.join(wanted, "doc_id").mapInArrow(chosen, "node bigint, n bigint, after bigint, light binary, sketch binary"), "prefixes")


def _sketch(own: np.ndarray) -> bytes:
    """For each cell of the hashes, whether it holds an odd number of the grams."""
    bits = min(max(LEAST_BITS, (4 * len(own)).bit_length()), MOST_BITS)
    cells = (mixed(own) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=1 << bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(left: bytes, right: bytes) -> int:
    """At least so many grams are in one of two sets only: each cell in which the sketches differ has one of them.

    The larger sketch is folded to the size of the smaller, whose cells are the sums of its own.
    """
    size = min(len(left), len(right))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, size), axis=0) for v in (left, right))
    return int(np.bitwise_count(x ^ y).sum())


def _possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose sketches differ in no more cells than the similarity lets the sets differ in grams."""

    def kept(batches):
        for batch in rows_of(batches, 4096):
            columns = (batch.column(c).to_pylist() for c in ("na", "nb", "left", "right"))
            near = [x is None or y is None or _apart(x, y) <= na + nb - 2 * (-(-SHARE * (na + nb) // (OF + SHARE))) for na, nb, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(near, pa.bool_()))
        freed()

    sketches = prefixes.dropDuplicates(["node"])
    left = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("right"))
    rows = pairs.join(left, "a", "left").join(right, "b", "left").select("a", "b", "na", "nb", "left", "right")
    return rows.mapInArrow(kept, "a bigint, b bigint, na bigint, nb bigint")


_LIST = "gram bigint, node bigint, n bigint, rest bigint, leader bigint, leader_n bigint, leader_rest bigint, smallest bigint"


def _lists(sets: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The classes that share a prefix gram, and the leader of each list: the member with the fewest grams before this one.

    Copies of one text differ by grams of their own, which come first; so the leader is the nearest to what they share.

    `rest` is how many grams of the class follow this one. Classes that not even the smallest one could reach are left out.
    """
    total = prefixes.agg(F.sum(F.length("light"))).first()[0] or 0
    buckets = max(1, -(-total // (8 * BUCKET_GRAMS)))

    def packed(batches):
        seen: set[int] = set()
        for batch in rows_of(batches, 4096):
            grams, nodes, ns, rests = [], [], [], []
            for node, n, light, after in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "light", "after")), strict=True):
                if node in seen:  # copies read by this task; what it forgets is sorted out in the bucket
                    continue
                seen.add(node)
                own = np.frombuffer(light, np.uint64)
                grams.append(own)
                nodes.append(np.full(len(own), node))
                ns.append(np.full(len(own), n, np.uint32))
                rests.append((after - np.arange(len(own))).astype(np.uint32))
            if len(seen) > 1 << 18:
                seen.clear()
            if not grams:
                continue
            grams, nodes, ns, rests = map(np.concatenate, (grams, nodes, ns, rests))
            bucket = (mixed(grams) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            parts = [order[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            columns = [[x[at].tobytes() for at in parts] for x in (grams, nodes, ns, rests)]
            yield pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "grams", "nodes", "ns", "rests"])
        freed()

    def listed(table: pa.Table) -> pa.Table:
        kinds = (("grams", np.uint64), ("nodes", np.int64), ("ns", np.uint32), ("rests", np.uint32))
        grams, nodes, ns, rests = (np.concatenate([np.frombuffer(v, kind) for v in table.column(c).to_pylist()]) for c, kind in kinds)
        order = np.lexsort((mixed(nodes.view(np.uint64)), ns, ns - rests, grams))
        grams, nodes, ns, rests = grams[order], nodes[order], ns[order], rests[order]
        own = np.ones(len(grams), bool)
        own[1:] = (grams[1:] != grams[:-1]) | (nodes[1:] != nodes[:-1])
        grams, nodes, ns, rests = grams[own], nodes[own], ns[own].astype(np.int64), rests[own].astype(np.int64)
        _, first, place, members = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
        kept = members[place] > 1
        lead = first[place[kept]]
        smallest = (np.minimum.reduceat(ns, first) if len(ns) else ns)[place[kept]]
        columns = [grams[kept].view(np.int64), nodes[kept], ns[kept], rests[kept], nodes[lead], ns[lead], rests[lead], smallest]
        return pa.table(dict(zip(("gram", "node", "n", "rest", "leader", "leader_n", "leader_rest", "smallest"), columns, strict=True)))

    light = prefixes.mapInArrow(packed, "bucket int, grams binary, nodes binary, ns binary, rests binary")
    light = light.groupBy("bucket").applyInArrow(freeing(listed), _LIST)
    heavy = sets.where(F.col("heavy").isNotNull()).select("node", "n", "often", F.posexplode("heavy").alias("at", "gram"))
    heavy = heavy.select("gram", "node", "n", (F.col("often") - F.col("at") - 1).alias("rest")).distinct()
    leaders = heavy.groupBy("gram").agg(F.min_by(F.struct("node", "n", "rest"), F.struct(F.col("n") - F.col("rest"), "n", "node")).alias("leader"), F.min("n").alias("smallest"))
    leaders = leaders.select("gram", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n"), F.col("leader.rest").alias("leader_rest"), "smallest")
    smallest = F.expr(f"greatest(smallest, ({SHARE} * n + {OF - 1}) div {OF})")
    rows = light.unionByName(heavy.join(leaders, "gram")).withColumn("smallest", smallest)
    return stored(rows.where(F.col("rest") + 1 >= _least("n", "smallest")).drop("smallest"), "lists")


_OTHER = ("other", "other_n", "other_rest", "other_component", "inside")


def _leaders(lists: DataFrame, turn: int) -> DataFrame:
    """Up to LEADERS members of each gram's list, the same for as many lists as possible."""
    by = F.xxhash64("other", F.lit(turn))
    chosen = lists.groupBy("gram", F.pmod(by, F.lit(LEADERS)).alias("seat")).agg(F.min_by(F.struct(*_OTHER), F.struct(by, "other")).alias("leader"))
    return chosen.select("gram", "leader.*")


def _fragments(docs: DataFrame, pairs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node, part and the grams of that part of the order, for the classes of the pairs."""

    def cut(batches):
        for batch in rows_of(batches):
            node, part, grams = [], [], []
            for text in batch.column("text").to_pylist():
                own = shingles(word_ids(text), size)
                own_node, places = _identity(own), (own >> np.uint64(32)) * np.uint64(FRAGMENTS) >> np.uint64(32)
                ends = np.searchsorted(places, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                for k in range(FRAGMENTS):
                    if ends[k + 1] > ends[k]:
                        node.append(own_node)
                        part.append(k)
                        grams.append(own[ends[k] : ends[k + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], names=["node", "part", "grams"])
        freed()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(classes.join(nodes, "node", "left_semi").select("doc_id"), "wanted")
    found = _texts(docs).join(wanted, "doc_id", "left_semi").mapInArrow(cut, "node bigint, part int, grams binary")
    return stored(found.dropDuplicates(["node", "part"]), "fragments")


def _linked(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that reach the similarity: common grams are counted per fragment and summed."""

    def common(batches):
        for batch in rows_of(batches, 4096):
            both = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True)
            n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in both]
            kept = [batch.column(c) for c in ("a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=["a", "b", "na", "nb", "common"])
        freed()

    left = fragments.select(F.col("node").alias("a"), "part", F.col("grams").alias("left"))
    right = fragments.select(F.col("node").alias("b"), "part", F.col("grams").alias("right"))
    rows = pairs.join(left, "a").join(right, ["b", "part"])
    counts = rows.select("a", "b", "na", "nb", "left", "right").mapInArrow(common, "a bigint, b bigint, na bigint, nb bigint, common bigint")
    sums = counts.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return sums.where(OF * F.col("common") >= SHARE * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of the edges (a, b).

    Every node takes the smallest label around it and then the label of its label, until nothing changes; so chains
    shorten by powers of two.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    both = stored(both.unionAll(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        lower = labels.join(around, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(lower.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if new.where("was <> component").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _component(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """The rows with the component of a node; a node without label is its own."""
    known = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(known, node, "left").withColumn(name, F.coalesce(name, node))


def _pairs(met: DataFrame) -> DataFrame:
    """a, b, na, nb, in how many lists they met, and how many grams may still follow, from (node, n, rest, other, ...).

    Only sizes and places in the order that can reach the share.
    """
    met = met.where((F.col("node") != F.col("other")) & (OF * F.least("n", "other_n") >= SHARE * F.greatest("n", "other_n")))
    met = met.where(F.least("rest", "other_rest") + 1 >= _least("n", "other_n"))
    first = F.col("node") < F.col("other")
    ends = [F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")]
    ends += [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("n", "other_n", "na"), ("other_n", "n", "nb"))]
    rows = met.select(*ends, F.least("rest", "other_rest").alias("rest"))
    return rows.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met"), F.min("rest").alias("follow"))


def _least(n: str, other: str) -> Column:
    """How many grams sets of these sizes must have in common."""
    return F.expr(f"({SHARE} * ({n} + {other}) + {OF + SHARE - 1}) div {OF + SHARE}")


def near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    heavy = heavy_grams(docs, size)
    sets = stored(_sets(docs, heavy, size), "sets")
    filled = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = stored(filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "classes")
    prefixes = _prefixes(docs, classes, heavy[0], size)
    lists = _lists(filled, prefixes)
    edges = labels = None
    for turn in range(TURNS + 1):
        if turn == 0 and turn < TURNS:
            met = lists.select("node", "n", "rest", F.col("leader").alias("other"), F.col("leader_n").alias("other_n"), F.col("leader_rest").alias("other_rest"))
        elif labels is not None or turn == TURNS:
            # Members of a list that are not in the component of its first leader; they only get fewer.
            known = labels if labels is not None else lists.select("node", F.col("node").alias("component")).limit(0)
            placed = _component(lists if turn == 1 or labels is None else outside.drop("component", "leading"), known, "node", "component")
            outside = stored(_component(placed, known, "leader", "leading").where("component <> leading"), "outside")
            every = _component(lists.join(outside.select("gram").distinct(), "gram", "left_semi"), known, "node", "component")
            every = _component(every, known, "leader", "leading").withColumn("inside", F.col("component") == F.col("leading"))
            every = every.select("gram", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("rest").alias("other_rest"), F.col("component").alias("other_component"), "inside")
            own = outside.select("gram", "node", "n", "rest", "component")
            if turn < TURNS:
                met = own.join(_leaders(every, turn), "gram")
            else:
                met = own.join(every, "gram").where(F.col("inside") | (F.col("node") < F.col("other")))
            met = met.where("component <> other_component")
        else:
            continue
        pairs = _pairs(met)
        if turn == TURNS:
            # All their common grams down to the last that passed are counted; after it they share no more than follow.
            pairs = pairs.where(F.col("met") + F.col("follow") >= _least("na", "nb"))
        pairs = stored(_possible(pairs, prefixes), "pairs")
        if pairs.isEmpty():
            continue
        new = stored(_linked(pairs, _fragments(docs, pairs, classes, size)), "links")
        edges = new if edges is None else edges.unionAll(new)
        labels = components(edges)
    # Rows of one doc_id with different sets are one vertex.
    several = filled.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    same = stored(several.select("a", F.explode("nodes").alias("b")), "same-id")
    if not same.isEmpty():
        labels = components(same if edges is None else edges.unionAll(same))
    rows = sets.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    if labels is None:
        named = classes.select("node", F.col("doc_id").alias("component_id"))
    else:
        of = classes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
        named = of.join(of.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs, sf_dir):
    """One document of each component, the one with the smallest doc_id."""
    found = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(found, docs["doc_id"] == found["_copy"], "left_anti")


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE} - 1], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE {OF} * c >= {SHARE} * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""
