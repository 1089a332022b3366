"""Operators that compare documents with each other or with other tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from corpus_fixtures import docs, table  # noqa: F401

from webloom.llm import ann, decontaminate, jaccard, line_dedup, pitman_yor, sharding
from webloom.llm.catalog import ORACLES, QUERIES


def test_minimal_hash_is_minimal_and_perfect():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    keys = np.unique(keys)
    index = line_dedup.MinimalHash.build(keys)
    assert sorted(index.find(keys)) == list(range(len(keys)))
    assert len(line_dedup.MinimalHash.build(keys[:0]).find(keys[:5])) == 5


def kept_lines(rows, min_chars=40, min_docs=5):
    key = lambda line: line.strip(" \t\n\r\v\f").translate({c: c + 32 for c in range(65, 91)})
    holders = collections.defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            holders[k].append(-(1 << 63) if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(set(v)) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [line for line in lines if gone.get(key(line), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def test_lines_are_counted_by_document(docs):
    """Four rows of one document and one of another are two documents, however often the line stands there."""
    line = "a line that is long enough to count, held by many rows"
    few = [(1, f"{line}\n{line}", None, None)] * 4 + [(2, line, None, None)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs(*few)).collect()} == {0}
    many = [(i, line, None, None) for i in (1, 2, 3, 4, None)]
    assert sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup.dedup_lines(docs(*many)).collect()) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


@pytest.mark.parametrize("probes", [line_dedup.PROBES_PER_TASK, 3])
def test_lines_against_brute_force(docs, monkeypatch, probes):
    monkeypatch.setattr(line_dedup, "PROBES_PER_TASK", probes)
    rng = random.Random(4)
    pool = ["Shared line number %d that is long enough to count é" % i for i in range(12)] + ["short"] * 3 + [""]
    change = lambda s: rng.choice([s, s.upper().replace("É", "é"), f"  {s}\t", s + "\r"])
    rows = [(i, "\n".join(change(rng.choice(pool)) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 50_000), (3, rows[3][1])]
    found = line_dedup.dedup_lines(docs(*[(i, t, "en", "s") for i, t in rows]))
    assert "n_chars" in found.columns and "score" in found.columns
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect())
    assert got == sorted(kept_lines(rows))
    assert line_dedup.dedup_lines(docs((1, "x", None, None)).limit(0)).count() == 0


def components_of(texts, share=(80, 100)):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and share[1] * both >= share[0] * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("turns", [0, 1, 6])
def test_near_duplicates_against_brute_force(docs, monkeypatch, turns):
    """Chains of edits, copies, a common passage and short texts; with and without leaders the components are the same."""
    monkeypatch.setattr(jaccard, "TURNS", turns)
    monkeypatch.setattr(jaccard, "HEAVY_SHARE", 1 << 9)
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 4)
    monkeypatch.setattr(jaccard, "LEVEL_GRAMS", 500)
    monkeypatch.setattr(jaccard, "CHUNK_GRAMS", 300)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [None, "", "  \n", "one two", "ONE  two", "one two three", "y " * 4000]
    for group in range(6):
        words = [f"g{group}w{rng.randint(0, 60)}" for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(12):
            texts.append(" ".join(words) + (" " + passage if group % 2 else ""))
            if rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = f"e{rng.randint(0, 9)}"
    found = jaccard.near_duplicates(docs(*[(i, t, None, None) for i, t in enumerate(texts)]))
    assert sorted(map(tuple, found.collect())) == components_of(texts)


def test_sketches_never_overrate_a_difference():
    """Sets of all sizes, so that sketches are folded: as many cells differ at most as grams do."""
    rng = np.random.default_rng(3)
    for size in (1, 7, 40, 900, 9_000):
        for other in (1, 30, 900, 20_000):
            pool = rng.integers(0, 2**63, size + other, dtype=np.uint64)
            left, right = pool[:size], pool[rng.integers(0, size) :][:other]
            assert jaccard._apart(jaccard._sketch(left), jaccard._sketch(right)) <= len(np.setxor1d(left, right))
    same = jaccard._sketch(pool)
    assert jaccard._apart(same, same) == 0


def test_near_duplicates_odd_tables(docs):
    same = docs((7, "a b c d e f", None, None), (7, "completely other words stand in here", None, None), (2, "a b c d e f", None, None), (None, "a b c d e f", None, None))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(same).collect())
    assert got == [(-1, 2, None), (2, 2, 2), (7, 2, 2), (7, 2, 2)]
    assert jaccard.near_duplicates(docs((1, "x", None, None)).limit(0)).count() == 0


def test_connected_components(table):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, jaccard.components(table(edges, "a bigint, b bigint")).collect()))
    assert all(found[i] == 0 for i in range(41)) and found[100] == found[95] == 90


def test_decontamination_finds_edited_passages(docs, table):
    rng = random.Random(6)
    item = [f"w{k}" for k in range(30)]
    edited = ["XX" if k % 6 == 5 else w for k, w in enumerate(item)]
    far = ["XX" if k % 2 else w for k, w in enumerate(item)]
    noise = lambda n: " ".join(f"n{rng.randint(0, 500)}" for _ in range(n))
    rows = [
        (1, f"{noise(50)} {', '.join(item).upper()}. {noise(20)}", None, None), (2, f"{noise(5)} {' '.join(edited)}", None, None), (3, " ".join(far), None, None),
        (4, noise(200), None, None), (5, None, None, None), (6, "", None, None), (7, " ".join(item[:22]), None, None), (8, " ".join(item[:8]), None, None),
        (1, "repeated id without passage", None, None), (9, " ".join(f"v{k}" for k in range(12)), None, None), (None, " ".join(item), None, None),
    ]
    benchmark = table([(10, " ".join(item), 1), (11, None, 1), (12, "repeated ID", 1), (14, "", 1), (15, "id passage", 1), (13, " ".join(f"v{k}" for k in range(12)), 1), (10, " ".join(item), 2)], "item_id bigint, text string, words int")
    want = {(1, 10), (2, 10), (7, 10), (9, 13), (None, 10), (1, 12)}
    for block in (decontaminate.BLOCK_WORDS, 20):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs(*rows), benchmark, block).collect()} == want
    assert decontaminate.contained(docs(*rows), benchmark.limit(0)).count() == 0
    assert decontaminate.contained(docs(*rows).limit(0), benchmark).count() == 0


def runs_contained(text, item):
    """(n_equal, n_run) of the best alignment that a mask hits, by looking at every pair of places; None without one."""
    n = len(item)
    if n < decontaminate.SPAN:
        return (n, n) if n and any(text[i : i + n] == item for i in range(len(text))) else None
    run, best = min(decontaminate.RUN, n), None
    for at in range(len(text)):
        for item_at in range(n - decontaminate.SPAN + 1):
            if any(all(at + o < len(text) and text[at + o] == item[item_at + o] for o in mask) for mask in decontaminate.MASKS):
                equal = [text[at - item_at + j] == item[j] for j in range(n) if 0 <= at - item_at + j < len(text)]
                for start in range(len(equal) - run + 1):
                    best = max(best or (0, run), (sum(equal[start : start + run]), run))
    return best if best and best[0] >= math.ceil(decontaminate.MIN_SHARE * run) else None


def test_decontamination_against_all_places(docs, table):
    rng = random.Random(21)
    items = [[f"w{rng.randint(0, 60)}" for _ in range(n)] for n in (1, 2, 5, 8, 8, 9, 10, 15, 20, 26, 40)]
    rows = [(1000, " ".join(f"w{rng.randint(0, 60)}" for _ in range(3000)), None, None)]
    for i in range(80):
        item = list(rng.choice(items))
        for k in rng.sample(range(len(item)), min(len(item), rng.choice([0, 0, 1, 2, 4, 6]))):
            item[k] = "other"
        first = rng.randint(0, len(item) // 3)
        noise = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(0, 20))]
        rows.append((i, " ".join(noise + item[first:] + noise[:3]), None, None))
    want = {(i, k, *found) for i, text, *_ in rows for k, item in enumerate(items) if (found := runs_contained(text.split(), item))}
    benchmark = table([(k, " ".join(item)) for k, item in enumerate(items)], "item_id bigint, text string")
    for block in (decontaminate.BLOCK_WORDS, 30):
        assert set(map(tuple, decontaminate.contained(docs(*rows), benchmark, block).collect())) == want
    assert len({k for _, k, *_ in want}) >= 10


def test_a_large_benchmark_is_not_sent_to_all_tasks(docs, table):
    """However many times the bound a benchmark is, no block of it is broadcast, let alone all blocks at once."""
    items = [(k, " ".join(f"w{k + j}" for j in range(20 if k % 2 else 5))) for k in range(30)]
    benchmark = table(items, "item_id bigint, text string")
    rows = docs(*[(k, f"some {text} more", None, None) for k, text in items[:7]])
    found = decontaminate.contained(rows, benchmark, 20)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, found.collect())) == set(map(tuple, decontaminate.contained(rows, benchmark).collect()))
    assert {(k, k) for k in range(7)} <= {(r.doc_id, r.item_id) for r in found.collect()}


def test_nearest_neighbours_of_extreme_numbers(table):
    rows = [(0, [1e200, 1e200]), (1, [1.0, 1.1]), (2, [3e-300, 0.0]), (3, [5e-324, 5e-324]), (4, [-1e308, 1e308])]
    found = ann.nearest(table(rows, "vec_id bigint, embedding array<double>"), ann.F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [3, 1, 2, 4]
    assert [round(r.score, 6) for r in sorted(found, key=lambda r: r.rank)] == [1.0, 0.998868, 0.707107, 0.0]


def test_nearest_neighbours_recall_and_odd_rows(spark, table):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[100:400] = x[100]  # a third of some part is one vector
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0, None] + [0.0] * 14, 0), (None, [1.0] * 16, 0), (5200, [1.0, 2.0], 0)]
    found = ann.nearest(table(rows, "vec_id bigint, embedding array<float>, rank int"), ann.F.col("vec_id") % 50 == 0).collect()
    by = collections.defaultdict(dict)
    for r in found:
        by[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(by) == set(range(0, 1500, 50))
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    hits = 0
    for q, own in by.items():
        assert sorted(own) == [1, 2, 3, 4, 5] and q not in [v for v, _ in own.values()]
        score = unit @ unit[q]
        score[q] = -2
        order = np.lexsort((np.arange(len(y)), -np.round(score, 9)))[:5]
        hits += len(set(order) & {v for v, _ in own.values()})
        assert all(abs(score[v] - s) < 1e-9 for v, s in own.values())
        if q in range(100, 400):
            assert [own[k][0] for k in range(1, 6)] == [v for v in range(100, 106) if v != q][:5]
    assert hits / (5 * len(by)) >= 0.9
    none = ann.nearest(table(rows, "vec_id bigint, embedding array<float>, rank int").limit(0), ann.F.col("vec_id") % 50 == 0)
    assert none.count() == 0
    few = ann.nearest(table(rows[:3], "vec_id bigint, embedding array<float>, rank int"), ann.F.col("vec_id") % 50 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


def test_shards_follow_the_mixture(docs):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randint(0, 9), None, rng.choice(["a", "a", "a", "b", None])) for i in range(1000)] + [(5, None, None, "b"), (None, "x", None, "c"), (5, None, None, "b")]
    found = sharding.interleave(docs(*rows), 24, range_rows=50).collect()
    assert len(found) == len(rows)
    per = collections.defaultdict(list)
    for r in found:
        per[r.shard].append(r)
    assert set(per) == set(range(24)) and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    for own in per.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for source in ("a", "b", None):
        share = sum(r[3] == source for r in rows) / 24
        assert all(abs(sum(r.source == source for r in own) - share) <= 2 for own in per.values())
    sizes = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == sizes
    # The ranges are only a way to count: one range gives the same places.
    whole = sharding.interleave(docs(*rows), 24, range_rows=10_000).collect()
    assert sorted((r.shard, r.slot, r.doc_id or -1) for r in whole) == sorted((r.shard, r.slot, r.doc_id or -1) for r in found)
    assert sharding.interleave(docs(*rows).limit(0), 24).count() == 0


def test_pitman_yor_base_and_normalisation(docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 200)
    rng = random.Random(9)
    words = ["the", "of", *[f"w{k}" for k in range(40)]]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([2, 42])]) for _ in range(rng.randint(0, 30)))) for i in range(90)] + [(200, None), (201, "  "), (3, "Repeated The"), (3, "Repeated The"), (None, "the of")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    from webloom.llm.words import remainder

    found = pitman_yor.score(docs(*[(i, t, None, None) for i, t in rows]), remainder(pitman_yor.F.col("doc_id"), 7) == 2).collect()
    tokens = lambda t: (t or "").lower().split() + ["\n"]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(counts.values())
    want = sorted((i or -1, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert pitman_yor.score(docs((1, "x", None, None)).limit(0), remainder(pitman_yor.F.col("doc_id"), 7) == 2).count() == 0


def test_pitman_yor_counts_thinly_spread_words(docs):
    """A word that no task meets twice has its restaurant by its count in the whole data."""
    rows = [(i, f"thin own{i} own{i}", None, None) for i in range(6)]
    table = docs(*rows).repartitionByRange(6, "doc_id").selectExpr("doc_id", "false AS held_out", "CAST(text AS BINARY) AS text")
    words, size = pitman_yor.vocabulary(table)
    known = {int(x) for x in words.contexts}
    assert size == 6 * 4
    assert int(pitman_yor.word_ids(b"thin")[0]) in known and len(known) == 8


def test_pitman_yor_probabilities_add_up(docs):
    """After a context, the probabilities of all known words, the end and one unknown word sum to one."""
    rng = random.Random(10)
    words = [f"w{k}" for k in range(25)]
    train = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(60)]
    every = [*words, "unknown"]
    texts = ["", *every, *[f"{v} {w}" for v in every for w in every]]
    held = pitman_yor.F.col("doc_id") >= 1000
    rows = [(i, t, None, None) for i, t in train] + [(1000 + k, t, None, None) for k, t in enumerate(texts)]
    found = {texts[r.doc_id - 1000]: r.score for r in pitman_yor.score(docs(*rows), held).collect() if r.held_out}
    # score("v w") - score("v") is log P(w | v) P(end | w) / P(end | v). With x(v) = 1 / P(end | v), that P(. | v) adds up
    # to one says x(v) = 1 + the sum over w of 10 ** (score("v w") - score("v")) x(w).
    step = np.array([[10 ** (found[f"{v} {w}"] - found[v]) for w in every] for v in every])
    x = np.linalg.solve(np.eye(len(every)) - step, np.ones(len(every)))
    assert (x > 1).all()
    # What follows the start of a text adds up as well.
    assert abs(10 ** found[""] + sum(10 ** found[w] * y for w, y in zip(every, x, strict=True)) - 1) < 1e-3


def test_pitman_yor_rare_words_have_restaurants_of_their_own(docs, monkeypatch):
    """Of 400 words each is followed by one word only, and the model knows that of each, however few are frequent."""
    monkeypatch.setattr(pitman_yor, "CONTEXTS", 2)
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 6000)
    train = [(i, f"c{i % 400} v{i % 400}", None, None) for i in range(8000)]
    held = [(10_000 + k, f"c{k} v{k}", None, None) for k in range(400)] + [(20_000 + k, f"c{k} v{(k + 1) % 400}", None, None) for k in range(400)]
    scores = {r.doc_id: r.score for r in pitman_yor.score(docs(*train, *held), pitman_yor.F.col("doc_id") >= 10_000).collect()}
    assert min(scores[10_000 + k] for k in range(400)) > math.log10(0.7 / 400)
    assert max(scores[20_000 + k] for k in range(400)) < math.log10(0.1 / 400)


def test_chunks_and_buckets_change_no_count(docs, monkeypatch):
    """One long text, many chunks and buckets: the counts stay, and the chunks alone change nothing at all."""
    rng = random.Random(12)

    def text(n):  # a word is mostly followed by the same one of few
        at = [rng.randint(0, 300)]
        for _ in range(n):
            at.append((at[-1] * 7 + rng.randint(0, 2)) % 301 if rng.random() < 0.8 else rng.randint(0, 300))
        return " ".join(f"w{k}" for k in at[:n])

    texts = [text(n) for n in (20_000, *[rng.randint(0, 60) for _ in range(200)])]
    rows = docs(*[(i, t, None, None) for i, t in enumerate(texts)])
    held = pitman_yor.F.col("doc_id") % 5 == 1
    of = lambda: sorted(map(tuple, pitman_yor.score(rows, held).collect()))
    whole = of()
    monkeypatch.setattr(pitman_yor, "CHUNK_BYTES", 500)
    chunked = of()
    assert np.allclose([r[5:] for r in whole], [r[5:] for r in chunked]) and [r[:5] for r in whole] == [r[:5] for r in chunked]
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 400)
    many = of()
    assert [r[:5] for r in whole] == [r[:5] for r in many] and np.allclose([r[5] for r in whole], [r[5] for r in many])
    for found in (whole, many):
        assert sum(r[6] for r in found if r[1]) > sum(r[5] for r in found if r[1])


@pytest.mark.parametrize("customers", [1, 2, 5, 400])
def test_seating_is_within_bounds(customers):
    rng = np.random.default_rng(11)
    t = pitman_yor.seated(np.full(2000, customers), np.full(2000, 0.7), 0.6, rng)
    assert t.min() >= 1 and t.max() <= customers
    if customers == 2:  # the second customer opens a table with probability 0.7 / (0.7 + 1 - 0.6)
        assert abs((t - 1).mean() - 0.7 / 1.1) < 0.05


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{DATA}/{name_}.parquet'")
    want = connection.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts
        texts = stage(spark, before, DATA)
        assert texts.columns == columns, name
    last = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    kept = {r.doc_id: r.text for r in texts.collect()}
    assert set(last) == set(kept) and len(kept) > 0.5 * docs.count()
    assert all(r.decoded_sha256 == hashlib.sha256(kept[i].encode()).hexdigest() for i, r in last.items())
