"""Ranked search, fill-in-the-middle and the line quality field, against plain versions of the same."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from conftest import DATA
from corpus_fixtures import docs, table  # noqa: F401

from webloom.llm import fill_middle, line_quality, ranked_search

ODD = [None, "", " ", "\n\n", "a", "é", "x" * 30_000, "aé日\U0001f600 b  c\t\n d", "\n", "no newline", "one\ntwo\n", "has <S> inside", "<", "a<\nS>b\n<M"]
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def best_documents(rows, items, k=10):
    counts = [(i, collections.Counter(terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_all = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    found = []
    for item, own in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n_docs // n_all
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(scores)[:k], 1):
            found.append((item or -1, rank, i, -score))
    return sorted(found, key=str)


@pytest.mark.parametrize(("segment", "block"), [(500_000, 200_000), (40, 200_000), (200, 30)])
def test_search_against_brute_force(docs, table, monkeypatch, segment, block):
    """Copies (ties), frequent and rare words, odd texts; many small segments and blocks change nothing."""
    monkeypatch.setattr(ranked_search, "SEGMENT_POSTINGS", segment)
    rng = random.Random(12)
    words = [f"W{k}" for k in range(60)] + ["日本", "é_x", "the"]
    draw = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), 62)] for _ in range(n))
    texts = [draw(rng.randint(0, 40)) for _ in range(150)]
    texts += [texts[3]] * 14 + ODD + ["the " * 3000]
    rows = list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (5, "w1 W2 w59")]
    items = [(k, draw(rng.randint(1, 12))) for k in range(1, 26)] + [(100, None), (101, ""), (102, "nowhere"), (1, "w59 more"), (None, texts[3])]
    benchmark = table([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    found = ranked_search.search(docs(*[(i, t, None, None) for i, t in rows]), benchmark, block_terms=block).collect()
    got = sorted(((r.item_id or -1, r.rank, r.doc_id, r.score) for r in found), key=str)
    assert got == best_documents(rows, items)


def test_search_stops_opening_accumulators():
    """Once k texts beat all that is left, later terms touch survivors only, and the scores stay those of all terms."""
    searcher = ranked_search.Searcher([np.array([0, 1])], np.array([3, 900]), 1000, 5000, 2)
    docs, rare = np.arange(1000), np.array([5, 7, 9], np.int32)
    common = np.arange(900, dtype=np.int32)
    places = np.concatenate([rare, common])
    searcher.add(docs, np.full(1000, 5), np.array([0, 1], np.int32), np.array([0, 3, 903]), places, np.ones(903, np.int32))
    whole = ranked_search.weights(np.array([3, 900]), 1000).sum() * (10**9 // (1000 + 8 * 100))
    assert sorted(searcher.best[0]) == [(whole, -7), (whole, -5)]


def test_search_empty_tables(docs, table):
    some, none = docs((1, "x y", None, None)), docs((1, "x", None, None)).limit(0)
    items = table([(1, "x")], "item_id bigint, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(some, items.limit(0)).count() == 0
    assert ranked_search.search(docs((1, None, None, None), (2, "...", None, None)), items).count() == 0


def fim(i, text):
    """The contract, word by word."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return i, n, "plain", None, None, text
    if h4 % 100 < 50:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_against_contract(docs):
    rng = random.Random(13)
    pieces = ["é", "日本", "\U0001f600", "abc", "\n", "\n", " ", "<", "S>"]
    texts = ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = list(enumerate(texts)) + [(None, "a\nb\né\n"), (4, texts[4]), (4, "other\ntext")]
    made = fill_middle.fill_middle(docs(*[(i, t, None, None) for i, t in rows]))
    back = fill_middle.restore(made).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in back), key=str)
    assert got == sorted((fim(i, t) for i, t in rows), key=str)
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.fill_middle(docs((1, "x", None, None)).limit(0))).count() == 0


def test_fill_middle_between_characters(docs):
    rule = fill_middle.Rule(unit="char", transformed=70)
    texts = ["é日\U0001f600abc" * 30, "plain ascii only", "日", *[t for t in ODD if t]]
    made = fill_middle.fill_middle(docs(*[(i, t, None, None) for i, t in enumerate(texts)]), rule)
    for r in fill_middle.restore(made, rule).collect():
        text = texts[r.doc_id]
        assert r.text == text and r.n == len(text)
        if r.form == "psm":
            body = bytes(r.output).decode()
            assert body[3 : 3 + r.prefix_chars] == text[: r.prefix_chars]
            assert body.endswith("<M>" + text[r.prefix_chars : r.prefix_chars + r.middle_chars])
    with pytest.raises(ValueError):
        fill_middle.Rule(prefix=b"<S><", suffix=b"<S>")
    with pytest.raises(ValueError):
        fill_middle.Rule(prefix=b"ab", suffix=b"bc")


@pytest.mark.parametrize("text", ["", "abc", "é", "aé日\U0001f600b" * 7, "日" * 5 + "x", "x" * 9 + "\U0001f600"])
def test_character_index(text):
    index = fill_middle.CharIndex(text.encode())
    places = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.n_chars == len(text) and index.n_bytes == places[-1]
    assert index.to_bytes(np.arange(len(places))).tolist() == places
    assert index.to_chars(places).tolist() == list(range(len(places)))


def test_chains_against_all_labellings():
    """Marginals, pairs and P(all good) of short chains, by listing every labelling."""
    rng = np.random.default_rng(14)
    counts = np.array([3, 1, 5])
    potential, links = rng.normal(size=9), rng.normal(size=(2, 2))
    lines = line_quality.Lines(np.zeros((9, len(line_quality.FEATURES)), np.uint8), np.ones(9), counts)
    found = line_quality.chains(potential, links, lines)
    pair = 0
    for d, start in enumerate(lines.starts):
        own = potential[start : start + counts[d]]
        weight = {y: math.exp(sum(p * v for p, v in zip(own, y, strict=True)) + sum(links[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=len(own))}
        z = sum(weight.values())
        assert math.isclose(math.exp(found.all_good[d]), weight[(1,) * len(own)] / z)
        for t in range(len(own)):
            assert math.isclose(found.good[start + t], sum(w for y, w in weight.items() if y[t]) / z)
        for t in range(1, len(own)):
            want = [sum(w for y, w in weight.items() if (y[t - 1], y[t]) == ab) / z for ab in ((0, 0), (0, 1), (1, 0), (1, 1))]
            assert np.allclose(found.pairs[pair], want)
            pair += 1


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(15)
    lines = line_quality.lines_of([b"good line here\nand more", b"BAD!! BAD!!\nBAD!!\nfine words", b"x", b""])
    label, cells = np.array([1.0, 0.0, 1.0, 0.0]), line_quality._cells(lines)
    model = line_quality.Field(tables=rng.normal(size=(3, len(line_quality.FEATURES), 13)) * 0.1, links=rng.normal(size=(2, 2)))
    _, tables, links = line_quality.gradient(model, lines, cells, label)
    value = lambda: line_quality.gradient(model, lines, cells, label)[0]
    for part, slope in ((model.tables.ravel(), tables.ravel()), (model.links.ravel(), links.ravel())):
        for at in {*np.argsort(-np.abs(slope))[:6].tolist(), 0}:
            part[at] += 1e-5
            up = value()
            part[at] -= 2e-5
            down = value()
            part[at] += 1e-5
            assert math.isclose((up - down) / 2e-5, slope[at], rel_tol=1e-3, abs_tol=1e-5)


def test_quality_odd_rows_and_batches(docs, table):
    rows = docs(*[(i, t, None, None) for i, t in enumerate(ODD)], *[(100 + i, "fine words here\nand there" if i % 2 else "JUNK!! JUNK!!\nfine words", None, None) for i in range(60)], (100, "JUNK!! JUNK!!", None, None), (None, "x", None, None))
    labels = table([(100 + i, i % 2, 0) for i in range(40)] + [(101, 1, 0), (None, 1, 1), (120, None, 0)], "doc_id bigint, quality int, toxic int")
    model = line_quality.train(rows, labels)
    found = line_quality.score(rows, model).collect()
    assert len(found) == len(ODD) + 62 and all(0 <= r.score <= 1 for r in found)
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in found if r.doc_id and r.doc_id >= 140)
    junk = [r for r in found if r.doc_id == 142]
    assert junk[0].n_lines == 2 and junk[0].n_bad >= 1
    # A text's score does not depend on its neighbours in the batch.
    alone = model.quality(line_quality.lines_of([b"JUNK!! JUNK!!\nfine words"]))[0]
    assert math.isclose(alone, junk[0].score)
    assert {r.n_lines for r in found if r.doc_id in (0, 1)} == {1}
    assert all(r.score == 0.5 for r in line_quality.score(rows, line_quality.train(rows, labels.limit(0))).collect())
    assert line_quality.score(rows.limit(0), model).count() == 0


def test_quality_held_out_accuracy(spark):
    found = line_quality.op13_line_quality(spark, "/root/testdata/sf0.1").where("held_out")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98


def test_new_queries_over_their_tables(spark):
    assert ranked_search.op11_ranked_search(spark, DATA).where("rank = 1").count() == spark.read.parquet(f"{DATA}/benchmark.parquet").count()
    rows = fill_middle.op12_fill_middle(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    assert rows.where("restored_sha256 <> sha2(cast(coalesce(text, '') as binary), 256)").count() == 0
