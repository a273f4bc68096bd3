import math
import re
from collections import Counter

import numpy as np
import pytest

from driftwell.llm import lexical_search
from driftwell.llm.lexical_search import Best, Block, rank_documents, search

from .conftest import SCHEMA, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k):
    held = [(d, Counter(t), len(t)) for d, t in ((d, terms(x)) for d, x in docs) if t]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        scores = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2.0 * n + 2) / (2.0 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("blocks", [1, 3])
def test_equals_brute_force(spark, monkeypatch, blocks):
    r = np.random.default_rng(blocks)
    words = [f"w{k}" for k in range(300)] + ["Été", "漢字", "ok"]
    weight = 1 / np.arange(1, len(words) + 1)
    some = lambda n: " ".join(r.choice(words, n, p=weight / weight.sum()))
    docs = [(int(k), some(int(r.integers(1, 200)))) for k in r.permutation(700)]
    docs += [(1000 + k, docs[k % 5][1].upper()) for k in range(60)]  # equal scores over the k best
    queries = [(k, some(int(r.integers(1, 30)))) for k in range(25)] + [(30, docs[0][1]), (31, docs[1][1] + " unknown-word"), (32, ""), (33, None), (34, "nowhere"), (35, "w0 w0 w0")]
    if blocks > 1:
        monkeypatch.setattr(lexical_search, "QUERY_BYTES", sum(len(t or "") for _, t in queries) // blocks + 1)
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 200)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for k in (1, 20):
        assert got(rank_documents(frame, spark.createDataFrame(queries, "item_id long, text string"), k)) == brute(docs, queries, k)


def test_awkward_rows(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    queries = [(1, prose(1, 40)), (1, "one TWO"), (None, "été"), (2, None), (3, prose(3, 20)), (3, prose(3, 20))]
    frame = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in queries], "item_id long, text string, doc_id int, rank string, score double")
    assert got(rank_documents(awkward, frame)) == brute(docs, queries, 20)
    assert rank_documents(empty, frame).collect() == []
    assert rank_documents(awkward, frame.limit(0)).collect() == []
    assert rank_documents(awkward, spark.createDataFrame([], SCHEMA), item="doc_id").collect() == []


def test_long_texts_are_read_whole(spark, longest):
    docs = [(1, longest + " lastword"), (2, "lastword here"), (3, "other")]
    queries = [(1, "lastword"), (2, longest[:500])]
    assert got(rank_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"))) == brute(docs, queries, 20)


def test_pruned_search_skips_documents():
    r = np.random.default_rng(2)
    n, n_terms = 20_000, 6
    doc, t = np.nonzero(r.random((n, n_terms)) < [[0.5, 0.3, 0.1, 0.02, 0.01, 0.005]])
    tf = r.integers(1, 9, len(doc))
    m = 75 + r.integers(0, 100, n)
    block = Block(np.arange(n), np.ones(n, bool), m, doc, t, tf, n_terms)
    terms_, weights = np.arange(n_terms), np.array([300, 800, 2000, 3800, 4500, 5200])
    best = Best(20)
    splits = search(block, terms_, weights, best)
    score = np.bincount(doc, weights[t] * ((10**9 * tf) // (1000 * tf + 12 * m[doc])), n).astype(np.int64)
    want = sorted(zip((-score).tolist(), range(n), strict=True))[:20]
    assert [(-s, d) for s, d in want] == list(zip(best.score.tolist(), best.id.tolist(), strict=True))
    assert splits < n / 10


def test_sparse_table_gives_greatest():
    r = np.random.default_rng(4)
    t = np.sort(r.integers(0, 5, 400))
    block = Block(np.arange(400), np.ones(400, bool), np.full(400, 100), np.arange(400), t, r.integers(1, 50, 400), 5)
    for k in range(5):
        lo, hi = np.sort(r.integers(block.start[k], block.start[k + 1] + 1, (200, 2)), axis=1).T
        place = block.greatest(lo, hi)
        for x, y, p in zip(lo, hi, place, strict=True):
            assert p == -1 if x == y else x <= p < y and block.impact[p] == block.impact[x:y].max()
