"""Term index, substring join and clustered vector index against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import substrings, term_index, vector_index
from driftwell.plans import scalars


@pytest.fixture(scope="module")
def skewed(spark):
    r = np.random.default_rng(1)
    p = 1 / np.arange(1, 401)
    rows = [(int(i), " ".join(f"w{k}" for k in r.choice(400, r.integers(1, 30), p=p / p.sum()))) for i in range(4000)]
    rows += [(-1, None), (-2, ""), (7, "w5 extra")]
    return rows, spark.createDataFrame(rows, "id long, text string")


def plain(rows, asked, k, every=False):
    held = {}
    for i, t in rows:
        held.setdefault(i, Counter()).update((t or "").split())
    out = []
    for q, terms in asked.items():
        found = [(-sum(c[t] for t in terms), i, sum(t in c for t in terms)) for i, c in held.items() if any(t in c for t in terms)]
        found = [f for f in found if not every or f[2] == len(terms)]
        out += [(q, i, -s, n, rank) for rank, (s, i, n) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("head", "block"), [(128, 256), (10, 16)])
def test_term_index_equals_full_scoring(spark, skewed, monkeypatch, head, block):
    monkeypatch.setattr(term_index, "HEAD", head)
    monkeypatch.setattr(term_index, "BLOCK", block)
    rows, frame = skewed
    index = term_index.build_scratch(term_index.field_postings(frame, "id", {"text": 1}), "t")
    r = np.random.default_rng(3)
    asked = {q: sorted({f"w{k}" for k in r.integers(0, 400, 5)} | {"w0"}) for q in range(12)} | {20: ["none"], 21: ["w399", "none"], 22: ["extra"]}
    frame = spark.createDataFrame([(q, t) for q, terms in asked.items() for t in terms], "query_id long, term string")
    for k in (1, 10):
        assert sorted(tuple(x) for x in term_index.search(index, frame, k).select("query_id", "id", "score", "hits", "rank").collect()) == plain(rows, asked, k)
    pairs = {q: terms[:2] for q, terms in asked.items()}
    few = spark.createDataFrame([(q, t) for q, terms in pairs.items() for t in terms], "query_id long, term string")
    assert sorted(tuple(x) for x in term_index.search(index, few, 10, every_term=True).select("query_id", "id", "score", "hits", "rank").collect()) == plain(rows, pairs, 10, True)
    assert term_index.search(index, frame.limit(0), 10).collect() == []


def test_frequent_terms_bring_no_candidates(spark, skewed, monkeypatch):
    monkeypatch.setattr(term_index, "BLOCK", 16)
    rows, _ = skewed
    weighted = [(i, t, 1 if t == "w0" else 9) for i, text in rows if text for t in set(text.split())]
    index = term_index.build_scratch(spark.createDataFrame(weighted, "id long, term string, score long"), "t")
    asked = spark.createDataFrame([(1, "w0"), (1, "w50"), (1, "w60")], "query_id long, term string")
    holders = sum(t in ("w50", "w60") for _, t, _ in weighted)
    assert term_index.candidates(index, asked, 5).count() <= holders < sum(t == "w0" for _, t, _ in weighted) / 2
    largest = index.blocks.agg(F.max(F.size("ids"))).first()[0]
    assert largest < 16 * 4


def test_term_index_on_nothing(spark):
    none = spark.createDataFrame([], "id long, term string, score long")
    index = term_index.build_scratch(none, "t")
    assert term_index.search(index, spark.createDataFrame([(1, "a")], "query_id long, term string"), 3).collect() == []


def test_substring_join_equals_plain(spark):
    r = np.random.default_rng(6)
    letters = list("abé漢𝄞 ")
    texts = [(i, "".join(r.choice(letters, r.integers(0, 200)))) for i in range(150)] + [(900, None), (901, "a" * 3000), (902, "")]
    needles = []
    for k in range(200):
        t = texts[int(r.integers(150))][1]
        at, n = int(r.integers(0, max(1, len(t)))), int(r.choice([3, 12, 19, 20, 25, 40]))
        needles.append((k, t[at : at + n]))
    needles += [(500, None), (501, ""), (502, "a" * 30), (503, "nowhere to be found at all"), (504, needles[0][1])]
    got = {tuple(x) for x in substrings.contained(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "text_id long, text string")).collect()}
    assert got == {(n, t) for n, s in needles if s for t, x in texts if x and s in x}


def test_anchors_are_few_and_cut_nothing(monkeypatch):
    r = np.random.default_rng(9)
    points = r.integers(97, 101, 5000).astype(np.uint32)
    whole = substrings.anchors(points)
    assert len(whole) < 5000 * 2.4 / (substrings.WINDOW + 1)
    monkeypatch.setattr(substrings, "PIECE", 100)
    assert (substrings.anchors(points) == whole).all()
    for at in r.integers(0, 4960, 200):
        part = points[at : at + substrings.LEAST]
        assert substrings.gram_hashes(part, substrings.GRAM).min() in whole


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 24))
    x = centres[r.integers(0, 60, 6000)] + 0.35 * r.normal(size=(6000, 24))
    rows = [(i, [float(v) for v in x[i]]) for i in range(6000)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def best(x, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = (u[queries] @ u.T).round(12)
    return {q: set(np.lexsort((np.arange(len(x)), -s[i]))[:k].tolist()) for i, q in enumerate(queries)}


def test_probes_of_few_lists_find_most(clustered):
    x, frame = clustered
    index = vector_index.build(frame, lists=80, sample=3000)
    asked = frame.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = best(x, list(range(0, 6000, 100)), 10)
    found, seen = vector_index.search(index, asked, 10, probes=8), 0
    rows = found.collect()
    assert all(r["rank"] <= 10 for r in rows) and len(rows) == 600
    seen = sum(r.vec_id in want[r.query_id] for r in rows)
    assert seen / 600 >= 0.9
    assert vector_index.recall(index, asked, 10, probes=8).first().recall == pytest.approx(seen / 600)
    exact = vector_index.search(index, asked, 10, probes=None).collect()
    assert all(r.vec_id in want[r.query_id] for r in exact) and len(exact) == 600
    opened = index.rows.where(F.col("list").isin(*range(8))).count()
    assert opened < 6000 / 4


def test_exact_search_bounds_skip_lists(clustered):
    x, frame = clustered
    index = vector_index.build(frame, lists=80, sample=3000)
    one = frame.where("vec_id = 500").withColumnRenamed("vec_id", "query_id")
    assert vector_index.needed(index, one, 5).count() < 40
    assert {r.vec_id for r in vector_index.search(index, one, 5, probes=None).collect()} == best(x, [500], 5)[500]


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 0.0]), (5, [-1.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(frame, lists=3)
    got = vector_index.search(index, spark.createDataFrame([(9, [1.0, 0.0]), (10, [0.0, 0.0]), (11, None)], "query_id long, embedding array<double>"), 2, probes=None)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [(9, 1, 1), (9, 2, 4), (10, 1, 1), (10, 2, 2)]
    empty = vector_index.build(frame.limit(0))
    assert vector_index.search(empty, frame.withColumnRenamed("vec_id", "query_id"), 2).collect() == []


def _plain_sources(rows, start, length, run):
    out = []
    for g, o, t in rows:
        q = t[start - 1 : start - 1 + length] if None not in (g, o, t) else ""
        if len(q) == length:
            has = [(int(q in x), len(x), -p) for h, p, x in rows if h == g and None not in (p, x) and p != o and any(q[i : i + run] in x for i in range(length - run + 1))]
            if has:
                out.append((g, o, -max(has)[2], max(has)[0]))
    return sorted(out)


@pytest.mark.parametrize("unit", [3, 1 << 15])
def test_best_sources_equal_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(substrings, "UNIT", unit)
    r = random.Random(unit)
    rows = [(g, o, "".join(r.choice("ab" if g % 2 else "abcé漢𝄞") for _ in range(r.randint(0, 30)))) for g in range(12) for o in range(r.randint(1, 14))]
    rows += [(20, o, "the same opening words" + " more" * (o % 3)) for o in range(10)]  # copies, and ties in length
    rows += [(21, 0, "0123abcdefghijklmn"), (21, 1, "....defghijklm"), (21, 2, "abcdefghij"), (22, 0, "0123abcdefghijklmn"), (None, 1, "0123abcdefghijklmn"), (21, None, "0123abcdefghijklmn"), (21, 3, None)]
    frame = spark.createDataFrame(rows, "conv long, turn long, text string")
    for length, run in ((8, 5), (14, 10), (4, 4)):
        got = sorted(tuple(x) for x in substrings.best_sources(frame, "conv", "turn", "text", 5, length, run).collect())
        assert got == _plain_sources(rows, 5, length, run) and got


def test_quote_support_moves_texts_not_their_grams(spark, tmp_path):
    r = random.Random(4)
    rows = [(g, o, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1000))) for g in range(50) for o in range(8)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = moved()
    try:
        scalars.quote_support(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < moved() - before < 1.5 * 1000 * len(rows)
