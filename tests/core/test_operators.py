import random

import pytest
from pyspark.sql import functions as F

from driftwell.functions import text as tx
from driftwell.functions.numbers import cosine, index_percentile
from driftwell.operators import dedup, evaluation, events, graph, incremental, joins, ordered, rules, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.squeeze(F.col("t")), t="  a \n b\t") == "a b"
    assert one(spark, tx.short(F.col("t"), 4), t="abcdefg") == "abc…"
    assert one(spark, tx.ngrams(F.col("t")), t="Ab c de") == ["abcd", "bcde"]
    assert one(spark, tx.ngrams(F.col("t")), t=" a") == ["a"] and one(spark, tx.ngrams(F.col("t")), t=" ") == []
    assert one(spark, tx.hits("aa", F.col("t")), t="AAaaa") == 2
    assert one(spark, tx.host(F.col("t")), t="HTTP://User@Host:80/x?y") == "user@host:80"
    assert one(spark, tx.redact(F.col("t")), t="a@b.com 4994226020900891 +1 (487) 555-7209") == "[EMAIL] [CARD] [PHONE]"
    assert one(spark, tx.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)


def test_numbers(spark):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert one(spark, cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 1.0]) == 0
    assert [one(spark, index_percentile(F.col("a"), q), a=[1, 2, 3, 4]) for q in (0.5, 0.95, 1.0)] == [3, 4, 4]


def test_projection_and_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "Key word"), (3, "b", "x")], "id long, kind string, text string")
    with pytest.raises(ValueError, match="unknown"):
        events.project(df, ["nope"], {"id": "id"})
    assert events.project(df, ["k", "id", "k"], {"id": "id", "k": "kind"}).columns == ["k", "id"]
    assert [r.id for r in events.select(df, {"kind": ""}, keyword=(["text", "kind"], "KEY")).collect()] == [2]
    assert events.select(df, keyword=(["text"], "")).count() == 3
    assert [r.id for r in events.after(df, ["kind", "id"], ("b", 2), 5).collect()] == [3]


def test_asof_takes_equal_times_and_keeps_rows(spark):
    left = spark.createDataFrame([(1, 1), (1, 5), (2, 3), (3, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (2, 4, "c"), (1, 6, None)], "k long, t long, v string")
    assert sorted((r.k, r.t, r.asof_v) for r in joins.asof(left, right, ["k"], "t", ["v"]).collect()) == [(1, 1, "a"), (1, 5, "b"), (2, 3, None), (3, 1, None)]


def test_overlaps_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, i % 3, s := r.randint(0, 200), s + r.randint(0, 10)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k long, s long, e long").select("id", "k", *(F.timestamp_seconds(F.col(c) * 86400).alias(c) for c in "se"))
    got = sorted((x.k, x.a, x.b) for x in joins.overlaps(df, "k", "id", F.col("s"), F.col("e"), 10).collect())
    assert got == sorted((a[1], a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[0] < b[0] and max(a[2], b[2]) < min(a[3], b[3]))


def test_crosswalk_uses_rows_once(spark):
    left = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, None, "q")], "a long, k1 string, k2 string")
    right = spark.createDataFrame([(7, "x", "p"), (8, "y", "p"), (9, None, "z")], "b long, k1 string, k2 string")
    got = joins.crosswalk(left, right, [(F.col("k1"), F.col("k1")), (F.col("k2"), F.col("k2"))], "a", "b").collect()
    assert sorted((r.a, r.b, r.step) for r in got) == [(1, 7, 1), (2, 8, 2)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (9, 9)], "src long, dst long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 9}
    assert {r.node: r.level for r in graph.levels(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()} == {1: 0, 2: 1, 3: 2}
    assert [r.node for r in graph.common_neighbours(edges, 1, 3).collect()] == [2]
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    assert {r.component for r in graph.components(path).collect()} == {0}
    assert graph.components(edges.limit(0)).collect() == []


def test_leaders_equal_a_plain_loop(spark):
    r = random.Random(4)
    rows = [(i, i % 2, [r.choice("abcdef") for _ in range(4)]) for i in range(60)]
    want, firsts = {}, {0: [], 1: []}
    for i, b, g in rows:
        lead = next((x for x, t in firsts[b] if len(set(g) & t) >= 0.5 * len(set(g) | t)), None)
        if lead is None:
            firsts[b].append((i, set(g)))
            lead = i
        want[i] = lead
    got = dedup.leaders(spark.createDataFrame(rows, "id long, b long, g array<string>"), ["b"], "id", "g", 0.5).collect()
    assert {x.id: x.leader for x in got} == want


def test_chunks_and_chain(spark):
    rows = [(g, i, (i * 7) % 5 + 1) for g in range(3) for i in range(20)]
    want = {}
    for g in range(3):
        chunk = used = 0
        for _, i, n in rows[g * 20 : g * 20 + 20]:
            if used and used + n > 9:
                chunk, used = chunk + 1, 0
            used += n
            want[g, i] = chunk
    df = spark.createDataFrame(rows, "g long, i long, n long")
    assert {(r.g, r.i): r.chunk for r in ordered.chunks(df, "g", "i", "n", 9).collect()} == want
    chain = sorted((r.g, r.i, r.row_hash, r.previous_hash) for r in ordered.chained(df, "g", "i", ["n"]).collect())
    assert all(b[3] == (a[2] if a[0] == b[0] else "") for a, b in zip(chain, chain[1:], strict=False))


def test_vectors_equal_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    got = sorted((r.a, r.b) for r in vectors.similar(df, 0.3, lists=3).collect())
    assert got == [(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.3]
    near = vectors.nearest(df, df.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), 4).collect()
    for q in range(3):
        assert [r.vec_id for r in sorted((r for r in near if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-s[q])[:4].tolist()


def test_generations(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    was = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k long, v string")
    assert sorted((r.k, r.change) for r in incremental.delta(now, was, ["k"], ["v"]).collect()) == [(2, "changed"), (3, "added"), (4, "removed")]
    assert incremental.delta(now, now, ["k"], ["v"]).collect() == []


def test_metrics(spark):
    hits = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 1, 0), ("b", 2, 0)], "query_id string, rank int, relevant int")
    s = {r.query_id: r for r in evaluation.per_query(hits, 5).collect()}
    assert (s["a"].hit, s["a"].reciprocal) == (1, 0.5) and (s["b"].hit, s["b"].reciprocal, s["b"].ndcg) == (0, 0.0, 0.0)
    assert s["a"].ndcg == pytest.approx(0.63093, abs=1e-5)
    scores = spark.createDataFrame([(f"q{i}", float(i % 2)) for i in range(200)], "query_id string, m double")
    r = evaluation.bootstrap(scores, "m", rounds=300).first()
    low, high = evaluation.exact_bootstrap([float(i % 2) for i in range(200)], rounds=2000)
    assert r["mean"] == 0.5 and r.low == pytest.approx(low, abs=0.03) and r.high == pytest.approx(high, abs=0.03)


def test_trend_and_tiers(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 3.0), ("b", 1, 1.0)], "k string, t long, v double")
    assert {r.k: (r.delta, r.direction) for r in rules.trend(df, ["k"], "t", "v").collect()} == {"a": (2.0, "up"), "b": (None, "insufficient")}
