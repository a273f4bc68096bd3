"""Candidates of similar sets, attachment of units and peers of clusters against all pairs."""

import pathlib
import random

import numpy as np

from driftwell.operators import graph, merge, set_pairs, units, vectors
from driftwell.runtime import shared_folder


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_candidates_miss_no_pair_and_bring_few_others(spark):
    rng = random.Random(3)
    sets = {}
    for base in range(60):
        whole = {rng.getrandbits(60) for _ in range(rng.randint(1, 90))}
        for copy in range(4):
            own = set(whole)
            for _ in range(rng.randint(0, max(1, len(whole) // 8))):
                own.discard(rng.choice(sorted(own))) if rng.random() < 0.5 and len(own) > 1 else own.add(rng.getrandbits(60))
            sets[base * 4 + copy] = own
    frame = spark.createDataFrame([(i, "k", list(s)) for i, s in sets.items()], "id long, kind string, g array<long>")
    for least in (0.85, 0.9):
        got = {tuple(r) for r in set_pairs.candidates(frame.where("id % 4 = 3"), frame.where("id % 4 <> 3"), least).collect()}
        want = {(a, b) for a in sets for b in sets if a % 4 == 3 and b % 4 != 3 and jaccard(sets[a], sets[b]) >= least}
        assert len(want) > 20 and want <= got
        assert len(got) < 4 * len(want)


def test_attach_makes_few_pairs_of_texts_that_begin_alike(spark):
    """All subjects begin alike, so rare grams of subjects would pair every unit with every canonical one."""
    rng = random.Random(4)
    text = lambda: "".join(rng.choice("abcdefgh") for _ in range(360))
    head = "the same forty characters of all subjects"
    rows = [(i, "en", (head + text())[:60], head + text()) for i in range(200)]
    rows += [(1000 + i, "en", s, a) for i, _, s, a in rows[:5]] + [(2000 + i, "en", s, a) for i, _, s, a in rows[:5]]
    frame = spark.createDataFrame(rows, "id long, kind string, subject string, answer string")
    got = sorted(tuple(r) for r in units.attach(frame.where("id >= 1000"), frame.where("id < 1000")).collect())
    assert got == sorted((k * 1000 + i, i, 1.0) for k in (1, 2) for i in range(5))


def test_attach_equals_all_pairs_and_stores_no_grams(spark, monkeypatch):
    """Many units of one subject and of like ones, in several chunks, and near copies whose subjects differ; what is written on the way stays near the texts' size."""
    for name, value in (("CHUNKS", 3), ("CHUNK_LEAST", 60), ("CHUNK_MOST", 150), ("CHUNK_ROWS", 7)):
        monkeypatch.setattr(units, name, value, raising=False)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijé𝒳") for _ in range(n))
    heads = [text(60) for _ in range(4)]
    heads += [h[:59] + "z" for h in heads[:3]]
    answers = [text(300) for _ in range(12)]
    rows = []
    for i in range(1600):
        head, own = list(rng.choice(heads)), list(rng.choice(answers)) if i % 2 else list(text(300))
        for _ in range(rng.choice((0, 0, 0, 1, 3))):
            head[rng.randrange(60)] = "q"
        for _ in range(rng.choice((0, 1, 4, 15, 30))):
            own[rng.randrange(300)] = "r"
        rows.append((i, rng.choice(("en", "de")), "".join(head), "".join(head + own)))
    grams = [({s[k : k + 4] for k in range(57)}, {t[k : k + 4] for k in range(len(t) - 3)}) for _, _, s, t in rows]
    want = {}
    for i, kind, *_ in rows[3::5]:
        for j, other, *_ in rows:
            if j % 5 != 3 and kind == other and (js := jaccard(grams[i][0], grams[j][0])) >= 0.5:
                jt = jaccard(grams[i][1], grams[j][1])
                if jt >= 0.85 or (js >= 0.9 and jt >= 0.6):
                    want[i] = max(want.get(i, (0, 0)), (round(0.4 * js + 0.6 * jt, 6), -j))
    frame = spark.createDataFrame(rows, "id long, kind string, subject string, answer string")
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    written = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = written()
    got = {r.id: (r.score, -r.canonical) for r in units.attach(frame.where("id % 5 = 3"), frame.where("id % 5 <> 3")).collect()}
    assert got == want and len(want) > 100
    assert written() - before < 3 * sum(len(s) + len(t) for _, _, s, t in rows)


def test_candidates_move_only_parts_that_may_meet(spark, monkeypatch):
    """Of sets that have nothing in common the sieves hold back nearly all parts, some forty for each set."""
    rng = random.Random(9)
    rows = [(i, "k", [rng.getrandbits(60) for _ in range(200)]) for i in range(600)]
    rows += [(1000 + i, k, g[:-3] + [rng.getrandbits(60) for _ in range(3)]) for i, k, g in rows[:3]]
    frame = spark.createDataFrame(rows, "id long, kind string, g array<long>")
    moved = []
    whole = set_pairs.materialize
    monkeypatch.setattr(set_pairs, "materialize", lambda df: moved.append(df.count()) or whole(df))
    got = {tuple(r) for r in set_pairs.candidates(frame.where("id >= 1000"), frame.where("id < 600"), 0.85).collect()}
    assert got == {(1000 + i, i) for i in range(3)}
    assert moved[0] < 600 * 40 / 4


def test_links_have_the_components_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PAIR_LEAST", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = vectors.links(df, [0.85, 0.8])
    pairs = {tuple(r)[:2] for r in vectors.similar(df, 0.8).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(np.triu(u.astype(float) @ u.T.astype(float) >= 0.8, 1)), strict=True)}
    for level in (0.85, 0.8):
        some = found.where(found.level == level)
        every = vectors.similar(df, level).selectExpr("a AS src", "b AS dst")
        assert sorted(map(tuple, graph.components(some).collect())) == sorted(map(tuple, graph.components(every).collect()))
    assert found.where("level = 0.8").count() <= 16 * 300


def test_a_large_cluster_without_peers_isn_t_joined_whole(spark, monkeypatch):
    """One member without a peer puts a cluster down; those left open are joined, and small clusters stay right."""
    monkeypatch.setattr(merge, "PROBES", 2)
    rng = random.Random(6)
    rows = []
    for cluster in range(12):
        base = [rng.getrandbits(50) for _ in range(40)]
        for m in range(9):
            own = base[:30] + [rng.getrandbits(50) for _ in range(10)] if cluster % 3 or m != 4 else [rng.getrandbits(50) for _ in range(60)]
            rows.append((cluster * 100 + m, cluster, base if cluster == 5 else own))
    rows += [(5000 + i, 99, [rng.getrandbits(50) for _ in range(30)]) for i in range(300)]
    joined = []
    whole = merge.dedup.similar_sets
    monkeypatch.setattr(merge.dedup, "similar_sets", lambda df, *a: joined.append(df.count()) or whole(df, *a))
    texts = spark.createDataFrame(rows, "id long, cluster long, g array<long>")
    got = sorted(r.cluster for r in merge._all_have_peers(texts, texts.select("cluster").distinct(), "g", 0.5).collect())
    assert got == [c for c in range(12) if c % 3]
    assert joined[0] <= 12 * 9
