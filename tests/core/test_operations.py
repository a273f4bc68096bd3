"""Queries without SQL against plain loops over the small tables; pair quality and the gate against counted pairs."""

import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from driftwell.functions import redaction
from driftwell.operators import evaluation, noise, units
from driftwell.plans import operations
from driftwell.sources import pointers, runs
from driftwell.streaming.outbox import expire, step

from .test_noise import plain as plain_noise
from .test_pairs import plain as plain_pairs

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
def test_outbox_states_equal_a_plain_loop(spark):
    log = {}
    for r in operations._commands(spark, SF).collect():
        log.setdefault(r.key, []).append((r["at"], r.seq, r.action, r.digest, r.owner, r.token))
    want = {}
    for key, rows in log.items():
        m, refused = None, 0
        for t, _, action, digest, owner, token in sorted(rows):
            ms = int(t.timestamp() * 1_000_000) // 1000
            m = expire(m, ms)[0] if m else None
            m, result = step(m, ms, action, digest, owner, token, 6 * 3_600_000)
            refused += result == "refused"
        if m:
            want[key] = (m.status, m.attempts, m.token, refused)
    got = {r.key: (r.status, r.attempts, r.token, r.refused) for r in operations.outbox_states(spark, SF).collect()}
    assert got == want and {s[0] for s in want.values()} == {"sent", "pending"}


@needs_tables
def test_noise_verdicts_equal_a_plain_loop(spark, monkeypatch):
    taken = []
    real = noise.evaluate
    monkeypatch.setattr(noise, "evaluate", lambda df, policy: taken.append((df, policy)) or real(df, policy))
    got = {(r.subject, r.candidate): r.verdict for r in operations.noise_verdicts(spark, SF).collect()}
    rows, policy = taken[0]
    rows = [tuple(x) for x in rows.select(*noise.COLUMNS).collect()]
    want = {(s, c): v for (s, _, c), (v, _) in plain_noise([(*r[:3], *r[3:]) for r in rows], policy).items()}
    assert got == want and len(set(want.values())) >= 6


@needs_tables
def test_review_pairs_equal_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "text").collect()]
    assert sorted(tuple(r) for r in operations.review_pairs(spark, SF).select("conv_id", "a", "b", "score").collect()) == plain_pairs(rows, 0.75)


@needs_tables
def test_sealed_texts_hold_no_span_any_more(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    both = frozenset({"credentials", "pii"})
    got = {r.doc_id: r for r in operations.sealed_texts(spark, SF).collect()}
    for i, t in texts.items():
        found = redaction.spans(t or "", both)
        assert (i in got) == bool(found)
        if found:
            assert got[i].n == len(found) and got[i].kinds == ",".join(sorted({k for *_, k in found}))
            assert all(t[s:e] not in got[i].text or len(t[s:e]) < 8 for s, e, _ in found)
            assert redaction.spans(got[i].text, both) == []


def test_pair_quality_equals_counted_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice([*range(12), None]), r.choice([*range(9), None])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, c long, g long")
    got = evaluation.pair_quality(frame.select("id", "c"), frame.select("id", "g"), "id", "c", "g").first()
    kept = [(c, g) for _, c, g in rows if c is not None and g is not None]
    found = sum(x[0] == y[0] for x, y in combinations(kept, 2))
    true = sum(x[1] == y[1] for x, y in combinations(kept, 2))
    both = sum(x == y for x, y in combinations(kept, 2))
    assert tuple(got) == (found, true, both, round(both / found, 6), round(both / true, 6))
    none = frame.limit(0)
    assert tuple(evaluation.pair_quality(none.select("id", "c"), none.select("id", "g"), "id", "c", "g").first()) == (0, 0, 0, 1.0, 1.0)


def test_gate_refuses_and_publishes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k", "s", "one text", 1, 0), (2, "k", "s", "One  text", 3, 1), (3, "k", "s", "other", 2, 0)], "id long, kind string, subject string, answer string, confidence int, stance int")
    found = units.exact(rows)
    built = units.canonical(found, rows)
    got = {r.canonical_id: (r.confidence, r.lifecycle, r.members, r.reason) for r in built.collect()}
    assert got == {2: (1, "conflict", 2, "similar_merge"), 3: (2, "current", 1, "singleton")}

    def gate(pairs):
        frame = spark.createDataFrame(pairs, "a long, b long, same boolean")
        return evaluation.labelled_gate(found, frame, "id", "representative").first(), frame

    good, frame = gate([(1, 2, True), (1, 3, False), (1, 99, True)])
    assert tuple(good) == (2, 1, 1, 1.0, 0, "passed")
    assert gate([(1, 2, False), (1, 2, True)])[0].verdict == "failed"
    assert gate([(1, 3, True)])[0].verdict == "failed" and gate([(1, 99, True)])[0].verdict == "not_applicable"
    store = str(tmp_path)
    with pytest.raises(units.GateFailed, match="failed"):
        units.publish_canonical(built, found, gate([(1, 3, True)])[1], store, "p", {}, 0)
    assert pointers.newest(spark, store) is None
    run = units.publish_canonical(built, found, frame, store, "p", {}, 0)
    assert runs.drift(spark, store) == [] and pointers.newest(spark, store).target == run
    assert runs.serving(spark, store).agg(F.sum("members")).first()[0] == 3


def test_hits_and_fold(spark):
    from driftwell.functions import text as tx
    from driftwell.operators import dedup

    rows = spark.createDataFrame([("İ" * 12 + " the",), ("The the",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(tx.hits("the", F.col("t")).alias("n")).collect()] == [1, 2, 0, None]
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z"), (2, "a", "z")], "id long, k string, v string")
    got = sorted(tuple(r) for r in dedup.fold(rows, "id", F.col("k"), [F.col("id")]).collect())
    assert got == [(1, "a", "x", 3), (1, "b", "y", 1)]
