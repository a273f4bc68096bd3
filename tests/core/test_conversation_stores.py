"""Gates, imports, policies and previews where they refuse."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from driftwell.operators import evaluation, external, memory
from driftwell.sources import conversations


def test_activities_fill_in_for_each_other(spark):
    rows = [(1, "svc", date(2024, 1, 1), " ", None, None, None), (2, None, None, None, " a   b ", "x" * 5000, date(2024, 2, 2)), (3, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, service string, event_at date, action string, title string, excerpt string, created_at date")
    got = {r.source_id: r for r in conversations.activities(df).collect()}
    assert got["activities:1"].title == got["activities:1"].content == "svc" and got["activities:1"].updated_at == date(2024, 1, 1)
    assert got["activities:2"].title == "a b" and len(got["activities:2"].content) == 4000 and got["activities:2"].created_at == date(2024, 2, 2)
    assert got["activities:3"].title == "" and len({r.source_hash for r in got.values()}) == 3
    with pytest.raises(ValueError, match="excerpt"):
        conversations.activities(df.drop("excerpt"))


def build(spark, sessions, messages, excluded, columns=("session_id", "text")):
    return conversations.normalized(
        spark.createDataFrame(sessions, "session_id string, deleted boolean, cwd string"), spark.createDataFrame(messages, "session_id string, text string, internal string"), spark.createDataFrame(excluded, "session_id string"), list(columns), F.contains("text", F.lit("KEY"))
    )


def test_normalised_build_and_its_gates(spark):
    s, m, t = build(spark, [("a", None, "/x"), ("b", True, "/y"), ("c", False, "/z"), ("d", None, "/w")], [("a", "fine", "i"), ("b", "old", "i"), ("c", "a KEY", "i"), ("c", "more", "i"), ("d", None, "i")], [("d",), ("zz",)])
    assert {r.session_id: (r.reasons, r.eligible) for r in s.collect()} == {"a": ([], True), "b": (["deleted"], False), "c": (["secret"], False), "d": (["excluded"], False)}
    assert s.columns == ["session_id", "reasons", "eligible"] and [tuple(r) for r in m.collect()] == [("a", "fine")]
    assert sorted((r.session_id, r.reason) for r in t.collect()) == [("b", "deleted"), ("c", "secret"), ("d", "excluded")]
    for bad, match in (
        (([("a", None, "")], [("a", "x", "")], [("zz",)]), "excluded"), (([("a", None, "")], [("b", "x", "")], []), "without a session"), (([("a", None, ""), ("a", None, "")], [("a", "x", "")], []), "unique"), (([(None, None, "")], [], []), "null"),
    ):
        with pytest.raises(conversations.GateFailed, match=match):
            build(spark, *bad)
    with pytest.raises(ValueError, match="nope"):
        build(spark, [], [], [], ["nope"])


def test_context_is_whole_or_refused(spark):
    e = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "u")], "id long, session string")
    wanted = e.where("id IN (1, 3)")
    assert sorted(r.id for r in conversations.around(e, wanted, "session", "id", 3).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="more than 2"):
        conversations.around(e, wanted, "session", "id", 2)


CONTRACT = conversations.Contract({"sessions": ("id long, n long", frozenset()), "events": ("id long, content string", frozenset({"content"}))})


def test_imports_align_count_and_clean_up(spark, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    one = spark.createDataFrame([(3, 1), (4, 2)], "n int, id long")
    one.write.parquet(f"{source}/sessions/generation=g")
    with pytest.raises(ValueError, match="isn't in the source"):
        conversations.import_generation(spark, CONTRACT, source, target, "g")
    assert not (tmp_path / "t/sessions/generation=g").exists()
    spark.createDataFrame([(1,)], "id long").write.parquet(f"{source}/events/generation=g")
    assert conversations.import_generation(spark, CONTRACT, source, target, "g") == {"sessions": 2, "events": 1}
    assert [tuple(r) for r in spark.read.parquet(f"{target}/events/generation=g").collect()] == [(1, None)]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{target}/sessions/generation=g").collect()) == [(1, 3), (2, 4)]
    assert conversations.import_generation(spark, CONTRACT, source, target, "g") == {"sessions": 2, "events": 1}
    one.limit(1).write.mode("overwrite").parquet(f"{source}/sessions/generation=g")
    with pytest.raises(ValueError, match="2 rows of 1"):
        conversations.import_generation(spark, CONTRACT, source, target, "g")
    with pytest.raises(ValueError, match="lacks"):
        CONTRACT.aligned("sessions", one.drop("n"))


def test_policy_names_the_first_fault(spark):
    day = date(2024, 1, 10)
    schema = "snap string, fact_id long, region string, lifecycle string, ingested_at date, valid_to date"
    good = ("r", "current", date(2024, 1, 5), None)
    cases = {
        "ok": [good, ("r", "current", day, day)], "region": [good, ("other", "conflict", day, None)], "conflict": [good, ("r", "conflict", date(2020, 1, 1), None)], "lifecycle": [good, ("r", "retired", day, None)], "future": [good, ("r", "current", date(2024, 1, 11), None)],
        "stale": [("r", "current", date(2023, 1, 1), None)], "expired": [good, ("r", "current", day, date(2024, 1, 9))], "drift": [good],
    }
    members = spark.createDataFrame([(k, i, *f) for k, facts in cases.items() for i, f in enumerate(facts)], schema)
    expected = external.snapshot(members, ["snap"]).select("snap", F.when(F.col("snap") == "drift", "else").otherwise(F.col("member_hash")).alias("member_hash")).union(spark.createDataFrame([("missing", "x")], "snap string, member_hash string"))
    got = {r.snap: r.verdict for r in external.policy(members, ["snap"], expected, "r", F.lit("2024-01-10").cast("date"), 10 * 86_400).collect()}
    assert got == {k: k for k in (*cases, "missing")}
    with pytest.raises(ValueError, match="below 0"):
        external.policy(members, ["snap"], expected, "r", F.current_date(), -1)


def test_admission(spark):
    d = date(2024, 1, 1)
    facts = [("s", 1, "a", 1.0, d, None, d, d), ("s", 2, "b", 1.0, d, d, d, d), ("off", 3, "a", 1.0, d, d, d, d), ("none", 4, "a", 1.0, d, d, d, d), ("s", 5, "a", None, d, d, d, d), ("s", 6, "a", 1.0, d, date(2023, 1, 1), d, d), ("s", 7, "a", 1.0, d, d, date(2024, 2, 1), d), (None, 8, "a", 1.0, d, d, d, d)]
    df = spark.createDataFrame(facts, "source_id string, fact_id long, kind string, value double, valid_from date, valid_to date, observed_at date, ingested_at date")
    registry = spark.createDataFrame([("s", True, ["a"]), ("off", False, ["a"])], "source_id string, enabled boolean, kinds array<string>")
    assert {r.fact_id: r.refusal for r in external.admitted(df, registry).collect()} == {1: None, 2: "kind_not_allowed", 3: "source_disabled", 4: "unknown_source", 5: "value_missing", 6: "window_invalid", 7: "observed_after_ingest", 8: "unknown_source"}


def test_memory_is_changed_as_previewed_or_not(spark):
    m = spark.createDataFrame([(1, "current"), (2, "conflict"), (3, "expired"), (4, "current")], "memory_id long, lifecycle string")
    a = spark.createDataFrame([(1, "expire"), (2, "renew"), (3, "renew"), (4, "expire"), (4, "retract"), (9, "expire")], "memory_id long, action string")
    assert {r.memory_id: r.refusal for r in memory.planned(m, a).collect()} == {1: None, 2: "illegal", 3: None, 4: "ambiguous", 9: "unknown"}
    seen = memory.preview(m, a)
    assert dict(map(tuple, memory.applied(m, a, seen).collect())) == {1: "expired", 2: "conflict", 3: "current", 4: "current"}
    for other in ((m.where("memory_id < 4"), a), (m, a.where("memory_id > 1"))):
        with pytest.raises(memory.Stale):
            memory.applied(*other, seen)
    assert memory.preview(m.orderBy(F.desc("memory_id")), a.orderBy("action")) == seen


def test_projects_and_evidence(spark):
    rows = spark.createDataFrame([(1, "cd /home/me/projects/alpha/src/main.py and C:\\Work\\beta\\x"), (1, "projects/Alpha"), (2, "src/deadbeef0 repos/app.js"), (2, None)], "id long, t string")
    assert sorted(tuple(r) for r in memory.projects(rows, F.col("t"), ["id"], ["blocked"]).collect())[:2] == [(1, "alpha", 2), (1, "beta", 1)]
    m = spark.createDataFrame([(k, "fact", "current" if k < 4 else "expired", k % 2, k) for k in range(5)], "memory_id long, kind string, lifecycle string, confidence int, updated int")
    assert [r.memory_id for r in memory.profile(m, "fact", 3).collect()] == [3, 1, 2]
    e = spark.createDataFrame([(1, f"r{k}") for k in range(9)] + [(1, "r0"), (2, "x")], "memory_id long, ref string")
    got = {r.memory_id: (r.refs, r.first_refs) for r in memory.with_evidence(m, e, 3).collect()}
    assert got[1] == (9, ["r0", "r1", "r2"]) and got[2] == (1, ["x"]) and got[0] == (0, None)


def test_calibration_of_any_labels(spark):
    h = [(i, "abc"[i % 3]) for i in range(30)] + [(90, "a"), (91, None)]
    j = [(i, "abc"[(i + (i % 5 == 0)) % 3]) for i in range(30)] + [(91, "b")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, label string")
    got = evaluation.calibration(frame(h), frame(j), "id", "label").first()
    pairs = [(a, dict(j)[i]) for i, a in h if i < 30]
    po = sum(a == b for a, b in pairs) / 30
    pe = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in "abc") / 900
    assert (got.pairs, got.agreement, got.kappa, got.only_human, got.only_judge, got.verdict) == (30, round(po, 6), round((po - pe) / (1 - pe), 6), 1, 1, "usable")
    assert evaluation.calibration(frame([(1, "a")]), frame([(1, "a")]), "id", "label").first().verdict == "unmeasured"
    assert evaluation.calibration(frame([]), frame([]), "id", "label").first().kappa is None


def test_retrieval_sets_count_misses(spark):
    results = spark.createDataFrame([("m", 1, 1, "x", "s", "c"), ("m", 1, 2, "y", "t", "c"), ("n", 2, 1, "z", "s", "c")], "mode string, query_id long, rank int, item string, source string, collection string")
    samples = spark.createDataFrame([(1, ["y"], "t", "c"), (2, None, "u", None), (3, ["q"], None, "c")], "query_id long, items array<string>, source string, collection string")
    got = {r["mode"]: tuple(r)[1:] for r in evaluation.retrieval_sets(results, samples, 5).collect()}
    assert got == {"m": (3, 2, 0.5, 0.25, 0.5, 0.5), "n": (3, 2, 0.0, 0.0, 0.0, 0.0)}
