"""Create-only pointers, content-addressed runs, and stores of which only what a change touches is written."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from driftwell.operators import incremental
from driftwell.sources import pointers, runs, tables


def test_of_two_publishers_one_wins(spark, tmp_path):
    store = str(tmp_path)
    assert pointers.newest(spark, store) is None
    pointers.move(spark, store, "a", 0)
    assert pointers.create(spark, f"{store}/_pointers/00000002.json", '{"n": 2, "target": "b"}')
    assert not pointers.create(spark, f"{store}/_pointers/00000002.json", "{}")
    with pytest.raises(pointers.Conflict):
        pointers.move(spark, store, "c", 1)
    assert pointers.newest(spark, store).target == "b" and [p.n for p in pointers.history(spark, store)] == [1, 2]
    (tmp_path / "_pointers/00000003.json").write_text("")  # created, not written yet
    assert pointers.newest(spark, store).target == "b"
    with pytest.raises(pointers.Conflict):
        pointers.move(spark, store, "c", 2)


def test_racing_publishers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = str(tmp_path)

    def publish(name):
        try:
            return pointers.move(spark, store, name, 0).target
        except pointers.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [w for w in pool.map(publish, "abcd") if w]
    assert len(won) == 1 and pointers.newest(spark, store).target == won[0]


def test_a_generation_that_lost_its_race_never_shows(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    tables.publish(df, str(tmp_path), "g1", ["k"])
    real = pointers.newest
    stale = real(spark, str(tmp_path))
    tables.publish(df.where("k = 1"), str(tmp_path), "g2", ["k"])
    seen = iter([stale])
    monkeypatch.setattr(pointers, "newest", lambda *a: next(seen, None) or real(*a))
    with pytest.raises(pointers.Conflict):
        tables.publish(df, str(tmp_path), "g3", ["k"])
    assert tables.current(spark, str(tmp_path)).count() == 1


def test_runs_are_named_by_content(spark, tmp_path):
    store = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, v string")
    one = runs.write(df, store, "p1", {"of": "x"})
    files = sorted(p.name for p in (tmp_path / "runs" / one).iterdir())
    assert runs.write(df.orderBy(F.desc("k")).select("v", "k"), store, "p1", {"of": "x"}) == one
    assert sorted(p.name for p in (tmp_path / "runs" / one).iterdir()) == files
    others = {runs.plan(df, "p2", {"of": "x"})[0], runs.plan(df, "p1", {"of": "y"})[0], runs.plan(df.distinct(), "p1", {"of": "x"})[0], runs.plan(df.fillna(""), "p1", {"of": "x"})[0], one}
    assert len(others) == 5
    for bad in ({"a": [{"prompt": 1}]}, {"Token": 1}):
        with pytest.raises(ValueError, match="private"):
            runs.plan(df, "p", bad)
    with pytest.raises(ValueError, match="producer"):
        runs.plan(df, " ", {})


def test_serving_and_drift(spark, tmp_path):
    store = str(tmp_path)
    df = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k long, v string")
    assert runs.drift(spark, store) == ["nothing"]
    with pytest.raises(ValueError, match="missing"):
        runs.serve(spark, store, "run-none", 0)
    run = runs.write(df, store, "p", {})
    runs.serve(spark, store, run, 0)
    assert runs.serving(spark, store).count() == 20 and runs.drift(spark, store) == [] and runs.drift(spark, store, "run-old") == ["pointer"]
    df.withColumn("v", F.when(F.col("k") == 3, "changed").otherwise(F.col("v"))).write.mode("overwrite").parquet(f"{store}/runs/{run}")
    assert runs.drift(spark, store) == ["digest"]
    df.limit(5).write.mode("overwrite").parquet(f"{store}/runs/{run}")
    assert runs.drift(spark, store) == ["rows"]
    with pytest.raises(ValueError, match="rows"):
        runs.serve(spark, store, run, 1)


def contents(frame):
    return sorted(map(tuple, frame.collect()))


def stamps(root):
    out = {}
    for p in Path(root).rglob("*.parquet"):
        out.setdefault(p.parent.name, set()).add((p.name, p.stat().st_mtime_ns))
    return out


SCHEMA = "slot string, session string, event string, value long"


def store(spark, path, **more):
    return incremental.KeyedStore(spark, str(path), SCHEMA, "session", "slot", "event", 16, **more)


def test_applied_changes_equal_a_rebuild(spark, tmp_path):
    r = random.Random(5)

    def slot(name):
        return [(name, f"s{r.randrange(40)}", f"{name}-e{k}", r.randrange(9)) for k in range(r.randint(0, 6))]

    held = {f"f{k}": slot(f"f{k}") for k in range(12)}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    flat = lambda: [x for rows in held.values() for x in rows]
    live = store(spark, tmp_path / "live")
    counts = incremental.KeyedStore(spark, str(tmp_path / "counts"), "session string, n long, total long", "session", "session", "session", 16)
    project = lambda rows: rows.groupBy("session").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    live.build(frame(flat()))
    counts.build(project(frame(flat())))
    for turn in range(3):
        changed = {f"f{turn}": [] if turn == 1 else slot(f"f{turn}"), f"new{turn}": slot(f"new{turn}")}
        held.update(changed)
        before = stamps(tmp_path / "live"), stamps(tmp_path / "counts")
        slots = spark.createDataFrame([(k,) for k in changed], "slot string")
        touched = live.apply(slots, frame(flat()))
        incremental.reprojected(live, counts, touched, project)
        assert contents(live.rows().drop("part")) == sorted(flat())
        assert contents(counts.rows().drop("part")) == contents(project(frame(flat())))
        parts = {f"part={x.part}" for x in touched.collect()}
        for root, was in zip(("live", "counts"), before, strict=True):
            now = stamps(tmp_path / root)
            assert all(now.get(p) == f for p, f in was.items() if p not in parts)
            assert any(now.get(p) != f for p, f in was.items() if p in parts) or not parts & set(was)


def test_broken_changes_leave_the_store(spark, tmp_path):
    live = store(spark, tmp_path / "live")
    rows = [("f1", "s1", "e1", 1), ("f2", "s2", "e2", 2)]
    live.build(spark.createDataFrame(rows, SCHEMA))
    before = stamps(tmp_path / "live")
    one = spark.createDataFrame([("f1",)], "slot string")
    parents = spark.createDataFrame([("s1",), ("s2",)], "session string")
    for bad, name in (([("f1", "s1", "e1", 1), ("f1", "s1", "e1", 2)], "twice"), ([("f1", "s1", None, 1)], "null"), ([("f1", "s9", "e9", 1)], "unknown"), ([("f1", "s1", "e2", 1)], "another|twice")):
        with pytest.raises(incremental.Violation, match=name):
            live.apply(one, spark.createDataFrame(bad, SCHEMA), parents)
    assert stamps(tmp_path / "live") == before
    live.apply(one, spark.createDataFrame([], SCHEMA), parents)
    assert contents(live.rows().drop("part")) == rows[1:]
