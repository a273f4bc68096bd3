import json

import pytest
from pyspark.sql import functions as F

from driftwell.operators import dedup, events, ledger, merge, ordered, units
from driftwell.sources import tables


def test_nested_messages_keep_their_text(spark, tmp_path):
    lines = [
        {"type": "assistant", "uuid": "u", "sessionId": "s", "message": {"role": "assistant", "content": [{"type": "thinking", "text": "hm"}, {"type": "text", "text": "hé"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "message_id": "m", "session_id": "s", "role": "user", "content": "plain [text]"},
        {"type": "turn_start", "turn_id": "t", "conversation_id": "c", "prompt": "asked"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines))
    got = {r.message_id: r for r in tables.read_sessions(spark, str(tmp_path)).collect()}
    assert (got["u"].session_id, got["u"].role, got["u"].content, got["u"].blocks) == ("s", "assistant", "hé\ntwo", ["thinking", "text", "tool_use", "text"])
    assert (got["m"].content, got["m"].blocks) == ("plain [text]", None) and got["t"].content == "asked"


def test_turn_artifacts(spark, tmp_path):
    turns = [{"role": "a", "narrative": "long enough to be a narrative"}, {"role": "b", "narrative": "short"}, {"role": "a", "narrative": "*" * 30}, {"role": "b", "narrative": "this one is long enough too"}]
    (tmp_path / "x.json").write_text(json.dumps({"sessions": [{"session_id": "s", "turns": turns}]}, indent=1))
    assert sorted((r.session_id, r.turn, r.role) for r in tables.read_turns(spark, str(tmp_path)).collect()) == [("s", 1, "a"), ("s", 4, "b")]


def test_files_and_their_changes(spark, tmp_path):
    root = tmp_path / "root"
    for f, t in (("a/1", "x"), ("a/2", "y"), ("b/3", "z")):
        (root / f).parent.mkdir(parents=True, exist_ok=True)
        (root / f).write_text(t)
    tables.scan_files(spark, str(root)).write.parquet(str(tmp_path / "scan"))
    (root / "a/1").write_text("x")
    (root / "a/2").write_text("other")
    (root / "b/3").unlink()
    (root / "b/4").write_text("new")
    got = {r.path[-3:]: r.change for r in tables.scan_files(spark, str(root), spark.read.parquet(str(tmp_path / "scan"))).collect()}
    assert got == {"a/1": "unchanged", "a/2": "changed", "b/3": "removed", "b/4": "added"}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", "q"), (2, "c", None)], "k long, v string, secret string")
    with pytest.raises(ValueError, match="unknown"):
        tables.snapshot(df, ["nope"], "k", df, str(tmp_path / "s"))
    tables.snapshot(df, ["k", "v"], "k", df.where("k = 2"), str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).collect())) == [(2, "b"), (2, "c")]
    tables.split_store(df, F.col("secret") == "p", str(tmp_path / "h"))
    assert [r.v for r in spark.read.parquet(str(tmp_path / "h")).where("half = 'true'").collect()] == ["a"] and spark.read.parquet(str(tmp_path / "h/half=false")).count() == 2
    v = spark.createDataFrame([(i, [float(i)], "d" * 3000, "t" * 200) for i in range(4)], "id long, embedding array<float>, document string, title string")
    assert [tables.write_vectors(v.where(c), str(tmp_path / "v")) for c in ("id < 2", "id < 4", "id < 4")] == [2, 2, 0]
    assert spark.read.parquet(str(tmp_path / "v")).agg(F.max(F.length("document")), F.max(F.length("title")), F.count("*")).first() == (2000, 100, 4)
    edges = spark.createDataFrame([(1, 2, "x", True), (1, 2, "x", True), (3, 4, "y", False)], "src long, dst long, kind string, accepted boolean")
    tables.write_graph(edges, str(tmp_path / "g"))
    assert {r.node for r in spark.read.parquet(str(tmp_path / "g/nodes")).collect()} == {1, 2} and spark.read.parquet(str(tmp_path / "g/edges")).count() == 1
    tables.register_run(df, str(tmp_path / "e"), "r1")
    with pytest.raises(Exception, match="exists"):
        tables.register_run(df, str(tmp_path / "e"), "r1")


def test_generations_roll_back(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k long")
    tables.publish(df, str(tmp_path), "g1", ["k"])
    tables.publish(df.where("k = 1"), str(tmp_path), "g2", ["k"])
    tables.rollback(spark, str(tmp_path), "g1")
    assert tables.current(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError, match="never published"):
        tables.rollback(spark, str(tmp_path), "g9")


def test_numbering_equals_a_window(spark):
    rows = [(i, None if i % 7 == 0 else f"g{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string")
    want, seen = {}, {}
    for i, g in rows:
        want[i] = seen[g] = seen.get(g, 0) + 1
    assert {r.i: r.n for r in ordered.numbered(df, "g", [F.asc("i")], "n").collect()} == want


def test_layers_demote_whole_components(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, [1.0, 0.0], text), (2, [1.0, 0.001], text), (3, [0.0, 1.0], text), (4, [0.001, 1.0], "quite another text without a thing in common"), (5, [0.5, 0.2], "alone")]
    found = merge.layers(spark.createDataFrame(rows, "id long, embedding array<double>, text string"), kinds=0.6)
    assert {r.id: (r.layer, r.cluster) for r in found.collect()} == {1: ("L1", 1), 2: ("L1", 1), 3: ("L2", 3), 4: ("L2", 3), 5: ("single", None)}


def test_similar_sets_miss_no_pair(spark):
    import random

    r = random.Random(5)
    sets = [(i, r.sample("abcdefghijklmnop", r.randint(1, 8))) for i in range(60)]
    got = {(x.a, x.b): x.common for x in dedup.similar_sets(spark.createDataFrame(sets, "id long, s array<string>"), "id", "s", 0.5).collect()}
    for i, a in sets:
        for j, b in sets:
            common = len(set(a) & set(b))
            if i < j and common >= 0.5 * len(set(a) | set(b)):
                assert got[i, j] == common


def test_ledgers(spark):
    writes = [("a", 1, 0, "t1"), ("a", 2, 0, "t2"), ("a", 3, 1, "t1"), ("a", 4, 1, "t2"), ("b", 1, 1, "t1")]
    got = ledger.appended(spark.createDataFrame(writes, "k string, n long, e long, t string"), "k", "n", "e", "t").collect()
    assert {(r.k, r.n): r.verdict for r in got} == {("a", 1): "applied", ("a", 2): "stale", ("a", 3): "replay", ("a", 4): "applied", ("b", 1): "stale"}
    feed = spark.createDataFrame([(i, "removed" if i % 2 else "added") for i in range(10)], "i long, change string")
    assert [(r.i, r.work) for r in ledger.feed_page(feed, ["i"], (6,), 2).collect()] == [(7, "withdraw"), (8, "prepare")]
    old, new = (spark.createDataFrame(x, "g string, i long, f string") for x in ([("a", 1, "Uses Spark daily")], [("a", 2, "Uses Spark daily"), ("a", 3, "uses spark, daily!"), ("b", 4, "Uses Spark daily")]))
    assert {r.i: (r.action, r.supersedes) for r in units.ledger(old, new, "g", "i", "f").collect()} == {2: ("noop", None), 3: ("supersede", 1), 4: ("add", None)}


def test_cursors():
    assert events.decode_cursor(events.encode_cursor(("a", 3))) == ("a", 3) and events.decode_cursor("") is None
    for bad in ("!!", "bm8=", "MQ=="):
        with pytest.raises(ValueError, match="cursor"):
            events.decode_cursor(bad)


def test_nested_values(spark):
    from driftwell.functions import nested

    rows = [(1, '{"a":[{"Token":{"x":1}}],"sum":{"token":2}}'), (2, "not json"), (3, None)]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i long, j string").select("i", nested.seal_keys(F.col("j"), {"token"}, {"sum"}).alias("s")).collect()}
    assert got == {1: '{"a":[{"Token":"[SEALED]"}],"sum":{"token":2}}', 2: "[SEALED]", 3: None}


def test_scratch_tables_are_cleared_together(spark, tmp_path):
    from driftwell import runtime

    was, runtime.RUN = runtime.RUN, "other-run"
    try:
        kept = runtime.scratch(spark, "kept")
        df = runtime.materialize(spark.range(5))
        assert df.count() == 5 and "/other-run/kept-" in kept
        runtime.clear_scratch(spark)
        from pathlib import Path

        assert not Path(runtime.shared_folder(spark).removeprefix("file:"), "driftwell/other-run").exists()
    finally:
        runtime.RUN = was
