import json

import pytest
from pyspark.sql import functions as F

from driftwell.sources import tables
from driftwell.streaming import feeds


def test_session_exports(spark, tmp_path):
    lines = [{"type": "message", "session_id": "s", "message_id": "m", "role": "user", "content": "hé"}, {"type": "turn", "conversation_id": "c", "uuid": "u", "parentUuid": "m"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    got = sorted(((r.session_id or "", r.message_id or "", r.parent_id, r.kind) for r in tables.read_sessions(spark, str(tmp_path)).collect()))
    assert got == [("", "", None, "unreadable"), ("c", "u", "m", "turn"), ("s", "m", None, "message")]


def test_cases_must_fit_the_schema(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"id": "1", "query": "q", "gold_evidence_refs": ["a"]}\n')
    assert tables.read_cases(spark, str(tmp_path / "good.jsonl")).first().gold_evidence_refs == ["a"]
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "expected_abstain": "maybe"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|CAST"):
        tables.read_cases(spark, str(tmp_path / "bad.jsonl")).collect()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}") for i in range(9)], "id long, t string")
    with pytest.raises(ValueError, match="unknown"):
        tables.export(df, str(tmp_path / "x"), "xml", [F.col("id")])
    tables.export(df, str(tmp_path / "c"), "csv", [F.desc("id")], 3)
    assert [r.id for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["8", "7", "6"]
    tables.export(df, str(tmp_path / "j"), "jsonl", [F.col("id")], 2)
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_generations_are_published_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    tables.publish(df, str(tmp_path), "g1", ["k"])
    tables.publish(df.where("k = 1"), str(tmp_path), "g2", ["k"])
    assert [r.k for r in tables.current(spark, str(tmp_path)).collect()] == [1]
    with pytest.raises(ValueError, match="not unique"):
        tables.publish(df.union(df), str(tmp_path), "g3", ["k"])
    with pytest.raises(Exception, match="exists"):
        tables.publish(df, str(tmp_path), "g1", ["k"])
    assert tables.current(spark, str(tmp_path)).count() == 1


def test_keyed_stores(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert sorted((r.k, r.v) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted((r.k, r.v) for r in tables.insert_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "y")]
    assert [r.k for r in tables.dangling(new, old, "k", "k").collect()] == [3]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([(i, i % 3, i * 60) for i in range(180)], "id long, kind long, s long").select("id", "kind", F.timestamp_seconds("s").alias("ts"))
    rows.where("id < 120").write.parquet(str(source))
    name = tmp_path.name

    def run():
        stream = feeds.windowed(feeds.read(spark, str(source), rows.schema), "ts", ["kind"])
        return feeds.drain(stream, name)

    run()
    rows.where("id >= 120").write.mode("append").parquet(str(source))
    run()
    run()
    from driftwell.runtime import shared_folder

    got = spark.read.parquet(f"{shared_folder(spark)}/streams/{name}/rows")
    assert got.agg(F.sum("n")).first()[0] <= 180 and got.groupBy("window_start", "kind").count().where("count > 1").isEmpty()
    assert got.where("n = 20").count() >= 3


def test_unique_rows_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, 60 * i) for i in range(40)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    feeds.drain(feeds.unique(feeds.read(spark, str(tmp_path / "in"), rows.schema), ["id"], "ts", "2 hours"), f"u{tmp_path.name}")
    from driftwell.runtime import shared_folder

    assert spark.read.parquet(f"{shared_folder(spark)}/streams/u{tmp_path.name}/rows").count() == 5
