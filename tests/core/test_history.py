import random

from driftwell.operators import history


def test_undo_of_undo(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, 2), ("a", 4, 3), ("a", 5, 1), ("b", 1, None), ("b", 2, 1)]
    df = spark.createDataFrame(rows, "k string, seq long, undoes long")
    assert sorted((r.k, r.seq) for r in history.effective(df, "k", "seq", "undoes").collect()) == [("a", 2)]


def test_budgets_equal_a_plain_loop(spark):
    r = random.Random(6)
    rows = [(g, i, r.choice("xyz"), round(r.random(), 3), r.random() < 0.1) for g in range(4) for i in range(40)]
    want = {}
    for g in range(4):
        room, used = 6, {}
        for _, i, d, _, must in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[3], x[1])):
            take = must or (room > 0 and used.get(d, 0) < 3)
            if take:
                room, used[d] = room - 1, used.get(d, 0) + 1
            want[g, i] = take
    df = spark.createDataFrame(rows, "g long, i long, d string, s double, must boolean")
    assert {(x.g, x.i): x.taken for x in history.within_budgets(df, "g", "i", "d", "s", "must", 6, 3).collect()} == want


def test_valid_as_of_ends_and_conflicts(spark):
    from pyspark.sql import functions as F

    rows = [("a", "x", 1, 5, 1), ("b", "x", 1, 4, 1), ("c", "x", 1, None, 1), ("c", "y", 2, None, 3), ("d", "x", 1, None, 2), ("d", "y", 1, None, 2), ("e", "x", 1, None, 9)]
    df = spark.createDataFrame(rows, "k string, v string, s long, e long, o long")
    got = {r.k: (r.v, r.status) for r in history.valid_as_of(df, ["k"], "v", "s", "e", "o", F.lit(5)).collect()}
    assert got == {"a": ("x", "valid"), "c": ("y", "valid"), "d": (None, "conflict")}


def test_supersede(spark):
    rows = [("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 3, "y", 1), ("b", 4, "x", 5), ("b", 5, "y", 5)]
    df = spark.createDataFrame(rows, "k string, id long, v string, t long")
    assert {r.id: r.status for r in history.supersede(df, ["k"], "v", "t", "id").collect()} == {1: "superseded", 2: "current", 3: "repeated", 4: "conflict", 5: "conflict"}
