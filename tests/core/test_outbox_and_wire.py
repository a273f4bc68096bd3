"""The leased outbox as a stream and as a log; the wire format against a plain encoder."""

import random

import pytest
from pyspark.sql import functions as F

from driftwell.sources import wire
from driftwell.streaming import feeds, outbox

COLUMNS = "key string, at timestamp, seq long, action string, digest string, owner string, token long"


def at(second):
    return f"2026-01-01 00:{second // 60:02d}:{second % 60:02d}"


def commands(spark, rows):
    return spark.createDataFrame([(k, at(s), i, a, d, o, t) for i, (k, s, a, d, o, t) in enumerate(rows)], COLUMNS.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


LOG = [
    ("m", 0, "enqueue", "d", None, None), ("m", 1, "enqueue", "d", None, None), ("m", 2, "enqueue", "other", None, None),
    ("m", 3, "claim", None, "one", None), ("m", 10, "claim", None, "two", None),
    ("m", 100, "claim", None, "two", None), ("m", 101, "ack", None, "one", 1), ("m", 110, "ack", None, "two", 2), ("m", 120, "claim", None, "one", None),
    ("n", 0, "claim", None, "one", None), ("n", 1, "enqueue", "e", None, None), ("n", 2, "claim", None, "one", None), ("n", 3, "fail", None, "one", 1), ("n", 4, "ack", None, "one", 1), ("n", 5, "claim", None, "two", None),
    ("o", 0, "enqueue", "f", None, None), ("o", 1, "claim", None, "one", None), ("o", 90, "ack", None, "one", 1),
]
WANT = {
    "m": ["pending", "idempotent", "conflict", "leased", "held", "leased", "refused", "sent", "done"],
    "n": ["unknown", "pending", "leased", "released", "refused", "leased"],
    "o": ["pending", "leased", "refused"],
}


def test_log_of_commands(spark):
    got = {r.key: (r.status, r.attempts, r.token, r.refused) for r in outbox.settled(commands(spark, LOG)).collect()}
    assert got == {"m": ("sent", 2, 2, 1), "n": ("pending", 2, 2, 1), "o": ("pending", 1, 1, 1)}


@pytest.mark.parametrize("parts", [1, 4])
def test_stream_lapses_leases_and_refuses_late_acks(spark, tmp_path, parts):
    """All in one batch, and in batches of time, where timers end leases between them."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", outbox.ROCKSDB)
    try:
        rows = commands(spark, LOG).collect()
        edges = {1: [0, 1000], 4: [0, 4, 50, 105, 1000]}[parts]
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            own = [r for r in rows if lo <= r["at"].minute * 60 + r["at"].second < hi]
            spark.createDataFrame(own, COLUMNS).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
        name = f"outbox-{parts}-{tmp_path.name}"
        for k in range(parts):  # each run goes on from the state of the last
            stream = spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in" / f"[0-{k}]"))
            feeds.drain(outbox.outbox(stream), name)
        folder = spark.conf.get("spark.checkpoint.dir") + f"/streams/{name}/rows"
        got = spark.read.parquet(folder).collect()
    finally:
        if was is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    for key, want in WANT.items():
        assert sorted(r.result for r in got if r.key == key and r.action != "timer") == sorted(want)
    expired = sorted((r.key, r.token) for r in got if r.action == "timer")
    assert expired == [("m", 1), ("n", 2), ("o", 1)]


def test_fields_equal_what_was_encoded(spark, tmp_path):
    r = random.Random(3)

    def message(depth):
        """Bytes, and the (path, value) pairs in them."""
        data, want = b"", []
        for _ in range(r.randint(1, 6)):
            n = r.choice([1, 2, 15, 16, 2000])
            kind = r.choice(["int", "text", "bytes", "sub"] if depth else ["int", "text", "bytes"])
            if kind == "int":
                v = r.choice([0, 1, 127, 128, 2**40, 2**63 - 1, -1])
                data += wire.encoded(n, v)
                want.append((str(n), v))
            elif kind == "text":
                v = r.choice(["", "hé llo", "line\nline", "漢字"])
                data += wire.encoded(n, v)
                want.append((str(n), v))
            elif kind == "bytes":
                v = b"\xff\xfe\x00" + bytes(r.randrange(256) for _ in range(5))
                data += wire.encoded(n, v)
                want.append((str(n), v))
            else:
                sub, inner = message(depth - 1)
                sub += wire.encoded(1, 7)  # ends with a control character, so that it is no text
                data += wire.encoded(n, sub)
                want += [(f"{n}.{p}", v) for p, v in [*inner, ("1", 7)]]
        return data, want

    made = {}
    for k in range(60):
        data, want = message(3)
        if all(not (isinstance(v, bytes) and wire.fields(v)[1]) for _, v in want):
            made[f"f{k}"] = want
            (tmp_path / f"f{k}").write_bytes(data)
    got = {}
    for x in wire.read(spark, str(tmp_path)).collect():
        assert x.complete
        got.setdefault(x.file.rsplit("/", 1)[1], []).append((x.path, x.number if x.wire == wire.VARINT else x.text if x.text is not None else bytes(x.bytes)))
    assert got == made


def test_broken_messages_give_what_comes_before(spark):
    whole = wire.encoded(1, 5) + wire.encoded(2, "text") + wire.encoded(3, b"\xff" * 9)
    rows = [(k, whole[:k]) for k in range(len(whole) + 1)] + [(100, None), (101, b"\x00\x01"), (102, wire.encoded(1, 5) + b"\x0b"), (103, b"\xff" * 11), (104, wire.encoded(1, 2) + b"\x29" + b"\x01" * 8 + b"\x35" + b"\x02" * 4)]
    got = {}
    for x in wire.decoded(spark.createDataFrame(rows, "id long, data binary"), "data", "id").collect():
        got.setdefault(x.id, []).append((x.path, x.complete))
    ends = [2, 8, 19]
    for k in range(1, len(whole) + 1):
        n = sum(e <= k for e in ends)
        assert [p for p, _ in got.get(k, [])] == ["1", "2", "3"][:n]
        assert all(c == (k in ends) for _, c in got.get(k, []))
    assert not {0, 100, 101, 103} & set(got) and got[102] == [("1", False)] and [p for p, _ in got[104]] == ["1", "5", "6"]


def test_depth_bounds_the_walk(spark):
    data = wire.encoded(1, 1)
    for _ in range(30):
        data = wire.encoded(2, data + b"\x08\x01")
    paths = {x.path for x in wire.decoded(spark.createDataFrame([(data,)], "data binary"), "data", depth=4).collect()}
    assert max(p.count(".") for p in paths) == 3
