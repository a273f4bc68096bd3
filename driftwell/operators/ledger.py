"""Ledgers, cursors and watermarks of incremental work."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feed_page(feed: DataFrame, order: list[str], cursor: tuple | None, size: int, change: str = "change") -> DataFrame:
    """The next rows of a change feed after ``cursor``, 1 to 100 of them, with what a consumer does: removed rows are withdrawn, others prepared.

    Rows come again until the consumer stores a later cursor, so its work must bear that.
    """
    types = dict(feed.dtypes)
    if cursor is not None:
        feed = feed.where(F.struct(*order) > F.struct(*(F.lit(v).cast(types[k]).alias(k) for k, v in zip(order, cursor, strict=True))))
    rows = feed.orderBy(*order).limit(max(1, min(size, 100)))
    return rows.withColumn("work", F.when(F.col(change) == "removed", "withdraw").otherwise("prepare"))


def watermarks(active: DataFrame, candidate: DataFrame, source: str, at: str) -> DataFrame:
    """(source, active, candidate, status): a candidate whose newest row is older than the active one's has regressed."""
    a, c = active.groupBy(source).agg(F.max(at).alias("active")), candidate.groupBy(source).agg(F.max(at).alias("candidate"))
    status = F.when(F.col("candidate").isNull(), "missing").when(F.col("active").isNull(), "new").when(F.col("candidate") < F.col("active"), "regressed").otherwise("ok")
    return a.join(c, source, "full_outer").select(source, "active", "candidate", status.alias("status"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those processed."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def hash_sum(*parts: Column) -> Column:
    """Aggregate: two sums over the rows' md5, 60 bits of each, as text; alike in any order and added up by partitions.

    The sums are decimals, so no number of rows overflows them.
    """
    whole = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    part = lambda at: F.sum(F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("-", part(1), part(16))


def ordered_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, members, digest, anchors) of batches (key, member, n) sorted by key and member: SHA-256 over a key's members joined by commas.

    Null members count among the anchors alone. One key's state is held at a time.
    """
    at, seen = object(), False
    members = anchors = 0
    state = sha256()
    row = lambda: (at, members, state.hexdigest(), anchors)
    for b in batches:
        names, out = list(b.columns), []
        for key, member, n in zip(*(b[c] for c in names), strict=True):
            key = None if pd.isna(key) else key
            if not seen or key != at:
                if seen:
                    out.append(row())
                at, seen, members, anchors, state = key, True, 0, 0, sha256()
            anchors += n
            if not pd.isna(member):
                state.update((b"," if members else b"") + str(int(member)).encode())
                members += 1
        yield pd.DataFrame(out, columns=["topic", "members", "member_digest", "anchors"])
    if seen:
        yield pd.DataFrame([row()], columns=["topic", "members", "member_digest", "anchors"])


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of each rule's offending rows; a gate passes where all are 0."""
    out = None
    for name, bad in rules.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.union(one)
    return out


def appended(df: DataFrame, key: str, seq: str, expected: str, token: str) -> DataFrame:
    """(key, seq, verdict) of writes in order: a repeated token is a replay, a write that expects another version than the key's is stale, else it is applied.

    Each key is an ordered stream; its version is the number of writes applied.
    """
    types = dict(df.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, version, seen = object(), 0, set()
        for b in batches:
            out = []
            for k, e, t in zip(b[key], b[expected], b[token], strict=True):
                if k != at:
                    at, version, seen = k, 0, set()
                if t in seen:
                    out.append("replay")
                elif e != version:
                    out.append("stale")
                else:
                    version += 1
                    seen.add(t)
                    out.append("applied")
            yield pd.DataFrame({key: b[key], seq: b[seq], "verdict": out})

    rows = df.select(key, seq, expected, token).repartition(key).sortWithinPartitions(key, seq)
    return rows.mapInPandas(scan, f"{key} {types[key]}, {seq} {types[seq]}, verdict string")


def transitions(df: DataFrame, key: str, seq: str, command: str, legal: dict[tuple[str, str], str], start: str) -> DataFrame:
    """(key, state, applied, refused): the state after a key's commands in order; a command that isn't legal in a state changes nothing."""
    types = dict(df.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, good, bad = None, start, 0, 0
        for b in batches:
            out = []
            for k, c in zip(b[key], b[command], strict=True):
                if k != at:
                    if at is not None:
                        out.append((at, state, good, bad))
                    at, state, good, bad = k, start, 0, 0
                nxt = legal.get((state, c))
                state, good, bad = (state, good, bad + 1) if nxt is None else (nxt, good + 1, bad)
            yield pd.DataFrame(out, columns=[key, "state", "applied", "refused"])
        if at is not None:
            yield pd.DataFrame([(at, state, good, bad)], columns=[key, "state", "applied", "refused"])

    rows = df.where(F.col(key).isNotNull()).select(key, seq, command).repartition(key).sortWithinPartitions(key, seq)
    return rows.mapInPandas(scan, f"{key} {types[key]}, state string, applied long, refused long")


def latest_version(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of each key's greatest version."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")
