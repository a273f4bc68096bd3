"""Event histories: undo, lifecycles with a hash chain, facts that supersede or contradict, budgets in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effective(df: DataFrame, key: str, seq: str, undoes: str) -> DataFrame:
    """Rows that stand after undos: an undo takes its target out, and an undo of an undo puts it back.

    ``undoes`` is the seq of the row of the same key that a row takes back, or null. Latest rows decide first, so
    each key is one ordered scan.
    """

    types = dict(df.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, gone = object(), set()
        for b in batches:
            keep = []
            for k, s, target in zip(b[key], b[seq], b[undoes], strict=True):
                if k != at:
                    at, gone = k, set()
                stands = s not in gone
                if stands and pd.notna(target):
                    gone.add(int(target))
                keep.append(stands and pd.isna(target))
            yield b[keep]

    if types[seq] not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError(f"{seq} must be a whole number")
    rows = df.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, F.desc(seq))
    return rows.mapInPandas(scan, df.schema)


def chain_faults(df: DataFrame, key: str, seq: str, own: str, before: str) -> DataFrame:
    """(key, gaps, breaks): places where numbers from 1 have a gap and where ``before`` isn't the last row's ``own``."""
    order = Window.partitionBy(key).orderBy(seq)
    rows = df.select(key, (F.col(seq) - F.coalesce(F.lag(seq).over(order), F.lit(0)) != 1).cast("long").alias("g"), (~F.coalesce(F.col(before), F.lit("")).eqNullSafe(F.coalesce(F.lag(own).over(order), F.lit("")))).cast("long").alias("b"))
    return rows.groupBy(key).agg(F.sum("g").alias("gaps"), F.sum("b").alias("breaks"))


def supersede(df: DataFrame, key: list[str], value: str, at: str, ident: str) -> DataFrame:
    """(key.., ident, status): the newest of a key is current, older ones of another value superseded, of the same value repeated.

    Rows of the newest time whose values differ are all conflicts.
    """
    by = Window.partitionBy(*key)
    newest = F.max(at).over(by)
    top = F.when(F.col(at) == newest, F.col(value))
    rows = df.select(*key, ident, at, value, newest.alias("_n"), F.min(top).over(by).alias("_lo"), F.max(top).over(by).alias("_hi"), F.row_number().over(by.orderBy(F.desc(at), F.desc(ident))).alias("_r"))
    clash = F.col("_lo") != F.col("_hi")
    status = F.when((F.col(at) == F.col("_n")) & clash, "conflict").when(F.col("_r") == 1, "current").when(F.col(value) == F.col("_hi"), "repeated").otherwise("superseded")
    return rows.select(*key, ident, status.alias("status"))


def valid_as_of(df: DataFrame, key: list[str], value: str, start: str, end: str, observed: str, when: Column) -> DataFrame:
    """(key.., value, status) of bitemporal rows: known by then and started; an end at ``when`` still counts.

    The latest observed of a key holds; simultaneous ones that differ are a conflict, and its value is null.
    """
    known = df.where((F.col(observed) <= when) & (F.col(start) <= when))
    live = known.where(F.col(end).isNull() | (F.col(end) >= when))
    by = live.groupBy(*key, observed).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).groupBy(*key).agg(F.max(F.struct(observed, "lo", "hi")).alias("x"))
    clash = F.col("x.lo") != F.col("x.hi")
    return by.select(*key, F.when(~clash, F.col("x.lo")).alias(value), F.when(clash, "conflict").otherwise("valid").alias("status"))


def within_budgets(df: DataFrame, by: str, order: str, domain: str, score: str, critical: str, total: int, each: int) -> DataFrame:
    """(by, order, taken): in falling score a row is taken while its group and its domain in it have room; critical rows always are.

    Critical rows use room too; rows that aren't taken don't. A group is one ordered stream.
    """
    types = dict(df.dtypes)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, used, room = object(), {}, total
        for b in batches:
            out = []
            for g, d, must in zip(b[by], b[domain], b[critical], strict=True):
                if g != group:
                    group, used, room = g, {}, total
                take = bool(must) or (room > 0 and used.get(d, 0) < each)
                if take:
                    room -= 1
                    used[d] = used.get(d, 0) + 1
                out.append(take)
            yield pd.DataFrame({by: b[by], order: b[order], "taken": out})

    rows = df.select(by, order, domain, score, critical).repartition(by).sortWithinPartitions(by, F.desc(score), order)
    return rows.mapInPandas(scan, f"{by} {types[by]}, {order} {types[order]}, taken boolean")


def previous_mean(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """(by, at, value, before): the mean of the values before, null for the first."""
    earlier = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(by, at, value, F.round(F.avg(value).over(earlier), 4).alias("before"))


def recent_text(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """(by, rows, chars): how many of the newest rows fit in ``most`` characters; the newest always does, cut if need be."""
    newest = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.select(by, F.least(F.col(size), F.lit(most)).alias("n"), F.sum(size).over(newest).alias("upto"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))).alias("r"))
    fit = rows.where((F.col("upto") <= most) | (F.col("r") == 1))
    return fit.groupBy(by).agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


def first_filled(df: DataFrame, by: str, order: str, text: Column, most: int) -> DataFrame:
    """(by, title): the first text of each group that isn't blank, white space folded, cut to ``most``."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    return df.select(by, order, clean.alias("t")).where("t <> ''").groupBy(by).agg(F.substring(F.min_by("t", order), 1, most).alias("title"))
