"""Ordered analytics: running values, steps, interleaving, budgets, chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def numbered(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in its group, from 1, by a total ``order``.

    Rows are sorted by ranges of (by, order) and counts of the ranges before are added, so a group that holds a third
    of all rows is spread over as many tasks. What is joined back has a row for each group and range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(by).asc_nulls_first(), *order]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    parts = ranged.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    joined = ranged.join(parts, (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*df.columns, (F.col("_at") - F.col("_low") + F.col("_before") + 1).alias(name))


def round_robin(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Rows with their turn: the first of every group, then the second of every group, and so on."""
    return numbered(df, by, order, "turn_no")


def every_kth(df: DataFrame, by: str, order: list[Column], step: int) -> DataFrame:
    """Of each stratum the rows at places 0, step, 2 * step, ..."""
    return numbered(df, by, order, "_place").where((F.col("_place") - 1) % step == 0).drop("_place")


def chunks(df: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """(by, order, chunk): rows in order fill chunks of ``budget``; a row that doesn't fit opens the next.

    Each group is sequential and is read in order as a stream of batches.
    """
    types = dict(df.dtypes)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, chunk, used = object(), 0, 0
        for b in batches:
            out = []
            for g, n in zip(b[by], b[size], strict=True):
                if g != group:
                    group, chunk, used = g, 0, 0
                if used and used + n > budget:
                    chunk, used = chunk + 1, 0
                used += n
                out.append(chunk)
            yield pd.DataFrame({by: b[by], order: b[order], "chunk": out})

    rows = df.select(by, order, size).repartition(by).sortWithinPartitions(by, order)
    return rows.mapInPandas(fill, f"{by} {types[by]}, {order} {types[order]}, chunk long")


def chained(df: DataFrame, by: str, order: str, payload: list[str]) -> DataFrame:
    """Each row with its hash and the hash of the row before it in its group; the first has an empty one before."""
    own = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (by, order, *payload))), 256)
    before = F.lag("row_hash", 1, "").over(Window.partitionBy(by).orderBy(order))
    return df.select(by, order, own.alias("row_hash")).withColumn("previous_hash", before)


def sessions(df: DataFrame, by: str, at: str, gap_minutes: int) -> DataFrame:
    """(by, session_start, session_end, n): rows with gaps of less than ``gap_minutes``."""
    window = F.session_window(at, f"{gap_minutes} minutes")
    found = df.groupBy(by, window.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("session_end"))
    return found.select(by, F.col("w.start").alias("session_start"), "session_end", "n")


def gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """(by, after, missing): holes in a group's numbers."""
    nxt = F.lead(number).over(Window.partitionBy(by).orderBy(number))
    return df.select(by, F.col(number).alias("after"), (nxt - F.col(number) - 1).alias("missing")).where("missing > 0")
