"""Joins that Spark has no single call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` in its group whose ``at`` is not later; null if none.

    Both sides are sorted together once by (by, at), the right first among equals, and the last right row is
    carried down the group: one shuffle, no row pairs.
    """
    held = F.struct(*values)
    rows = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(held.alias("v")).schema["v"].dataType).alias("_v"))
    rows = rows.unionByName(right.select(*by, at, F.lit(0).alias("_side"), held.alias("_v")), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return rows.select(*left.columns, *(F.col("_v")[v].alias(f"asof_{v}") for v in values))


def overlaps(df: DataFrame, key: str, ident: str, start: Column, end: Column, width_days: int) -> DataFrame:
    """Pairs (a < b) of one key whose half-open intervals overlap; touching ones don't. No interval is longer than ``width_days``.

    Each interval goes to the time buckets that it meets, as wide as the longest one, so a pair meets in one of two
    and is kept in the one where the later one starts: the work follows the overlaps, not the squares of the groups.
    """
    rows = df.select(F.col(key).alias("k"), F.col(ident).alias("id"), start.alias("s"), end.alias("e"))
    bucket = lambda t: F.floor(F.unix_seconds(t) / (86400 * width_days))
    rows = rows.withColumn("own", bucket(F.col("s"))).withColumn("b", F.explode(F.sequence("own", bucket(F.col("e")))))
    x, y = rows.alias("x"), rows.alias("y")
    on = (F.col("x.k") == F.col("y.k")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.id") < F.col("y.id"))
    on &= (F.greatest("x.s", "y.s") < F.least("x.e", "y.e")) & (F.col("x.b") == F.greatest("x.own", "y.own"))
    return x.join(y, on).select(F.col("x.k").alias(key), F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def adjacent(df: DataFrame, by: str, number: str, values: list[str]) -> DataFrame:
    """Rows paired with the row of the next number in their group; a gap breaks the pair."""
    nxt = df.select(by, (F.col(number) - 1).alias(number), *(F.col(v).alias(f"next_{v}") for v in values))
    return df.select(by, number, *values).join(nxt, [by, number])


def latest(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Rows with the latest ``at`` of their group; ties all stay. A max is shuffled, not the rows of the group sorted."""
    most = df.groupBy(*by).agg(F.max(at).alias("_most"))
    return df.join(most, by).where(F.col(at) == F.col("_most")).drop("_most")


def keywords(df: DataFrame, ident: str, text: str, topics: dict[str, list[str]]) -> DataFrame:
    """(ident, topic): a row for each topic one of whose words is in the lower-case text."""
    low = F.lower(F.col(text))
    found = []
    for topic, words in topics.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        found.append(F.when(hit, F.lit(topic)))
    return df.select(ident, F.explode(F.array_compact(F.array(*found))).alias("topic"))


def crosswalk(left: DataFrame, right: DataFrame, passes: list[tuple[Column, Column]], a: str, b: str) -> DataFrame:
    """(a, b, step): rows of two tables matched by one key after another, each row used once at most.

    In a pass the unmatched rows of equal key are paired in the order of their ids.
    """
    out = None
    for step, (lk, rk) in enumerate(passes, 1):
        x, y = left.select(F.col(a).alias("a"), lk.alias("k")), right.select(F.col(b).alias("b"), rk.alias("k"))
        if out is not None:
            x, y = x.join(out.select("a"), "a", "left_anti"), y.join(out.select("b"), "b", "left_anti")
        x = x.where("k IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("a")))
        y = y.where("k IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("b")))
        found = x.join(y, ["k", "r"]).select("a", "b", F.lit(step).alias("step"))
        out = found if out is None else out.union(found)
    return out.select(F.col("a").alias(a), F.col("b").alias(b), "step")
