"""Rules over counts and time: usage, interest and capability classes, states as of a time, changes, trends, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(df: DataFrame, service: str, month: Column) -> DataFrame:
    """(service, n, months, first_month, last_month, share): usage by service over months."""
    by_month = df.select(F.col(service).alias("service"), month.alias("month")).groupBy("service", "month").agg(F.count("*").alias("n"))
    by = by_month.groupBy("service").agg(F.sum("n").alias("n"), F.count("*").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("service", "n", "months", "first_month", "last_month", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def usage_class(n: Column, months: Column, last_month: Column, recent: str) -> Column:
    """long_term, frequent, recent, dormant or tried, the first that fits."""
    fresh = last_month >= F.lit(recent)
    return F.when(fresh & (months >= 6) & (n >= 100), "long_term").when(fresh & (n >= 50), "frequent").when(fresh, "recent").when(n >= 50, "dormant").otherwise("tried")


def tier(n: Column) -> tuple[Column, Column]:
    """Capability tier by the number of proofs, and its confidence."""
    names = F.when(n >= 5, "core").when(n >= 3, "common").when(n >= 2, "occasional").otherwise("minor")
    return names, F.when(n >= 5, 0.9).when(n >= 3, 0.8).when(n >= 2, 0.6).otherwise(0.4)


def as_of(df: DataFrame, key: list[str], at: str, values: list[str], when: object) -> DataFrame:
    """The last values of each key observed not later than ``when``; the largest of simultaneous ones."""
    held = df.where(F.col(at) <= F.lit(when)).groupBy(*key).agg(F.max(F.struct(at, *values)).alias("_v"))
    return held.select(*key, *(F.col("_v")[c].alias(c) for c in (at, *values)))


def changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key.., change, before, after): keys added, removed or with another value."""
    a, b = before.select(*key, F.col(value).alias("before")), after.select(*key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.select(*key, change.alias("change"), "before", "after").where("change IS NOT NULL")


def trend(df: DataFrame, key: list[str], at: str, value: str, least: int = 3, flat: float = 0.0) -> DataFrame:
    """(key.., samples, delta, direction) from the first to the last sample; keys of fewer than ``least`` samples are insufficient."""
    by = df.groupBy(*key).agg(F.count("*").alias("samples"), (F.max_by(value, at) - F.min_by(value, at)).alias("d"))
    delta = F.round("d", 4)
    enough = F.col("samples") >= least
    direction = F.when(~enough, "insufficient").when(delta > flat, "up").when(delta < -flat, "down").otherwise("flat")
    return by.select(*key, "samples", F.when(enough, delta).alias("delta"), direction.alias("direction"))


def weighted(weights: dict[str, float]) -> Column:
    """Weighted sum of columns clamped to 0..1, rounded to six places."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(w) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return F.round(total, 6)


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
