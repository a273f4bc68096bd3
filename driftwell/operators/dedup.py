"""Duplicates: equal texts, components with representatives, greedy leaders, folding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def equal_groups(df: DataFrame, ident: str, key: Column, least: int = 2) -> DataFrame:
    """(key_hash, first_id, copies) of the keys that ``least`` rows or more share."""
    by = df.select(ident, F.sha2(key, 256).alias("key_hash")).groupBy("key_hash")
    return by.agg(F.min(ident).alias("first_id"), F.count("*").alias("copies")).where(F.col("copies") >= least)


def fold(df: DataFrame, ident: str, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, with merged_count, the rows it stands for; ties by id."""
    place = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), F.col(ident).alias("i"))
    keyed = df.select(F.sha2(F.coalesce(key, F.lit("")), 256).alias("k"), place.alias("o"), F.struct(*df.columns).alias("row"))
    best = keyed.groupBy("k").agg(F.min_by("row", "o").alias("row"), F.count("*").alias("merged_count"))
    return best.select("row.*", "merged_count")


def leaders(df: DataFrame, bucket: list[str], ident: str, grams: str, least: float) -> DataFrame:
    """(bucket.., ident, leader): in id order a row joins the first leader of its bucket with a Jaccard of ``least`` or more.

    Sequential within a bucket by definition; a bucket is read in order as a stream of batches and only its leaders
    are held. Buckets are the unit of parallel work.
    """
    types = dict(df.dtypes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, firsts = object(), []
        for b in batches:
            out = []
            for key, i, g in zip(zip(*(b[c] for c in bucket), strict=True), b[ident], b[grams], strict=True):
                if key != at:
                    at, firsts = key, []
                s = set(g)
                found = next((lead for lead, t in firsts if s and t and len(s & t) >= least * len(s | t)), None)
                if found is None:
                    firsts.append((i, s))
                    found = i
                out.append(found)
            yield pd.DataFrame({**{c: b[c] for c in bucket}, ident: b[ident], "leader": out})

    schema = ", ".join([*(f"{c} {types[c]}" for c in bucket), f"{ident} {types[ident]}", f"leader {types[ident]}"])
    return df.select(*bucket, ident, grams).repartition(*bucket).sortWithinPartitions(*bucket, ident).mapInPandas(assign, schema)


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The one row of each key with the least values of ``order``: a minimum that partitions take first."""
    best = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("_best"))
    return best.select("_best.*")


def similar_sets(df: DataFrame, ident: str, items: str, least: float) -> DataFrame:
    """(a, b, common, m, n): pairs a < b of sets whose Jaccard similarity may be ``least`` or more, with what they share.

    Each set is ordered by how many sets hold an element, rare ones first; sets that are similar share one of their
    first n - ceil(least * n) + 1 elements, so the most frequent ones, which would pair everything, are never joined.
    """
    sets = df.select(F.col(ident).alias("id"), F.array_distinct(items).alias("s")).where(F.size("s") > 0)
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("k"))
    ranked = each.join(each.groupBy("k").agg(F.count("*").alias("c")), "k").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "k"))).alias("s"), F.first("n").alias("n"))
    prefix = ranked.select("id", "n", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("x")).select("id", "n", F.xxhash64("x.k").alias("k"))
    x, y = prefix.alias("x"), prefix.alias("y")
    size = (F.col("x.n") >= least * F.col("y.n")) & (F.col("y.n") >= least * F.col("x.n"))
    pairs = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id")) & size).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    left, right = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("common"), F.size("sa").alias("m"), F.size("sb").alias("n"))
