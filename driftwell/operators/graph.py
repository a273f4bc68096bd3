"""Graphs as (src, dst) edges: degrees, levels, shared neighbours, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree); repeated edges count."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def levels(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, level): nodes within ``hops`` of the start nodes and their fewest steps; each round joins the frontier alone."""
    both = materialize(undirected(edges))
    seen = [materialize(start.select(F.col(start.columns[0]).alias("node")).distinct().withColumn("level", F.lit(0)))]
    for hop in range(1, hops + 1):
        reached = seen[-1].select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct()
        known = reduce(DataFrame.union, seen).select("node")
        nxt = materialize(reached.join(known, "node", "left_anti").withColumn("level", F.lit(hop)))
        if nxt.isEmpty():
            break
        seen.append(nxt)
    return reduce(DataFrame.union, seen)


def common_neighbours(edges: DataFrame, a: object, b: object) -> DataFrame:
    both = undirected(edges)
    of = lambda n: both.where(F.col("src") == F.lit(n)).select(F.col("dst").alias("node"))
    return of(a).intersect(of(b))


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component's least node: least labels of neighbours and of labels, until none changes."""
    both = materialize(undirected(edges))
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        lower = materialize(labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component")))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        labels = materialize(lower.join(jump, "component").select("node", F.least("component", "jump").alias("component"), "was"))
        if labels.where("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
