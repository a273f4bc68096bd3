"""Generations: what changed, what went, what a slot needs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from ..sources import pointers


def delta(current: DataFrame, prior: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key.., change): added, changed and removed keys of two generations, by a hash of the values; one join."""
    sign = F.sha2(F.to_json(F.struct(*values)), 256)
    a, b = current.select(*key, sign.alias("now")), prior.select(*key, sign.alias("was"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def changed_rows(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Whole rows that the prior generation lacks."""
    return current.subtract(prior)


def removed_keys(current: DataFrame, prior: DataFrame, key: list[str]) -> DataFrame:
    return prior.select(*key).subtract(current.select(*key))


def digest(df: DataFrame, by: list[str], ident: str) -> DataFrame:
    """(by.., n, digest): sha256 of a group's sorted ids."""
    ids = F.array_join(F.array_sort(F.collect_list(F.col(ident).cast("string"))), ",")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(ids, 256).alias("digest"))


def affected(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Rows of the groups that a change touches."""
    return rows.join(changed.select(key).distinct(), key, "left_semi")


class Violation(ValueError):
    """An invariant that staged rows break; the store is as it was."""


class KeyedStore:
    """Rows in partitions by a hash of ``group``, so that what a group's change touches is one partition.

    ``key`` tells rows apart; a row belongs to one ``slot``, the source it came from, and to one group.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, group: str, slot: str, key: str, partitions: int = 64):
        self.spark, self.path, self.schema, self.group, self.slot, self.key, self.partitions = spark, path, schema, group, slot, key, partitions

    def part(self) -> F.Column:
        return F.pmod(F.xxhash64(self.group), F.lit(self.partitions)).cast("int")

    def rows(self) -> DataFrame:
        """All rows with their partition, none before the first write."""
        try:
            return self.spark.read.schema(f"{self.schema}, part int").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], f"{self.schema}, part int")

    def check(self, staged: DataFrame, parents: DataFrame | None = None) -> None:
        """Keys are there and unique, groups are there and, with ``parents``, known."""
        broken = {
            "null key": staged.where(F.col(self.key).isNull() | F.col(self.group).isNull()),
            "key twice": staged.groupBy(self.key).agg(F.count("*").alias("c")).where("c > 1"),
        }
        if parents is not None:
            broken["unknown group"] = staged.join(parents.select(self.group).distinct(), self.group, "left_anti")
        for name, rows in broken.items():
            if not rows.isEmpty():
                raise Violation(name)

    def build(self, rows: DataFrame, parents: DataFrame | None = None) -> None:
        """The whole store anew."""
        staged = materialize(rows.withColumn("part", self.part()))
        self.check(staged, parents)
        staged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(self.path)

    def apply(self, slots: DataFrame, rows: DataFrame, parents: DataFrame | None = None) -> DataFrame:
        """Replace what the changed ``slots`` hold by ``rows`` and give the affected partitions (part).

        slots: (slot) of sources that changed, came or went; rows: all that they hold now. Partitions that had or
        get rows of a changed slot are worked out anew from the store, staged, and checked whole; a key that an
        untouched partition has too is a violation. Only then are these partitions, and no others, overwritten.
        """
        changed = materialize(slots.select(self.slot).distinct())
        new = materialize(rows.join(changed, self.slot, "left_semi").withColumn("part", self.part()))
        old = self.rows()
        touched = old.join(changed, self.slot, "left_semi").select("part").union(new.select("part")).distinct()
        touched = materialize(touched)
        numbers = [r.part for r in touched.collect()]  # as many as the store has partitions, at most
        kept = old.where(F.col("part").isin(numbers)).join(changed, self.slot, "left_anti")
        staged = materialize(kept.unionByName(new))
        self.check(staged, parents)
        if not old.where(~F.col("part").isin(numbers)).join(new.select(self.key), self.key, "left_semi").isEmpty():
            raise Violation("key in another group")
        staged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        full = {r.part for r in staged.select("part").distinct().collect()}
        for n in sorted(set(numbers) - full):  # an overwrite leaves a partition that has become empty
            pointers.remove(self.spark, f"{self.path}/part={n}")
        return touched


def reprojected(store: KeyedStore, target: KeyedStore, touched: DataFrame, project) -> DataFrame:
    """Work ``project`` out anew for the groups of the touched partitions alone, and overwrite these partitions of ``target``.

    project: a function from rows of whole groups to rows of the same groups; both stores have the same group and
    number of partitions, so a partition of one is a partition of the other.
    """
    if (store.group, store.partitions) != (target.group, target.partitions):
        raise ValueError("the stores are partitioned differently")
    numbers = [r.part for r in touched.collect()]
    made = materialize(project(store.rows().where(F.col("part").isin(numbers)).drop("part")).withColumn("part", target.part()))
    target.check(made)
    made.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(target.path)
    full = {r.part for r in made.select("part").distinct().collect()}
    for n in sorted(set(numbers) - full):
        pointers.remove(target.spark, f"{target.path}/part={n}")
    return touched
