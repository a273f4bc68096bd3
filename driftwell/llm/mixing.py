"""Mixing sources to target weights (operator 2).

Every document gets a hash-random key; documents are range-sorted by (source, key), word counts are summed along
that order with a prefix sum whose parts are the range partitions, and each source is cut at its exact budget.
A budget above the source's size takes whole epochs first and cuts the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialize, unused

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
SPACES = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null has none."""
    parts = F.split(text, SPACES)
    edge = lambda x: (x == "").cast("long")
    n = F.size(parts).cast("long") - edge(F.element_at(parts, 1)) - F.when(F.size(parts) > 1, edge(F.element_at(parts, -1))).otherwise(0)
    return F.coalesce(n, F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Word budgets of the sources: rows (source, source_size, target).

    ``sizes`` has (source, size). Sources by code point, null last, take the weights in turn. The budget, ``share``
    of all words, is dealt by weight; a source stops at ``max_epochs`` times its size and the excess is dealt again
    among the others until none is above. Each round is an aggregate over the sources; its two sums alone reach the
    driver. No sources: no rows. A corpus without words has targets of 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = _rank(by)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by = materialize(rank.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(max_epochs)).alias("most")))
    total = (by.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        free = F.col("weight") * level < F.col("most")
        fixed, w = by.agg(F.sum(F.when(~free, F.col("most")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if not w:
            break
        now = (total - fixed) / w
        if now <= level:
            break
        level = now
    return by.select("source", "source_size", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def _rank(by: DataFrame) -> DataFrame:
    """Place of each source (0 first) in code-point order, null last, by range partitions and their counts."""
    spark = by.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        by.repartitionByRange(n, F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .select("*", (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("at"), F.spark_partition_id().alias("pid"))
    )
    counts = {r.pid: r.n for r in ranged.groupBy("pid").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, at = [F.lit(-1), F.lit(0)], 0
    for pid in sorted(counts):
        before += [F.lit(pid), F.lit(at)]
        at += counts[pid]
    return ranged.withColumn("rank", F.col("at") + F.create_map(*before)[F.col("pid")]).drop("at", "pid")


def _local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, total = object(), 0
    for b in batches:
        if not b.num_rows:
            continue
        source, size = b.column("source").to_pandas(), b.column("size").to_pandas()
        new = source.ne(source.shift())
        new &= ~(source.isna() & source.shift().isna())
        first = source.iloc[0]
        same = first == last or (first is None and last is None)
        new.iloc[0] = not same
        run = new.cumsum()
        before = size.groupby(run).cumsum() - size
        if same:
            before = before + total * (run == 0)
        before = before.astype("int64")
        last, total = source.iloc[-1], int(before.iloc[-1] + size.iloc[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(before)], [*b.schema.names, "before"])


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken: rows (doc_id, source, size, source_size, target, taken).

    taken is the number of words the mix takes of the document: whole epochs times its size, plus what the last,
    cut epoch takes; the document at the cut gives a part of its words, so that a source's words meet its budget
    (rounded to a word) exactly. Documents follow in the order of the first 16 hex digits of md5('seed:doc_id'), then doc_id and size;
    rows equal in all of these are interchangeable. Null text is empty, null source a source of its own, null
    doc_id an id like any other. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    sized = materialize(_sized(docs, seed))
    return _placed(sized, weights, max_epochs, share).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mix itself: the rows of ``docs`` of which ``mix_sources`` takes words, all their columns, and size, source_size, target and taken.

    taken // size is how often the text comes whole, taken % size how many of its first words come once more. A
    document of which the mix takes nothing isn't in it. Columns of ``docs`` named like the four new ones give way
    to them.
    """
    (row,) = unused(docs, "_row")
    docs = materialize(docs.drop("size", "source_size", "target", "taken").withColumn(row, F.monotonically_increasing_id()))  # stored, so a row keeps its number
    placed = _placed(materialize(_sized(docs, seed, F.col(row).alias("row"))), weights, max_epochs, share)
    taken = placed.where("taken > 0").select(F.col("row").alias(row), "size", "source_size", "target", "taken")
    return docs.join(taken, row).drop(row)


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *more)


def _placed(sized: DataFrame, weights: tuple[float, ...], max_epochs: int, share: float) -> DataFrame:
    """``sized`` with source_size, target and taken."""
    goal = targets(sized, weights, max_epochs, share)
    n = int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), "key", F.col("doc_id").asc_nulls_last(), "size"]
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("key").withColumn("pid", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType())])
    ranged = materialize(ranged.mapInArrow(_local_sums, schema))
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("source", "pid").agg(F.sum("size").alias("part"))  # a row for each partition a source reaches
    parts = parts.withColumn("earlier", F.coalesce(F.sum("part").over(earlier), F.lit(0)))
    parts = parts.join(goal, parts["source"].eqNullSafe(goal["source"])).select(parts["source"].alias("s"), F.col("pid").alias("p"), "earlier", "source_size", "target")
    out = ranged.join(parts, (F.col("pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") + F.col("earlier"))))
    return out.withColumn("taken", (epochs * F.col("size") + part).cast("long"))
