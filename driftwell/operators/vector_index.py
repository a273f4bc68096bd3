"""A clustered vector index: vectors in lists around centroids, searched by few lists or, exactly, by bounds.

Centroids come from a bounded sample; every row is assigned to the list of its nearest centroid. A search opens the
lists of the nearest centroids, ``probes`` of them. The exact search first takes the k-th best score of the nearest
lists, and opens every other list in which a row could be as near: a row of a list lies within the list's greatest
angle of its centroid, so no cosine in it is above that of the query's angle to the centroid less that angle.

A list that is opened meets the queries that ask for it in blocks: rows in chunks of bounded size, each with the
queries of its list, so a hot list is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

SAMPLE, ROUNDS = 20_000, 8  # vectors that centroids are fitted to, and how often they move
CHUNK, QUERIES = 4096, 512  # rows and queries of a task's product
MOST_LISTS = 4096


@dataclass(frozen=True)
class VectorIndex:
    """rows: (list, chunk, id, v) with unit vectors; lists: (list, n, angle); centroids: one unit vector for each list."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _stack(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))


def fit(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Unit centroids by a few rounds of spherical k-means; a centroid that loses all its vectors stays where it was."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        some = np.linalg.norm(total, axis=1) > 0
        c[some] = unit(total[some])
    return c


def build(df: DataFrame, lists: int | None = None, sample: int = SAMPLE, ident: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> VectorIndex:
    """The index of all rows with an id and a vector; vectors are of one length, and one of zeros has a cosine of 0 to all.

    ``sample`` rows, those of the least hashes of their id, fit the centroids: a bounded number that reaches the
    driver. ``lists`` is the square root of the row count unless given, MOST_LISTS at most, so that centroids stay a
    bounded table. ``search`` needs chunks of CHUNK rows.
    """
    given = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = given.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    taken = given.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    x = unit(np.array([r.v for r in taken], float)) if taken else np.zeros((0, 1))
    centroids = fit(x, lists) if len(x) else x
    sent = given.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                v = _stack(b.column(1))
                s = v @ sent.value.T
                own = np.argmax(s, axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(own)), own], -1, 1))
                unit_v = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), b.column(0), unit_v, pa.array(angle)], ["list", "id", "v", "angle"])

    rows = materialize(given.mapInArrow(assigned, "list int, id long, v array<double>, angle double"))
    by = materialize(rows.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / chunk)).cast("int")
    return VectorIndex(rows.join(by.select("list", "n"), "list").select("list", part.alias("chunk"), "id", "v"), by, centroids)


def _asked(queries: DataFrame, vector: str) -> DataFrame:
    return queries.where(F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q"))


def nearest_lists(index: VectorIndex, asked: DataFrame, probes: int | None) -> DataFrame:
    """(query_id, q, list, away): the ``probes`` nearest lists of each query and their centroid's angle, all lists without ``probes``."""
    sent = asked.sparkSession.sparkContext.broadcast(index.centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                s = _stack(b.column(1)) @ sent.value.T
                k = s.shape[1] if probes is None else min(probes, s.shape[1])
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(top)), k)
                away = np.arccos(np.clip(np.take_along_axis(s, top, 1).ravel(), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(top.ravel(), pa.int32()), pa.array(away)], ["query_id", "q", "list", "away"])

    if not len(index.centroids):
        return asked.select("query_id", "q", F.lit(0).alias("list"), F.lit(0.0).alias("away")).limit(0)
    return asked.mapInArrow(near, "query_id long, q array<double>, list int, away double")


def _scored(index: VectorIndex, opened: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the k best rows of each pair of a chunk and a block of queries, for the lists that are opened."""
    chunks = index.lists.select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), "n")
    asks = opened.join(chunks, "list")
    many = opened.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    asks = asks.join(many, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"))
    held = index.rows.join(many, "list").select("list", "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "id", "v")

    def product(b: pd.DataFrame) -> pd.DataFrame:
        left, right = b[b["asks"]], b[~b["asks"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        s = unit(np.stack(left["v"].to_numpy())) @ np.stack(right["v"].to_numpy()).T
        own = right["id"].to_numpy()
        order = np.lexsort((np.broadcast_to(own, s.shape), -s.round(12)), axis=1)[:, :k]
        return pd.DataFrame({"query_id": np.repeat(left["id"].to_numpy(), order.shape[1]), "id": own[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    return held.union(asks).groupBy("list", "chunk", "block").applyInPandas(product, "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def needed(index: VectorIndex, queries: DataFrame, k: int, vector: str = "embedding", first: DataFrame | None = None) -> DataFrame:
    """(query_id, q, list): lists besides the nearest ones in which a row may be among a query's k best."""
    asked = _asked(queries, vector)
    first = _scored(index, _first(index, asked), k) if first is None else first
    sure = _ranked(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    every = nearest_lists(index, asked, None).join(index.lists.select("list", "angle"), "list").join(sure, "query_id", "left")
    closest = F.greatest(F.col("away") - F.col("angle"), F.lit(0.0))
    open_ = F.col("least").isNull() | (F.cos(closest) + F.lit(1e-9) >= F.col("least"))
    return every.where(open_).join(_first(index, asked).select("query_id", "list"), ["query_id", "list"], "left_anti").select("query_id", "q", "list")


def _first(index: VectorIndex, asked: DataFrame) -> DataFrame:
    return nearest_lists(index, asked, 4).select("query_id", "q", "list")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = 16, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, ident, score, rank): the k rows of the greatest cosine to each query (query_id, vector), ties by id.

    With ``probes`` the rows of that many lists alone are looked at, and some of the best may be missed; ``recall``
    measures how many. Without, the result is exact. Queries without a vector have no result.
    """
    asked = materialize(_asked(queries, vector))
    if probes is not None:
        found = _scored(index, nearest_lists(index, asked, probes).select("query_id", "q", "list"), k)
    else:
        first = materialize(_scored(index, _first(index, asked), k))
        found = first.union(_scored(index, materialize(needed(index, asked.withColumnRenamed("q", vector), k, vector, first)), k))
    return _ranked(found, k).select("query_id", F.col("id").alias(ident), "score", "rank")


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int, vector: str = "embedding") -> DataFrame:
    """One row (recall, queries): the share of the exact results that ``probes`` lists give."""
    pairs = lambda p: search(index, queries, k, p, "id", vector).select("query_id", "id")
    exact = materialize(pairs(None))
    hit = exact.join(pairs(probes).withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"), F.countDistinct("query_id").alias("queries"))
