"""Vectors: nearest rows to a stated query set, and similar pairs by lists of a clustered index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_index
from .vector_index import _stack, unit

QUERY_BLOCK, ROW_BLOCK = 4096, 2048  # queries that a task is sent, rows of its products
PAIR_PARTS, PAIR_LEAST, PAIR_MOST = 16, 512, 32768  # chunks that similar rows are looked for in, and the bounds of their size
PAIR_ROWS, PAIR_HITS = 512, 1 << 18  # rows of a product and similar pairs that are held at a time
SALT = 64  # groups in which a query's results of all tasks meet first


def nearest(df: DataFrame, queries: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, ident, score, rank): the k most similar rows of ``df`` to each query by cosine, ties by id.

    Exact, for a stated query set: the rows stay where they are, and queries are sent to them in blocks of some
    QUERY_BLOCK vectors. A task keeps k rows for each query and hands those on. ``vector_index`` has the search that
    opens few rows.
    """
    spark = df.sparkSession
    asked = queries.where(F.col("query_id").isNotNull() & F.col(vector).isNotNull()).select(F.col("query_id").cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    rows = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    out = None
    for block in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)).collect()  # a block of bounded size
        ids = np.array([r.q for r in own], np.int64)
        sent = spark.sparkContext.broadcast((ids, unit(np.array([r.v for r in own], float)) if own else np.zeros((0, 0))))
        found = rows.mapInArrow(_best_of(sent, k), "query_id long, id long, score double")
        out = found if out is None else out.union(found)
    order = (F.desc(F.round("score", 12)), F.col("id"))
    first = out.withColumn("salt", F.spark_partition_id() % SALT)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return first.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(ident), "score", "rank")


def _best_of(sent, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's place, row's id, score
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, ROW_BLOCK):
                b = whole.slice(at, ROW_BLOCK)
                s = q @ _stack(b.column(1)).T
                near = s.round(12)
                least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k] if near.shape[1] > k else np.full((len(q), 1), -np.inf)
                i, j = np.nonzero(near >= least)
                row, own, score = (np.concatenate([x, y]) for x, y in zip(kept, (i, b.column(0).to_numpy()[j], s[i, j]), strict=True))
                order = np.lexsort((own, -score.round(12), row))
                row, own, score = row[order], own[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = tuple(x[place < k] for x in (row, own, score))
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "id", "score"])

    return best


def _met(df: DataFrame, least: float, ident: str, vector: str, lists: int | None) -> DataFrame | None:
    """(x, y, cx, cy, left, id, v): both sides of every pair of chunks that may hold a cosine of ``least`` or more; None without rows.

    Chunks grow with the row count, from PAIR_LEAST to PAIR_MOST rows, so that a row is sent to some PAIR_PARTS chunks
    and only beyond PAIR_PARTS * PAIR_MOST rows to more.
    """
    n = df.count()
    chunk = min(max(-(-n // PAIR_PARTS), PAIR_LEAST), PAIR_MOST)
    index = vector_index.build(df, lists or max(1, -(-n // chunk)), ident=ident, vector=vector, chunk=chunk)
    spark, c = df.sparkSession, index.centroids
    by = {r.list: (r.n, r.angle) for r in index.lists.collect()}  # MOST_LISTS rows at most
    used = np.array(sorted(by), np.int64)
    if not len(used):
        return None
    angle = np.array([by[k][1] for k in used.tolist()])
    room = np.arccos(np.clip(c[used] @ c[used].T, -1, 1)) - angle[:, None] - angle[None] <= np.arccos(np.clip(least, -1, 1)) + 1e-7
    x, y = np.nonzero(np.triu(room))
    chunks = np.array([-(-by[k][0] // chunk) for k in used.tolist()])
    pairs = spark.createDataFrame(pd.DataFrame({"x": used[x].astype("int32"), "y": used[y].astype("int32"), "nx": chunks[x].astype("int32"), "ny": chunks[y].astype("int32")}))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.rows.join(pairs.withColumnRenamed("x", "list"), "list").select(F.col("list").alias("x"), "y", F.col("chunk").alias("cx"), to("ny").alias("cy"), F.lit(True).alias("left"), "id", "v")
    right = index.rows.join(pairs.withColumnRenamed("y", "list"), "list").select("x", F.col("list").alias("y"), to("nx").alias("cx"), F.col("chunk").alias("cy"), F.lit(False).alias("left"), "id", "v")
    # A chunk with itself needs one side alone.
    return left.union(right.where((F.col("x") != F.col("y")) | (F.col("cx") != F.col("cy")))).where((F.col("x") != F.col("y")) | (F.col("cx") <= F.col("cy")))


def _sides(key: tuple, batches: Iterator[pa.RecordBatch]) -> tuple[list, bool]:
    """[(ids, unit vectors)] of the left and right rows of a pair of chunks, and whether these are one chunk."""
    x, y, cx, cy = (k.as_py() for k in key)
    got = {True: [], False: []}
    for b in batches:
        left = b.column("left").to_numpy(zero_copy_only=False)
        ids, v = b.column("id").to_numpy(), b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
        for side in got:
            if (left == side).any():
                got[side].append((ids[left == side], v[left == side]))
    same = (x, cx) == (y, cy)
    joined = lambda parts: (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros((0, 1)))
    one = joined(got[True])
    return [one, one if same else joined(got[False])], same


def _products(sides: list, same: bool, least: float) -> Iterator[tuple]:
    """(a, b, score) of some rows' similar pairs at a time; single precision finds them, double precision tells."""
    (ids, v), (own, w) = sides
    if not len(ids) or not len(own):
        return
    small = np.ascontiguousarray(w.astype(np.float32).T)
    for at in range(0, len(ids), PAIR_ROWS):
        i, j = np.nonzero(v[at : at + PAIR_ROWS].astype(np.float32) @ small >= np.float32(least - 1e-5))
        for lo in range(0, len(i), PAIR_HITS):
            k, m = i[lo : lo + PAIR_HITS] + at, j[lo : lo + PAIR_HITS]
            k, m = (k[k < m], m[k < m]) if same else (k, m)
            score = np.einsum("ij,ij->i", v[k], w[m])
            a, b, keep = ids[k], own[m], (score >= least) & (ids[k] != own[m])
            yield np.minimum(a, b)[keep], np.maximum(a, b)[keep], score[keep]


def similar(df: DataFrame, least: float, ident: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b with a cosine of ``least`` or more.

    Rows are put into lists around centroids. Two lists are compared if the angle between their centroids, less the
    greatest angles inside them, leaves room for ``least``, so rows meet few lists where vectors are clustered and
    all where they aren't. A list is dealt in chunks; a pair of chunks is one task's matrix product, which hands on
    the similar pairs alone, some rows' at a time. ``lists`` follows the row count.
    """
    both = _met(df, least, ident, vector, lists)
    if both is None:
        return df.sparkSession.createDataFrame([], "a long, b long, score double")

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, score in _products(*_sides(key, batches), least):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], ["a", "b", "score"])

    return both.groupBy("x", "y", "cx", "cy").applyInArrow(product, "a long, b long, score double")


def links(df: DataFrame, levels: list[float], ident: str = "vec_id", vector: str = "embedding", lists: int | None = None) -> DataFrame:
    """(level, src, dst): links whose components are those of all pairs with a cosine of each of ``levels`` or more.

    A task hands on, for its pair of chunks, only a link from each row to the first row of its part, so no more than
    there are rows, however many pairs are similar. One pass over the vectors serves all levels.
    """
    both = _met(df, min(levels), ident, vector, lists)
    if both is None:
        return df.sparkSession.createDataFrame([], "level double, src long, dst long")

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, same = _sides(key, batches)
        nodes = np.unique(np.concatenate([sides[0][0], sides[1][0]]))
        label = {level: np.arange(len(nodes)) for level in levels}
        for a, b, score in _products(sides, same, min(levels)):
            x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
            for level in levels:
                _joined(label[level], x[score >= level], y[score >= level])
        for level in levels:
            own = np.flatnonzero(label[level] != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), level)), pa.array(nodes[own]), pa.array(nodes[label[level][own]])], ["level", "src", "dst"])

    return both.groupBy("x", "y", "cx", "cy").applyInArrow(product, "level double, src long, dst long")


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the parts of x and y in ``label``, each place's least place of its part."""
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label[:] = label[label]
