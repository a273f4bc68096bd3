"""Benchmark decontamination (operator 5): greedy string tiling of benchmark items by the documents.

Words are compared without case and punctuation. Runs of ``least`` words of the benchmark are seeds; a bit array of
bounded size sifts the documents' runs, a join keeps the true seeds, and pairs whose shared seeds could reach the
threshold are tiled: the longest match not yet marked, found by Karp-Rabin hashes of windows, is marked again and
again down to ``least`` words. Tiles may come in any order, so reordered passages count. Only the words inside
shared seeds can be in a tile, so only those leave a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bit_sieve, materialize
from ._words import K1, K2, PUNCTUATION, Words, groups, mix, powers, texts_of

LEAST = 5
COVERAGE = 0.5


def words_of(texts: list[bytes]) -> Words:
    return Words([t.decode("utf-8", "replace").lower().encode() for t in texts], parts=PUNCTUATION)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(h) - width + 1] + np.uint64(width))


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, int]:
    """(words of ``item`` in tiles, tiles) by greedy string tiling; 0 in ``doc`` matches nothing."""
    free_i, free_d = np.ones(len(item), bool), doc != 0
    marked = tiles = 0

    def open_windows(free: np.ndarray, s: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[s:] == taken[:-s])

    def common(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        a, b = open_windows(free_i, s), open_windows(free_d, s)
        if not len(a) or not len(b):
            return None
        ha, hb = windows(item, s)[a], windows(doc, s)[b]
        hit = np.isin(ha, hb)
        return (a[hit], ha[hit], b, hb) if hit.any() else None

    longest = min(len(item), len(doc))
    while longest >= least:
        low, high, found = least - 1, longest, None
        while low < high:  # the longest match not yet marked; a match of s words has matches of fewer
            s = (low + high + 1) // 2
            if (got := common(s)) is not None:
                low, found = s, got
            else:
                high = s - 1
        if found is None:
            break
        a, ha, b, hb = found
        order = np.argsort(hb, kind="stable")
        hb, b = hb[order], b[order]
        for i, lo, hi in zip(a, np.searchsorted(hb, ha), np.searchsorted(hb, ha, "right"), strict=True):
            if not free_i[i : i + low].all():
                continue
            for j in b[lo:hi]:
                if free_d[j : j + low].all():
                    free_i[i : i + low] = False
                    free_d[j : j + low] = False
                    marked += low
                    tiles += 1
                    break
        longest = low
    return marked, tiles


def _items(benchmark: DataFrame, least: int) -> DataFrame:
    """(item, item_id, n, width, words, seeds) of the distinct item texts; item is the text's hash, item_id the least id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(2))
            out = []
            for t in texts:
                h = words_of([t]).hash
                width = min(least, len(h))
                out.append((len(h), width, h.view(np.int64), windows(h, width).view(np.int64) if width else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.int64()))],
                ["item", "item_id", "n", "width", "words", "seeds"],
            )

    one = benchmark.select(F.xxhash64("text").alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").groupBy("item").agg(F.min("item_id").alias("item_id"), F.first("text").alias("text"))
    return materialize(one.mapInArrow(rows, "item long, item_id long, n long, width long, words array<long>, seeds array<long>").where("n > 0"))


def _shared_runs(docs: DataFrame, marks, widths: list[int]) -> DataFrame:
    """(t, runs, seeds) of the texts with a marked seed: their words inside such seeds, 0 between the runs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            ts = b.column(0).to_numpy()
            out = []
            for i, j in groups(texts):
                w = words_of(texts[i:j])
                cover = np.zeros(len(w.hash) + 1, np.int64)
                found = []
                for width in widths:
                    h = windows(w.hash, width)
                    at = np.flatnonzero(marks.value.has(h) & (w.doc[: len(h)] == w.doc[width - 1 :][: len(h)])) if len(h) else np.zeros(0, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    found.append((w.doc[at], h[at]))
                inside = np.cumsum(cover[:-1]) > 0
                d, h = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                if not len(d):
                    continue
                bounds = np.searchsorted(w.doc, np.arange(j - i + 1))
                for k in np.unique(d):
                    lo, hi = bounds[k], bounds[k + 1]
                    on = inside[lo:hi]
                    first = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
                    runs = np.insert(w.hash[lo:hi][on], np.cumsum(on)[first] - 1, np.uint64(0))
                    out.append((ts[i + k], runs.view(np.int64), np.unique(h[d == k]).view(np.int64)))
            if out:
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], longs), pa.array([o[2] for o in out], longs)], ["t", "runs", "seeds"])

    return docs.select(F.xxhash64("text").alias("t"), "text").mapInArrow(rows, "t long, runs array<long>, seeds array<long>")


def _rare(seeds: DataFrame, held: DataFrame, coverage: float) -> DataFrame:
    """(h, item): the rarest seeds of each item, of which a text that tiles enough of it has one.

    Tiles of ``coverage`` need a number of the item's seeds; the most frequent ones that together are fewer than that
    are left out, so that a phrase of many texts and many items doesn't bring all of these together.
    """
    often = held.groupBy("h").agg(F.count("*").alias("df"))
    each = seeds.groupBy("item", "h").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("width").alias("width"))
    ranked = each.join(often, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    upto = F.sum("m").over(Window.partitionBy("item").orderBy(F.desc("df"), "h"))
    return ranked.withColumn("upto", upto).where(F.col("upto") * F.col("width") >= coverage * F.col("n")).select("h", "item")


def tilings(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """(t, item_id, n_words, coverage, tiles): texts, by their xxhash64 ``t``, and items of which they tile enough."""
    spark = docs.sparkSession
    items = _items(benchmark, least)
    widths = [r.width for r in items.select("width").distinct().collect()] or [least]  # 1 to ``least``
    seeds = materialize(items.select("item", "n", "width", F.explode("seeds").alias("h")))
    marks = spark.sparkContext.broadcast(bit_sieve(seeds))
    texts = materialize(_shared_runs(docs, marks, widths)).groupBy("t").agg(F.first("runs").alias("runs"), F.first("seeds").alias("seeds"))
    texts = materialize(texts)
    held = texts.select("t", F.explode("seeds").alias("h"))
    hits = held.join(_rare(seeds, held, coverage), "h").select("t", "item").distinct()
    # How many of an item's seeds a text has, those that the item repeats counted as all there.
    shared = F.size(F.array_intersect("seeds", "own")) + F.size("seeds") - F.size(F.array_distinct("seeds"))
    both = hits.join(items.select("item", "item_id", "n", "width", "words", "seeds"), "item").join(texts.select("t", "runs", F.col("seeds").alias("own")), "t")
    both = both.where(shared * F.col("width") >= coverage * F.col("n"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, item_id, n, width, words, runs in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4), b.column(5), strict=True):
                marked, tiles = tile(words.values.to_numpy().view(np.uint64), runs.values.to_numpy().view(np.uint64), width)
                if marked >= coverage * n:
                    out.append((t, item_id, n, marked / n, tiles))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "item_id", "n_words", "coverage", "tiles"])

    return both.select("t", "item_id", "n", "width", "words", "runs").mapInArrow(rows, "t long, item_id long, n_words long, coverage double, tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, n_words, coverage, tiles): each document and each item of which its tiles cover ``coverage`` or more.

    Of equally long matches the one earliest in the item and then in the document is marked first. Texts are read
    whole, however long; what leaves a task are the words inside seeds. Items of fewer than ``least`` words must be found as they are; items without words match nothing, and items of
    equal text are one with the least id. Null and empty texts hold nothing. Rows that repeat are reported each,
    null ids included. Columns other than doc_id and text, item_id and text are not read. Without documents or
    items there are no rows.
    """
    found = materialize(tilings(docs, benchmark, least, coverage))
    return docs.select("doc_id", F.xxhash64("text").alias("t")).join(found, "t").drop("t")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that ``contaminated`` reports; columns and all other rows as they are."""
    found = materialize(tilings(docs, benchmark, least, coverage).select("t").distinct())
    return docs.join(found, F.xxhash64(docs["text"]) == found["t"], "left_anti")
