"""N-gram Jaccard join (operator 10): prefix filtering with rare shingles first, and length, positional and suffix filters.

A document is the set of its distinct word shingles; sets ordered by (corpus frequency, hash) that are similar share
a shingle in their short prefixes. Frequencies come from a fixed-size counter array over all documents: collisions
touch the order alone, never the result. Documents with equal sets are one class. A prefix shingle of few classes
gives all its pairs; one of many classes first joins each to its hub, the class where the shingle comes earliest
(the least edited), and then only classes that are still in different components. Every candidate pair is verified
once on whole sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bit_sieve, components, materialize, unused
from ._words import Words, groups, mix, shingles, texts_of

BLOCKS = 512
MOST_BITS = 25  # the counters take 32 MB at most
CELLS = 128  # ranges of hashes by which sets are compared before they move
FEW = 8  # classes of a shingle of which all pairs are made at once


def sketch_bits(docs: DataFrame) -> int:
    """Counters, as a power of two, for about one shingle each: an eighth of the texts' bytes, 2**25 at most.

    Beyond some 0.25 GB of text counters are shared; then only shingles clearly more frequent than a counter's mean
    load are told from rare ones, which costs candidates but no result.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(MOST_BITS, max(16, np.ceil(np.log2(size / 8 + 1)))))


def frequency_ranks(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """A byte for each of 2**bits counters: the rounded logarithm of how many documents have a shingle of that counter.

    All documents count; a partition counts to 255, which only the most frequent reach. Partitions send compressed
    blocks of counters, summed as they stream in; 2**bits bytes reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in groups(texts):
                _, h = shingles(Words(texts[i:j]), j - i, width)
                at, c = np.unique((h & np.uint64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
                total[at] = np.minimum(255, total[at] + c)
        parts = [(k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(np.split(total, BLOCKS)) if p.any()]
        for k, p in parts:
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([p], pa.binary())], ["block", "counts"])

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b["block"], b["counts"], strict=True):
                total.setdefault(k, np.zeros((1 << bits) // BLOCKS, np.int64))[:] += np.frombuffer(zlib.decompress(c), np.uint8)
        for k, c in total.items():
            yield pd.DataFrame({"block": [k], "ranks": [np.minimum(255, np.rint(6 * np.log2(c + 1.0))).astype(np.uint8).tobytes()]})

    spark = docs.sparkSession
    n = min(BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("text").mapInArrow(count, "block long, counts binary").repartition(n, "block").mapInPandas(ranked, "block long, ranks binary").collect()
    out = np.zeros(1 << bits, np.uint8)
    size = len(out) // BLOCKS
    for r in rows:
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.ranks, np.uint8)
    return out


def ordered_sets(texts: list[bytes], width: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text its set's size, class and elements in each cell (127 at most), and all sets one after the other, each with rare shingles first."""
    n = len(texts)
    d, h = shingles(Words(texts), n, width)
    size = np.bincount(d, minlength=n)
    key = (ranks[(h & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(55)) | (h >> np.uint64(9))
    sums = np.zeros((2, n), np.uint64)
    full = np.flatnonzero(size)
    if len(h):
        at = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        sums[0, full] = np.add.reduceat(mix(h), at)
        sums[1, full] = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), at)
    cls = mix(sums[0] + mix(sums[1] + size.astype(np.uint64)))
    cells = np.minimum(127, np.bincount(d * CELLS + (h >> np.uint64(57)).astype(np.int64), minlength=n * CELLS)).astype(np.int8)
    return size, cls.view(np.int64), cells, key[np.lexsort((key, d))].view(np.int64)


def _lists(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[index]))


def document_sets(docs: DataFrame, width: int, ranks, of: int, at_least: int, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, cls, s, cells): the set's size and class, its prefix and its elements by cell; with ``wanted``, all of it and no cells.

    wanted: hashes ``h`` of ids; a sieve in the task leaves other documents out, but for a few. A column ``t`` of
    ``docs`` (hash of the text) comes along.
    """
    more = [c for c in docs.columns if c == "t"]
    names = ["doc_id", "n", "cls", "s", "cells", *more]
    marks = None if wanted is None else docs.sparkSession.sparkContext.broadcast(bit_sieve(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if marks is not None:
                b = b.filter(pa.array(marks.value.has(b.column(2).to_numpy())))
            texts = texts_of(b.column(1))
            for i, j in groups(texts):
                size, cls, cells, s = ordered_sets(texts[i:j], width, ranks.value)
                take = np.where(size > 0, size - -(-at_least * size // of) + 1, 0) if marks is None else size
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                held = np.where(size > 0, CELLS, 0) if marks is None else np.zeros(j - i, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(cls), _lists(s, starts, take), _lists(cells, np.arange(j - i) * CELLS, held), *(b.column(3 + k).slice(i, j - i) for k in range(len(more)))], names)

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("key"), *more).mapInArrow(rows, "doc_id long, n long, cls long, s array<long>, cells array<tinyint>" + "".join(f", {c} long" for c in more))


def suffix_bound(x: F.Column, y: F.Column) -> F.Column:
    """At least so many elements are in one of two sorted sets alone: halves of y against the parts of x around its middle."""
    nx, ny = F.size(x), F.size(y)
    left = F.floor(ny / 2).cast("int")
    middle = F.element_at(y, left + 1)
    below = F.size(F.filter(x, lambda v: v < middle))
    hit = F.array_contains(x, middle).cast("int")
    return F.abs(below - left) + F.abs((nx - below - hit) - (ny - left - 1)) + 1 - hit


def _sifted(pairs: DataFrame, classes: DataFrame, of: int, at_least: int) -> DataFrame:
    """Suffix filter over ranges of hashes: sets differ at least by what their cells differ; few others than similar pairs stay."""
    x, y = (classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")
    both = F.col("na") + F.col("nb")
    apart = F.aggregate(F.zip_with("ca", "cb", lambda p, q: F.abs(p.cast("int") - q.cast("int"))), F.lit(0), lambda s, v: s + v)
    return pairs.join(x, "a").join(y, "b").where((of + at_least) * apart <= (of - at_least) * both).select("a", "b")


def _verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, ranks, of: int, at_least: int) -> DataFrame:
    """The pairs of classes (a, b) whose whole sets are similar. Only documents that stand for such a class are read again."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = materialize(classes.join(wanted, "cls", "left_semi").select("cls", F.xxhash64("rep").alias("h")))
    # A class may come twice, from rows that repeat an id, or unasked, from the sieve; neither makes a wrong edge. The
    # exchange of the sets serves both joins, and with nothing between it and them a hub's pairs can be split.
    sets = document_sets(docs, width, ranks, of, at_least, wanted)
    left, right = (sets.select(F.col("cls").alias(c), F.col("s").alias(f"s{c}")).hint("merge") for c in "ab")
    joined = pairs.join(left, "a").join(right, "b")
    both = F.size("sa") + F.size("sb")
    near = (of + at_least) * (both - suffix_bound(F.col("sa"), F.col("sb"))) >= 2 * at_least * both
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.where(near & (of * common >= at_least * (both - common))).select("a", "b")


def _similar(of: int, at_least: int, x: str, y: str) -> F.Column:
    """Length and positional filter of two entries (cls, n, pos) of one shingle."""
    nx, ny, px, py = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    fits = (of * nx >= at_least * ny) & (of * ny >= at_least * nx)
    return fits & ((of + at_least) * F.least(nx - px, ny - py) >= at_least * (nx + ny))


def link_documents(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of ``docs``.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than ``width`` words is one
    shingle. Two documents link when the intersection of their sets is at least ``similarity`` of the union, tested
    in integers; component_id is the smallest doc_id that links reach. Null, empty and blank texts have no shingles
    and link with nothing. Rows that repeat an id count as documents of their own; a set that only documents with
    null ids have links with no other. Columns other than doc_id and text are not read. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _linked(docs, width, similarity).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Rows of ``link_documents`` with ``comp``, the component itself (an id may be in several), and ``t`` where ``docs`` has it."""
    at_least, of = similarity
    ranks = docs.sparkSession.sparkContext.broadcast(frequency_ranks(docs, width, sketch_bits(docs)))
    sets = materialize(document_sets(docs, width, ranks, of, at_least))
    classes = materialize(sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("s").alias("s"), F.first("cells").alias("cells")))
    entries = classes.where(F.col("rep").isNotNull()).select("cls", "n", F.posexplode("s").alias("pos", "k"))
    counts = entries.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    shared = materialize(entries.join(counts.hint("merge"), "k").select("k", "cls", "n", "pos", "c"))

    def pairs(x: DataFrame, y: DataFrame, *more: F.Column) -> DataFrame:
        on = (F.col("x.k") == F.col("y.k")) & (F.col("x.cls") < F.col("y.cls")) & _similar(of, at_least, "x", "y")
        for m in more:
            on &= m
        return x.alias("x").join(y.alias("y"), on).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()

    few, many = shared.where(F.col("c") <= FEW).drop("c"), shared.where(F.col("c") > FEW).drop("c")
    place = F.struct("pos", "n", "cls")
    hubs = many.groupBy("k").agg(F.min(place).alias("hub"))
    to_hub = many.join(hubs, "k").select(place.alias("me"), "hub").where((F.col("me.cls") != F.col("hub.cls")) & _similar(of, at_least, "me", "hub"))
    to_hub = to_hub.select(F.least("me.cls", "hub.cls").alias("a"), F.greatest("me.cls", "hub.cls").alias("b"))
    first = materialize(_sifted(pairs(few, few).union(to_hub).distinct(), classes, of, at_least))
    edges = materialize(_verify(docs, first, classes, width, ranks, of, at_least))
    parts = components(edges)
    many = materialize(many.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    split = many.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k")
    many = materialize(many.join(split, "k", "left_semi").withColumn("band", F.floor(F.log("n") / max(1.0001 * math.log(of / at_least), 1e-6)).cast("long")))
    # Similar sets are in one band of sizes or in neighbouring ones: bands split what a frequent shingle brings together.
    near = many.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    rest = pairs(near, many, F.col("x.band") == F.col("y.band"), F.col("x.comp") != F.col("y.comp")).join(first, ["a", "b"], "left_anti")
    rest = materialize(_sifted(rest, classes, of, at_least))
    if not rest.isEmpty():
        more = materialize(_verify(docs, rest, classes, width, ranks, of, at_least))
        parts = components(edges.union(more))
    reps = classes.select("cls", "rep")
    joined = parts.withColumnRenamed("node", "cls").join(reps, "cls")
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    linked = joined.select("cls", "comp").join(least, "comp").select("cls", "comp", "component_id")
    final = materialize(reps.join(linked, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), F.coalesce("component_id", "rep").alias("component_id")))
    more = [c for c in sets.columns if c == "t"]
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"), *more)
    return out.join(final, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "comp", *more)


def one_of_each(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each component of ``link_documents``, that with the smallest id; columns as they are.

    A document is its id and the xxhash64 of its text, so rows that share an id stay or go each by its own text; of
    several texts of the smallest id in one component that with the smallest hash stays. Rows equal in id and text
    are one document and stay once. Documents without shingles all stay, and so do those with null ids unless their
    set has an id elsewhere.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    several = not repeated.isEmpty()
    if several:
        docs = materialize(docs.dropDuplicates(["doc_id", "text"]))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    linked = _linked(keyed, width, similarity)
    if several:
        linked = materialize(linked)
    ident, text = unused(docs, "_id", "_t")
    gone = linked.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(ident), F.col("t").alias(text))
    if several:
        own = linked.where((F.col("doc_id") == F.col("component_id")) & F.col("comp").isNotNull())
        least = own.groupBy("comp").agg(F.min("t").alias("least"), F.count("*").alias("c")).where("c > 1")
        gone = gone.union(own.join(least, "comp").where("t <> least").select("doc_id", "t"))
    gone = materialize(gone.distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(docs["text"]) == F.col(text)), "left_anti")
