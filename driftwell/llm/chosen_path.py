"""MinHash near-dedup (operator 11): a chosen-path set similarity join.

A document is the set of its distinct word shingles. Independent trees branch the sets: a tree's root deals them by
one minwise token, so that two sets share a node with a probability of their similarity, and a node of many sets
deals them on by further minwise tokens that it chooses by its own hash, two for each node. All pairs of a small
node are compared. With the roots alone, ``trees`` trees miss a pair of similarity s with a probability of
(1 - s) ** trees.

Documents with equal sets are one class. Sets of a large node are first joined to hubs, one for each of a few
orders; nodes whose sets are all in one component need nothing more, and only sets of different components are
compared in the nodes further down. Every candidate pair is verified on whole sets.

Sets that share a long passage and little else stay together on all paths, since their likeness is what the paths
sample. Classes that are in a large node of several components at the last level are few and are joined exactly, by
the rare-first prefix join of operator 10, which such a passage, being frequent, doesn't bring together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, materialize
from ._words import Words, groups, mix, shingles, texts_of
from .jaccard_join import CELLS, _linked, _lists, _sifted, _verify

SMALL = 12  # classes of a node of which all pairs are made
MISS = 1e-8  # how likely the roots of all trees part a pair that is just similar enough
CHOICE, BRANCHES, DEPTH = 4, 2, 3  # minwise tokens a level has, those of them a node takes, levels below the roots
ORDERS = 3  # hubs of a large node's sets differ by tree, in so many orders

#: By the hash alone, without frequencies: the verification's sets need some common order.
NO_RANKS = np.zeros(1 << 16, np.uint8)


def trees_for(similarity: float, miss: float = MISS) -> int:
    """Trees whose roots miss a pair of this similarity with a probability of ``miss`` at most."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


def minwise(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """For each run of hashes, one after the other, ``n`` minwise tokens: the least values under n hash functions, to 32 bits."""
    out = np.empty((len(starts), n), np.int32)
    for k in range(n):
        v = (h ^ mix(np.array([k + 1], np.uint64))[0]) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        out[:, k] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def signatures(docs: DataFrame, width: int, n: int) -> DataFrame:
    """(doc_id, t, n, cls, sig, cells): the text's hash, the set's size, class, minwise tokens and elements by ranges of hashes; sig and cells are empty without shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in groups(texts):
                d, h = shingles(Words(texts[i:j]), j - i, width)
                size = np.bincount(d, minlength=j - i)
                full = np.flatnonzero(size)
                at = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64)
                sums = np.zeros((2, j - i), np.uint64)
                sig = np.zeros((j - i, n), np.int32)
                if len(h):
                    sums[0, full] = np.add.reduceat(mix(h), at)
                    sums[1, full] = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), at)
                    sig[full] = minwise(h, at, n)
                cls = mix(sums[0] + mix(sums[1] + size.astype(np.uint64))).view(np.int64)
                cells = np.minimum(127, np.bincount(d * CELLS + (h >> np.uint64(57)).astype(np.int64), minlength=(j - i) * CELLS)).astype(np.int8)
                row = np.arange(j - i)
                lists = [_lists(x.ravel(), row * w, np.where(size > 0, w, 0)) for x, w in ((sig, n), (cells, CELLS))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(size, pa.int64()), pa.array(cls), *lists], ["doc_id", "t", "n", "cls", "sig", "cells"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(rows, "doc_id long, t long, n long, cls long, sig array<int>, cells array<tinyint>")


def _counted(members: DataFrame) -> DataFrame:
    """``members`` of nodes with two classes or more, with ``c``, how many."""
    counts = members.groupBy("node").agg(F.count("*").alias("c")).where("c > 1")
    return members.join(counts.hint("merge"), "node")


def _pairs(members: DataFrame, at_least: int, of: int, by: str = "node", *more: str) -> DataFrame:
    """(a, b): pairs of classes of one node whose sizes can be similar; ``more``: conditions on x and y."""
    x, y = members.alias("x"), members.alias("y")
    on = (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.cls") < F.col("y.cls")) & (of * F.col("x.n") >= at_least * F.col("y.n")) & (of * F.col("y.n") >= at_least * F.col("x.n"))
    for m in more:
        on &= F.expr(m)
    return x.join(y, on).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _to_hubs(members: DataFrame, at_least: int, of: int) -> DataFrame:
    """(a, b): each class of a node with the node's first class in an order that the tree chooses."""
    place = F.struct(F.xxhash64("cls", F.col("tree") % ORDERS).alias("o"), "n", "cls")
    hubs = members.groupBy("node").agg(F.min(place).alias("hub"))
    fits = (of * F.col("n") >= at_least * F.col("hub.n")) & (of * F.col("hub.n") >= at_least * F.col("n"))
    joined = members.join(hubs, "node").where((F.col("cls") != F.col("hub.cls")) & fits)
    return joined.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")).distinct()


def _apart(members: DataFrame) -> DataFrame:
    """The members of nodes whose classes are in two components or more."""
    split = members.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
    return members.join(split.hint("merge"), "node", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: tuple[int, int] = (80, 100), miss: float = MISS) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Words are lower-cased in A-Z and split at ASCII white space; a text of fewer than ``width`` words is one
    shingle. Two documents link when the intersection of their sets is at least ``similarity`` of the union, tested
    in integers on whole sets, however long the texts; component_id is the smallest doc_id that links reach, and kept
    says that it is the row's own. The join is randomised with fixed hash functions, so reruns agree; a pair is
    missed by all roots with a probability of ``miss`` at most, a pair that shares only large nodes more often.
    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id count as documents of
    their own and are kept or not together; rows with null ids keep null, with kept false, where no link gives one.
    Columns other than doc_id and text are not read. An empty table gives none.
    """
    at_least, of = similarity
    trees = trees_for(at_least / of, miss)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(signatures(docs, width, trees + CHOICE * DEPTH))
    classes = materialize(rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "t")).alias("own"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("cells").alias("cells")))
    known = classes.where(F.col("rep").isNotNull())
    roots = known.select("cls", "n", F.posexplode(F.slice("sig", 1, trees)).alias("tree", "token")).select("cls", "n", "tree", F.xxhash64("tree", "token").alias("node"))
    shared = materialize(_counted(roots))
    ranks = docs.sparkSession.sparkContext.broadcast(NO_RANKS)
    large = shared.where(F.col("c") > SMALL).drop("c")
    first = materialize(_sifted(_pairs(shared.where(F.col("c") <= SMALL), at_least, of).union(_to_hubs(large, at_least, of)).distinct(), classes, of, at_least))
    edges = materialize(_verify(docs, first, classes, width, ranks, of, at_least))
    parts = components(edges)

    members = large.join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    found, left = _descend(materialize(_apart(members)), classes, trees, at_least, of)
    more = []
    if found is not None:
        rest = materialize(_sifted(found.join(first, ["a", "b"], "left_anti"), classes, of, at_least))
        if not rest.isEmpty():
            more.append(materialize(_verify(docs, rest, classes, width, ranks, of, at_least)))
    if left is not None:
        more.append(materialize(_exactly(docs, classes, left, width, similarity)))
    for m in more:
        edges = edges.union(m)
    if more:
        parts = components(edges)

    reps = classes.select("cls", "rep")
    joined = parts.withColumnRenamed("node", "cls").join(reps, "cls")
    least = joined.groupBy("comp").agg(F.min("rep").alias("component_id"))
    linked = joined.join(least, "comp").select("cls", "component_id")
    final = materialize(reps.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id")))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls")).join(final, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _descend(members: DataFrame, classes: DataFrame, trees: int, at_least: int, of: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs (a, b) of different components that small nodes below large ones bring together, and (cls) of those that are in large ones to the end."""
    if members.isEmpty():
        return None, None
    found = None
    for level in range(DEPTH):
        own = classes.select("cls", F.slice("sig", trees + 1 + CHOICE * level, CHOICE).alias("s"))
        first = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(CHOICE))
        chosen = [F.pmod(first + F.lit(k), F.lit(CHOICE)).cast("int") + 1 for k in range(BRANCHES)]
        child = F.explode(F.array(*(F.xxhash64("node", c, F.element_at("s", c)) for c in chosen)))
        dealt = _counted(members.join(own, "cls").select("cls", "n", "comp", child.alias("node")))
        dealt = materialize(_apart(dealt))
        pairs = _pairs(dealt.where(F.col("c") <= SMALL), at_least, of, "node", "x.comp <> y.comp")
        found = pairs if found is None else found.union(pairs)
        members = dealt.where(F.col("c") > SMALL).drop("c")
        if members.isEmpty():
            return found.distinct(), None
    return found.distinct(), materialize(members.select("cls").distinct())


def _exactly(docs: DataFrame, classes: DataFrame, left: DataFrame, width: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) among the classes ``left``, each with the least class of its component, from the texts that stand for them."""
    stand = materialize(classes.join(left, "cls", "left_semi").select("cls", F.col("own.doc_id").alias("id"), F.col("own.t").alias("t")))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = keyed.join(stand, (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("t")), "left_semi").select("doc_id", "text", F.col("h").alias("t"))
    linked = _linked(materialize(texts.dropDuplicates(["doc_id", "t"])), width, similarity).select(F.col("doc_id").alias("id"), "t", "comp")
    return linked.join(stand, ["id", "t"]).where("cls <> comp").select(F.col("cls").alias("a"), F.col("comp").alias("b"))
