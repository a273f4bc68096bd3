"""Ranked lexical search (operator 13): exact best documents through range-maximum tables over posting lists.

The texts are read once: each document's counts of the queries' terms are written as a table, from which come the
statistics and the postings. A task turns blocks of documents into posting lists by term, each with a sparse table of
the places of its greatest impacts. A query starts with the whole block as one interval of documents; the greatest
impacts of its terms inside an interval, summed, bound every document there. The intervals of the highest bounds are
split first, at the document of the greatest impact, which is scored; those whose bound is under the k-th best score
so far are never looked into. Short intervals are scored document by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import PUNCTUATION, Words, groups, texts_of

QUERY_BYTES = 8 << 20  # text of the queries that are worked on at a time
BLOCK_POSTINGS, BLOCK_DOCS = 400_000, 50_000  # of which a task makes one block
SHORT = 16  # documents of an interval that isn't split any more
AT_ONCE = 64  # intervals of a query that are split together
SALT = 64  # groups in which a query's results of all tasks meet first


class Queries:
    """The terms of a block of queries: ``terms`` sorted; of query q the term places ``of[q]`` and their numbers ``times[q]``."""

    def __init__(self, texts: list[str | None]):
        w = Words([(t or "").encode() for t in texts], parts=PUNCTUATION)
        self.terms = np.unique(w.hash)
        place = np.searchsorted(self.terms, w.hash)
        self.of, self.times = [], []
        for q in np.split(place, np.cumsum(np.bincount(w.doc, minlength=len(texts)))[:-1]):
            t, c = np.unique(q, return_counts=True)
            self.of.append(t)
            self.times.append(c)
        self.mask = np.zeros(1 << 20, bool)  # most terms of the documents are told to be no query's by their low bits
        self.mask[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms, and their places."""
        at = np.flatnonzero(self.mask[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.terms, h[at])
        hit = self.terms[np.minimum(place, len(self.terms) - 1)] == h[at] if len(self.terms) else np.zeros(0, bool)
        return at[hit], place[hit]


def term_counts(docs: DataFrame, queries) -> DataFrame:
    """(doc_id, n, t, tf) of each document with a term: how many terms it has with repeats, and those of the queries with their numbers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in groups(texts):
                w = Words(texts[i:j], parts=PUNCTUATION)
                n = np.bincount(w.doc, minlength=j - i)
                at, place = asked.find(w.hash)
                key, tf = np.unique(w.doc[at] * len(asked.terms) + place, return_counts=True)
                doc, t = np.divmod(key, max(1, len(asked.terms)))
                offsets = pa.array(np.searchsorted(doc, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (t, tf)]
                out = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "t", "tf"])
                yield out.filter(pa.array(n > 0))

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, t array<int>, tf array<int>")


class Block:
    """Posting lists of a few documents, one after the other by term, with a sparse table over their impacts."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, m: np.ndarray, doc: np.ndarray, t: np.ndarray, tf: np.ndarray, n_terms: int):
        # Documents of like length stand together: their impacts are alike, which makes bounds of intervals tight.
        order = np.argsort(m, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids, self.known, doc = ids[order], known[order], place[doc]
        by = np.lexsort((doc, t))
        self.doc, t, tf = doc[by], t[by], tf[by].astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[order][self.doc])
        self.start = np.searchsorted(t, np.arange(n_terms + 1))
        longest = int(np.diff(self.start).max(initial=0))
        table = np.arange(len(t), dtype=np.int32)
        self.levels = [table]
        # Runs that reach into the next term's list are filled too but never asked for.
        for k in range(max(0, longest.bit_length() - 1)):
            left, right = table[: -(1 << k)], table[1 << k :]
            table = np.where(self.impact[left] >= self.impact[right], left, right)
            self.levels.append(table)
        self.size = np.array([len(x) for x in self.levels])
        self.flat = np.concatenate(self.levels)
        self.offset = np.cumsum(self.size) - self.size

    def greatest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Place of the greatest impact among postings lo to hi - 1, -1 for none: two overlapping runs of the sparse table."""
        n = hi - lo
        k = np.frexp(np.maximum(n, 1))[1] - 1
        left = self.flat[np.where(n > 0, self.offset[k] + lo, 0)]
        right = self.flat[np.where(n > 0, self.offset[k] + hi - (1 << k), 0)]
        return np.where(n > 0, np.where(self.impact[left] >= self.impact[right], left, right), -1)


class Best:
    """The k best (score, id) of a query so far: higher scores first, equal ones by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.known = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        some = score > 0 if len(self.score) < self.k else score >= self.score[-1]
        if some.any():
            s, i, n = (np.concatenate([x, y[some]]) for x, y in ((self.score, score), (self.id, ids), (self.known, known)))
            top = np.lexsort((i, ~n, -s))[: self.k]
            self.score, self.id, self.known = s[top], i[top], n[top]

    def least(self) -> int:
        """A bound under this can't change the result."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1


def search(block: Block, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the block's documents that are among the query's best; gives the number of splits."""
    starts, stops = block.start[terms], block.start[terms + 1]
    some = (stops > starts) & (weights > 0)
    starts, stops, weights = starts[some], stops[some], weights[some]
    if not len(starts):
        return 0
    end = len(block.ids)
    lo, hi, at, to = np.array([0]), np.array([end]), starts[None], stops[None]
    top = block.greatest(at, to)
    value = np.where(top >= 0, block.impact[top], 0) * weights
    bound, splits = value.sum(1), 0
    while len(lo):
        alive = bound >= best.least()
        lo, hi, at, to, top, value, bound = (x[alive] for x in (lo, hi, at, to, top, value, bound))
        if not len(lo):
            break
        take = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
        rest = np.ones(len(lo), bool)
        rest[take] = False
        short = take[hi[take] - lo[take] <= SHORT]
        if len(short):
            n = (to - at)[short]
            run = np.repeat(np.arange(n.size), n.ravel())
            posting = np.arange(len(run)) - np.repeat(np.cumsum(n) - n.ravel(), n.ravel()) + at[short].ravel()[run]
            doc, which = np.unique(block.doc[posting], return_inverse=True)
            score = np.zeros(len(doc), np.int64)
            np.add.at(score, which, block.impact[posting] * np.broadcast_to(weights, n.shape).ravel()[run])
            best.add(score, block.ids[doc], block.known[doc])
        wide = take[hi[take] - lo[take] > SHORT]
        if len(wide):
            splits += len(wide)
            doc = block.doc[top[wide, value[wide].argmax(1)]]
            # The postings of an interval are in order of document, so a step of halves finds the document's place in each list.
            low, high = at[wide].copy(), to[wide].copy()
            while (open_ := low < high).any():
                mid = (low + high) // 2
                right = open_ & (block.doc[np.minimum(mid, len(block.doc) - 1)] < doc[:, None])
                low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
            hit = (low < to[wide]) & (block.doc[np.minimum(low, len(block.doc) - 1)] == doc[:, None])
            score = (np.where(hit, block.impact[np.minimum(low, len(block.doc) - 1)], 0) * weights).sum(1)
            best.add(score, block.ids[doc], block.known[doc])
            halves = (lo[wide], doc, at[wide], low), (doc + 1, hi[wide], low + hit, to[wide])
            lo2, hi2, at2, to2 = (np.concatenate(x) for x in zip(*halves, strict=True))
            top2 = block.greatest(at2, to2)
            value2 = np.where(top2 >= 0, block.impact[top2], 0) * weights
        else:
            lo2, hi2, at2, to2, top2, value2 = lo[:0], hi[:0], at[:0], to[:0], top[:0], value[:0]
        lo, hi, at, to, top, value = (np.concatenate([x[rest], y]) for x, y in ((lo, lo2), (hi, hi2), (at, at2), (to, to2), (top, top2), (value, value2)))
        bound = value.sum(1)
    return splits


def _blocks(batches: Iterator[pa.RecordBatch], n_terms: int, docs: int, total: int) -> Iterator[Block]:
    held: list[tuple[np.ndarray, ...]] = []
    postings = rows = 0

    def made() -> Block:
        ids, known, n, counts, t, tf = (np.concatenate(x) for x in zip(*held, strict=True))
        most = int(n.max(initial=0))
        share = (25 * n * docs) // total if 25 * most * docs < 1 << 63 else np.array([25 * int(x) * docs // total for x in n], np.int64)
        return Block(ids, known, 75 + share, np.repeat(np.arange(len(n)), counts), t, tf, n_terms)

    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            t, tf = (b.column(k) for k in (2, 3))
            ids = b.column(0)
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), b.column(1).to_numpy(), t.value_lengths().to_numpy(), t.flatten().to_numpy(), tf.flatten().to_numpy()))
            postings, rows = postings + len(held[-1][4]), rows + b.num_rows
            if postings >= BLOCK_POSTINGS or rows >= BLOCK_DOCS:
                yield made()
                held, postings, rows = [], 0, 0
    if held:
        yield made()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 20, item: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each row of ``queries``, equal scores by doc_id.

    Terms are runs of ASCII letters and digits and of other characters than ASCII, in lower case of A-Z alone, over
    whole texts however long. A document's score sums, over the query's terms with repeats, the term's weight
    floor(1000 ln((2N + 2) / (2 df + 1))) times (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L. Every row
    of ``docs`` is a document of its own, repeated ids included; null ids come after all others of the same score.
    Every row of ``queries`` is a query of its own; one without terms, or whose terms no document has, gives none,
    as do empty tables. Other columns are not read.

    Queries are taken in blocks of some QUERY_BYTES of text, so what a task is sent is bounded; each block reads the
    documents once.
    """
    spark = docs.sparkSession
    queries = materialize(queries.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")))
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = None
    for block in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        asked = own.collect()  # a block of bounded size
        found = _search_block(docs, [r.text for r in asked], k)
        names = spark.createDataFrame([(q, r["item"]) for q, r in enumerate(asked)], "q long, item_id long")
        part = found.join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = part if out is None else out.union(part)
    return out


def _search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    queries = Queries(texts)
    sent = sc.broadcast(queries)
    counts = materialize(term_counts(docs, sent))
    n_docs, total = counts.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(queries.terms), np.int64)
    for r in counts.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row for each term of the block of queries
        df[r.t] = r.df
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    stats = sc.broadcast((weights, n_docs, total or 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        asked, (weights, n_docs, total) = sent.value, stats.value
        best = [Best(k) for _ in asked.of]
        for b in _blocks(batches, len(asked.terms), n_docs, total):
            for q, (t, times) in enumerate(zip(asked.of, asked.times, strict=True)):
                search(b, t, weights[t] * times, best[q])
        for q, x in enumerate(best):
            if len(x.id):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x.id), q)), pa.array(x.id, mask=~x.known), pa.array(x.score)], ["q", "doc_id", "score"])

    found = counts.mapInArrow(rows, "q long, doc_id long, score long").withColumn("salt", F.spark_partition_id() % SALT)
    return _ranked(found, k)
