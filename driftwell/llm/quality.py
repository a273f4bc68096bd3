"""Quality classifier (operator 9): regularised quadratic discriminant over document statistics.

One pass over the texts makes a short vector for each document; class counts, sums and outer products are summed in
the partitions and then together, so training sees every labelled row and the driver only d x d numbers. The score
is the posterior from Mahalanobis log-density differences with Cholesky factors made once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import Words, groups, mix, texts_of

FEATURES = (
    "log_words", "word_length", "upper", "digit", "mark", "stop", "other_ascii", "non_ascii", "distinct", "adjacent", "bigrams", "lines", "long_words", "longest_line",
)

_KIND = np.zeros(256, np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (".,", 4), ("!?;:'\"()-", 5)):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[[32, 9, 10, 11, 12, 13]] = 6
_KIND[128:] = 7


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Variance-stabilised share; nothing of nothing is 0."""
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text, from its whole bytes; an empty text has zeros."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    kinds = np.zeros((n, 8))
    breaks, longest = np.zeros(n), np.zeros(n)
    for i, t in enumerate(texts):
        buf = np.frombuffer(t, np.uint8)
        kinds[i] = np.bincount(_KIND[buf], minlength=8)
        at = np.flatnonzero(buf == 10)
        breaks[i] = len(at)
        longest[i] = np.diff(np.concatenate([[-1], at, [len(buf)]])).max() - 1
    w = Words(texts)
    words = np.bincount(w.doc, minlength=n).astype(float)
    same = w.doc[1:] == w.doc[:-1]
    adjacent = np.bincount(w.doc[1:][same & (w.hash[1:] == w.hash[:-1])], minlength=n)
    two = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[same]

    def distinct(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        if not len(h):
            return np.zeros(n)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n).astype(float)

    letters = kinds[:, 1] + kinds[:, 2]
    black = size - kinds[:, 6]
    per_word = black / np.maximum(words, 1)
    types = distinct(w.hash, w.doc)
    return np.column_stack([
        np.log1p(words), np.log1p(per_word), _share(kinds[:, 2], letters), _share(kinds[:, 3], black), _share(kinds[:, 5], black), _share(kinds[:, 4], words), _share(kinds[:, 0], black), _share(kinds[:, 7], black),
        np.log1p(types) / np.log1p(np.maximum(words, 1)) * (words > 0), _share(adjacent, words - 1), _share(distinct(two, w.doc[1:][same]), words - 1), _share(breaks, words), np.log1p(np.maximum(0, per_word - 8)), np.log1p(longest / np.maximum(size, 1)),
    ])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = texts_of(b.column(1))
        for i, j in groups(texts):
            x = features(texts[i:j])
            f = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), f], ["doc_id", "f"])


def document_vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, f) of every document; written once, as training and scoring both read it."""
    return materialize(docs.select("doc_id", "text").mapInArrow(_vectors, "doc_id long, f array<double>"))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(FEATURES)
    total = {}
    for b in batches:
        for k, g in b.groupby("label"):
            x = np.stack(g["f"].to_numpy())
            x1 = np.column_stack([np.ones(len(x)), x])
            total[k] = total.get(k, np.zeros((d + 1, d + 1))) + x1.T @ x1
    for k, m in total.items():
        yield pd.DataFrame({"label": int(k), "at": np.arange(m.size), "v": m.ravel()})


def fit(vectors: DataFrame, labels: DataFrame, own: float = 0.5, round_share: float = 0.05) -> dict | None:
    """Train on rows (doc_id, label in 0, 1): moments of all of them, covariances shrunk towards the pooled one and a sphere.

    A document with labels that differ is left out; one labelled twice alike counts once. Without both classes
    there is no model (None).
    """
    one = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    rows = vectors.join(one.select("doc_id", "label"), "doc_id").select("label", "f")
    sums = rows.mapInPandas(_moments, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()  # 2 (d + 1)**2 numbers
    d = len(FEATURES)
    m = {k: np.zeros((d + 1, d + 1)) for k in (0, 1)}
    for r in sums:
        m[r.label].flat[r["at"]] = r.v
    if min(m[0][0, 0], m[1][0, 0]) < 2:
        return None
    n = {k: m[k][0, 0] for k in m}
    mean = {k: m[k][0, 1:] / n[k] for k in m}
    cov = {k: m[k][1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k in m}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # shrink in units of the pooled deviations
    model = {"scale": scale, "prior": np.log(n[1] / n[0])}
    for k in m:
        c = own * cov[k] + (1 - own - round_share) * pooled
        c = c / np.outer(scale, scale) + (round_share + 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(c)
        model[k] = (mean[k] / scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())
    return model


def posterior(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    x = x / model["scale"]
    density = [-0.5 * ((((x - mean) @ inv.T) ** 2).sum(axis=1) + logdet) for mean, inv, logdet in (model[0], model[1])]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + model["prior"], -700, 700)))


def score(vectors: DataFrame, model: dict | None) -> DataFrame:
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": posterior(model, np.stack(b["f"].to_numpy()))})

    schema = "doc_id long, score double"
    return vectors.mapInPandas(scored, schema) if model else vectors.select("doc_id", F.lit(0.5).alias("score"))


def held_out() -> F.Column:
    """Rows whose labels are never learned from: crc32(doc_id as text) mod 3 is 1; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame, own: float = 0.5, round_share: float = 0.05) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of ``docs``.

    Learns ``labels.quality`` of documents that are not held out. Null and empty texts are scored like any other
    (all statistics are 0); labels other than 0 and 1, null ids and documents with labels that differ teach
    nothing; with fewer than two documents of a class every score is 0.5. Only doc_id, text and quality are read,
    so other columns do no harm. Repeated rows are scored each.
    """
    vectors = document_vectors(docs)
    model = fit(vectors, labels.select("doc_id", F.col("quality").alias("label")).where(~held_out()), own, round_share)
    return score(vectors, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, own: float = 0.5, round_share: float = 0.05) -> DataFrame:
    """``docs`` without those whose score is under 0.5; columns as they are, and every row judged by its own text.

    Trained as in ``classify``, on the labelled documents of ``docs``. Only the short vectors meet the labels and the
    score is a column expression of the text, so no join moves the texts.
    """
    labels = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    model = fit(document_vectors(docs), labels, own, round_share)
    if model is None:
        return docs

    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        texts = [(t or "").encode() for t in text]
        parts = [posterior(model, features(texts[i:j])) for i, j in groups(texts)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(good(F.col("text")) >= 0.5)
