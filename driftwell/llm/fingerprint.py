"""Document fingerprints (operator 8): a locality-sensitive digest of bucket quartiles.

Byte triplets inside a sliding window are hashed into buckets; every bucket's count is written as its quartile, two
bits, before a check byte and the logarithm of the length. Digests are compared by a difference score that is 0 for
equal digests and bounded by MOST.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import PIECE, texts_of

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places in a window of four bytes
LENGTH_STEP = np.log(1.2)
LENGTH_MOST = 24
FAR = 6  # difference of a bucket in the lowest quartile and one in the highest
MOST = BUCKETS * FAR + LENGTH_MOST + 1
PART_BYTES = 64 << 20  # text of a bucket of neighbouring ids
MOST_PARTS = 10_000  # buckets; beyond 640 GB of text they grow


def bucket_counts(text: bytes) -> np.ndarray:
    """Triplets of the whole text by bucket; long texts are counted in pieces that overlap by a window."""
    out = np.zeros(BUCKETS, np.int64)
    if len(text) < 4:
        if text:
            out += np.bincount([int.from_bytes(text, "little") * 0x9E3779B1 % (1 << 32) >> 24], minlength=BUCKETS)
        return out
    all_bytes = np.frombuffer(text, np.uint8)
    for start in range(0, len(text) - 3, PIECE):
        b = all_bytes[start : start + PIECE + 3].astype(np.uint32)
        n = len(b) - 3
        for salt, (i, j, k) in enumerate(TRIPLETS):
            h = (b[i : i + n] | b[j : j + n] << np.uint32(8) | b[k : k + n] << np.uint32(16)) + np.uint32(salt << 24)
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def fingerprint(text: bytes) -> bytes:
    """66 bytes: check byte of the counts, length step, quartiles of the buckets."""
    c = bucket_counts(text)
    q = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (c[:, None] > q[None, :]).sum(axis=1).astype(np.uint8)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    check = int((c * np.arange(1, BUCKETS + 1)).sum() * 0x9E3779B1 >> 8) & 255
    length = min(255, round(np.log1p(len(text)) / LENGTH_STEP))
    return bytes([check, length]) + packed.tobytes()


def _codes(digest: bytes) -> np.ndarray:
    packed = np.frombuffer(digest, np.uint8)[2:]
    return np.stack([packed & 3, packed >> 2 & 3, packed >> 4 & 3, packed >> 6], 1).ravel().astype(np.int64)


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests down to 0: one less the difference score as a share of MOST."""
    d = np.abs(_codes(a) - _codes(b))
    score = int(np.where(d == 3, FAR, d).sum()) + min(LENGTH_MOST, abs(a[1] - b[1])) + (a[0] != b[0])
    return 1 - score / MOST


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, ahead, ord, text): each of a bucket's own rows meets the next, the last one the row ahead."""
    held: tuple | None = None  # bucket, doc_id, text, whether it has met the row ahead
    rows: list[tuple] = []

    def emit(doc_id: int | None, text: bytes, digest: bytes, following: bytes, next_digest: bytes) -> None:
        t = text.decode()
        edited = edited_text(t, following.decode()).encode()
        other = digest if edited == text else fingerprint(edited)
        rows.append((doc_id, len(t), sha256(edited).hexdigest(), digest.hex(), other.hex(), likeness(digest, other), likeness(digest, next_digest)))

    def batch() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for bucket, ahead, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts_of(b.column(3)), strict=True):
            if held and held[0] == bucket:
                digest = fingerprint(text)
                emit(*held[1:], text, digest)
                held = None if ahead else (bucket, doc_id, text, digest)
            elif not ahead:
                held = (bucket, doc_id, text, fingerprint(text))
            if len(rows) >= 500:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one for each of ``docs``.

    The next document is the one with the next doc_id, after the last the first; rows of one id follow by their
    texts, null ids come first, and a lone row is its own next. Null text is empty. Ids are dealt in ranges to
    ``parts`` buckets (one for each PART_BYTES of text, at least the shuffle partitions) whose bounds are quantiles of
    the ids; the first row of each bucket also goes to the one before, so texts move once and no row needs a global
    order. Rows that share one id are in one bucket, read as a stream. An empty table gives none; columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES))
    low = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("o"))
    quantiles = ids.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []  # parts numbers
    bounds = np.array(sorted(set(quantiles)), np.int64)

    @F.pandas_udf("long")
    def bucket(o: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, o.to_numpy(), "right"))

    firsts = materialize(ids.select("o", bucket("o").alias("b")).groupBy("b").agg(F.min("o").alias("o"))).orderBy("b").collect()  # a row for each bucket
    starts = np.array([r.o for r in firsts], np.int64)
    earlier = np.roll([r.b for r in firsts], 1)

    @F.pandas_udf("array<long>")
    def places(o: pd.Series) -> pd.Series:
        o = o.to_numpy()
        own = np.searchsorted(bounds, o, "right")
        k = np.minimum(np.searchsorted(starts, o), len(starts) - 1)
        return pd.Series([[b, earlier[i]] if first else [b] for b, i, first in zip(own, k, starts[k] == o, strict=True)])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("o"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.select(F.posexplode(places("o")).alias("ahead", "b"), "o", "doc_id", "text")
    dealt = dealt.repartitionByRange(parts, "b").sortWithinPartitions("b", "ahead", "o", "text").select("b", "ahead", "doc_id", "text")
    return dealt.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
