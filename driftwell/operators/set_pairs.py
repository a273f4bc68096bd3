"""Candidates for similar sets of two sides, by parts of the sets that must be equal.

Sets of a Jaccard similarity of ``least`` differ in a bounded number of elements, d of them for their sizes. Dealt by
hash into d + 1 parts, they are equal in one part at least, and few others are: a part holds several elements. Pairs
that meet so are sifted by the parity of 256 counters, which can't differ in more places than the sets in elements.

A set is given as an array of distinct longs or as a text, whose distinct character 4-grams are meant; these are made
in the tasks and never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

ROWS, BITS = 1000, 256  # sets that are dealt at a time, counters of a sketch
SKETCH = [f"p{i}" for i in range(BITS // 64)]
BLOCKS, SIEVE_BITS = 64, 29  # a sieve has 2**29 bits, 64 MB, at most
HELD = 1 << 18  # keys whose marks a task hands on at a time


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct character 4-grams of texts, in order; a shorter text is one, an empty none."""
    own = texts.to_pylist()
    n = np.array([len(x) for x in own], np.int64)
    code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    code = np.concatenate([code, np.zeros(3, np.uint64)])
    row = np.repeat(np.arange(len(n)), n)
    left = (np.cumsum(n))[row] - np.arange(len(row))  # characters from here to the text's end
    at = np.nonzero((left >= 4) | (left == n[row]))[0]
    row, left = row[at], left[at]
    one, two, three = (np.where(left > k, code[at + k], np.uint64(0)) for k in (1, 2, 3))
    h = _mix(_mix(code[at] << np.uint64(32) | one, 6) + (two << np.uint64(32) | three), 7)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def parity(row: np.ndarray, h: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Parity of each set's elements in each of so many counters, one row of 0 and 1 for each set."""
    return (np.bincount(row * bits + (_mix(h, 1) % np.uint64(bits)).astype(np.int64), minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)


def _elements(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if pa.types.is_string(sets.type) or pa.types.is_large_string(sets.type):
        return grams(sets)
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(n)), n), sets.flatten().to_numpy().view(np.uint64)


def _size(rows: DataFrame) -> Column:
    return F.length("g") if dict(rows.dtypes)["g"] == "string" else F.size("g")


class _Sieve:
    """A bit for each value of a key's low bits; ``has`` says whether a key may be among those marked."""

    def __init__(self, bits: int, marks: np.ndarray):
        self.mask, self.marks = np.uint64((1 << bits) - 1), marks

    def has(self, k: np.ndarray) -> np.ndarray:
        at = k.view(np.uint64) & self.mask
        return (self.marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def _sieve(keys: DataFrame, wanted: int) -> Broadcast:
    """A ``_Sieve`` of keys, one column of longs, with sixteen bits for each of some ``wanted`` ones, in all 8 KB to 64 MB; a key is moved as four bytes.

    It holds back what can't be joined and changes no result. From 2**27 keys on more than a fifth of the rest passes.
    """
    bits = int(min(SIEVE_BITS, max(16, np.ceil(np.log2(16 * max(1, wanted))))))
    size = (1 << bits) // BLOCKS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def handed() -> pa.RecordBatch:
            at = np.unique(np.concatenate(held))
            cut = np.searchsorted(at, np.arange(BLOCKS + 1) * size)
            held.clear()
            own = [(at[a:b] - k * size).astype(np.uint32).tobytes() for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS)), pa.array(own, pa.binary())], ["block", "at"])

        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64))
            if sum(map(len, held)) >= HELD:
                yield handed()
        if held:
            yield handed()

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for k, at in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blocks.setdefault(k, np.zeros(size, bool))[np.frombuffer(at.as_buffer(), np.uint32)] = True
        for k, m in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["block", "m"])

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in keys.mapInArrow(places, "block long, at binary").repartition(BLOCKS, "block").mapInArrow(marks, "block long, m binary").collect():  # 64 rows
        out[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.m, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(_Sieve(bits, out))


def _dealt(rows: DataFrame, least: float, around: tuple[int, ...], sieve: Broadcast | None = None) -> DataFrame:
    """(id, n, p.., k) of rows (id, kind, g): a row for each part of a set, for its band of sizes and those ``around``; with ``sieve``, of the keys it lets pass."""
    low = least - 1e-6  # so that rounding takes no pair apart

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                row, h = _elements(b.column(2))
                n = np.bincount(row, minlength=b.num_rows)
                kind = b.column(1).to_numpy().view(np.uint64)
                sketch = np.packbits(parity(row, h, len(n), BITS), axis=1).view(np.int64)
                band = np.floor(np.log(np.maximum(n, 1)) / -np.log(low)).astype(np.int64)
                for step in around:
                    label = band + step
                    parts = np.floor((1 - low) * low ** -(label + 2.0) + 1e-6).astype(np.int64) + 1
                    first = np.cumsum(parts) - parts
                    total = np.zeros(parts.sum(), np.uint64)
                    np.add.at(total, first[row] + (_mix(h, 2) % parts[row].astype(np.uint64)).astype(np.int64), _mix(h, 3))
                    own = np.repeat(np.arange(len(n)), parts)
                    part = np.arange(len(own)) - first[own]
                    k = _mix(_mix(total + _mix(((label[own] + 8) << 32 | part).astype(np.uint64), 4), 5) ^ kind[own], 8).view(np.int64)
                    if sieve is not None:
                        some = sieve.value.has(k)
                        own, k = own[some], k[some]
                    cols = [b.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32)), *(pa.array(sketch[own, i]) for i in range(len(SKETCH))), pa.array(k)]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "n", *SKETCH, "k"])

    return rows.select("id", F.xxhash64("kind").alias("kind"), "g").mapInArrow(deal, f"id long, n int, {', '.join(f'{p} long' for p in SKETCH)}, k long")


def candidates(new: DataFrame, old: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of a row of new and one of old (id, kind, g), of one kind, whose sets may have a Jaccard similarity of ``least`` or more; empty sets have none.

    Parts move only if a sieve of the other side's lets them pass, so what moves grows with the rows that have a
    likeness, not with the parts of all.
    """
    low = least - 1e-6
    new, old = (rows.where(_size(rows) > 0) for rows in (new, old))
    parts = new.agg(F.sum(3 * (1 + (1 - low) / low**2 * _size(new)))).first()[0] or 0
    sieve = _sieve(_dealt(new, least, (-1, 0, 1)).select("k"), int(parts))
    y = materialize(_dealt(old, least, (0,), sieve))
    sieve.destroy()
    x = _dealt(new, least, (-1, 0, 1), _sieve(y.select("k"), y.count())).alias("x")
    y = y.alias("y")
    m, n = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in SKETCH), F.lit(0))
    near = (m >= low * n) & (n >= low * m) & (apart <= (1 - low) / (1 + low) * (m + n))
    return x.join(y, (F.col("x.k") == F.col("y.k")) & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def likeness(pairs: DataFrame, one: str, other: str, name: str) -> DataFrame:
    """``pairs`` with ``name``, the Jaccard similarity of the character 4-grams of two texts, in place of these."""
    kept = [(c, t) for c, t in pairs.dtypes if c not in (one, other)]

    def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                row, h = (np.concatenate(x) for x in zip(grams(b.column(one)), grams(b.column(other)), strict=True))
                order = np.lexsort((h, row))
                twice = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
                both = np.bincount(row[order][1:][twice], minlength=b.num_rows)
                value = both / np.maximum(np.bincount(row, minlength=b.num_rows) - both, 1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c, _ in kept), pa.array(value)], [*(c for c, _ in kept), name])

    return pairs.mapInArrow(like, f"{', '.join(f'{c} {t}' for c, t in kept)}, {name} double")
