"""Line dedup (operator 3): of equal or nearly equal lines of the whole corpus the first stays.

Equal lines are joined by their hashes. Lines within as many byte edits as the shorter one's length allows share a
segment: every line is split into edits + 1 segments, which are the index, and probes the index of its own and of the
next smaller lengths with the substrings that can be such a segment. A sieve of the index holds back the probes that
can't meet anything. Pairs of one segment are sifted by their parity of byte pairs, an edit changes four of those bits
at most, and verified by the banded bit-parallel edit distance. A segment of many lines first joins each to a few hubs
and then only lines that are still apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bit_sieve, components, materialize, unused
from ._words import PIECE, SPACE, groups, hashes, mix, powers, texts_of

EDITS = 1
LONG = 20  # bytes from which lines are compared by a fixed number of edits
#: Edits by the bytes of the shorter line: a tenth of it, until what three edits cost is reached; under ten bytes that is none.
BY_LENGTH = ((10, 1), (40, 2), (80, 3))
ONE_EDIT = ((10, 1),)  # what the registered query and the pipeline take: pairs at more edits grow with the square of a hot group
Steps = tuple[tuple[int, int], ...]
FEW = 16  # entries of a segment of which all pairs are made at once
HUBS = 8  # entries that stand for a segment of more; those near any of them need no pairs among themselves
PAD = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """Lines of a few texts that aren't blank, without white space at their ends: text, number in it, bounds in ``buf``."""

    __slots__ = ("buf", "count", "end", "hash", "number", "start", "text")

    def __init__(self, texts: list[bytes], at: int = 0):
        """at: number of the first line."""
        self.buf = buf = np.frombuffer(b"\n".join(texts), np.uint8)
        ends = np.concatenate([np.flatnonzero(buf == 10), [len(buf)]])
        starts = np.concatenate([[0], ends[:-1] + 1])
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        text = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(starts, offsets[:-1])
        number = np.arange(len(starts)) - first[text] + at
        self.count = np.bincount(text, minlength=len(texts))
        black = np.flatnonzero(~SPACE[buf])
        lo, hi = np.searchsorted(black, starts), np.searchsorted(black, ends)
        keep = hi > lo
        self.text, self.number = text[keep], number[keep]
        self.start, self.end = (black[lo[keep]], black[hi[keep] - 1] + 1) if len(black) else (starts[keep], ends[keep])
        self.hash = hashes(buf, self.start, self.end, lower=False)


def lines_of(texts: list[bytes]) -> Iterator[tuple[int, Lines]]:
    """(first text, Lines) of neighbouring texts; a long text is cut at line ends."""
    for i, j in groups(texts):
        if j - i > 1 or len(texts[i]) <= 2 * PIECE:
            yield i, Lines(texts[i:j])
            continue
        start, number = 0, 0
        while start <= len(texts[i]):
            end = texts[i].find(b"\n", start + PIECE)
            end = len(texts[i]) if end < 0 else end
            part = Lines([texts[i][start:end]], number)
            yield i, part
            number += int(part.count[0])
            start = end + 1


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the edits + 1 segments of lines of these lengths, as even as can be."""
    n = edits + 1
    short, longer = length // n, length % n
    out, start = [], np.zeros_like(length)
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((start, size))
        start = start + size
    return out


class Segments:
    """Keys of segments and substrings of lines."""

    def __init__(self, lines: Lines):
        self.buf, self.start, self.length = lines.buf, lines.start, lines.end - lines.start
        _, self.down = powers(len(self.buf) + 1)
        up, _ = powers(len(self.buf) + 1)
        self.total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=self.total[1:])

    def key(self, length: np.ndarray, i: int, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix((self.total[a + size] - self.total[a]) * self.down[a] + length.astype(np.uint64) * PAD + np.uint64(i))

    def index(self, at: np.ndarray, edits: int) -> list[np.ndarray]:
        """Keys of the segments of the lines ``at``."""
        return [self.key(self.length[at], i, self.start[at] + p, size) for i, (p, size) in enumerate(segments(self.length[at], edits))]

    def probe(self, at: np.ndarray, edits: int, less: int) -> list[tuple[bool, np.ndarray]]:
        """(own, keys): substrings of the lines ``at`` that may be segments of lines shorter by ``less``; own: it is the line's own segment."""
        out = []
        length = self.length[at] - less
        for i, (p, size) in enumerate(segments(length, edits)):
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                a = np.clip(self.start[at] + p + shift, 0, len(self.buf) - size)  # a substring outside the line matches nothing true
                out.append((less == 0 and shift == 0, self.key(length, i, a, size)))
        return out


def parities(lines: Lines) -> np.ndarray:
    """Parity of the pairs of neighbouring bytes of each line, by 64 kinds."""
    buf = lines.buf
    pair = np.zeros(len(buf) + 1, np.uint64)
    pair[: len(buf) - 1] = np.uint64(1) << (((buf[:-1].astype(np.uint64) << np.uint64(8)) | buf[1:]) * PAD >> np.uint64(58))
    seen = np.bitwise_xor.accumulate(np.concatenate([[np.uint64(0)], pair]))
    return seen[lines.end - 1] ^ seen[lines.start]


def keys(lines: Lines, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of byte pairs, index keys and probe keys of each line at one threshold."""
    s, every = Segments(lines), np.arange(len(lines.start))
    return parities(lines), np.stack(s.index(every, edits), 1), np.stack([k for less in range(edits + 1) for _, k in s.probe(every, edits, less)], 1)


def classes_of(steps: Steps) -> list[tuple[int, int, int]]:
    """(from bytes, up to bytes, edits) of each length class."""
    return [(lo, hi, e) for (lo, e), (hi, _) in zip(steps, (*steps[1:], (1 << 40, 0)), strict=True)]


def index_keys(lines: Lines, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the segments, each line's by the class of its length."""
    s = Segments(lines)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi, edits in classes_of(steps):
        at = np.flatnonzero((s.length >= lo) & (s.length < hi))
        for k in s.index(at, edits) if len(at) else ():
            rows.append(at)
            out.append(k)
    return np.concatenate(rows), np.concatenate(out)


def probe_keys(lines: Lines, steps: Steps, every, repeated) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of the probes that the sieves ``every`` (all index keys) and ``repeated`` (those of several lines) let pass.

    A line probes each shorter length by that length's class.
    """
    s = Segments(lines)
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, hi, edits in classes_of(steps):
        for less in range(edits + 1):
            at = np.flatnonzero((s.length - less >= lo) & (s.length - less < hi))
            for own, k in s.probe(at, edits, less) if len(at) else ():
                hit = (repeated if own else every).has(k)
                rows.append(at[hit])
                out.append(k[hit])
    return np.concatenate(rows), np.concatenate(out)


def threshold(n: F.Column, steps: Steps) -> F.Column:
    out = F.lit(0)
    for lo, edits in steps:
        out = F.when(n >= lo, edits).otherwise(out)
    return out


LONG_LINE = 512  # bytes from which on pairs lose their common ends before they are compared


def mismatch(a: np.ndarray, b: np.ndarray) -> int:
    """Place of the first difference, the shorter length if there is none; reads on in parts that grow."""
    n, at, size = min(len(a), len(b)), 0, 256
    while at < n:
        part = a[at : min(n, at + size)] != b[at : min(n, at + size)]
        if part.any():
            return at + int(part.argmax())
        at, size = at + size, min(size * 4, 1 << 20)
    return n


def within(a: bytes, b: bytes, edits: int) -> int:
    """Edit distance of two lines if it is at most ``edits``, else edits + 1: how far each diagonal reaches with each number of edits."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    reach = {0: mismatch(x, y)}
    for e in range(edits + 1):
        if e:
            last, reach = reach, {}
            for d in range(-e, e + 1):
                i = max(last.get(d, -9) + 1, last.get(d - 1, -9), last.get(d + 1, -9) + 1)
                if 0 <= i <= len(x) and 0 <= i + d <= len(y):
                    reach[d] = i + mismatch(x[i:], y[i + d :])
        if reach.get(len(y) - len(x), -1) >= len(x):
            return e
    return edits + 1


def without_ends(a: bytes, b: bytes, keep: int) -> tuple[bytes, bytes]:
    """Two lines less what both begin and end with, but for ``keep`` bytes before the first difference; their distance stays."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    start = max(0, mismatch(x, y) - keep)
    x, y = x[start:], y[start:]
    end = min(mismatch(x[::-1], y[::-1]), min(len(x), len(y)) - min(keep, len(x), len(y)))
    return x[: len(x) - end].tobytes(), y[: len(y) - end].tobytes()


def distances(a: list[bytes], b: list[bytes], edits: int) -> np.ndarray:
    """Edit distance of each pair where it is at most ``edits``, else edits + 1: banded, bit-parallel, pairs side by side.

    The band's vertical differences are the top 2 * edits + 1 bits of a word; every step goes down the diagonal.
    Both lines are longer than ``edits`` and differ in length by ``edits`` at most. Long lines first lose their
    common ends; of those that are long still, few, edits lie far apart, which their diagonals tell in time that is
    linear in vector steps.
    """
    long = [i for i in range(len(a)) if max(len(a[i]), len(b[i])) >= LONG_LINE]
    if long:
        out = np.zeros(len(a), np.int64)
        rest = [i for i in range(len(a)) if max(len(a[i]), len(b[i])) < LONG_LINE]
        cut = {i: without_ends(a[i], b[i], edits + 1) for i in long}
        for i in long:
            if max(map(len, cut[i])) >= LONG_LINE:
                out[i] = within(*cut[i], edits)
            else:
                rest.append(i)
        if rest:
            out[rest] = distances([cut[i][0] if i in cut else a[i] for i in rest], [cut[i][1] if i in cut else b[i] for i in rest], edits)
        return out
    n = len(a)
    m, k = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width = max(int(m.max()), int(k.max()))
    p, t = np.zeros((n, width + 2 * edits + 1), np.uint8), np.full((n, width), 255, np.uint8)
    for i in range(n):
        p[i, edits : edits + m[i]] = np.frombuffer(a[i], np.uint8)
        t[i, : k[i]] = np.frombuffer(b[i], np.uint8)
    p, t = np.ascontiguousarray(p.T), np.ascontiguousarray(t.T)
    one, top = np.uint64(1), np.uint64(63)
    vp = np.full(n, ((1 << (edits + 1)) - 1) << (63 - edits), np.uint64)
    vn = np.zeros(n, np.uint64)
    score = np.full(n, edits)
    across = np.full(n, 62, np.int64)
    for i in range(width):
        x = np.zeros(n, np.uint64)
        for d in range(2 * edits + 1):
            x |= (p[i + d] == t[i]).astype(np.uint64) << np.uint64(63 - 2 * edits + d)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        down = i < m - edits
        row = ~down & (i < k)
        bit = np.maximum(across, 0).astype(np.uint64)
        score = score + np.where(down, 1 - (d0 >> top).astype(np.int64), 0) + np.where(row, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64), 0)
        across = across - row
        d0 >>= one
        vp, vn = hn | ~(d0 | hp), d0 & hp
    return np.minimum(score, edits + 1)


def _entries(docs: DataFrame) -> DataFrame:
    """(doc_id, t, number, h) of every line that isn't blank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, lines in lines_of(texts_of(b.column(2))):
                if len(lines.hash):
                    at = pa.array(lines.text + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lines.number), pa.array(lines.hash.view(np.int64))], ["doc_id", "t", "number", "h"])

    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(rows, "doc_id long, t long, number long, h long")


def _keyed(docs: DataFrame, steps: Steps, sieves=None) -> DataFrame:
    """(k, h, n, parity): index keys of the lines, of equal lines in a task once; with ``sieves``, the probes that pass them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lines in lines_of(texts_of(b.column(0))):
                one = np.sort(np.unique(lines.hash, return_index=True)[1])
                lines.start, lines.end, lines.hash = lines.start[one], lines.end[one], lines.hash[one]
                if not len(one):
                    continue
                at, k = index_keys(lines, steps) if sieves is None else probe_keys(lines, steps, *sieves.value)
                parity, n = parities(lines).view(np.int64), lines.end - lines.start
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(lines.hash.view(np.int64)[at]), pa.array(n[at]), pa.array(parity[at])], ["k", "h", "n", "parity"])

    return docs.select("text").mapInArrow(rows, "k long, h long, n long, parity long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted line hashes ``h``."""
    marks = docs.sparkSession.sparkContext.broadcast(bit_sieve(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lines in lines_of(texts_of(b.column(0))):
                hit = np.flatnonzero(marks.value.has(lines.hash))
                hit = hit[np.unique(lines.hash[hit], return_index=True)[1]]
                if len(hit):
                    found = [lines.buf[s:e].tobytes() for s, e in zip(lines.start[hit], lines.end[hit], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(lines.hash[hit].view(np.int64)), pa.array(found, pa.binary())], ["h", "line"])

    return materialize(docs.select("text").mapInArrow(rows, "h long, line binary").join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")))


def _verify(docs: DataFrame, pairs: DataFrame, steps: Steps) -> DataFrame:
    """The pairs of line hashes (a, b) whose lines are within the edits that the shorter one allows."""
    wanted = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct())
    texts = _texts(docs, wanted)
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            la, lb = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = []
            for lo, hi, edits in classes_of(steps):
                order = sorted((i for i in range(len(la)) if lo <= min(len(la[i]), len(lb[i])) < hi and abs(len(la[i]) - len(lb[i])) <= edits), key=lambda i: len(la[i]))
                start = 0
                while start < len(order):
                    end = start
                    while end < len(order) and (end - start + 1) * len(la[order[end]]) <= 1 << 22 or end == start:
                        end += 1
                    part = order[start:end]
                    good = distances([la[i] for i in part], [lb[i] for i in part], edits) <= edits
                    keep += [i for i, g in zip(part, good, strict=True) if g]
                    start = end
            yield b.select([0, 1]).take(pa.array(keep, pa.int64()))

    return materialize(both.select("a", "b", "la", "lb").mapInArrow(rows, "a long, b long"))


def parity_parts(parity: F.Column, edits: int) -> F.Column:
    """Array of parts of a parity of 64 bits, in which two that differ in 4 * edits bits at most agree somewhere.

    One more part than bits may differ leaves one alike. At one edit two of six parts are, and a place of the array
    is a pair of parts, with some 21 bits; else a place is one part.
    """
    if not edits:
        return F.array(parity)
    n = 6 if edits == 1 else 4 * edits + 1
    bounds = [64 * k // n for k in range(n + 1)]
    part = lambda k: F.shiftrightunsigned(parity, bounds[k]).bitwiseAND((1 << (bounds[k + 1] - bounds[k])) - 1)
    if edits != 1:
        return F.array(*map(part, range(n)))
    return F.array(*(F.xxhash64(part(i), part(j)) for i in range(n) for j in range(i + 1, n)))


def line_classes(docs: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """(lines, repeated): every line's (doc_id, t, number, h), and (h, first) of the line hashes that occur again.

    first is the place (doc_id, t, number) of the first line of the class; t is the xxhash64 of the text.
    """
    all_lines = materialize(_entries(docs))
    distinct = materialize(all_lines.groupBy("h").agg(F.min(F.struct("doc_id", "t", "number")).alias("first"), F.count("*").alias("c")))
    index = materialize(_keyed(docs, steps).groupBy("k", "h").agg(F.first("n").alias("n"), F.first("parity").alias("parity")))
    counts = materialize(index.groupBy("k").agg(F.count("*").alias("c")))
    sieves = docs.sparkSession.sparkContext.broadcast((bit_sieve(counts.select(F.col("k").alias("h"))), bit_sieve(counts.where("c > 1").select(F.col("k").alias("h")))))
    probe = materialize(_keyed(docs, steps, sieves).distinct())

    def near(n: F.Column, m: F.Column, p: F.Column, q: F.Column) -> F.Column:
        edits = threshold(F.least(n, m), steps)
        return (F.abs(n - m) <= edits) & (F.bit_count(p.bitwiseXOR(q)) <= 4 * edits)

    def pairs(x: DataFrame, y: DataFrame, *more: F.Column) -> DataFrame:
        longer = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.h") < F.col("y.h")))
        on = (F.col("x.k") == F.col("y.k")) & longer & near(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity"))
        for m in more:
            on &= m
        return x.alias("x").join(y.alias("y"), on).select(F.col("x.h").alias("a"), F.col("y.h").alias("b")).distinct()

    big = materialize(counts.where(F.col("c") > FEW).select("k"))
    few = pairs(probe, index.join(big, "k", "left_anti"))
    asks, holds = (materialize(d.join(big, "k")) for d in (probe, index))
    hubs = holds.groupBy("k", F.pmod("h", F.lit(HUBS)).alias("hub")).agg(F.min(F.struct("n", "h", "parity")).alias("y"))
    x, y = asks.alias("x"), hubs.select("k", "y.*").alias("y")
    to_hub = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.h") != F.col("y.h")) & near(F.col("x.n"), F.col("y.n"), F.col("x.parity"), F.col("y.parity")))
    longer = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.h") < F.col("y.h")))
    to_hub = to_hub.select(F.when(longer, F.col("x.h")).otherwise(F.col("y.h")).alias("a"), F.when(longer, F.col("y.h")).otherwise(F.col("x.h")).alias("b"))
    first = materialize(few.union(to_hub).distinct())
    edges = _verify(docs, first, steps)
    parts = components(edges)
    labels = parts.withColumnRenamed("node", "h")
    asks, holds = (materialize(d.join(labels, "h", "left").withColumn("comp", F.coalesce("comp", "h"))) for d in (asks, holds))
    # A segment all of whose lines are one class by now brings nothing together.
    open_keys = asks.select("k", "comp").union(holds.select("k", "comp")).groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("k")
    open_keys = materialize(open_keys)
    asks, holds = (d.join(open_keys, "k", "left_semi") for d in (asks, holds))
    # Lines within the edits differ in few bits of their parity, so they agree in some of its parts: those split a segment of many lines.
    parts_of = parity_parts(F.col("parity"), max(e for _, e in steps))
    asks, holds = (d.withColumn("k", F.explode(F.transform(parts_of, lambda p, i: F.xxhash64("k", i, p)))) for d in (asks, holds))
    rest = materialize(pairs(asks, holds, F.col("x.comp") != F.col("y.comp")).join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        parts = components(edges.union(_verify(docs, rest, steps)))
    classes = distinct.join(parts.withColumnRenamed("node", "h"), "h", "left")
    again = materialize(classes.where((F.col("c") > 1) | F.col("comp").isNotNull()).select("h", "first", F.coalesce("comp", "h").alias("comp")))
    least = again.groupBy("comp").agg(F.min("first").alias("first"))
    return all_lines, again.select("h", "comp").join(least, "comp").select("h", "first")


def _steps(edits: int | Steps, long: int) -> Steps:
    return ((long, edits),) if isinstance(edits, int) else edits


def repeated_lines(docs: DataFrame, edits: int | Steps = EDITS, long: int = LONG) -> DataFrame:
    """(doc_id, t, dropped): for each text with lines that go, their sorted numbers from 0; t is the text's xxhash64."""
    lines, again = line_classes(docs, _steps(edits, long))
    here = F.struct("doc_id", "t", "number")
    gone = lines.join(again, "h").where(~here.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("number")).alias("dropped"))


def dropped_lines(docs: DataFrame, edits: int | Steps = EDITS, long: int = LONG) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, dropped), one for each row of ``docs``.

    Lines part at \\n and are compared without ASCII white space at their ends; blank lines always stay. Lines of
    ``long`` bytes or more that are within ``edits`` byte edits, and lines that are equal, are one class, and so are
    lines that such links reach; the first line of a class by (doc_id, xxhash64 of the text, number) stays. Null
    and empty texts have no line to lose (null: 0 lines). Texts and lines are read whole, however long. A null doc_id comes first. Rows equal in id and text are
    one document. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = repeated_lines(docs, edits, long)
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("t"), F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = all_docs.join(gone, all_docs["doc_id"].eqNullSafe(gone["doc_id"]) & (all_docs["t"] == gone["t"]), "left")
    dropped = F.coalesce(gone["dropped"], F.array().cast("array<long>"))
    return joined.select(all_docs["doc_id"], "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def dedup_lines(docs: DataFrame, edits: int | Steps = EDITS, long: int = LONG) -> DataFrame:
    """``docs`` without repeated lines: text and n_chars follow, other columns and the order of lines stay.

    Documents that lose every line that isn't blank go; documents that had none stay as they are.
    """
    ident, key, dropped, cut = unused(docs, "_id", "_t", "_dropped", "_cut")
    gone = repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), edits, long)
    gone = materialize(gone.select(F.col("doc_id").alias(ident), F.col("t").alias(key), F.col("dropped").alias(dropped)))
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    # The lines are bound once, and those that stay are told by a set, so the work is linear in a text's lines.
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1).cast("array<long>"), F.col(dropped))
    joined_lines = lambda lines: F.array_join(F.transform(numbers(lines), lambda i: F.get(lines, i.cast("int"))), "\n")
    kept = F.get(F.transform(F.array(F.split(docs["text"], "\n", -1)), joined_lines), 0)
    text = F.when(F.col(dropped).isNull(), docs["text"]).otherwise(kept)
    columns = [text.alias(c) if c == "text" else docs[c] for c in docs.columns]
    out = joined.select(*columns, F.col(dropped).isNotNull().alias(cut))
    out = out.where(~F.col(cut) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(cut)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
