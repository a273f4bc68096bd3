"""Words of whole Arrow batches as 64-bit hashes, without a Python object for each word.

A word is a run of bytes other than space and \\x09-\\x0D; only A-Z are lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64 with a fixed odd base, mixed afterwards; two different words share a hash
with probability about 2**-64 each. Texts are taken whole: long ones are cut at white space into pieces whose
words are put together again, so that no temporary array is larger than a few times PIECE.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: For text compared across case and punctuation: every ASCII byte other than a letter or digit parts words.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
PUNCTUATION[[c for c in range(128) if chr(c).isalnum()]] = False

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p)
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def groups(texts: list[bytes], size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``size`` bytes together; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > size:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def spans(buf: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer; ``parts``: the bytes between words."""
    word = ~parts[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    if len(word) and word[-1]:
        edge = np.concatenate([edge, [len(word)]])
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    up, down = powers(max(1, len(buf)))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(((LOWER[buf] if lower else buf).astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] if len(starts) else np.zeros(0, np.uint64))


class Words:
    """Words of a few texts: hash, document (index into the texts), last three bytes as a number."""

    __slots__ = ("doc", "hash", "tail")

    def __init__(self, texts: list[bytes], tail: bool = False, parts: np.ndarray = SPACE):
        if len(texts) == 1 and len(texts[0]) > 2 * PIECE:
            pieces = list(_cut(texts[0]))
        else:
            pieces = [b"\n".join(texts)]
        found, tails, starts_all = [], [], None
        for p in pieces:
            buf = np.frombuffer(p, np.uint8)
            starts, ends = spans(buf, parts)
            found.append(hashes(buf, starts, ends))
            if tail:
                low = LOWER[buf].astype(np.uint32)
                at = [np.where(ends - k >= starts, low[np.maximum(ends - k, 0)], 0) for k in (1, 2, 3)]
                tails.append(at[0] | at[1] << 8 | at[2] << 16)
            starts_all = starts
        self.hash = np.concatenate(found) if len(found) > 1 else found[0]
        self.tail = (np.concatenate(tails) if len(tails) > 1 else tails[0]) if tail else None
        if len(texts) == 1:
            self.doc = np.zeros(len(self.hash), np.int64)
        else:
            offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
            self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts_all, offsets)))


def _cut(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        yield text[start:end]
        start = end


K1, K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingles(words: Words, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct ``width``-word shingles, by document and hash; fewer words than that are one shingle."""
    h, doc = words.hash, words.doc
    count = np.bincount(doc, minlength=n_docs)
    out_h, out_d = [], []
    if len(h) >= width:
        s = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            s = mix(s * K1 + h[k : len(h) - width + 1 + k] * K2 + np.uint64(k))
        ok = doc[: len(s)] == doc[width - 1 :]
        out_h.append(s[ok])
        out_d.append(doc[: len(s)][ok])
    ends = np.cumsum(count)
    for d in np.flatnonzero((count > 0) & (count < width)):
        s = h[ends[d] - count[d] : ends[d]]
        v = s[0]
        with np.errstate(over="ignore"):
            for k in range(1, len(s)):
                v = mix(np.array([v * K1 + s[k] * K2 + np.uint64(k)]))[0]
        out_h.append(np.array([v ^ np.uint64(0x5851F42D4C957F2D + len(s))], np.uint64))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]
