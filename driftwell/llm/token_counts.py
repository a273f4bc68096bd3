"""Token counts (operator 7): unigram segmentation of pre-tokens over a trie.

Distinct pre-tokens go into a trie; a node's forward score, the best segmentation of the prefix it stands for, is made
once from the scores of the nodes above it, whatever number of pre-tokens share the prefix, and the node where a
pre-token ends has its number of tokens. The pieces are those of a public byte-level vocabulary; a piece's
log-probability follows Zipf's law over its rank. Counting needs no shuffle: each task keeps what it has counted.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import groups, texts_of

#: A word with the one space before it; white space, but for that space, by itself.
PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
LONG = 256  # bytes from which a pre-token's scores roll along it instead of staying in the trie
AT_ONCE = 500_000  # pre-tokens of a text held at a time
REMEMBERED = 300_000  # pre-tokens whose counts a task keeps
NODES = 1_000_000  # nodes from which a task starts a new trie


def read_pieces(path: str) -> dict[bytes, float]:
    """Pieces and scores of a vocabulary file of lines "base64 rank": the log of Zipf's share of each rank."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    norm = np.log((1.0 / np.arange(1, max(ranks.values()) + 2)).sum())
    return {p: float(-np.log(r + 1) - norm) for p, r in ranks.items()}


class Pieces:
    """Scores of the pieces, and for the last one to three bytes of a prefix the lengths that a piece at its end can have."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        ends: dict[bytes, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.longest = max(map(len, scores), default=0)
        shorter = lambda e: {n for n in (1, 2) if n < len(e) and e[-n:] in scores}
        self.lengths = {e: tuple(sorted(n | shorter(e))) for e, n in ends.items()}


class Trie:
    """Prefixes with their best scores and, at equal scores, least numbers of tokens. A prefix no pieces make has none (-1).

    A node is a number; the edge by a byte is kept under node * 256 + byte.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.child: dict[int, int] = {}
        self.score: list[float] = [0.0]
        self.tokens: list[int] = [0]

    def insert(self, word: bytes) -> int:
        """The number of tokens of ``word``, -1 if no pieces make it."""
        child, score, tokens = self.child, self.score, self.tokens
        piece, lengths = self.pieces.scores.get, self.pieces.lengths.get
        node, path, d = 0, [0], 0
        for byte in word:
            d += 1
            edge = node << 8 | byte
            node = child.get(edge, 0)
            if not node:
                best, count = -np.inf, -1
                end = word[d - 3 if d > 3 else 0 : d]
                fit = lengths(end) or lengths(end[-2:]) or lengths(end[-1:], ())
                for n in fit:
                    if n > d:
                        break
                    p = piece(word[d - n : d])
                    if p is not None:
                        above = path[d - n]
                        if tokens[above] >= 0:
                            s = score[above] + p
                            if s > best or (s == best and tokens[above] + 1 < count):
                                best, count = s, tokens[above] + 1
                node = child[edge] = len(score)
                score.append(best)
                tokens.append(count)
            path.append(node)
        return tokens[node]


def rolled(word: bytes, pieces: Pieces) -> int:
    """What ``Trie.insert`` gives, from the scores of the last ``pieces.longest`` prefixes alone."""
    piece, lengths = pieces.scores.get, pieces.lengths.get
    size = pieces.longest + 1
    score, tokens = [-np.inf] * size, [-1] * size
    score[0], tokens[0] = 0.0, 0
    at = 0
    for d in range(1, len(word) + 1):
        best, count = -np.inf, -1
        end = word[d - 3 if d > 3 else 0 : d]
        for n in lengths(end) or lengths(end[-2:]) or lengths(end[-1:], ()):
            if n > d:
                break
            above = (d - n) % size
            if tokens[above] >= 0 and (p := piece(word[d - n : d])) is not None:
                s = score[above] + p
                if s > best or (s == best and tokens[above] + 1 < count):
                    best, count = s, tokens[above] + 1
        at = d % size
        score[at], tokens[at] = best, count
    return tokens[at]


def count_tokens(docs: DataFrame, pieces: dict[bytes, float]) -> DataFrame:
    """Rows (doc_id, n_pre_tokens, n_tokens), one for each row of ``docs``, over the UTF-8 bytes of whole texts.

    Null and empty texts have none of either. A pre-token that the pieces can't make counts a token for each byte.
    Pre-tokens of LONG bytes or more aren't kept: their scores roll along them, so a run of any length takes no more
    memory. Repeated rows are counted each; columns other than doc_id and text are not read; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Pieces(pieces))  # as large as the vocabulary file

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        trie = Trie(sent.value)

        def tokens(words: list[list[bytes]]) -> list[int]:
            nonlocal trie
            new = set().union(*words).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set().union(*words)
            if len(trie.score) > NODES:
                trie = Trie(sent.value)
            long = {}
            for w in new:
                n = trie.insert(w) if len(w) < LONG else rolled(w, sent.value)
                (known if len(w) < LONG else long)[w] = n if n >= 0 else len(w)
            if long:
                return [sum(known[x] if x in known else long[x] for x in w) for w in words]
            return [sum(map(known.__getitem__, w)) for w in words]

        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in groups(texts):
                if j - i == 1:  # perhaps a long text
                    found, n, total = PRE_TOKEN.finditer(texts[i]), 0, 0
                    while part := [m[0] for m in islice(found, AT_ONCE)]:
                        n, total = n + len(part), total + tokens([part])[0]
                    sizes, counts = [n], [total]
                else:
                    words = [PRE_TOKEN.findall(t) for t in texts[i:j]]
                    sizes, counts = [len(w) for w in words], tokens(words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_pre_tokens", "n_tokens"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_pre_tokens long, n_tokens long")
