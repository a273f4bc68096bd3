"""Cross-tokenizer alignment (operator 12): tokens of two tokenizers matched by the bytes that they cover.

The tokens of both cover the same bytes, so they are intervals on one line. Sorted by start, a group ends where the
next start reaches the greatest end so far; within a group the overlapping pairs are expanded, and those that end
together are links. Both tokenizers part a text before a single space between other characters, whatever stands
around it, so a text is aligned in the units between such spaces and each distinct unit once.

Of two tokens that end together one's bytes are the end of the other's: the vocabularies alone bound the id pairs
that can ever be linked, a few hundred thousand. The corpus-wide counts are one vector of that length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

CUT = re.compile(r"(?<=\S) (?=\S)")
PIECE = 1 << 20  # characters of texts that are worked on at a time
REMEMBERED = 120_000  # units that a worker keeps before it forgets the rare ones
REMEMBERED_BYTES = 32 << 20
ROWS = 500  # of a batch whose texts or links are worked on at a time

_aligners: dict[str, Aligner] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(other)}


def bytes_of_a(file: bytes) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary file; an added token's string stands for itself."""
    from tokenizers import Tokenizer

    of, t = byte_of_character(), Tokenizer.from_str(file.decode())
    entries = t.get_vocab(with_added_tokens=True)
    out = [b""] * (max(entries.values()) + 1)
    for s, k in entries.items():
        out[k] = bytes(of[c] for c in s) if all(c in of for c in s) else s.encode()
    return out


def bytes_of_b(file: bytes) -> list[bytes]:
    """Bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_proto=file)
    pieces = [m.id_to_piece(k) for k in range(m.get_piece_size())]
    inner = [p for p in pieces if "▁" in p.lstrip("▁")]
    if inner:
        raise ValueError(f"pieces that go on after a space can't be cut at spaces: {inner[:3]}")
    return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]


def possible_links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All a << 32 | b of which one's bytes are the end of the other's, sorted."""
    ids_a: dict[bytes, list[int]] = {}
    ids_b: dict[bytes, list[int]] = {}
    for own, ids in ((a, ids_a), (b, ids_b)):
        for k, s in enumerate(own):
            if s:
                ids.setdefault(s, []).append(k)
    found = [k << 32 | j for k, s in enumerate(a) for n in range(len(s)) for j in ids_b.get(s[n:], ())]
    found += [k << 32 | j for j, s in enumerate(b) for n in range(1, len(s)) for k in ids_a.get(s[n:], ())]
    return np.unique(np.array(found, np.int64))


def coalesced(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and each one's group in that order: a new one where a start reaches all ends before."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(fresh) - 1


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of A and B tokens that share a byte. Both sides are in order of place."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    i = np.repeat(np.arange(len(starts_a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


class Aligner:
    """Units with their numbers of tokens and groups, links and written groups."""

    def __init__(self, file_a: bytes, file_b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(file_a.decode()), SentencePieceProcessor(model_proto=file_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.bytes_a, self.bytes_b = bytes_of_a(file_a), bytes_of_b(file_b)
        self.size_a, self.size_b = (np.array([len(x) for x in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        self.pairs = possible_links(self.bytes_a, self.bytes_b)
        n, m = len(self.bytes_a), len(self.bytes_b)
        # What is written for a token: its id and what parts it from the next one.
        self.written = [b"%d%s" % (k, s) for s in (b",", b"|") for k in range(n)] + [b"%d%s" % (k, s) for s in (b",", b";") for k in range(m)]
        self.index: dict[str, int] = {}
        self._keep(np.zeros(0, np.int64), first=True)

    def _keep(self, rows: np.ndarray, first: bool = False) -> None:
        """Forget all units but these rows, which are numbered anew."""
        if first:
            self.text, self.numbers, self.links, self.at = [], np.zeros((0, 4), np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
        new = np.full(len(self.numbers), -1)
        new[rows] = np.arange(len(rows))
        new = new.tolist()
        self.index = {u: new[k] for u, k in self.index.items() if new[k] >= 0}
        n = np.diff(self.at)[rows]
        ends = np.cumsum(n)
        self.links = self.links[np.repeat(self.at[rows] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]
        self.at = np.concatenate([[0], ends])
        self.text = [self.text[k] for k in rows.tolist()]
        self.numbers = self.numbers[rows]  # A tokens, B tokens, groups, 1 if bytes differ
        self.uses = np.zeros(len(rows), np.int64)
        self.held = sum(len(u) for u in self.index)

    def full(self) -> bool:
        return len(self.index) > REMEMBERED or self.held > REMEMBERED_BYTES

    def forget(self) -> None:
        """Keep the units that were met more than once since last time, those most often first and up to half of what fits."""
        often = np.flatnonzero(self.uses > 1)
        if self.held > REMEMBERED_BYTES:
            often = often[:0]
        self._keep(np.sort(often[np.argsort(-self.uses[often], kind="stable")[: REMEMBERED // 2]]))

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of each text, as rows of ``numbers``, one text after the other, and how many each has."""
        units = [CUT.split(t) if t else [] for t in texts]
        new = list(set().union(*units).difference(self.index))
        if new:
            self._add(new)
        rows = np.array(list(map(self.index.__getitem__, chain.from_iterable(units))), np.int64)
        self.uses += np.bincount(rows, minlength=len(self.uses))
        return rows, np.array([len(u) for u in units], np.int64)

    def _tokens(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of A and of B, none where the bytes of either aren't the unit's, and where that is."""
        spaced = [f" {u}" for u in units]
        ids_a = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        joined = lambda ids, of: b"".join(map(of.__getitem__, ids))
        whole, bad = "".join(spaced).encode(), np.zeros(len(units), bool)
        size = np.array([len(u.encode()) for u in spaced], np.int64)
        for ids, of, sizes in ((ids_a, self.bytes_a, self.size_a), (ids_b, self.bytes_b, self.size_b)):
            flat = list(chain.from_iterable(ids))
            n = np.array([len(x) for x in ids], np.int64)
            total = np.concatenate([[0], np.cumsum(sizes[np.array(flat, np.int64)])])
            ends = np.cumsum(n)
            # All units at once; only where that fails one by one.
            if (total[ends] - total[ends - n] != size).any() or joined(flat, of) != whole:
                bad |= np.array([joined(x, of) != t.encode() for x, t in zip(ids, spaced, strict=True)])
        for k in np.flatnonzero(bad).tolist():
            ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b, bad

    def _add(self, units: list[str]) -> None:
        ids_a, ids_b, bad = self._tokens(units)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.array(list(chain.from_iterable(ids)), np.int64) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        start_a, start_b = end_a - self.size_a[flat_a], end_b - self.size_b[flat_b]

        order, group = coalesced(np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b]))
        of = np.empty(len(order), np.int64)
        of[order] = group
        group_a, group_b = of[: len(flat_a)], of[len(flat_a) :]
        n_groups = int(group[-1]) + 1 if len(group) else 0
        i, j = overlaps(start_a, end_a, start_b, end_b)
        together = end_a[i] == end_b[j]
        i, j = i[together], j[together]

        unit_a = np.repeat(np.arange(len(units)), n_a)
        groups = np.bincount(unit_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(units)) if n_groups else np.zeros(len(units), np.int64)
        linked = np.bincount(unit_a[i], minlength=len(units))
        self.links = np.concatenate([self.links, np.searchsorted(self.pairs, flat_a[i] << 32 | flat_b[j]).astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(linked)])
        self.numbers = np.concatenate([self.numbers, np.column_stack([n_a, n_b, groups, bad]).astype(np.int32)])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])
        self.index.update(zip(units, range(len(self.index), len(self.index) + len(units)), strict=True))
        self.held += sum(map(len, units))

        # Groups are written in order, A tokens before B tokens; a token's place follows from how many stand before it.
        below_a, below_b = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in (group_a, group_b))
        place = np.concatenate([np.arange(len(flat_a)) + below_b[group_a], np.arange(len(flat_b)) + below_a[group_b + 1]]) if n_groups else np.zeros(0, np.int64)
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (group_a, group_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        keys = np.empty(len(place), np.int64)
        keys[place] = np.concatenate([flat_a + n * last_a, 2 * n + flat_b + m * last_b])
        pieces = list(map(self.written.__getitem__, keys.tolist()))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        whole = b"".join(pieces)
        self.text += [whole[s:e] for s, e in zip(ends, ends[1:], strict=False)]

    def links_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``pairs`` of the links of these units, one unit after the other, and how many each has."""
        n = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(n)
        return self.links[np.repeat(self.at[rows] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)], n


def _aligner(files: tuple[str, bytes, bytes]) -> Aligner:
    """The worker's aligner for these files; it outlives a task."""
    key, a, b = files
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that a cut separates."""
    start = 0
    while len(text) - start > PIECE and (m := CUT.search(text, start + PIECE - 1)):
        yield text[start : m.start()]
        start = m.end()
    yield text[start:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about PIECE characters; a longer text stands alone."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > PIECE:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _rows(aligner: Aligner, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of units and their number for each text, of texts in a group or of the parts of one long text."""
    for part in ([[p] for p in _pieces(texts[0])] if len(texts) == 1 else [texts]):
        yield aligner.rows(part)


class Alignment:
    """Two tokenizers by the contents of their files, and the jobs that use them.

    file_a: a byte-level BPE file of ``tokenizers``; file_b: a ``sentencepiece`` model. A text is encoded without
    special tokens, by A with a space before it, which B adds itself. A text has tokens if it isn't null or empty
    and both token sequences are its bytes, space first.
    """

    def __init__(self, file_a: bytes, file_b: bytes):
        self.pairs = possible_links(bytes_of_a(file_a), bytes_of_b(file_b))
        self.files = (hashlib.sha256(file_a + file_b).hexdigest(), file_a, file_b)

    def groups(self, docs: DataFrame) -> DataFrame:
        """Rows (doc_id, n_a, n_b, n_groups, links, groups), one for each row of ``docs``.

        groups: the groups in order as ``a1,a2|b1;a3|b2,b3``, empty without tokens; links: places in ``pairs`` of the
        A and B tokens that end together. Texts that are null, empty or not what their tokens' bytes say have zeros,
        an empty string and no links. Texts are worked on in parts, however long, but a run without a cut is one unit
        and a row's groups are one value. Repeated rows count each; other columns are not read; an empty table gives
        none.
        """
        files = docs.sparkSession.sparkContext.broadcast(self.files)  # as large as the files

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = _aligner(files.value)
            for b in _slices(batches):
                texts = [t or "" for t in b.column(1).to_pylist()]
                for i, j in _groups(texts):
                    if aligner.full():
                        aligner.forget()
                    total, written, links = np.zeros((j - i, 4), np.int64), [[] for _ in range(j - i)], []
                    size = np.zeros(j - i, np.int64)
                    for own, n in _rows(aligner, texts[i:j]):
                        some, ends = n > 0, np.cumsum(n)
                        found, each = aligner.links_of(own)
                        if len(own):
                            total[some] += np.add.reduceat(aligner.numbers[own].astype(np.int64), (ends - n)[some])
                            size[some] += np.add.reduceat(each, (ends - n)[some])
                        links.append(found)
                        parts = list(map(aligner.text.__getitem__, own.tolist()))
                        for k, e in enumerate(ends.tolist()):
                            written[k].append(b"".join(parts[e - int(n[k]) : e]))
                    bad = total[:, 3] > 0
                    total[bad] = 0
                    whole = np.concatenate(links)[~np.repeat(bad, size)].astype(np.int32)
                    size[bad] = 0
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(whole))
                    said = [b"" if x else b"".join(w)[:-1] for x, w in zip(bad, written, strict=True)]
                    columns = [pa.array(total[:, k], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *columns, lists, pa.array(said, pa.binary()).cast(pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "links", "groups"])

        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n_a long, n_b long, n_groups long, links array<int>, groups string")

    def counts(self, aligned: DataFrame) -> np.ndarray:
        """How many links of all rows join each of ``pairs``: a vector as long as the vocabularies allow, however many rows there are."""
        size = len(self.pairs)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _aligners.clear()  # a worker that has encoded texts doesn't need its units any more
            total = np.zeros(size, np.int64)
            for b in _slices(batches):
                total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "count"])

        out = np.zeros(size, np.int64)
        for r in aligned.select("links").mapInArrow(count, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count")).collect():  # ``size`` rows at most
            out[r.pair] = r["count"]
        return out

    def _best(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs have the greatest count of their B id, ties included."""
        of_b = self.pairs & 0xFFFFFFFF
        most = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
        np.maximum.at(most, of_b, counts)
        return counts == most[of_b]

    def links(self, docs: DataFrame) -> DataFrame:
        """(a_id, b_id, count, best): the linked id pairs of the corpus; best: no other pair of this B id has more links."""
        counts = self.counts(self.groups(docs))
        at, best = np.flatnonzero(counts), self._best(counts)
        rows = [(int(self.pairs[k]) >> 32, int(self.pairs[k]) & 0xFFFFFFFF, int(counts[k]), bool(best[k])) for k in at]
        return docs.sparkSession.createDataFrame(rows, "a_id long, b_id long, count long, best boolean")

    def with_counts(self, aligned: DataFrame) -> DataFrame:
        """Rows of ``groups``, with whatever columns they have got since, with n_links, n_best and count_sum for ``links``.

        A link's count is how many links of all rows join its two ids; n_best: links whose count is the greatest of
        their B id, ties included; count_sum: the sum over links. The rows are written once, so that the texts are
        encoded once.
        """
        aligned = materialize(aligned)
        counts = self.counts(aligned)
        known = aligned.sparkSession.sparkContext.broadcast((counts, self._best(counts)))
        kept = [c for c in aligned.columns if c != "links"]
        types = dict(aligned.dtypes)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _aligners.clear()
            counts, best = known.value
            for b in _slices(batches):
                links = b.column(len(kept))
                n, at = links.value_lengths().to_numpy(), links.flatten().to_numpy()
                ends = np.cumsum(n)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (best[at], counts[at])]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(kept))), pa.array(n, pa.int64()), *(pa.array(x[ends] - x[ends - n], pa.int64()) for x in sums)], [*kept, "n_links", "n_best", "count_sum"])

        schema = "".join(f"`{c}` {types[c]}, " for c in kept)
        return aligned.select(*kept, "links").mapInArrow(rows, schema + "n_links long, n_best long, count_sum long")

    def align(self, docs: DataFrame) -> DataFrame:
        """``groups`` of ``docs`` ``with_counts``."""
        return self.with_counts(self.groups(docs))
