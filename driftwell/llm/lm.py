"""LM scoring (operator 4): a hidden Markov model over word classes, trained by Baum-Welch over all training documents.

Words are counted over the whole training part. The most frequent words are classes of their own, the others share
classes by their last three bytes; the model's states emit classes, and a class gives its words by their add-one
counts, so the model is a distribution over texts. Expected counts of a round are summed inside partitions and then
together. A text's likelihood is exact: the scaled forward recursion over all its words and the end.

Counts of the most frequent words (a bounded number) go to every task; counts of the others are joined, and as each
of those is rare no key of that join is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import Words, groups, texts_of

STATES = 6
OWN = 6144  # words that are classes of their own
TAILS = 2048  # classes of the other words, by their last three bytes
KNOWN = 1 << 18  # words whose counts every task holds
ROUNDS = 5  # of Baum-Welch over all training texts, at most
SETTLED = 1e-3  # gain of the summed likelihood from which on rounds go on
LEAN = 0.9  # share of a text's words that its first state has in the start values
END = np.uint64(0x0E4D0E4D0E4D0E4D)  # the end's stand-in for a word's hash
STEP = 1 << 19  # words that one forward-backward run takes at most, but for a longer text


def tail_class(tail: np.ndarray) -> np.ndarray:
    return OWN + 1 + ((tail.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)


N_CLASSES = 1 + OWN + TAILS  # class 0 is the end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a partition, handed over whenever many have gathered: (h, tail, c)."""
    held: list[tuple] = []
    n = 0

    def out() -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate([x[2] for x in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.concatenate([x[1] for x in held])[first].astype(np.int64)), pa.array(c)], ["h", "tail", "c"])

    for b in batches:
        texts = texts_of(b.column(0))
        for i, j in groups(texts):
            w = Words(texts[i:j], tail=True)
            u, first, c = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((u, w.tail[first], c))
            held.append((np.array([END]), np.zeros(1, np.uint32), np.array([j - i])))
            n += len(u)
            if n > 3_000_000:
                yield out()
                held, n = [], 0
    if held:
        yield out()


class Vocabulary:
    """The bounded part of the vocabulary that goes to the tasks."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, floor: int, total: int, distinct: int, tail_total: np.ndarray, tail_distinct: np.ndarray):
        """hashes, counts: of all words, and the end, that occur ``floor`` times or more, by falling count."""
        self.floor = floor
        is_end = hashes == END
        self.end = int(counts[is_end][0]) if is_end.any() else 0
        hashes, counts = hashes[~is_end], counts[~is_end]
        own = np.arange(len(hashes)) < OWN
        order = np.argsort(hashes)
        self.hash, self.count = hashes[order], counts[order]
        self.cls = np.where(own, np.arange(1, len(hashes) + 1), 0)[order]  # 0: by its tail
        self.total, self.distinct = total, distinct
        self.share = np.concatenate([[self.end], np.pad(counts[own], (0, OWN - own.sum())), tail_total]) / max(1, total)  # by class
        self.tail_log = np.log10(tail_total + tail_distinct + 1.0)  # by class - OWN - 1
        self.base_log = float(np.log10(total + distinct + 1.0))

    def look_up(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the words, and their counts where they are known here, else -1."""
        cls, count = tail_class(w.tail), np.full(len(w.hash), -1, np.int64)
        if len(self.hash) and len(w.hash):
            k = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
            hit = self.hash[k] == w.hash
            count[hit] = self.count[k[hit]]
            own = self.cls[k]
            cls = np.where(hit & (own > 0), own, cls)
        return cls, count


def vocabulary(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """(h, tail, c) of every training word and the end, and its bounded part. ``docs`` has text."""
    words = docs.select("text").mapInArrow(_counts, "h long, tail long, c long")
    words = materialize(words.groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")))
    total, distinct = words.agg(F.sum("c"), F.count("*")).first()
    bins = words.groupBy(F.floor(F.log2("c") * 8).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect()  # 512 rows at most
    within = np.cumsum([r.n for r in bins]) <= KNOWN
    floor = min((int(r.c) for r, w in zip(bins, within, strict=True) if w), default=1 << 62)
    top = words.where(F.col("c") >= floor).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])  # KNOWN rows at most
    rest = words.where(F.col("h") != int(END.view(np.int64)))
    own = np.sort(top["h"][top["h"] != int(END.view(np.int64))].to_numpy()[:OWN].view(np.uint64) if len(top) else np.zeros(0, np.uint64))

    def by_tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, c = np.zeros(TAILS), np.zeros(TAILS)
        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            free = ~np.isin(h, own)
            at = tail_class(b["tail"].to_numpy()[free]) - OWN - 1
            n += np.bincount(at, minlength=TAILS)
            c += np.bincount(at, weights=b["c"].to_numpy()[free], minlength=TAILS)
        yield pd.DataFrame({"at": np.arange(TAILS), "n": n, "c": c})

    tails = rest.mapInPandas(by_tail, "at long, n double, c double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).toPandas().sort_values("at")  # TAILS rows
    n, c = np.zeros(TAILS), np.zeros(TAILS)
    n[tails["at"]], c[tails["at"]] = tails["n"], tails["c"]
    voc = Vocabulary(top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), floor, int(total or 0), int(distinct), c, n)
    return words, voc


# --- the model


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start (k), move (k, k), emit (classes, k): columns are distributions over classes."""
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def of_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """Expected counts, smoothed: a hundredth of a count for each class by its share, and for each move."""
        share = emit.sum(axis=1) + 0.5
        emit = emit + 100 * (share / share.sum())[:, None]
        move = move + 1.0
        start = start + 1.0
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def runs(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences by falling length, in groups of STEP words at most."""
    order = np.argsort(-lengths, kind="stable")
    start, total = 0, 0
    for i, k in enumerate(order):
        if i > start and total + lengths[k] > STEP:
            yield order[start:i]
            start, total = i, 0
        total += lengths[k]
    if start < len(order):
        yield order[start:]


def forward(model: Model, seqs: list[np.ndarray], counts: dict | None = None) -> np.ndarray:
    """Log10 likelihood of each class sequence (none is empty), all words in turn; expected counts are added to ``counts``.

    Sequences go side by side by falling length, so those still running at a word are the first rows.
    """
    k = len(model.start)
    length = np.array([len(s) for s in seqs])
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.concatenate(seqs)
    active = np.searchsorted(-length, -np.arange(length[0]) - 1, "right")  # rows longer than t
    at = np.concatenate([[0], np.cumsum(active)])
    where = np.concatenate([first[:n] + t for t, n in enumerate(active)]) if len(active) else np.zeros(0, np.int64)
    cls = flat[where]
    b = model.emit[cls]
    alpha = np.empty((len(cls), k))
    scale = np.empty(len(cls))
    a = np.broadcast_to(model.start, (len(seqs), k)) * b[: active[0]]
    move = model.move
    for t, n in enumerate(active):
        lo = at[t]
        if t:
            a = (a[:n] @ move) * b[lo : lo + n]
        s = a.sum(axis=1)
        a = a / s[:, None]
        alpha[lo : lo + n] = a
        scale[lo : lo + n] = s
    row = np.concatenate([np.arange(n) for n in active])
    logs = np.bincount(row, weights=np.log10(scale), minlength=len(seqs))
    if counts is not None:
        beta = np.ones((0, k))
        b /= scale[:, None]
        xi = np.zeros((k, k))
        gamma = alpha  # alpha is not needed after its step back
        for t in range(len(active) - 1, -1, -1):
            n, lo = active[t], at[t]
            now = np.ones((n, k))
            if len(beta):
                m = len(beta)
                ahead = beta * b[at[t + 1] : at[t + 1] + m]
                xi += alpha[lo : lo + m].T @ ahead
                now[:m] = ahead @ move.T
            beta = now
            gamma[lo : lo + n] = alpha[lo : lo + n] * now
        counts["move"] += xi * move
        counts["start"] += gamma[: active[0]].sum(axis=0)
        for j in range(k):
            counts["emit"][:, j] += np.bincount(cls, weights=gamma[:, j], minlength=len(model.emit))
    return logs


def empty_counts(k: int = STATES) -> dict:
    return {"start": np.zeros(k), "move": np.zeros((k, k)), "emit": np.zeros((N_CLASSES, k)), "log": np.zeros(1)}


def sequences(texts: list[bytes], voc: Vocabulary) -> tuple[list[np.ndarray], Words, np.ndarray, np.ndarray]:
    """Class sequence of each text with its end, and the words, their classes and counts."""
    w = Words(texts, tail=True)
    cls, count = voc.look_up(w)
    ends = np.cumsum(np.bincount(w.doc, minlength=len(texts)))
    parts = np.split(cls.astype(np.int16), ends[:-1]) if len(texts) else []
    zero = np.zeros(1, np.int16)
    return [np.concatenate([p, zero]) for p in parts], w, cls, count


def encode(docs: DataFrame, voc) -> DataFrame:
    """(key, seq): a hash of each training document, and its classes as 16-bit numbers, written once for all rounds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in groups(texts):
                seqs = sequences(texts[i:j], voc.value)[0]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([s.tobytes() for s in seqs], pa.binary())], ["key", "seq"])

    return materialize(docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(rows, "key long, seq binary"))


def _gathered(encoded: DataFrame, work) -> dict | None:
    """Counts that ``work(sequences, counts)`` adds up over all training texts; None without texts. A task sends as many numbers as the model has."""
    blocks = 64

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seqs, size = empty_counts(), [], 0
        for b in batches:
            for s in b.column(1).to_pylist():
                seqs.append(np.frombuffer(s, np.int16))
                size += len(seqs[-1])
                if size > 8 * STEP:
                    work(seqs, total)
                    seqs, size = [], 0
        if seqs:
            work(seqs, total)
        parts = np.array_split(np.concatenate([np.ravel(x) for x in total.values()]), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "v"])

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b["block"], b["v"], strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(v)
        for k, v in total.items():
            yield pd.DataFrame({"block": [k], "v": [v.tobytes()]})

    n = min(blocks, int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    got = encoded.mapInArrow(rows, "block long, v binary").repartition(n, "block").mapInPandas(summed, "block long, v binary").collect()  # as many numbers as the model has
    got = {r.block: np.frombuffer(r.v) for r in got}
    if not got:
        return None
    flat, out, at = np.concatenate([got[i] for i in range(blocks)]), {}, 0
    for name, x in empty_counts().items():
        out[name] = flat[at : at + x.size].reshape(x.shape)
        at += x.size
    return out


def expected(encoded: DataFrame, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all training texts: the next model, and the summed log10 likelihood by ``model``."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)  # N_CLASSES x STATES numbers

    def work(seqs: list[np.ndarray], total: dict) -> None:
        for group in runs(np.array([len(s) for s in seqs])):
            total["log"] += forward(sent.value, [seqs[i] for i in group], total).sum()

    got = _gathered(encoded, work)
    return (Model.of_counts(got["start"], got["move"], got["emit"]), float(got["log"][0])) if got else (model, 0.0)


def first_states(seqs: list[np.ndarray], share: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """For each text the state whose random direction its words, less the corpus's shares of them, point to most."""
    length = np.array([len(s) for s in seqs])
    sums = np.add.reduceat(lines[np.concatenate(seqs)], np.concatenate([[0], np.cumsum(length)[:-1]]))
    return np.argmax(sums - length[:, None] * (share @ lines), axis=1)


def start_model(encoded: DataFrame, share: np.ndarray, seed: int = 11) -> Model:
    """Start values from all training texts: a text gives most of its words to the state it points to, and states are sticky."""
    lines = np.random.default_rng(seed).normal(size=(N_CLASSES, STATES))
    sent = encoded.sparkSession.sparkContext.broadcast((share, lines))

    def work(seqs: list[np.ndarray], total: dict) -> None:
        for group in runs(np.array([len(s) for s in seqs])):
            some = [seqs[i] for i in group]
            state = np.repeat(first_states(some, *sent.value), [len(s) for s in some])
            words = np.bincount(np.concatenate(some).astype(np.int64) * STATES + state, minlength=N_CLASSES * STATES).reshape(-1, STATES)
            total["emit"] += LEAN * words + (1 - LEAN) / STATES * words.sum(axis=1, keepdims=True)

    got = _gathered(encoded, work) or empty_counts()
    return Model.of_counts(np.ones(STATES), 1000 * (1 + 100 * np.eye(STATES)), got["emit"])


def train(encoded: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Model:
    """Start values and all rounds from all training texts; ends early once a round gains less than SETTLED of the likelihood."""
    model, before = start_model(encoded, voc.share), None
    for _ in range(rounds):
        model, log = expected(encoded, model)
        if before is not None and log - before <= SETTLED * abs(before):
            break
        before = log
    return model


def score_documents(docs: DataFrame, words: DataFrame, voc: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((voc, model))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, model = sent.value
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in groups(texts, 1 << 21):
                seqs, w, cls, count = sequences(texts[i:j], voc)
                n = j - i
                length = np.array([len(s) for s in seqs])
                score = np.zeros(n)
                for group in runs(length):
                    score[group] = forward(model, [seqs[g] for g in group])
                seen = count >= 0
                logs = np.where(seen, np.log10(np.maximum(count, 0) + 1.0), 0.0)
                tail = cls > OWN
                score += np.bincount(w.doc[tail], weights=logs[tail] - voc.tail_log[cls[tail] - OWN - 1], minlength=n)
                base = np.bincount(w.doc, weights=logs, minlength=n) + np.log10(voc.end + 1.0) - length * voc.base_log
                known = np.bincount(w.doc[seen], minlength=n) + (voc.end > 0)
                rare = np.flatnonzero(~seen)
                u, c = w.hash[rare], None
                order = np.lexsort((u, w.doc[rare]))
                h, d = u[order], w.doc[rare][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                at = np.flatnonzero(new)
                c = np.diff(np.concatenate([at, [len(h)]]))
                lists = pa.array(np.searchsorted(d[at], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, n), pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(lists, pa.array(h[at].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(c.astype(np.int32)))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<int>"
    scored = docs.select("doc_id", "text").mapInArrow(rows, schema).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored)
    asked = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = asked.join(words.where(F.col("c") < voc.floor).select("h", "c"), "h")
    more = found.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.drop("rare", "times").join(more, "row", "left")
    gain = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score"))


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32(doc_id as text) mod 7 is 2; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2


def score_texts(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Null and empty texts are the end alone and are scored and learned from like others; repeated rows count each.
    An empty table gives an empty result; with nothing to learn from, every word is unknown and the model is its
    smoothing alone. Only doc_id and text are read. Words are known by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(~held_out())
    words, voc = vocabulary(training)
    encoded = encode(training, docs.sparkSession.sparkContext.broadcast(voc))
    model = train(encoded, voc, rounds)
    scored = score_documents(docs, words, voc, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(voc.total).cast("long").alias("train_tokens"), "base_score", "score")
