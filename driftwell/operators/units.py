"""Knowledge units: exact and semantic duplicates, attachment to canonical ones, ledgers of facts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from . import graph, set_pairs, vectors

CHUNKS, CHUNK_LEAST, CHUNK_MOST = 16, 2048, 8192  # chunks that units of like subjects are dealt in, and the bounds of their size
CHUNK_BITS, CHUNK_ROWS = 512, 256  # counters of a sketch, rows of a product and pairs that are held at a time


def exact(units: DataFrame) -> DataFrame:
    """(id, representative) of (id, kind, answer): units of one kind whose answers are equal but for case and white space; the longest stands, then the least id."""
    key = F.sha2(F.concat_ws("|", "kind", F.lower(F.regexp_replace("answer", r"\s+", ""))), 256)
    keyed = units.select("id", key.alias("k"), F.length("answer").alias("n"))
    best = keyed.groupBy("k").agg(F.max_by("id", F.struct("n", (-F.col("id")).alias("minus"))).alias("representative"))
    return keyed.join(best, "k").select("id", "representative")


def semantic(found: DataFrame, embeddings: DataFrame, least: float = 0.95) -> DataFrame:
    """``exact`` with representatives of similar vectors (id, embedding) joined: the least representative of a component stands."""
    reps = found.select(F.col("representative").alias("id")).distinct()
    near = vectors.links(materialize(embeddings.join(reps, "id", "left_semi")), [least], "id").select("src", "dst")
    parts = graph.components(near).select(F.col("node").alias("representative"), "component")
    return found.join(parts, "representative", "left").select("id", F.coalesce("component", "representative").alias("representative"))


def attach(new: DataFrame, canonical: DataFrame) -> DataFrame:
    """(id, canonical, score) for units (id, kind, subject, answer) that belong to a canonical one of their kind.

    Likeness is the Jaccard similarity of 4-grams. A subject of 0.5 is needed; then an answer of 0.85, or a subject of
    0.9 with an answer of 0.6. The best by 0.4 subject + 0.6 answer is taken, ties by the least id. Units of equal
    texts are compared once. Those whose subjects reach 0.9 meet in chunks, where their answers are compared, however
    many begin alike; of the others those are compared whose answers may reach 0.85.
    """
    texts = lambda d: d.select("id", "kind", tx.bare(F.col("subject")).alias("s"), tx.bare(F.col("answer")).alias("t")).where("kind IS NOT NULL AND length(s) > 0 AND length(t) > 0")
    rows, key = texts(new), F.xxhash64("kind", "s", "t").alias("h")
    one, other = (materialize(d.groupBy("kind", "s", "t").agg(F.min("id").alias("id")).select("*", key)) for d in (rows, texts(canonical)))
    both = _alike_subjects(one, other, 0.9, 0.6).union(_alike_answers(one, other, 0.5, 0.9, 0.85))
    score = F.round(0.4 * F.col("subject") + 0.6 * F.col("answer"), 6)
    best = both.withColumn("score", score).groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("minus"))).alias("b"))
    found = rows.select("id", key).join(best.withColumnRenamed("a", "h"), "h").groupBy("id").agg(F.max("b").alias("b"))
    return found.select("id", (-F.col("b.minus")).alias("canonical"), F.col("b.score").alias("score"))


def _alike_answers(one: DataFrame, other: DataFrame, least: float, below: float, answer: float) -> DataFrame:
    """(a, b, subject, answer) of all pairs of units (id, kind, s, t, h) whose answers reach ``answer`` and whose subjects ``least``, but not ``below``: a's h and b's id."""
    of = lambda d: d.select(F.col("h").alias("id"), "kind", F.col("t").alias("g"))
    side = lambda d, ident, c, *more: d.select(F.col("h").alias(ident), F.col(c).alias(f"{c}{ident}"), *more)
    near = materialize(set_pairs.candidates(of(one), of(other), answer))
    near = set_pairs.likeness(near.join(side(one, "a", "s"), "a").join(side(other, "b", "s"), "b"), "sa", "sb", "subject")
    near = materialize(near.where((F.col("subject") >= least) & (F.col("subject") < below)))
    near = set_pairs.likeness(near.join(side(one, "a", "t"), "a").join(side(other, "b", "t", "id"), "b"), "ta", "tb", "answer")
    return near.where(F.col("answer") >= answer).select("a", F.col("id").alias("b"), "subject", "answer")


def _alike_subjects(one: DataFrame, other: DataFrame, subject: float, answer: float) -> DataFrame:
    """(a, b, subject, answer) of pairs of units (id, kind, s, t, h) whose subjects and answers reach these, a's h and b's id: for each a those of best score in a chunk.

    All units of one subject, and those it is like, are dealt in chunks of some CHUNK_LEAST to CHUNK_MOST units, so that
    one is sent to some CHUNKS chunks at most up to CHUNKS * CHUNK_MOST units of like subjects, and beyond that to more.
    """
    c = F.xxhash64("kind", "s").alias("c")
    mine, theirs = (materialize(d.groupBy("kind", "s").agg(F.count("*").alias("n")).withColumn("c", c)) for d in (one, other))
    of = lambda d: d.select(F.col("c").alias("id"), "kind", F.col("s").alias("g"))
    side = lambda d, ident: d.select(F.col("c").alias(ident), F.col("s").alias(f"s{ident}"))
    near = set_pairs.candidates(of(mine), of(theirs), subject).join(side(mine, "a"), "a").join(side(theirs, "b"), "b")
    links = materialize(set_pairs.likeness(near, "sa", "sb", "subject").where(F.col("subject") >= subject))
    chunks = lambda n: F.ceil(n / F.least(F.greatest(F.ceil(n / CHUNKS), F.lit(CHUNK_LEAST)), F.lit(CHUNK_MOST))).cast("int")
    many = links.join(theirs.select(F.col("c").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("m"))
    plan = materialize(many.join(mine.select(F.col("c").alias("a"), "n"), "a").select("a", chunks(F.col("n")).alias("x"), chunks(F.col("m")).alias("y")))
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod("h", F.col(n)).cast("int")
    left = one.select("h", "t", c).join(plan.withColumnRenamed("a", "c"), "c").select("c", dealt("x").alias("x"), to("y").alias("y"), F.lit(True).alias("left"), F.col("h").alias("id"), F.lit(0.0).alias("subject"), "t")
    right = other.select("id", "h", "t", c.alias("b")).join(links.join(plan, "a"), "b").select(F.col("a").alias("c"), to("x").alias("x"), dealt("y").alias("y"), F.lit(False).alias("left"), "id", "subject", "t")
    met = left.union(right).repartition("c", "x", "y").sortWithinPartitions("c", "x", "y", F.desc("left"))
    return met.mapInArrow(_best_answers(answer), "a long, b long, subject double, answer double")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(left, id, subject, signs, n, h) of the rows of each chunk: their sketches as 1 and -1, the numbers of their grams, and these in a row."""
    held: list[list[np.ndarray]] = []
    last = None
    for whole in batches:
        for at in range(0, whole.num_rows, set_pairs.ROWS):
            b = whole.slice(at, set_pairs.ROWS)
            left, ids, subject, c, x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in ("left", "id", "subject", "c", "x", "y"))
            row, h = set_pairs.grams(b.column("t"))
            signs = 1 - 2 * set_pairs.parity(row, h, b.num_rows, CHUNK_BITS).astype(np.int8)
            n = np.bincount(row, minlength=b.num_rows)
            end = np.concatenate([[0], np.cumsum(n)])
            cut = np.nonzero((c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[0] + 1
            for i, j in itertools.pairwise([0, *cut.tolist(), b.num_rows]):
                if held and (c[i], x[i], y[i]) != last:
                    yield [np.concatenate(k) for k in zip(*held, strict=True)]
                    held = []
                held.append([left[i:j], ids[i:j], subject[i:j], signs[i:j], n[i:j], h[end[i] : end[j]]])
                last = (c[i], x[i], y[i])
    if held:
        yield [np.concatenate(k) for k in zip(*held, strict=True)]


def _answers(left: np.ndarray, n: np.ndarray, signs: np.ndarray, h: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, others, answer): for a left row of a chunk, some of the right ones whose answers reach ``least``.

    Sketches can't differ in more places than the sets in elements; what they leave is compared in full.
    """
    low = least - 1e-6
    start, mid = np.cumsum(n) - n, int(left.sum())
    right = np.ascontiguousarray(signs[mid:].astype(np.float32).T)
    for at in range(0, mid if mid < len(left) else 0, CHUNK_ROWS):
        to = min(at + CHUNK_ROWS, mid)
        apart = (CHUNK_BITS - signs[at:to].astype(np.float32) @ right) / 2
        i, j = np.nonzero(apart <= (1 - low) / (1 + low) * (n[at:to, None] + n[None, mid:]))
        for k, own in zip(np.unique(i) + at, np.split(j + mid, np.nonzero(np.diff(i))[0] + 1), strict=False):
            mine = h[start[k] : start[k] + n[k]]
            for lo in range(0, len(own), CHUNK_ROWS):
                some = own[lo : lo + CHUNK_ROWS]
                first = np.cumsum(n[some]) - n[some]
                theirs = h[np.repeat(start[some] - first, n[some]) + np.arange(n[some].sum())]
                same = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                both = np.add.reduceat(same.astype(np.int64), first)
                answer = both / (n[k] + n[some] - both)
                if (answer >= least).any():
                    yield k, some[answer >= least], answer[answer >= least]


def _best_answers(least: float):
    """(a, b, subject, answer) of sorted rows (c, x, y, left, id, subject, t): for a left row of a chunk the right ones whose answers reach ``least`` and that may be its best."""

    def rows(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*out, strict=True)], ["a", "b", "subject", "answer"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for left, ids, subject, signs, n, h in _chunks(batches):
            for k, some, answer in _answers(left, n, signs, h, least):
                score = 0.4 * subject[some] + 0.6 * answer
                top = np.nonzero(score >= score.max() - 2e-6)[0]  # rounding may make these equal
                top = top[np.lexsort((ids[some[top]], score[top]))]
                top = top[np.diff(score[top], prepend=-1) > 0]  # of equal ones the least id
                out.append((np.full(len(top), ids[k]), ids[some[top]], subject[some[top]], answer[top]))
            if len(out) >= set_pairs.ROWS:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return best


def ledger(old: DataFrame, new: DataFrame, group: str, ident: str, fact: str) -> DataFrame:
    """(ident, action, supersedes) of new facts: noop where the group has the same text, supersede where one begins alike, else add.

    supersedes is the newest old fact of that beginning.
    """
    key = tx.fact_key(F.col(fact)).alias("k")
    known = old.select(F.col(group).alias("g"), F.sha2(fact, 256).alias("h")).distinct().withColumn("same", F.lit(True))
    latest = old.select(F.col(group).alias("g"), key, F.col(ident).alias("i")).groupBy("g", "k").agg(F.max("i").alias("supersedes"))
    rows = new.select(F.col(ident), F.col(group).alias("g"), key, F.sha2(fact, 256).alias("h")).join(known, ["g", "h"], "left").join(latest, ["g", "k"], "left")
    action = F.when(F.col("same"), "noop").when(F.col("supersedes").isNotNull(), "supersede").otherwise("add")
    return rows.select(ident, action.alias("action"), F.when(action == "supersede", F.col("supersedes")).alias("supersedes"))


def targets(new: DataFrame, existing: DataFrame, key: list[str], claim: str, ident: str) -> DataFrame:
    """(ident, verdict, target): a duplicate of the first existing row of equal key and claim, else in conflict with the last one of that key, else new."""
    by = existing.groupBy(*key).agg(F.max(ident).alias("last"))
    same = existing.groupBy(*key, claim).agg(F.min(ident).alias("first"))
    rows = new.select(ident, *key, claim).join(by, key, "left").join(same, [*key, claim], "left")
    verdict = F.when(F.col("first").isNotNull(), "duplicate").when(F.col("last").isNotNull(), "conflict").otherwise("new")
    return rows.select(ident, verdict.alias("verdict"), F.coalesce("first", "last").alias("target"))


def first_state(states: list[tuple[str, Column]], default: str) -> Column:
    """Name of the first condition that holds, in order of precedence; null conditions don't hold."""
    out = F.lit(default)
    for name, condition in reversed(states):
        out = F.when(condition, name).otherwise(out)
    return out


class GateFailed(ValueError):
    """A build isn't good enough to be served."""


def canonical(found: DataFrame, units: DataFrame) -> DataFrame:
    """(canonical_id, subject, answer, kind, confidence, lifecycle, members, reason) of ``found`` (id, representative) and units (id, kind, subject, answer, confidence, stance).

    The representative gives the texts, the least sure member the confidence. Members whose stances differ make a
    conflict. ``members`` is how many there are; which they are is what ``found`` says.
    """
    rows = found.join(units.select("id", "confidence", "stance"), "id")
    by = rows.groupBy("representative").agg(F.min("confidence").alias("confidence"), F.min("stance").alias("lo"), F.max("stance").alias("hi"), F.count("*").alias("members"))
    texts = units.select(F.col("id").alias("representative"), "kind", "subject", "answer")
    lifecycle = F.when(F.col("lo") != F.col("hi"), "conflict").otherwise("current")
    reason = F.when(F.col("members") > 1, "similar_merge").otherwise("singleton")
    return by.join(texts, "representative").select(F.col("representative").alias("canonical_id"), "subject", "answer", "kind", "confidence", lifecycle.alias("lifecycle"), "members", reason.alias("reason"))


def publish_canonical(built: DataFrame, found: DataFrame, pairs: DataFrame, store: str, producer: str, inputs: dict, seen: int, least: float = 0.8) -> str:
    """Write a canonical build as a content-addressed run and serve it, unless ``labelled_gate`` fails or can't be applied."""
    from ..sources import runs
    from .evaluation import labelled_gate

    gate = labelled_gate(found, pairs, "id", "representative", least).first()
    if gate.verdict != "passed":
        raise GateFailed(f"{gate.verdict}: recall {gate.recall}, {gate.false_merges} false merges, {gate.unresolved} pairs unresolved")
    run = runs.write(built, store, producer, inputs)
    runs.serve(built.sparkSession, store, run, seen)
    return run
