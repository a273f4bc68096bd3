"""The best pair of rows of each group under a difference ratio, without making all pairs of a group."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from .dedup import first_of

BONUS, MOST = 0.01, 8  # what a shared word adds to a pair's likeness, and up to how many


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def ratio(x: str, y: str) -> float:
    """Twice the characters in matching blocks over all, 1 for two empty texts."""
    return SequenceMatcher(None, x, y).ratio()


def at_least(x: str, y: str, limit: float) -> bool:
    """Whether ``ratio`` is ``limit`` or more. Lengths and numbers of each character bound it, so that few pairs are matched.

    Matching ends once the blocks found and the shorter sides of the places still open can't reach the limit.
    """
    both = len(x) + len(y)
    if not both or 2 * min(len(x), len(y)) < limit * both:
        return not both and limit <= 1
    (ka, na), (kb, nb) = (np.unique(_codes(s), return_counts=True) for s in (x, y))
    _, i, j = np.intersect1d(ka, kb, return_indices=True)
    if 2 * int(np.minimum(na[i], nb[j]).sum()) < limit * both:
        return False
    matcher, total, still, todo = SequenceMatcher(None, x, y), 0, min(len(x), len(y)), [(0, len(x), 0, len(y))]
    while todo and 2 * (total + still) / both >= limit:
        alo, ahi, blo, bhi = todo.pop()
        still -= min(ahi - alo, bhi - blo)
        at, to, size = matcher.find_longest_match(alo, ahi, blo, bhi)
        total += size
        if size:
            for part in ((alo, at, blo, to), (at + size, ahi, to + size, bhi)):
                if least := min(part[1] - part[0], part[3] - part[2]):
                    still += least
                    todo.append(part)
    return 2 * (total + still) / both >= limit


def differs(x: Column, y: Column, limit: float) -> Column:
    """Whether two texts, in normal form, have a ratio under ``limit``."""

    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([not at_least(s, t, limit) for s, t in zip(a, b, strict=True)], dtype=bool)

    return run(x, y)


def _score(x: Column, y: Column) -> Column:
    shared = F.size(F.array_intersect(x, y))
    return F.when(shared > 0, tx.jaccard(x, y) + F.least(shared, F.lit(MOST)) * BONUS).otherwise(F.lit(0.0))


def best_pairs(df: DataFrame, group: str, order: str, text: str, limit: float = 0.75) -> DataFrame:
    """(group, a, b, score): of each group the pair of rows, a before b, that are most alike in words and yet differ.

    A pair's score is the Jaccard similarity of its words and BONUS for each shared one up to MOST. Pairs whose
    squeezed lower-case texts are equal or have a ratio of ``limit`` or more don't count. Of equal scores the
    greatest b stays, then the smallest a. ``order`` tells the rows of a group apart; rows with a null key or text
    are left out; a group without a pair that counts has no row.

    A group's rows of equal texts stand as one with their first and last place: of two such texts the first of one
    and the last of the other are the pair to keep. Neighbours are scored first: a group's best pair is at least as
    good as its best neighbours, which bounds the similarity that another pair needs, and only pairs that share one
    of their rarest words up to that bound are made, by word and group. Texts are matched in the order of the scores
    until a group has a pair that differs. A group in which no pair that shares a word counts takes its last row with
    the first that differs.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(order).isNotNull() & F.col(text).isNotNull())
    low = F.lower(tx.squeeze(F.col(text)))
    rows = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), low.alias("x")).groupBy("g", "x").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
    rows = materialize(rows.select("g", F.xxhash64("x").alias("k"), "lo", "hi", "x", tx.tokens(F.col("x")).alias("w")))
    by = Window.partitionBy("g", "t")
    words = rows.select("g", "k", "lo", F.size("w").alias("n"), F.explode("w").alias("t"))
    ranked = words.withColumn("c", F.count("*").over(by)).where("c > 1")

    # Neighbours by shared words: for each word of a group the row before, a bounded number of pairs for each word.
    before = F.lag("k").over(by.orderBy("lo", "k"))
    near = ranked.withColumn("p", before).where(F.col("p").isNotNull()).select("g", F.least("p", "k").alias("ka"), F.greatest("p", "k").alias("kb"))
    near = materialize(near.distinct())
    first = _first_differing(rows, _scored(rows, near), limit)
    sure = first.select("g", F.col("score").alias("sure"))

    # A pair as good as that has a Jaccard similarity of j at least, so of the m words a row doesn't have alone it shares one of the m - ceil(j n) + 1 rarest.
    own = Window.partitionBy("g", "k")
    j = F.greatest(F.coalesce("sure", F.lit(0.0)) - BONUS * MOST, F.lit(0.0))
    bounded = ranked.withColumn("place", F.row_number().over(own.orderBy("c", "t"))).withColumn("m", F.count("*").over(own)).join(sure, "g", "left").withColumn("j", j)
    prefix = bounded.where(F.col("place") <= F.col("m") - F.greatest(F.ceil(F.col("j") * F.col("n") - 1e-9), F.lit(1)) + 1).select("g", "t", "k", "n", "j")
    x, y = prefix.alias("x"), prefix.alias("y")
    on = (F.col("x.g") == F.col("y.g")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.k") < F.col("y.k"))
    sized = (F.col("x.n") >= F.col("x.j") * F.col("y.n") - 1e-9) & (F.col("y.n") >= F.col("x.j") * F.col("x.n") - 1e-9)
    rest = x.join(y, on & sized).select(F.col("x.g").alias("g"), F.col("x.k").alias("ka"), F.col("y.k").alias("kb")).distinct()
    rest = _scored(rows, rest.join(near, ["g", "ka", "kb"], "left_anti")).join(sure, "g", "left")
    rest = rest.where(F.col("sure").isNull() | (F.round("score", 9) >= F.round("sure", 9))).drop("sure")
    found = first.union(_first_differing(rows, rest, limit))

    # Without a pair that counts among those that share a word: the last row with any other, and where none of these counts any pair.
    bare = rows.join(found.select("g").distinct(), "g", "left_anti").select("g", "k", "hi")
    last = bare.groupBy("g").agg(F.max_by("k", "hi").alias("kb"))
    to_last = _scored(rows, bare.select("g", F.col("k").alias("ka")).join(last, "g").where("ka <> kb")).where("score = 0").join(last, ["g", "kb"])
    ends = _first_differing(rows, to_last, limit)
    left = bare.join(ends.select("g").distinct(), "g", "left_anti")
    l, r = left.alias("l"), left.alias("r")
    others = l.join(r, (F.col("l.g") == F.col("r.g")) & (F.col("l.k") < F.col("r.k"))).select(F.col("l.g").alias("g"), F.col("l.k").alias("ka"), F.col("r.k").alias("kb"))
    every = found.union(ends).union(_first_differing(rows, _scored(rows, others).where("score = 0"), limit))
    best = first_of(every, ["g"], [-F.round("score", 9), -F.col("b"), F.col("a")])
    return best.select(F.col("g").alias(group), "a", "b", F.round("score", 6).alias("score"))


def _scored(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(g, ka, kb, a, b, score) of pairs of texts: a row for each order in which they occur."""
    of = lambda c: rows.select("g", F.col("k").alias(f"k{c}"), F.col("w").alias(f"w{c}"), F.struct(F.col("k"), F.col("lo"), F.col("hi")).alias(c))
    both = pairs.join(of("a"), ["g", "ka"]).join(of("b"), ["g", "kb"]).select("g", "a", "b", _score(F.col("wa"), F.col("wb")).alias("score"))
    turned = lambda x, y: F.struct(F.col(f"{x}.k").alias("ka"), F.col(f"{y}.k").alias("kb"), F.col(f"{x}.lo").alias("a"), F.col(f"{y}.hi").alias("b"))
    return both.select("g", F.explode(F.array(turned("a", "b"), turned("b", "a"))).alias("p"), "score").select("g", "p.*", "score").where("a < b")


def _differing(rows: DataFrame, scored: DataFrame, limit: float) -> DataFrame:
    of = lambda c: rows.select("g", F.col("k").alias(f"k{c}"), F.col("x").alias(f"x{c}"))
    both = scored.join(of("a"), ["g", "ka"]).join(of("b"), ["g", "kb"])
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # matching takes far longer than its bytes tell
    return both.repartition(tasks, "g", "ka", "kb").where(differs(F.col("xa"), F.col("xb"), limit)).select(*scored.columns)


def _first_differing(rows: DataFrame, scored: DataFrame, limit: float) -> DataFrame:
    """Of each group the best of the scored pairs that differ: the first one is matched, then eight times as many of each group still without."""
    key = F.struct((-F.round("score", 9)).alias("s"), (-F.col("b")).alias("b"), "a", "ka", "kb")
    left, take, found = materialize(scored.withColumn("o", key)), 1, None
    while True:
        place = F.row_number().over(Window.partitionBy("g").orderBy("o"))
        top = materialize(left.withColumn("r", place).where(F.col("r") <= take).drop("r"))
        good = materialize(first_of(_differing(rows, top, limit), ["g"], [F.col("o")]))
        found = good if found is None else found.union(good)
        still = top.groupBy("g").agg(F.max("o").alias("cut")).join(good.select("g"), "g", "left_anti")
        left = materialize(left.join(still, "g").where(F.col("o") > F.col("cut")).drop("cut"))
        if left.isEmpty():
            return found.drop("o")
        take *= 8
