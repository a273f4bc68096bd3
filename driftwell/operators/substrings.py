"""Which texts contain which needles, by anchors that both choose alike, and an exact look at the few pairs they share.

Every WINDOW neighbouring grams of GRAM characters give the place of their least hash as an anchor. A needle of
GRAM + WINDOW - 1 characters or more holds a whole window, so the anchor of its first one is an anchor of any text
around it: texts give some 2 / (WINDOW + 1) anchors a character, a needle one. Shorter needles are looked for by all
grams of their own length, one exchange for each such length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

GRAM, WINDOW = 8, 13
LEAST = GRAM + WINDOW - 1
PIECE = 1 << 20  # characters of a text that are worked on at a time
UNIT = 1 << 15  # rows of a group whose passages are looked for together, some 70 MB


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n characters from each place."""
    h = np.zeros(max(0, len(points) - n + 1), np.uint64)
    for k in range(n):
        h = (h ^ points[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def anchors(points: np.ndarray) -> np.ndarray:
    """Distinct anchor hashes of a text's code points, none for one shorter than LEAST."""
    found = []
    for at in range(0, max(1, len(points)), PIECE):
        h = gram_hashes(points[at : at + PIECE + LEAST - 1], GRAM)
        if len(h) >= WINDOW:
            found.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _keys(rows: DataFrame, ident: str, text: str, of) -> DataFrame:
    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.iloc[lo : lo + 200]
                found = [of(_points(t)) for t in part["text"]]
                yield pd.DataFrame({"row": np.repeat(part["row"].to_numpy(), [len(f) for f in found]), "k": np.concatenate(found).view(np.int64)})

    plain = rows.select(F.col(ident).cast("long").alias("row"), F.col(text).alias("text")).where(F.col("row").isNotNull() & F.col("text").isNotNull())
    return plain.mapInPandas(keys, "row long, k long")


def contained(needles: DataFrame, texts: DataFrame, needle_id: str = "needle_id", needle: str = "needle", text_id: str = "text_id", text: str = "text") -> DataFrame:
    """(needle_id, text_id) of all pairs where the text contains the needle, both ids longs; empty and null needles and texts have none.

    Equal needles are looked for once. A needle that very many texts contain gives a row for each of them, as asked;
    what is joined before the exact look is such pairs and those of a like anchor alone.
    """
    asked = needles.select(F.col(needle_id).cast("long").alias("n"), F.col(needle).alias("s")).where(F.length("s") > 0)
    distinct = materialize(asked.groupBy("s").agg(F.min("n").alias("first")).withColumn("length", F.length("s")))
    shorts = [r.length for r in distinct.where(F.col("length") < LEAST).select("length").distinct().collect()]  # LEAST - 1 rows at most
    found = []
    for length in [None, *sorted(shorts)]:
        own = distinct.where(F.col("length") >= LEAST if length is None else F.col("length") == length)
        if length is None:
            ask = _keys(own, "first", "s", lambda p: gram_hashes(p[:LEAST], GRAM).min(keepdims=True))
            hold = _keys(texts, text_id, text, anchors)
        else:
            ask = _keys(own, "first", "s", lambda p, n=length: gram_hashes(p, n))
            hold = _keys(texts, text_id, text, lambda p, n=length: np.unique(gram_hashes(p, n)))
        found.append(hold.join(ask.withColumnRenamed("row", "first"), "k").select("first", F.col("row").alias("t")))
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.union(f)
    pairs = materialize(pairs.distinct())
    held = texts.select(F.col(text_id).cast("long").alias("t"), F.col(text).alias("x"))
    good = pairs.join(distinct, "first").join(held, "t").where(F.contains("x", "s")).select("s", "t").distinct()
    return asked.join(good, "s").select(F.col("n").alias(needle_id), F.col("t").alias(text_id)).distinct()


def best_sources(df: DataFrame, group: str, order: str, text: str, start: int, length: int, run: int) -> DataFrame:
    """(group, order, source, exact): for each row's passage, ``length`` characters from ``start`` on, the other row of its group that has it best.

    A row has a passage if its text contains it (exact is 1) or any ``run`` characters of it (0). Exact goes before
    partial, then long texts before short ones, then the least ``order``, a long that tells the rows of a group apart.
    Rows with a null and texts too short for the passage ask for none; passages that no other row has give no row.

    A group's passages and texts come together as one sorted stream, each text once: passages first, whose runs are
    held, then texts, of which the two best for each run are kept, since one may be the row that asks. A group of more
    than UNIT rows is dealt into parts by hash, and each part of passages meets each part of texts in a stream of its own.
    """
    rows = df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("o"), F.col(text).alias("x")).dropna()
    parts = F.ceil(F.count("*") / UNIT).cast("int")
    large = rows.groupBy("g").agg(parts.alias("parts")).where("parts > 1")  # a row for UNIT rows at most
    rows = rows.join(F.broadcast(large), "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("o", "x"), F.col("parts")).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    passage = F.substring("x", start, length)
    ask = rows.where(F.length(passage) == length).select("g", F.col("own").alias("p"), F.col("each").alias("t"), F.lit(0).alias("side"), "o", passage.alias("x"))
    hold = rows.where(F.length("x") >= run).select("g", F.col("each").alias("p"), F.col("own").alias("t"), F.lit(1).alias("side"), "o", "x")
    stream = ask.union(hold).repartition("g", "p", "t").sortWithinPartitions("g", "p", "t", "side")

    def keep(best: dict, key: str, n: int, o: int) -> None:
        """The two best (length, -order) of a key, of two rows."""
        new, held = (n, -o), best[key] or ()
        if new not in held and (len(held) < 2 or new > held[1]):
            other = [h for h in held if h[1] != -o]
            if len(other) == len(held) or new > next(h for h in held if h[1] == -o):
                best[key] = tuple(sorted([new, *other], reverse=True)[:2])

    def found(g, asked: list, best: dict) -> Iterator[tuple]:
        for o, s in asked:
            for exact, keys in ((1, (s,)), (0, (s[i : i + run] for i in range(length - run + 1)))):
                good = [h for k in keys for h in best[k] or () if h[1] != -o]
                if good:
                    n, source = max(good)
                    yield g, o, -source, exact, n
                    break

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, asked, best = None, [], {}
        columns = ["g", "o", "source", "exact", "n"]
        for b in batches:
            out = []
            for g, p, t, side, o, x in zip(*(b[c] for c in ("g", "p", "t", "side", "o", "x")), strict=True):
                if (g, p, t) != at:
                    if at is not None:
                        out += found(at[0], asked, best)
                    at, asked, best = (g, p, t), [], {}
                if side == 0:
                    asked.append((o, x))
                    for k in (x, *(x[i : i + run] for i in range(length - run + 1))):
                        best.setdefault(k)
                elif best:
                    for i in range(len(x) - run + 1):
                        if (k := x[i : i + run]) in best:
                            keep(best, k, len(x), o)
                            if (k := x[i : i + length]) in best:
                                keep(best, k, len(x), o)
            yield pd.DataFrame(out, columns=columns)
        if at is not None:
            yield pd.DataFrame(list(found(at[0], asked, best)), columns=columns)

    hits = stream.mapInPandas(search, f"g {rows.schema['g'].dataType.simpleString()}, o long, source long, exact long, n long")
    place = F.struct("exact", "n", (-F.col("source")).alias("first"))
    by = hits.groupBy("g", "o").agg(F.max_by("source", place).alias("source"), F.max("exact").alias("exact"))
    return by.select(F.col("g").alias(group), F.col("o").alias(order), "source", "exact")
