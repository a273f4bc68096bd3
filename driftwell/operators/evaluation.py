"""Retrieval and agreement metrics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_query(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, reciprocal, dcg, ndcg) from (query_id, rank, relevant 0/1) with the ideal order of the same hits."""
    gain = F.col("relevant") / F.log2(F.col("rank") + 1.0)
    by = hits.where(F.col("rank") <= k).groupBy("query_id").agg(
        F.max("relevant").alias("hit"), F.coalesce(F.max(F.when(F.col("relevant") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("reciprocal"), F.sum(gain).alias("dcg"), F.sum("relevant").alias("n")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return by.select("query_id", "hit", "reciprocal", "dcg", F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"))


def summary(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("reciprocal"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def win_loss(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(wins, losses, ties) of b over a on the queries that both have."""
    both = a.select("query_id", F.col(metric).alias("x")).join(b.select("query_id", F.col(metric).alias("y")), "query_id")
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return both.agg(one(F.col("y") > F.col("x")).alias("wins"), one(F.col("y") < F.col("x")).alias("losses"), one(F.col("y") == F.col("x")).alias("ties"))


def kappa(a: Column, b: Column) -> list[Column]:
    """Aggregates of Cohen's kappa of two 0/1 columns: observed, expected, kappa (1 where all is expected)."""
    n = F.count("*")
    seen = F.sum(F.when(a == b, 1).otherwise(0)) / n
    pa, pb = F.avg(a), F.avg(b)
    chance = pa * pb + (1 - pa) * (1 - pb)
    return [F.round(seen, 6).alias("observed"), F.round(chance, 6).alias("expected"), F.round(F.when(chance == 1, 1.0).otherwise((seen - chance) / (1 - chance)), 6).alias("kappa")]


def bootstrap(scores: DataFrame, metric: str, rounds: int = 1000, seed: int = 1701) -> DataFrame:
    """(mean, low, high): percentile interval of the mean over resampled queries.

    Resampling is by Poisson(1) weights of each query and round, drawn from its hash, so a round is two sums that
    partitions add up; the rounds' means are ``rounds`` numbers.
    """
    draw = (F.pmod(F.xxhash64("query_id", "round", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = F.lit(0)
    for c in cuts:
        weight = weight + F.when(F.col("u") >= c, 1).otherwise(0)
    rows = scores.select("query_id", metric, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).select(metric, "round", draw).withColumn("w", weight)
    means = rows.groupBy("round").agg((F.sum(F.col("w") * F.col(metric)) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    bounds = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return scores.agg(F.avg(metric).alias("mean")).join(F.broadcast(bounds))


def exact_bootstrap(values: list[float], rounds: int = 10_000, seed: int = 1701) -> tuple[float, float]:
    """The same with whole resamples of a short list of scores, for golden sets of some hundred cases."""
    r, n = random.Random(seed), len(values)
    means = sorted(sum(r.choices(values, k=n)) / n for _ in range(rounds))
    return means[int(rounds * 0.025)], means[min(rounds - 1, int(rounds * 0.975))]


def pair_quality(found: DataFrame, truth: DataFrame, ident: str, cluster: str, group: str) -> DataFrame:
    """(pairs_found, pairs_true, pairs_both, precision, recall) of a clustering against groups known to belong together.

    Pairs are counted from the sizes of clusters, groups and what they share, so none is made: sums of n (n - 1) / 2
    as decimals. Ids that either side lacks or that have a null cluster or group count for neither. Without a pair
    that is found precision is 1, without a true one recall is.
    """
    both = found.select(ident, cluster).join(truth.select(ident, group), ident).where(F.col(cluster).isNotNull() & F.col(group).isNotNull())
    cells = both.groupBy(cluster, group).agg(F.count("*").alias("n"))
    n = F.col("n").cast("decimal(19,0)")
    pairs = F.coalesce(F.sum(n * (n - 1)), F.lit(0)).cast("decimal(38,0)") / 2
    count = lambda rows, name: rows.agg(pairs.cast("decimal(38,0)").alias(name))
    by = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n"))
    one = count(by(cluster), "pairs_found").crossJoin(count(by(group), "pairs_true")).crossJoin(count(cells, "pairs_both"))  # three rows of one
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("pairs_both").cast("double") / F.col(of).cast("double"), 6)).otherwise(1.0)
    return one.select(*(F.col(c).cast("long").alias(c) for c in ("pairs_found", "pairs_true", "pairs_both")), share("pairs_found").alias("precision"), share("pairs_true").alias("recall"))


def labelled_gate(found: DataFrame, pairs: DataFrame, ident: str, cluster: str, least: float = 0.8) -> DataFrame:
    """(resolved, unresolved, merged, recall, false_merges, verdict) for labelled pairs (a, b, same).

    A pair resolves if both ids have a cluster; an id of several clusters is merged with another if any of them is
    shared. recall is over resolved pairs that belong together; one false merge or a recall under ``least`` fails;
    without any resolved pair of that kind the gate is not_applicable.
    """
    pairs = pairs.select("a", "b", "same").distinct()
    own = lambda c: found.select(F.col(ident).alias(c), F.col(cluster).alias(f"c{c}")).where(F.col(f"c{c}").isNotNull())
    met = pairs.join(own("a"), "a").join(own("b"), "b").groupBy("a", "b", "same").agg(F.max((F.col("ca") == F.col("cb")).cast("int")).alias("m"))
    rows = pairs.join(met, ["a", "b", "same"], "left")
    one = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    there = F.col("m").isNotNull()
    by = rows.agg(one(there).alias("resolved"), one(~there).alias("unresolved"), one(F.col("same") & there).alias("_p"), one(F.col("same") & (F.col("m") == 1)).alias("merged"), one(~F.col("same") & (F.col("m") == 1)).alias("false_merges"))
    recall = F.when(F.col("_p") > 0, F.round(F.col("merged") / F.col("_p"), 6))
    verdict = F.when(F.col("false_merges") > 0, "failed").when(F.col("_p") == 0, "not_applicable").when(recall < least, "failed").otherwise("passed")
    return by.select("resolved", "unresolved", "merged", recall.alias("recall"), "false_merges", verdict.alias("verdict"))


def retrieval_sets(results: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """(mode, queries, exact_queries, exact_hit_rate, exact_mrr, source_hit_rate, preferred_top1) of results (mode, query_id, rank, item, source, collection).

    samples: (query_id, items, source, collection), what each query should find: any of the items, something of the
    source, and the collection first. A query counts for a rate only if its sample asks for that; one without
    results is a miss in every mode.
    """
    asked = samples.select("query_id", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("source").alias("_source"), F.col("collection").alias("_collection"))
    modes = results.select("mode").distinct()
    rows = results.where(F.col("rank") <= k).join(asked, "query_id")
    exact, same = F.array_contains("items", F.col("item").cast("string")), F.col("source") == F.col("_source")
    hit = rows.groupBy("mode", "query_id").agg(F.min(F.when(exact, F.col("rank"))).alias("first"), F.max(F.coalesce(same, F.lit(False)).cast("int")).alias("sourced"), F.max(F.coalesce((F.col("rank") == 1) & (F.col("collection") == F.col("_collection")), F.lit(False)).cast("int")).alias("top"))
    every = asked.crossJoin(F.broadcast(modes)).join(hit, ["mode", "query_id"], "left")  # modes are a handful of names
    wants, sourced, prefers = F.size("items") > 0, F.col("_source").isNotNull(), F.col("_collection").isNotNull()
    mean = lambda when, value: F.round(F.avg(F.when(when, F.coalesce(value, F.lit(0.0)))), 6)
    return every.groupBy("mode").agg(
        F.count("*").alias("queries"), F.sum(wants.cast("int")).alias("exact_queries"), mean(wants, F.col("first").isNotNull().cast("double")).alias("exact_hit_rate"), mean(wants, 1.0 / F.col("first")).alias("exact_mrr"),
        mean(sourced, F.col("sourced").cast("double")).alias("source_hit_rate"), mean(prefers, F.col("top").cast("double")).alias("preferred_top1"),
    )


def calibration(human: DataFrame, judge: DataFrame, ident: str, label: str, least: int = 20, agreement: float = 0.8, chance: float = 0.6) -> DataFrame:
    """(pairs, agreement, expected, kappa, only_human, only_judge, verdict) of a judge's labels beside people's.

    Labels of any number of kinds; rows with a null label are unanswered and count to the side that answered alone.
    The judge may stand in for people (usable) with ``least`` pairs, that agreement, and that kappa; else it is weak,
    or unmeasured if there are too few pairs. Kappa is null where chance alone explains everything.
    """
    h, j = (d.where(F.col(label).isNotNull()).select(ident, F.col(label).cast("string").alias(c)) for d, c in ((human, "h"), (judge, "j")))
    cells = h.join(j, ident, "full_outer").groupBy("h", "j").agg(F.count("*").alias("n"))
    both = cells.where("h IS NOT NULL AND j IS NOT NULL")
    side = lambda c: both.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(c))
    chances = side("h").join(side("j"), "k").agg(F.coalesce(F.sum(F.col("h").cast("double") * F.col("j")), F.lit(0.0)).alias("c"))
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    paired = F.col("h").isNotNull() & F.col("j").isNotNull()
    by = cells.agg(count(paired).alias("pairs"), count(F.col("h") == F.col("j")).alias("same"), count(F.col("j").isNull()).alias("only_human"), count(F.col("h").isNull()).alias("only_judge"))
    one = by.crossJoin(chances)  # one row each
    pairs = F.nullif(F.col("pairs"), F.lit(0))
    po, pe = F.col("same") / pairs, F.col("c") / (pairs * pairs)
    rows = one.select("pairs", F.round(po, 6).alias("agreement"), F.round(pe, 6).alias("expected"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"), "only_human", "only_judge")
    verdict = F.when(F.col("pairs") < least, "unmeasured").when((F.col("agreement") >= agreement) & (F.coalesce("kappa", F.lit(0.0)) >= chance), "usable").otherwise("weak")
    return rows.withColumn("verdict", verdict)
