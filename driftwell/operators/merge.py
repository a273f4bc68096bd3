"""Merge layers over vectors and texts: true duplicates, topics, their summaries and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from . import dedup, graph, vectors

PART, PROBES = 2048, 16  # rows of a cluster that a task compares with its probes, and how many of these are the smallest and others


def _linked(df: DataFrame, *levels: float) -> list[DataFrame]:
    """For each of ``levels`` (id, cluster): components of vectors with a cosine of that or more; one pass over the vectors."""
    found = materialize(vectors.links(df, list(levels), "id", "embedding"))
    parts = [graph.components(found.where(F.col("level") == level)) for level in levels]
    return [p.select(F.col("node").alias("id"), F.col("component").alias("cluster")) for p in parts]


def _grams(text: Column) -> Column:
    return F.array_distinct(F.transform(tx.ngrams(text), lambda g: F.xxhash64(g)))


def _alone(sets: DataFrame, probes: DataFrame, least: float) -> DataFrame:
    """(cluster, id) of ``probes`` (cluster, id, g) without a peer among the rows of ``sets`` (cluster, id, g).

    A cluster's rows are dealt in parts and its probes sent to each, so a large cluster is many tasks' work.
    """
    parts = sets.groupBy("cluster").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    of = sets.join(parts, "cluster").select("cluster", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("other"), F.col("g").alias("h"))
    ask = probes.join(parts, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "g")
    m, n = F.size("g"), F.size("h")
    sized = (F.col("id") != F.col("other")) & (m >= least * n) & (n >= least * m) & (m > 0)
    common = F.size(F.array_intersect("g", "h"))
    peers = ask.join(of, ["cluster", "part"]).where(sized).where(common >= least * (m + n - common)).select("id").distinct()
    return probes.select("cluster", "id").join(peers, "id", "left_anti").select("cluster", "id")


def _all_have_peers(texts: DataFrame, clusters: DataFrame, grams: str, least: float) -> DataFrame:
    """Of ``clusters`` (cluster) those in which every row of texts (id, cluster, grams) has another one with a Jaccard similarity of ``least`` or more.

    Rows of equal sets are each other's peers. Of the others one without a peer puts its cluster down, so a few of
    each cluster, the smallest sets and some by hash, are compared with all of it first; only clusters that are
    still open are joined as a whole.
    """
    sets = materialize(texts.join(clusters, "cluster", "left_semi").select("cluster", "id", F.col(grams).alias("g"), F.xxhash64(F.array_sort(grams)).alias("h")))
    copied = sets.where(F.size("g") > 0).groupBy("cluster", "h").agg(F.count("*").alias("c")).where("c > 1").select("cluster", "h")
    singles = sets.join(copied, ["cluster", "h"], "left_anti")
    small = F.row_number().over(Window.partitionBy("cluster").orderBy(F.size("g"), "id"))
    some = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    slim = singles.select("cluster", "id", F.size("g").alias("n"), "g")
    first = slim.withColumn("p", small).where(F.col("p") <= PROBES).select("cluster", "id", "g")
    more = slim.withColumn("p", some).where(F.col("p") <= PROBES).select("cluster", "id", "g")
    probes = materialize(first.union(more).dropDuplicates(["id"]))
    down = materialize(_alone(sets, probes, least).select("cluster").distinct())
    open_ = materialize(sets.join(down, "cluster", "left_anti"))
    left = open_.join(copied, ["cluster", "h"], "left_anti").join(probes.select("id"), "id", "left_anti").select("id", "cluster")
    own = F.transform("g", lambda g: F.xxhash64("cluster", g))  # so only members of one cluster meet
    asked = open_.join(left.select("cluster").distinct(), "cluster", "left_semi").select("id", own.alias("s"))
    near = dedup.similar_sets(asked, "id", "s", least)
    peers = near.where(F.col("common") >= least * (F.col("m") + F.col("n") - F.col("common"))).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    fallen = left.join(peers, "id", "left_anti").select("cluster").distinct()
    return materialize(open_.select("cluster").distinct().join(fallen, "cluster", "left_anti"))


def layers(df: DataFrame, duplicate: float = 0.97, topic: float = 0.88, raw: float = 0.8, skeleton: float = 0.75, kinds: float = 0.5, most: int = 50) -> DataFrame:
    """(id, layer, cluster) of rows (id, embedding, text): L1 true duplicates, L2 topics, structural groups, single rows.

    A component at ``duplicate`` is L1 if each member has a peer by its raw 4-grams and one by its skeleton's, and
    different skeletons are less than ``kinds`` of its members; one failure puts the whole component down. L2 are the
    components at ``topic`` over all rows less the L1 members, so rows may be linked through removed ones; more than
    ``most`` that are left are structural. cluster is the component's least id, null for single rows.
    """
    df = materialize(df.select("id", "embedding", "text"))
    members, topics = _linked(df, duplicate, topic)
    members = materialize(members)
    texts = materialize(df.join(members, "id").select("id", "cluster", "text", F.sha2(tx.skeleton(F.col("text")), 256).alias("skeleton")))
    good = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("skeleton").alias("d")).where(F.col("d") < kinds * F.col("n")).select("cluster")
    good = materialize(good)
    for grams, least in ((_grams(F.col("text")), raw), (_grams(tx.skeleton(F.col("text"))), skeleton)):
        good = _all_have_peers(texts.select("id", "cluster", grams.alias("g")), good, "g", least)
    first = materialize(members.join(good, "cluster", "left_semi").select("id", F.lit("L1").alias("layer"), "cluster"))
    rest = topics.join(first, "id", "left_anti")
    sizes = rest.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2")
    second = rest.join(sizes, "cluster").select("id", F.when(F.col("n") > most, "structural").otherwise("L2").alias("layer"), "cluster")
    both = materialize(first.unionByName(second))
    return df.select("id").join(both, "id", "left").select("id", F.coalesce("layer", F.lit("single")).alias("layer"), "cluster")


def report(found: DataFrame) -> DataFrame:
    """One row of ``layers``: n, merged, clusters, saved, effective, compression; structural and single rows stay unmerged."""
    merged = F.col("layer").isin("L1", "L2")
    by = found.agg(F.count("*").alias("n"), F.sum(merged.cast("int")).alias("merged"), F.countDistinct(F.when(merged, F.struct("layer", "cluster"))).alias("clusters"))
    saved = F.col("merged") - F.col("clusters")
    return by.select("n", "merged", "clusters", saved.alias("saved"), (F.col("n") - saved).alias("effective"), F.round(saved / F.col("n"), 4).alias("compression"))


def earliest(found: DataFrame, by: str, at: Column, ident: str) -> DataFrame:
    """(by, representative): the earliest row of each group; one without a time comes last, ties by id."""
    return found.groupBy(by).agg(F.min_by(ident, F.struct(F.coalesce(at, F.lit("9999")), F.col(ident))).alias("representative"))


def titles(found: DataFrame, by: str, ident: str, title: str, most: int = 5) -> DataFrame:
    """(by, titles): the first ``most`` different titles of each group by id, and how many more there are."""
    first = found.groupBy(by, title).agg(F.min(ident).alias("i"))
    ranked = first.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("i", F.col(title).alias("t")))).alias("s"))
    more = F.size("s") - most
    return ranked.select(by, F.concat(F.array_join(F.transform(F.slice("s", 1, most), lambda x: x["t"]), " / "), F.when(more > 0, F.concat(F.lit(" ...(+"), more.cast("string"), F.lit(")"))).otherwise("")).alias("titles"))


def clusters(df: DataFrame, least: float = 0.92, size: int = 2) -> DataFrame:
    """(cluster, n, mean_similarity) of rows (id, embedding): components of ``size`` or more.

    The mean over all pairs of members comes from the length of the sum of their unit vectors; no pairs are made.
    """
    df = materialize(df.select("id", "embedding"))
    members = materialize(_linked(df, least)[0])
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v))
    flat = df.join(members, "id").select("cluster", norm.alias("norm"), F.posexplode("embedding").alias("i", "v")).select("cluster", "i", (F.col("v").cast("double") / F.col("norm")).alias("v"))
    sums = flat.groupBy("cluster", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return sums.where(F.col("n") >= size).select("cluster", "n", F.round((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_similarity"))
