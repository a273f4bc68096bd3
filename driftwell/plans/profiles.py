"""Queries: profiles of sources, gates and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp01, wilson
from ..operators import ordered, rules
from ..sources.tables import table
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("""WITH m AS (SELECT c_mktsegment AS service, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), g AS (SELECT month FROM m GROUP BY 1 ORDER BY 1 DESC LIMIT 3)
SELECT service, sum(n)::BIGINT AS total, count(*) AS active_months, round(sum(n) / count(*), 4) AS monthly, max(n) AS peak, coalesce(max(n) FILTER (month IN (SELECT month FROM g)), 0) AS recent_peak, max(month) FILTER (month IN (SELECT month FROM g)) AS last_recent FROM m GROUP BY 1""")
def usage_months(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderdate"), table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("service"))
    m = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("service", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    last = m.select("month").distinct().orderBy(F.desc("month")).limit(3).withColumn("recent", F.lit(True))
    m = m.join(last, "month", "left")
    return m.groupBy("service").agg(F.sum("n").alias("total"), F.count("*").alias("active_months"), F.round(F.sum("n") / F.count("*"), 4).alias("monthly"), F.max("n").alias("peak"), F.coalesce(F.max(F.when(F.col("recent"), F.col("n"))), F.lit(0)).alias("recent_peak"), F.max(F.when(F.col("recent"), F.col("month"))).alias("last_recent"))


@query("SELECT lang, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'mid' ELSE 'long' END AS bucket, count(*) AS n, round(least(0.9, 0.5 + count(*) / 200.0), 4) AS confidence FROM documents GROUP BY 1, 2")
def stratified_inventory(spark, d):
    n = F.length("text")
    bucket = F.when(n < 100, "short").when(n < 500, "mid").otherwise("long")
    by = table(spark, d, "documents").groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return by.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.5 + F.col("n") / 200.0), 4))


@query("SELECT source, list_sort(list(length(text)))[count(*) // 2 + 1]::BIGINT AS upper_median, count(*) AS n FROM documents GROUP BY 1")
def upper_median(spark, d):
    by = table(spark, d, "documents").groupBy("source", F.length("text").alias("v")).agg(F.count("*").alias("c"))  # distinct lengths with counts
    upto = by.withColumn("upto", F.sum("c").over(Window.partitionBy("source").orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    return upto.groupBy("source").agg(F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v"))).cast("long").alias("upper_median"), F.max("n").alias("n"))


@query("SELECT doc_id, round(greatest(0.0, least(1.0, 0.3 * (length(text) >= 200)::INT + 0.3 * (text LIKE '%.%')::INT + 0.2 * (length(text) < 10000)::INT - 0.4 * (text LIKE '%###%')::INT - 0.4 * (text LIKE '%!!%')::INT + 0.2)), 4)::DOUBLE AS score FROM documents")
def structure_score(spark, d):
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    t = F.col("text")
    has = lambda w: F.contains(t, F.lit(w))
    score = 0.3 * yes(F.length(t) >= 200) + 0.3 * yes(has(".")) + 0.2 * yes(F.length(t) < 10000) - 0.4 * yes(has("###")) - 0.4 * yes(has("!!")) + 0.2
    return table(spark, d, "documents").select("doc_id", F.round(clamp01(score), 4).alias("score"))


@query("SELECT source, count(*) AS n, round(avg((quality IS NOT NULL)::INT), 4) AS coverage, round(1 - count(DISTINCT substring(text, 1, 120)) / count(*), 4) AS duplication, array_to_string(list_sort(list(d.doc_id) FILTER (quality IS NULL))[1:3], ',') AS sample FROM documents d LEFT JOIN labels USING (doc_id) GROUP BY 1")
def ratio_metrics(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", F.substring("text", 1, 120).alias("key"), "quality")
    by = rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").isNotNull().cast("int")), 4).alias("coverage"), F.round(1 - F.countDistinct("key") / F.count("*"), 4).alias("duplication"))
    first = rules.ranked(rows.where("quality IS NULL").select("source", "doc_id"), ["source"], [F.asc("doc_id")], 3).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return by.join(first, "source", "left")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, floor(date_diff('second', min(ts), max(ts)) / 86400)::BIGINT AS days, count(DISTINCT strftime(ts, '%Y-%m')) AS months FROM events GROUP BY 1")
def span_window(spark, d):
    span = F.unix_seconds(F.date_trunc("second", F.max("ts")).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.min("ts")).cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.floor(span / 86400).alias("days"), F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("months"))


@query("""WITH c AS (SELECT lang, count(*) AS n, sum(toxic) AS h FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, n, CASE WHEN n >= 20 THEN round(h / n, 6) END AS rate, CASE WHEN n >= 20 THEN greatest(0, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6)) END AS low FROM c""")
def cohort_summary(spark, d):
    by = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("h"))
    low, _ = wilson(F.col("h"), F.col("n"))
    enough = F.col("n") >= 20
    return by.select("lang", "n", F.when(enough, F.round(F.col("h") / F.col("n"), 6)).alias("rate"), F.when(enough, F.greatest(F.lit(0.0), F.round(low, 6))).alias("low"))


@query("""SELECT user_id, event_type, count(*) >= 3 AND count(DISTINCT strftime(ts, '%Y-%m-%d')) >= 3 AND date_diff('second', min(ts), max(ts)) >= 7 * 86400 AND avg(value) >= 20 AS ready FROM events GROUP BY 1, 2""")
def depth_readiness(spark, d):
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", c).cast("timestamp"))
    ready = (F.count("*") >= 3) & (F.countDistinct(F.date_format("ts", "yyyy-MM-dd")) >= 3) & (seconds(F.max("ts")) - seconds(F.min("ts")) >= 7 * 86400) & (F.avg("value") >= 20)
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(ready.alias("ready"))


@query("""WITH s AS (SELECT d.doc_id, quality IS NULL AS unlabelled, least(1.0, length(text) / 2000.0) AS size, (lang = 'en')::INT * 1.0 AS known, 0.35 * coalesce(toxic, 0) + 0.25 * (1 - coalesce(quality, 1)) AS penalty FROM documents d LEFT JOIN labels USING (doc_id)), t AS (SELECT doc_id, unlabelled, round(greatest(0.0, least(1.0, 0.6 * size + 0.4 * known - penalty)), 6) AS score FROM s)
SELECT doc_id, score, CASE WHEN score < 0.6 THEN 'reject' WHEN score >= 0.85 AND NOT unlabelled THEN 'approve' ELSE 'review' END AS decision FROM t""")
def promotion_score(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    penalty = 0.35 * F.coalesce("toxic", F.lit(0)) + 0.25 * (1 - F.coalesce("quality", F.lit(1)))
    raw = 0.6 * F.least(F.lit(1.0), F.length("text") / 2000.0) + 0.4 * F.when(F.col("lang") == "en", 1.0).otherwise(0.0) - penalty
    s = rows.select("doc_id", F.col("quality").isNull().alias("u"), F.round(clamp01(raw), 6).alias("score"))
    return s.select("doc_id", "score", F.when(F.col("score") < 0.6, "reject").when((F.col("score") >= 0.85) & ~F.col("u"), "approve").otherwise("review").alias("decision"))


@query("""WITH c AS (SELECT user_id, event_type, (count(*) % 2 = 0) AS allow, 2 AS depth FROM events GROUP BY 1, 2 UNION ALL SELECT user_id, NULL, (count(*) % 3 <> 0), 1 FROM events GROUP BY 1), e AS (SELECT DISTINCT user_id, event_type FROM events), m AS (SELECT e.user_id, e.event_type, c.allow, c.depth FROM e JOIN c ON c.user_id = e.user_id AND (c.event_type = e.event_type OR c.event_type IS NULL))
SELECT user_id, event_type, bool_and(allow) FILTER (depth = 2) AS allowed FROM m GROUP BY 1, 2""")
def control_overlay(spark, d):
    """The most specific control of a pair decides; among equals a denial does."""
    e = table(spark, d, "events").select("user_id", "event_type")
    exact = e.groupBy("user_id", "event_type").agg((F.count("*") % 2 == 0).alias("allow")).withColumn("depth", F.lit(2))
    wide = e.groupBy("user_id").agg((F.count("*") % 3 != 0).alias("allow")).withColumn("depth", F.lit(1))
    pairs = e.distinct()
    rows = pairs.join(exact, ["user_id", "event_type"]).unionByName(pairs.join(wide, "user_id"))
    return rows.groupBy("user_id", "event_type").agg(F.max(F.struct("depth", (~F.col("allow")).alias("denied"))).alias("x")).select("user_id", "event_type", (~F.col("x.denied")).alias("allowed"))


@query("""WITH h AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS after, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN before IS NULL OR after IS NULL OR n < 5 THEN 'inconclusive' WHEN after > before + 5 THEN 'higher' WHEN after < before - 5 THEN 'lower' ELSE 'equal' END AS verdict FROM h""")
def paired_verdict(spark, d):
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast(dict(table(spark, d, "events").dtypes)["ts"])
    by = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(~late, F.col("value"))).alias("b"), F.avg(F.when(late, F.col("value"))).alias("a"), F.sum(late.cast("int")).alias("n"))
    verdict = F.when(F.col("b").isNull() | F.col("a").isNull() | (F.col("n") < 5), "inconclusive").when(F.col("a") > F.col("b") + 5, "higher").when(F.col("a") < F.col("b") - 5, "lower").otherwise("equal")
    return by.select("user_id", verdict.alias("verdict"))


@query("""WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents), k AS (SELECT source, n, j, round_even(j * (n - 1) / 4.0, 0)::BIGINT AS i FROM (SELECT DISTINCT source, n FROM x), range(0, 5) t(j))
SELECT DISTINCT x.source, x.doc_id FROM x JOIN k ON x.source = k.source AND x.i = k.i""")
def uniform_sample(spark, d):
    """Five evenly spaced rows of each source, places rounded half to even."""
    docs = table(spark, d, "documents").select("source", "doc_id")
    sizes = docs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    x = ordered.numbered(docs, "source", [F.asc("doc_id")], "i").withColumn("i", F.col("i") - 1).join(sizes, F.col("source").eqNullSafe(F.col("s")))
    places = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.bround(j * (F.col("n") - 1) / 4.0, 0).cast("long"))
    return x.where(F.array_contains(places, F.col("i").cast("long"))).select("source", "doc_id")


@query("SELECT 'documents' AS layer, count(*) AS n, round(avg(length(text)), 4) AS mean_size, count(DISTINCT text) AS different FROM documents UNION ALL SELECT 'conversations', count(*), round(avg(length(text)), 4), count(DISTINCT text) FROM conversations UNION ALL SELECT 'pages', count(*), round(avg(length(html)), 4), count(DISTINCT html) FROM pages")
def layer_scorecard(spark, d):
    rows = None
    for name, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        # hashes, not texts, are shuffled for the distinct count
        one = table(spark, d, name).select(F.lit(name).alias("layer"), F.length(column).alias("size"), F.sha2(column, 256).alias("h"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("size"), 4).alias("mean_size"), F.countDistinct("h").alias("different"))


@query("""WITH o AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1), n AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations WHERE NOT (conv_id % 10 = 3 AND turn = 0) GROUP BY 1)
SELECT o.conv_id, CASE WHEN n.conv_id IS NULL THEN 'missing' WHEN o.roles = n.roles THEN 'equal' ELSE 'different' END AS parity FROM o LEFT JOIN n USING (conv_id)""")
def cutover_parity(spark, d):
    def roles(df):
        return df.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))

    old = table(spark, d, "conversations").select("conv_id", "turn", "role")
    new = roles(old.where("NOT (conv_id % 10 = 3 AND turn = 0)")).withColumnRenamed("roles", "now")
    parity = F.when(F.col("now").isNull(), "missing").when(F.col("roles") == F.col("now"), "equal").otherwise("different")
    return roles(old).join(new, "conv_id", "left").select("conv_id", parity.alias("parity"))


@query("SELECT count(*) AS cases, count(*) - count(DISTINCT text) AS repeated, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank, (SELECT count(DISTINCT b.item_id) FROM benchmark b JOIN documents d ON d.text = b.text) AS leaked FROM benchmark")
def dataset_audit(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text", F.sha2("text", 256).alias("h"))
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("h")).distinct().withColumn("known", F.lit(1))
    return items.join(docs, "h", "left").agg(F.count("*").alias("cases"), (F.count("*") - F.countDistinct("h")).alias("repeated"), F.sum(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1).otherwise(0)).alias("blank"), F.count("known").alias("leaked"))
