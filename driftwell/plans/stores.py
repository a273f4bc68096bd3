"""Queries: activities, normalised sessions, whole sessions around events, imports, external facts, memory, evaluation sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, external, memory
from ..runtime import materialize, scratch
from ..sources import conversations
from ..sources.tables import table
from .catalogue import Catalogue
from .similarity import _nearest

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("""WITH a AS (SELECT event_id AS id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN NULL ELSE event_type || '  of ' || user_id END AS t, CASE WHEN event_id % 4 > 0 THEN props END AS e FROM events),
b AS (SELECT id, ts, coalesce(nullif(trim(regexp_replace(t, '[ \t\n\f\r\v]+', ' ', 'g')), ''), event_type) AS title, e FROM a), c AS (SELECT id, ts, title, coalesce(trim(regexp_replace(e, '[ \t\n\f\r\v]+', ' ', 'g')), title) AS content FROM b)
SELECT 'activities:' || id AS source_id, title, content, sha256('activities|activities:' || id || '|' || strftime(ts, '%Y-%m-%d') || '|' || title || '|' || content) AS source_hash FROM c""")
def activity_records(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 3
    title = F.when(k == 0, "  ").when(k == 2, F.concat("event_type", F.lit("  of "), F.col("user_id").cast("string")))
    rows = e.select(F.col("event_id").alias("id"), F.lit(None).cast("string").alias("service"), F.to_date("ts").alias("event_at"), F.col("event_type").alias("action"), title.alias("title"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("excerpt"), F.lit(None).cast("date").alias("created_at"))
    return conversations.activities(rows).select("source_id", "title", "content", "source_hash")


@query("""WITH s AS (SELECT conv_id, count(*) AS turns, sum(contains(text, '@')::INT) > 0 AS secret, conv_id % 11 = 3 AS excluded, max(turn) < 1 AS deleted FROM conversations GROUP BY 1)
SELECT conv_id AS session_id, array_to_string(list_filter([CASE WHEN secret THEN 'secret' END, CASE WHEN excluded THEN 'excluded' END, CASE WHEN deleted THEN 'deleted' END], lambda x: x IS NOT NULL), ',') AS reasons, CASE WHEN secret OR excluded OR deleted THEN 0 ELSE turns END AS messages FROM s""")
def normalized_sessions(spark, d):
    """Sessions with why they may not be read, and how many of their messages are kept."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")
    sessions = c.groupBy("session_id").agg((F.max("turn") < 1).alias("deleted"))
    excluded = sessions.where("session_id % 11 = 3").select("session_id")
    s, m, _ = conversations.normalized(sessions, c, excluded, ["session_id", "turn", "role", "text"], F.contains("text", F.lit("@")))
    kept = m.groupBy("session_id").agg(F.count("*").alias("messages"))
    return s.join(kept, "session_id", "left").select("session_id", F.array_join("reasons", ",").alias("reasons"), F.coalesce("messages", F.lit(0)).alias("messages"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id % 500 = 0)")
def affected_context(spark, d):
    """All events of the users of every five hundredth event."""
    e = table(spark, d, "events").select("event_id", "user_id")
    return conversations.around(e, e.where("event_id % 500 = 0"), "user_id", "event_id", 1_000_000_000)


@query("SELECT 'sessions' AS name, count(DISTINCT conv_id) AS rows, 0 AS summaries FROM conversations UNION ALL SELECT 'messages', count(*), 0 FROM conversations")
def imported_generation(spark, d):
    """Two tables of a generation copied to another store, by name, with a column that the source is too old to have."""
    source, target = (scratch(spark, n) for n in ("old", "new"))
    c = table(spark, d, "conversations")
    c.groupBy("conv_id").agg(F.count("*").alias("turns")).write.parquet(f"{source}/sessions/generation=g1")
    c.select("text", "turn", "conv_id", F.lit(1).alias("internal")).write.parquet(f"{source}/messages/generation=g1")
    contract = conversations.Contract({"sessions": ("conv_id long, turns long", frozenset()), "messages": ("conv_id long, turn long, text string, summary string", frozenset({"summary"}))})
    counts = conversations.import_generation(spark, contract, source, target, "g1")
    there = {n: spark.read.parquet(f"{target}/{n}/generation=g1") for n in counts}
    summaries = there["messages"].where("summary IS NOT NULL").count()
    return spark.createDataFrame([(n, counts[n], summaries if n == "messages" else 0) for n in counts], "name string, rows long, summaries int")


FACTS = """f AS (SELECT s_suppkey AS fact_id, 'n' || s_nationkey AS source_id, CASE s_suppkey % 4 WHEN 0 THEN 'rate' WHEN 1 THEN 'price' ELSE 'note' END AS kind, CASE WHEN s_suppkey % 29 > 0 THEN s_acctbal END AS value, DATE '2024-01-01' AS valid_from, DATE '2024-01-01' + (s_suppkey % 90 - 3)::INT AS valid_to, DATE '2024-01-02' AS observed_at, DATE '2024-01-01' + (s_suppkey % 41)::INT AS ingested_at, 'r' || n_regionkey AS region, CASE WHEN s_suppkey % 37 = 0 THEN 'conflict' WHEN s_suppkey % 31 = 0 THEN 'retired' ELSE 'current' END AS lifecycle FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def _facts(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    return s.select(
        k.alias("fact_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_id"), F.when(k % 4 == 0, "rate").when(k % 4 == 1, "price").otherwise("note").alias("kind"), F.when(k % 29 > 0, F.col("s_acctbal")).alias("value"),
        day(F.lit(0)).alias("valid_from"), day(k % 90 - 3).alias("valid_to"), day(F.lit(1)).alias("observed_at"), day(k % 41).alias("ingested_at"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("region"),
        F.when(k % 37 == 0, "conflict").when(k % 31 == 0, "retired").otherwise("current").alias("lifecycle"),
    )


@query(f"""WITH {FACTS} SELECT fact_id, CASE WHEN n_nationkey IS NULL OR n_nationkey % 7 = 6 THEN 'unknown_source' WHEN n_nationkey % 5 = 4 THEN 'source_disabled' WHEN NOT (kind = 'rate' OR (kind = 'price' AND n_nationkey % 2 = 0)) THEN 'kind_not_allowed' WHEN value IS NULL THEN 'value_missing' WHEN valid_to < valid_from THEN 'window_invalid' WHEN observed_at > ingested_at THEN 'observed_after_ingest' END AS refusal FROM f LEFT JOIN nation ON 'n' || n_nationkey = source_id""")
def external_facts(spark, d):
    """Facts against the registry of their sources: what may come in and why the rest may not."""
    k = F.col("n_nationkey")
    registry = table(spark, d, "nation").where("n_nationkey % 7 <> 6").select(F.concat(F.lit("n"), k.cast("string")).alias("source_id"), (k % 5 != 4).alias("enabled"), F.when(k % 2 == 0, F.array(F.lit("rate"), F.lit("price"))).otherwise(F.array(F.lit("rate"))).alias("kinds"))
    return external.admitted(_facts(spark, d), registry).select("fact_id", "refusal")


@query(f"""WITH {FACTS}, s AS (SELECT source_id, bool_or(region <> 'r1') AS elsewhere, bool_or(lifecycle = 'conflict') AS conflict, bool_or(lifecycle <> 'current') AS other, bool_or(ingested_at > DATE '2024-02-08') AS future, bool_or(ingested_at < DATE '2024-01-04') AS stale, bool_or(valid_to < DATE '2024-02-08') AS expired, count(*) AS n FROM f WHERE fact_id % 3 = 0 GROUP BY 1), w AS (SELECT source_id, count(*) AS n FROM f WHERE fact_id % 3 = 0 OR (source_id = 'n3' AND fact_id % 3 = 1) GROUP BY 1)
SELECT w.source_id, CASE WHEN s.source_id IS NULL THEN 'missing' WHEN w.n <> s.n THEN 'drift' WHEN elsewhere THEN 'region' WHEN conflict THEN 'conflict' WHEN other THEN 'lifecycle' WHEN future THEN 'future' WHEN stale THEN 'stale' WHEN expired THEN 'expired' ELSE 'ok' END AS verdict FROM w LEFT JOIN s USING (source_id)""")
def external_policy(spark, d):
    """Snapshots of facts by source, used from one region at one time; one source's snapshot was of more facts than are there."""
    f = materialize(_facts(spark, d))
    then = external.snapshot(f.where("fact_id % 3 = 0 OR (source_id = 'n3' AND fact_id % 3 = 1)"), ["source_id"])
    now = F.lit("2024-02-08").cast("date")
    return external.policy(f.where("fact_id % 3 = 0"), ["source_id"], then, "r1", now, 35 * 86_400)



@query("""WITH x AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/[0-9]+', 1)) AS lang, regexp_extract(url, '^[a-z]+://(?:m[.]|www[.])?([a-z]+)[.]', 1) AS name FROM pages) SELECT lang, name AS project, count(*) AS mentions FROM x WHERE length(name) BETWEEN 2 AND 64 AND lang <> '' AND name NOT IN ('example') GROUP BY 1, 2""")
def project_names(spark, d):
    """Names of projects in paths made of the pages' hosts, by language."""
    p = table(spark, d, "pages")
    name = F.regexp_extract("url", r"^[a-z]+://(?:m[.]|www[.])?([a-z]+)[.]", 1)
    rows = p.select(F.lower(F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/[0-9]+", 1)).alias("lang"), F.concat(F.lit("see C:\\Users\\me\\Projects\\"), name, F.lit("\\main.py")).alias("text")).where("lang <> ''")
    return memory.projects(rows, F.col("text"), ["lang"], ["example"])


@query("""WITH m AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'current' WHEN toxic = 1 THEN 'conflict' ELSE 'expired' END AS was, CASE doc_id % 4 WHEN 0 THEN 'expire' WHEN 1 THEN 'resolve' WHEN 2 THEN 'renew' END AS action FROM labels)
SELECT doc_id AS memory_id, CASE WHEN was = 'current' AND action = 'expire' THEN 'expired' WHEN was = 'conflict' AND action = 'resolve' THEN 'current' WHEN was = 'expired' AND action = 'renew' THEN 'current' ELSE was END AS lifecycle FROM m""")
def memory_sync(spark, d):
    """Memories after lifecycle actions that were previewed; steps that aren't legal change nothing."""
    l = table(spark, d, "labels")
    memories = l.select(F.col("doc_id").alias("memory_id"), F.when(F.col("quality") == 1, "current").when(F.col("toxic") == 1, "conflict").otherwise("expired").alias("lifecycle"))
    k = F.col("doc_id") % 4
    actions = l.where(k < 3).select(F.col("doc_id").alias("memory_id"), F.when(k == 0, "expire").when(k == 1, "resolve").otherwise("renew").alias("action"))
    return memory.applied(memories, actions, memory.preview(memories, actions))


@query("""WITH h AS (SELECT doc_id, quality AS h FROM labels WHERE doc_id % 9 <> 0), j AS (SELECT doc_id, (length(text) >= 600)::INT AS j FROM documents WHERE doc_id % 5 <> 0), p AS (SELECT h, j FROM h JOIN j USING (doc_id)), a AS (SELECT count(*) AS pairs, avg((h = j)::INT) AS po, (avg(h) * avg(j) + (1 - avg(h)) * (1 - avg(j))) AS pe FROM p)
SELECT pairs, round(po, 6) AS agreement, round(pe, 6) AS expected, round((po - pe) / (1 - pe), 6) AS kappa, (SELECT count(*) FROM h WHERE doc_id NOT IN (SELECT doc_id FROM j)) AS only_human, (SELECT count(*) FROM j WHERE doc_id NOT IN (SELECT doc_id FROM h)) AS only_judge, CASE WHEN pairs < 20 THEN 'unmeasured' WHEN po >= 0.8 AND (po - pe) / (1 - pe) >= 0.6 THEN 'usable' ELSE 'weak' END AS verdict FROM a""")
def judge_calibration(spark, d):
    """A judge that goes by length beside the people's labels."""
    human = table(spark, d, "labels").where("doc_id % 9 <> 0").select("doc_id", F.col("quality").alias("label"))
    judge = table(spark, d, "documents").where("doc_id % 5 <> 0").select("doc_id", (F.length("text") >= 600).cast("int").alias("label"))
    return evaluation.calibration(human, judge, "doc_id", "label")


KNN = "SELECT a.vec_id AS query_id, b.vec_id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0"


@query(f"""WITH k AS ({KNN}), m AS (SELECT 'near' AS mode, query_id, r AS rank, vec_id, la, lb FROM k WHERE r <= 5 UNION ALL SELECT 'skip', query_id, r - 1, vec_id, la, lb FROM k WHERE r BETWEEN 2 AND 6), q AS (SELECT mode, query_id, min(CASE WHEN vec_id = query_id THEN rank END) AS first, max((la = lb)::INT) AS sourced, max((rank = 1 AND vec_id % 2 = query_id % 4 // 2)::INT) AS top FROM m GROUP BY 1, 2)
SELECT mode, count(*) AS queries, count(*) AS exact_queries, round(avg((first IS NOT NULL)::INT), 6) AS exact_hit_rate, round(avg(coalesce(1.0 / first, 0)), 6)::DOUBLE AS exact_mrr, round(avg(sourced), 6) AS source_hit_rate, round(avg(top), 6) AS preferred_top1 FROM q GROUP BY 1""")
def retrieval_sets(spark, d):
    """Two modes of vector search against what each query should find: itself, its label, and the half of the ids asked for."""
    e = table(spark, d, "embeddings")
    near = _nearest(spark, d, 6).join(e.select("vec_id", "label"), "vec_id")
    of = lambda mode, skip: near.where((F.col("rank") > skip) & (F.col("rank") <= 5 + skip)).select(F.lit(mode).alias("mode"), "query_id", (F.col("rank") - skip).alias("rank"), F.col("vec_id").alias("item"), F.col("label").cast("string").alias("source"), (F.col("vec_id") % 2).cast("string").alias("collection"))
    samples = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.array(F.col("vec_id").cast("string")).alias("items"), F.col("label").cast("string").alias("source"), F.floor(F.col("vec_id") % 4 / 2).cast("string").alias("collection"))
    return evaluation.retrieval_sets(of("near", 0).union(of("skip", 1)), samples, 5)
