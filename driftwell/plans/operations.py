"""Queries: sealed texts, review pairs, binary messages, outbox, noise, runs, scoped overwrites, canonical builds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import redaction
from ..functions import text as tx
from ..operators import evaluation, incremental, noise, pairs, units
from ..runtime import materialize, scratch
from ..sources import runs, wire
from ..sources.tables import table
from ..streaming import outbox
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query()
def sealed_texts(spark, d):
    """Documents that hold secrets or personal data: the sealed text, and how many spans of each kind; tested against a plain reading of the rules."""
    sealed = redaction.sealed(F.col("text"), "fingerprint", key=b"driftwell")
    rows = table(spark, d, "documents").select("doc_id", sealed.alias("s")).where(F.size("s.kinds") > 0)
    return rows.select("doc_id", F.col("s.text").alias("text"), F.size("s.kinds").alias("n"), F.array_join(F.array_sort(F.array_distinct("s.kinds")), ",").alias("kinds"))


@query()
def review_pairs(spark, d):
    """Of each conversation the two turns that are most alike in words without being nearly the same text."""
    return pairs.best_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT event_id, user_id, event_type, ts, json_extract(props, '$.k')::BIGINT AS k FROM events")
def wire_fields(spark, d):
    """Events written as binary messages, one inside the other, and read back without a schema."""

    @F.pandas_udf("binary")
    def message(event: pd.Series, user: pd.Series, kind: pd.Series, at: pd.Series, k: pd.Series) -> pd.Series:
        one = lambda e, u, t, m, v: wire.encoded(1, e) + wire.encoded(2, t) + wire.encoded(3, wire.encoded(1, u) + wire.encoded(2, wire.encoded(1, m) + wire.encoded(9, v)))
        return pd.Series([one(*map(int, (e, u)), t, int(m), int(v)) for e, u, t, m, v in zip(event, user, kind, at, k, strict=True)])

    events = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = events.select("event_id", message("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")), k).alias("data"))
    f = wire.decoded(rows, "data", "event_id").where("complete")
    of = lambda path, c: F.max(F.when(F.col("path") == path, F.col(c)))
    by = f.groupBy("event_id").agg(of("3.1", "number").alias("user_id"), of("2", "text").alias("event_type"), of("3.2.1", "number").alias("m"), of("3.2.9", "number").alias("k"))
    return by.select("event_id", "user_id", "event_type", F.timestamp_micros("m").cast("timestamp_ntz").alias("ts"), "k")


def _commands(spark, d):
    """Events of a user as commands for one message: views enqueue, clicks claim, purchases and errors end a claim by its number."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "error", "fail").otherwise("ack")
    ends = action.isin("ack", "fail")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), action.alias("action"), F.lit("body").alias("digest"), F.col("event_type").alias("owner"), F.when(ends, F.pmod("event_id", F.lit(3)) + 1).alias("token"))


@query()
def outbox_states(spark, d):
    """Where each message of a log of commands stands: sent, or pending after so many claims; tested against a plain loop."""
    return outbox.settled(_commands(spark, d), lease=6 * 3_600_000)


@query("""WITH RECURSIVE c AS (SELECT user_id AS subject, date_trunc('day', ts) AS win, date_trunc('day', ts) + to_hours((user_id % 24)::INT) AS tm, event_id AS candidate, least(value / 40, 1.0) AS score, event_type AS domain, event_type || ':' || json_extract_string(props, '$.k') AS key, (user_id + 8) % 24 >= 22 OR (user_id + 8) % 24 < 7 AS quiet, ts FROM events),
v AS (SELECT *, CASE WHEN domain = 'error' THEN 'privacy_veto' WHEN candidate % 17 = 0 THEN 'evidence_veto' WHEN tm >= ts + INTERVAL 20 HOURS THEN 'expired' WHEN score < 0.2 THEN 'below_threshold' WHEN candidate % 19 = 0 THEN 'duplicate_no_material_change' END AS veto FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY tm, score DESC, candidate) AS n FROM v WHERE veto IS NULL),
r AS (SELECT DISTINCT subject, 0::BIGINT AS n, NULL::TIMESTAMP AS win, []::VARCHAR[] AS used, []::STRUCT(key VARCHAR, tm TIMESTAMP)[] AS shown, NULL::BIGINT AS candidate, NULL::VARCHAR AS verdict FROM e
UNION ALL SELECT subject, n, win, CASE WHEN verdict = 'shown' THEN list_append(used, domain) ELSE used END, CASE WHEN verdict = 'shown' THEN list_append(shown, {'key': key, 'tm': tm}) ELSE shown END, candidate, verdict
FROM (SELECT *, CASE WHEN len(list_filter(shown, lambda x: x.key = y.key AND y.tm - x.tm < INTERVAL 24 HOURS)) > 0 THEN 'cooldown_active' WHEN quiet THEN 'quiet_period' WHEN len(used) >= 3 AND score < 0.95 THEN 'global_budget_exhausted' WHEN len(list_filter(used, lambda x: x = y.domain)) >= 2 AND score < 0.95 THEN 'domain_budget_exhausted' ELSE 'shown' END AS verdict
FROM (SELECT e.subject, e.n, e.win, e.tm, e.key, e.domain, e.score, e.quiet, e.candidate, CASE WHEN e.win = r.win THEN r.used ELSE [] END AS used, r.shown FROM r JOIN e ON e.subject = r.subject AND e.n = r.n + 1) y))
SELECT subject, candidate, verdict FROM r WHERE n > 0 UNION ALL SELECT subject, candidate, veto FROM v WHERE veto IS NOT NULL""")
def noise_verdicts(spark, d):
    """Events as candidates of their user, a window being a day."""
    e = table(spark, d, "events")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    at = day + F.make_interval(hours=(F.col("user_id") % 24).cast("int"))
    rows = e.select(
        F.col("user_id").alias("subject"), day.alias("window"), at.alias("at"), F.col("event_id").alias("candidate"), F.least(F.col("value") / 40, F.lit(1.0)).alias("score"), F.lit(0.0).alias("urgency"),
        F.array("event_type").alias("domains"), F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("cooldown_key"), (F.col("event_type") == "error").alias("sensitive"),
        (F.col("event_id") % 17 != 0).alias("evidence"), F.lit(True).alias("trusted"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("expires"), (F.col("event_id") % 19 == 0).alias("repeated"), F.lit("Asia/Shanghai").alias("zone"),
    )
    return noise.evaluate(rows, noise.Policy(threshold=0.2)).select("subject", "candidate", "verdict")


@query("SELECT 'ok' AS first, count(*) AS rows, 'digest' AS after FROM events")
def run_drift(spark, d):
    """A content-addressed run of the events: whole when it is served, and told to have drifted once a row has changed."""
    store, e = scratch(spark, "runs"), table(spark, d, "events")
    run = runs.write(e, store, "events", {"table": "events"})
    first = runs.status(spark, store, run)
    runs.serve(spark, store, run, 0)
    rows = runs.serving(spark, store).count()
    least = e.agg(F.min("event_id")).first()[0]
    e.withColumn("value", F.when(F.col("event_id") == least, F.col("value") + 1).otherwise(F.col("value"))).write.mode("overwrite").parquet(f"{store}/runs/{run}")
    return spark.createDataFrame([(first, rows, ",".join(runs.drift(spark, store)))], "first string, rows long, after string")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def slot_reprojection(spark, d):
    """A store whose clicks were wrong and whose errors were missing, put right slot by slot, and its totals worked out anew where that touched them."""
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", "value")
    live = incremental.KeyedStore(spark, scratch(spark, "events"), "event_type string, user_id long, event_id long, value double", "user_id", "event_type", "event_id", 16)
    totals = incremental.KeyedStore(spark, scratch(spark, "totals"), "user_id long, n long, total double", "user_id", "user_id", "user_id", 16)
    project = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    wrong = e.where("event_type <> 'error'").withColumn("value", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value")))
    live.build(wrong)
    totals.build(project(wrong))
    touched = live.apply(spark.createDataFrame([("click",), ("error",)], "event_type string"), e)
    incremental.reprojected(live, totals, touched, project)
    return totals.rows().select("user_id", "n", F.round("total", 4).alias("total"))


KEY = r"lower(regexp_replace(text, '[ \t\n\f\r\v]+', '', 'g'))"


@query(f"""WITH x AS (SELECT doc_id, lang || '|' || {KEY} AS c, split_part(text, chr(10), 1) AS g FROM documents), n AS (SELECT c, g, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT (SELECT sum(s * (s - 1) // 2) FROM (SELECT sum(n) AS s FROM n GROUP BY c))::BIGINT AS pairs_found, (SELECT sum(s * (s - 1) // 2) FROM (SELECT sum(n) AS s FROM n GROUP BY g))::BIGINT AS pairs_true, (SELECT sum(n * (n - 1) // 2) FROM n)::BIGINT AS pairs_both)
SELECT *, CASE WHEN pairs_found > 0 THEN round(pairs_both / pairs_found, 6) ELSE 1 END::DOUBLE AS precision, CASE WHEN pairs_true > 0 THEN round(pairs_both / pairs_true, 6) ELSE 1 END::DOUBLE AS recall FROM p""")
def cluster_quality(spark, d):
    """Exact duplicates as clusters against documents of one first line, by pairs that are counted and never made."""
    docs = table(spark, d, "documents")
    found = units.exact(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("answer")))
    truth = docs.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("g"))
    return evaluation.pair_quality(found, truth, "id", "representative", "g")


@query(f"""WITH u AS (SELECT d.doc_id, sha256(lang || '|' || {KEY}) AS k, length(text) AS n, coalesce(quality, 1) AS q FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT k, arg_max(doc_id, (n, -doc_id)) AS canonical_id, min(q) AS confidence, CASE WHEN min(q) <> max(q) THEN 'conflict' ELSE 'current' END AS lifecycle, count(*) AS members FROM u GROUP BY 1)
SELECT canonical_id, split_part(text, chr(10), 1) AS subject, confidence, lifecycle, members, CASE WHEN members > 1 THEN 'similar_merge' ELSE 'singleton' END AS reason FROM r JOIN documents ON doc_id = canonical_id""")
def canonical_build(spark, d):
    """Canonical units of the documents, published through the labelled gate: first copies of one text belong together, neighbours of other texts don't."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    sure = F.coalesce("quality", F.lit(1))
    rows = materialize(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("subject"), F.col("text").alias("answer"), sure.alias("confidence"), sure.alias("stance")))
    found = materialize(units.exact(rows))
    built = materialize(units.canonical(found, rows))
    same = rows.groupBy(F.sha2("answer", 256).alias("h"), "kind").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("a", "b", F.lit(True).alias("same"))
    other = rows.select(F.col("id").alias("a"), "kind", F.length(tx.squeeze(F.col("answer"))).alias("n")).alias("x").join(rows.select((F.col("id") - 1).alias("a"), F.col("kind").alias("k"), F.length(tx.squeeze(F.col("answer"))).alias("m")), "a")
    other = other.where((F.col("kind") != F.col("k")) | (F.col("n") > 2 * F.col("m")) | (F.col("m") > 2 * F.col("n"))).select("a", (F.col("a") + 1).alias("b"), F.lit(False).alias("same"))
    store = scratch(spark, "canonical")
    units.publish_canonical(built, found, same.union(other), store, "canonical", {"table": "documents"}, 0)
    return runs.serving(spark, store).select("canonical_id", "subject", "confidence", "lifecycle", "members", "reason")
