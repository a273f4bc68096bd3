"""Queries: scoring rules, decisions, incremental gates and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation, incremental, ledger, units
from ..sources.tables import table
from .catalogue import Catalogue
from .similarity import KNN, _nearest

CATALOGUE = Catalogue()
query = CATALOGUE.query

DAY = lambda c: F.date_format(c, "yyyy-MM-dd")


def _events(spark, d):
    return table(spark, d, "events")


# --- rules


@query("SELECT user_id, CASE WHEN errors >= 20 AND errors > 0.25 * n THEN 'error_rate' WHEN spread > 150 THEN 'volatile' ELSE 'none' END AS risk FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) - min(value) AS spread FROM events GROUP BY 1)")
def risk_rules(spark, d):
    by = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"), (F.max("value") - F.min("value")).alias("spread"))
    risk = units.first_state([("error_rate", (F.col("errors") >= 20) & (F.col("errors") > 0.25 * F.col("n"))), ("volatile", F.col("spread") > 150)], "none")
    return by.select("user_id", risk.alias("risk"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_changes(spark, d):
    """Changes of a window, both ends in it, the newest first."""
    e = _events(spark, d)
    bound = lambda t: F.lit(t).cast(dict(e.dtypes)["ts"])
    return e.where((F.col("ts") >= bound("2024-01-10 00:00:00")) & (F.col("ts") <= bound("2024-01-12 00:00:00"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("""WITH s AS (SELECT user_id, event_type, max(0.5 + least(0.3, value / 400)) AS top FROM events GROUP BY 1, 2) SELECT user_id, round(sum(top), 6) AS recall, count(*) AS signals FROM s GROUP BY 1""")
def recall_signals(spark, d):
    """A signal's base and a bounded weight, the best of each signal, summed."""
    best = _events(spark, d).groupBy("user_id", "event_type").agg(F.max(0.5 + F.least(F.lit(0.3), F.col("value") / 400)).alias("top"))
    return best.groupBy("user_id").agg(F.round(F.sum("top"), 6).alias("recall"), F.count("*").alias("signals"))


@query("""WITH f AS (SELECT user_id, count(*) AS n, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS days, count(DISTINCT event_type) AS kinds, count(*) FILTER (event_type = 'error' AND value > 100) AS against FROM events GROUP BY 1),
s AS (SELECT user_id, CASE WHEN n >= 60 THEN 1.5 WHEN n >= 20 THEN 1.0 ELSE 0.4 END + CASE WHEN days >= 25 THEN 1.2 WHEN days >= 10 THEN 0.8 ELSE 0.2 END + CASE WHEN kinds >= 5 THEN 1.0 ELSE 0.5 END - least(against, 2) * 0.35 AS score FROM f)
SELECT user_id, round(score, 4)::DOUBLE AS score, CASE WHEN score >= 3.4 THEN 'deep' WHEN score >= 2.5 THEN 'solid' WHEN score >= 1.6 THEN 'hint' ELSE 'none' END AS level FROM s""")
def insight_levels(spark, d):
    """Step functions of support less a bounded penalty for contradictions, and the level that it reaches."""
    f = _events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(DAY("ts")).alias("days"), F.countDistinct("event_type").alias("kinds"), F.sum(((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int")).alias("against"))
    step = lambda c, a, b: F.when(F.col(c) >= a[0], a[1]).when(F.col(c) >= b[0], b[1])
    raw = step("n", (60, 1.5), (20, 1.0)).otherwise(0.4) + step("days", (25, 1.2), (10, 0.8)).otherwise(0.2) + F.when(F.col("kinds") >= 5, 1.0).otherwise(0.5) - F.least("against", F.lit(2)) * 0.35
    s = f.select("user_id", F.round(raw, 4).alias("score"))
    level = units.first_state([("deep", F.col("score") >= 3.4), ("solid", F.col("score") >= 2.5), ("hint", F.col("score") >= 1.6)], "none")
    return s.select("user_id", "score", level.alias("level"))


@query("""WITH h AS (SELECT user_id, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS before, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS after, count(*) FILTER (event_type = 'error' AND value > 120) AS limits FROM events GROUP BY 1)
SELECT user_id, CASE WHEN limits > 0 OR before IS NULL OR after IS NULL THEN 'inconclusive' WHEN after >= before * 1.1 THEN 'increase' WHEN after <= before * 0.9 THEN 'decrease' ELSE 'maintain' END AS outcome FROM h""")
def outcomes(spark, d):
    """What became of a measure; any limitation makes it inconclusive."""
    e = _events(spark, d)
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast(dict(e.dtypes)["ts"])
    h = e.groupBy("user_id").agg(F.avg(F.when(~late, F.col("value"))).alias("b"), F.avg(F.when(late, F.col("value"))).alias("a"), F.sum(((F.col("event_type") == "error") & (F.col("value") > 120)).cast("int")).alias("limits"))
    outcome = units.first_state([("inconclusive", (F.col("limits") > 0) | F.col("b").isNull() | F.col("a").isNull()), ("increase", F.col("a") >= F.col("b") * 1.1), ("decrease", F.col("a") <= F.col("b") * 0.9)], "maintain")
    return h.select("user_id", outcome.alias("outcome"))


@query("""WITH f AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, max(ts) AS newest, avg(value) AS mean FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n < 50 THEN 'abstain_evidence' WHEN kinds < 5 THEN 'abstain_variety' WHEN newest < TIMESTAMP '2024-01-30' THEN 'abstain_stale' WHEN mean > 52 THEN 'recommend' ELSE 'abstain_effect' END AS verdict FROM f""")
def recommendations(spark, d):
    """A recommendation, or the first reason in a fixed order to abstain from one."""
    e = _events(spark, d)
    f = e.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("newest"), F.avg("value").alias("mean"))
    verdict = units.first_state([("abstain_evidence", F.col("n") < 50), ("abstain_variety", F.col("kinds") < 5), ("abstain_stale", F.col("newest") < F.lit("2024-01-30 00:00:00").cast(dict(e.dtypes)["ts"])), ("recommend", F.col("mean") > 52)], "abstain_effect")
    return f.select("user_id", verdict.alias("verdict"))


@query("SELECT user_id, event_id, (event_type = 'error' AND value > 20 AND NOT coalesce(ts < lag(ts) OVER w + INTERVAL 24 HOUR, false)) AS sent FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def notice_cooldown(spark, d):
    """Notices go out unless a row of that user came less than a day before."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = _events(spark, d).where("event_type = 'error'").withColumn("before", before)
    return rows.select("user_id", "event_id", ((F.col("value") > 20) & ~F.coalesce(F.col("ts") < F.col("before") + F.expr("INTERVAL 24 HOURS"), F.lit(False))).alias("sent"))


@query("SELECT event_type, max(ts) AS last_seen, count(*) AS n, sum(('0x' || substring(md5(event_id || '|' || value::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substring(md5(event_id || '|' || value::VARCHAR), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM (SELECT event_type, ts, event_id, round(value)::BIGINT AS value FROM events) GROUP BY 1")
def source_digests(spark, d):
    """Governance data of each source: when it was last seen, and a digest that any order of its rows gives."""
    e = _events(spark, d).withColumn("value", F.round("value").cast("long"))
    return e.groupBy("event_type").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"), ledger.hash_sum(F.col("event_id"), F.col("value")).alias("digest"))


@query("SELECT source, count(*) AS n, sum(('0x' || substring(md5(doc_id::VARCHAR), 1, 15))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substring(md5(doc_id::VARCHAR), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY 1")
def id_digests(spark, d):
    """Order-free digest of each source's ids: sums that partitions add up, whatever a source's size."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), ledger.hash_sum(F.col("doc_id")).alias("digest"))


@query("""WITH b AS (SELECT 'text' AS family, doc_id AS id, row_number() OVER (ORDER BY doc_id) AS r FROM documents WHERE contains(lower(text), 'token') UNION ALL SELECT 'label', doc_id, row_number() OVER (ORDER BY doc_id) FROM labels WHERE toxic = 1 UNION ALL SELECT 'turn', conv_id, row_number() OVER (ORDER BY conv_id) FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY family, r) AS k FROM b WHERE r <= 12) SELECT id, family, row_number() OVER (ORDER BY r, family, id) AS place FROM o WHERE k = 1""")
def evidence_bundle(spark, d):
    """Twelve rows of each of three families, an id once, interleaved by their places."""
    docs = table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("token"))).select("doc_id")
    families = {"text": docs, "label": table(spark, d, "labels").where("toxic = 1").select("doc_id"), "turn": table(spark, d, "conversations").where("role = 'system'").select("conv_id").distinct()}
    rows = None
    for name, f in families.items():  # at most twelve rows of each
        top = f.toDF("id").orderBy("id").limit(12).withColumn("r", F.row_number().over(Window.orderBy("id"))).withColumn("family", F.lit(name))
        rows = top if rows is None else rows.union(top)
    one = rows.groupBy("id").agg(F.min(F.struct("family", "r")).alias("x")).select("id", "x.family", "x.r")
    return one.select("id", "family", F.row_number().over(Window.orderBy("r", "family", "id")).cast("long").alias("place"))


@query("""WITH c AS (SELECT doc_id AS id, CASE WHEN quality IS NULL THEN NULL ELSE lower(source) || ':' || quality END AS claim FROM documents LEFT JOIN labels USING (doc_id)) SELECT id, claim, sha256(id || '|' || claim) AS candidate_id FROM c WHERE claim IS NOT NULL""")
def normal_candidates(spark, d):
    """Candidates with evidence, each with an id that its content gives."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where("quality IS NOT NULL")
    claim = F.concat(F.lower("source"), F.lit(":"), F.col("quality").cast("string"))
    return rows.select(F.col("doc_id").alias("id"), claim.alias("claim")).select("id", "claim", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "claim"), 256).alias("candidate_id"))


@query("""WITH c AS (SELECT event_id, event_type, user_id, [event_id, event_id + 1] AS refs, value FROM events), k AS (SELECT event_id FROM events WHERE event_type <> 'error')
SELECT event_id, CASE WHEN value < 1 THEN 'schema_value' WHEN event_type = 'signup' THEN 'schema_kind' WHEN event_id NOT IN (SELECT event_id FROM k) OR (event_id + 1) NOT IN (SELECT event_id FROM k) THEN 'evidence_refs' ELSE 'ok' END AS verdict FROM c""")
def claim_checks(spark, d):
    """Claims by the first check that fails: fields, kind, references outside the allowed evidence."""
    e = _events(spark, d)
    allowed = e.where("event_type <> 'error'").select(F.col("event_id").alias("ref")).withColumn("there", F.lit(1))
    refs = e.select("event_id", F.explode(F.array("event_id", F.col("event_id") + 1)).alias("ref")).join(allowed, "ref", "left").groupBy("event_id").agg((F.count("there") == F.count("*")).alias("known"))
    verdict = units.first_state([("schema_value", F.col("value") < 1), ("schema_kind", F.col("event_type") == "signup"), ("evidence_refs", ~F.col("known"))], "ok")
    return e.select("event_id", "event_type", "value").join(refs, "event_id").select("event_id", verdict.alias("verdict"))


@query("SELECT count(*) AS total, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS months, (SELECT array_to_string(list(source ORDER BY n DESC, source)[1:8], ',') FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)) AS top_sources, (SELECT round(count(*) / (SELECT count(*) FROM documents), 3) FROM labels) AS labelled FROM (SELECT strftime(ts, '%Y-%m') AS month FROM events)")
def profile_statistics(spark, d):
    """Totals, range of months, the eight largest sources and the labelled share: one row."""
    by = _events(spark, d).agg(F.count("*").alias("total"), F.min(F.date_format("ts", "yyyy-MM")).alias("first_month"), F.max(F.date_format("ts", "yyyy-MM")).alias("last_month"), F.countDistinct(F.date_format("ts", "yyyy-MM")).alias("months"))
    top = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(8)
    names = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "source"))), lambda x: x["source"]), ",").alias("top_sources"))
    share = table(spark, d, "labels").agg(F.count("*").alias("l")).join(F.broadcast(table(spark, d, "documents").agg(F.count("*").alias("n")))).select(F.round(F.col("l") / F.col("n"), 3).alias("labelled"))
    return by.join(F.broadcast(names)).join(F.broadcast(share))


# --- incremental work


def _feed(spark, d):
    now = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    prior = now.where("doc_id % 6 <> 1").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))).union(now.where("doc_id % 9 = 2").select((-F.col("doc_id")).alias("doc_id"), "source", "n_chars"))
    return incremental.delta(now, prior, ["doc_id"], ["source", "n_chars"])


FEED = "f AS (SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'added' WHEN doc_id % 5 = 0 THEN 'changed' END AS change FROM documents WHERE doc_id % 6 = 1 OR doc_id % 5 = 0 UNION ALL SELECT -doc_id, 'removed' FROM documents WHERE doc_id % 9 = 2)"


@query(f"WITH {FEED} SELECT doc_id, change, CASE WHEN change = 'removed' THEN 'withdraw' ELSE 'prepare' END AS work FROM f WHERE doc_id > -100 ORDER BY doc_id LIMIT 100")
def feed_page(spark, d):
    """A page of the change feed after a cursor."""
    return ledger.feed_page(_feed(spark, d), ["doc_id"], (-100,), 500)


@query("WITH a AS (SELECT event_type, max(ts) AS active FROM events WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT event_type, max(ts) AS candidate FROM events WHERE event_id % 3 = 0 AND event_type <> 'view' GROUP BY 1) SELECT event_type, active, candidate, CASE WHEN candidate IS NULL THEN 'missing' WHEN active IS NULL THEN 'new' WHEN candidate < active THEN 'regressed' ELSE 'ok' END AS status FROM a FULL JOIN c USING (event_type)")
def watermark_check(spark, d):
    e = _events(spark, d)
    return ledger.watermarks(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0 AND event_type <> 'view'"), "event_type", "ts")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_unprocessed(spark, d):
    """What is left to do of the documents: those not yet processed, here those without a good label."""
    return ledger.unprocessed(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("WITH a AS (SELECT source, sum(('0x' || substring(md5(doc_id || '|' || n_chars), 1, 15))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substring(md5(doc_id || '|' || n_chars), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS digest FROM documents GROUP BY 1), b AS (SELECT source, sum(('0x' || substring(md5(doc_id || '|' || n_chars), 1, 15))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substring(md5(doc_id || '|' || n_chars), 16, 15))::BIGINT::HUGEINT)::VARCHAR AS approved FROM documents WHERE doc_id % 97 <> 3 GROUP BY 1) SELECT source, CASE WHEN digest = approved THEN 'approved' ELSE 'stale' END AS status FROM a LEFT JOIN b USING (source)")
def baseline_approvals(spark, d):
    """An approval holds while the digest of what was approved is the source's digest."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    digest = lambda df, name: df.groupBy("source").agg(ledger.hash_sum(F.col("doc_id"), F.col("n_chars")).alias(name))
    both = digest(docs, "digest").join(digest(docs.where("doc_id % 97 <> 3"), "approved"), "source", "left")
    return both.select("source", F.when(F.col("digest") == F.col("approved"), "approved").otherwise("stale").alias("status"))


@query("SELECT 'null_key' AS rule, count(*) AS violations FROM documents WHERE doc_id IS NULL UNION ALL SELECT 'repeated_key', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan_label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'size', count(*) FROM documents WHERE n_chars <> length(text)")
def invariant_gate(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return ledger.violations({
        "null_key": docs.where("doc_id IS NULL"), "repeated_key": docs.groupBy("doc_id").count().where("count > 1"), "orphan_label": labels.join(docs, "doc_id", "left_anti"), "size": docs.where(F.col("n_chars") != F.length("text")),
    })


@query("""WITH RECURSIVE w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, (event_id % 5)::BIGINT AS expected, event_type || (event_id % 4) AS token FROM events),
r AS (SELECT user_id, event_id, i, CASE WHEN expected = 0 THEN 'applied' ELSE 'stale' END AS verdict, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS version, CASE WHEN expected = 0 THEN [token] ELSE [] END AS seen FROM w WHERE i = 1
UNION ALL SELECT w.user_id, w.event_id, w.i, CASE WHEN list_contains(seen, token) THEN 'replay' WHEN expected = version THEN 'applied' ELSE 'stale' END, CASE WHEN NOT list_contains(seen, token) AND expected = version THEN version + 1 ELSE version END, CASE WHEN NOT list_contains(seen, token) AND expected = version THEN list_append(seen, token) ELSE seen END FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + 1) SELECT user_id, event_id, verdict FROM r""")
def optimistic_writes(spark, d):
    """Writes with an expected version and an idempotency token: applied, replayed or stale."""
    rows = _events(spark, d).select("user_id", "event_id", (F.col("event_id") % 5).alias("expected"), F.concat("event_type", (F.col("event_id") % 4).cast("string")).alias("token"))
    return ledger.appended(rows, "user_id", "event_id", "expected", "token")


LEGAL = {("draft", "signup"): "open", ("open", "view"): "review", ("review", "click"): "approved", ("review", "error"): "open", ("approved", "purchase"): "closed", ("approved", "error"): "review"}


@query("WITH RECURSIVE w AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), m(s, c, t) AS (VALUES " + ", ".join(f"('{a}', '{c}', '{b}')" for (a, c), b in LEGAL.items()) + """),
r AS (SELECT w.user_id, i, coalesce(t, 'draft') AS state, (t IS NOT NULL)::BIGINT AS applied, (t IS NULL)::BIGINT AS refused FROM w LEFT JOIN m ON s = 'draft' AND c = event_type WHERE i = 1 UNION ALL SELECT w.user_id, w.i, coalesce(t, state), applied + (t IS NOT NULL)::BIGINT, refused + (t IS NULL)::BIGINT FROM r JOIN w ON w.user_id = r.user_id AND w.i = r.i + 1 LEFT JOIN m ON s = state AND c = w.event_type)
SELECT user_id, arg_max(state, i) AS state, max(applied) AS applied, max(refused) AS refused FROM r GROUP BY 1""")
def decision_states(spark, d):
    """Where each user's decision stands after all commands; commands that a state doesn't allow are refused."""
    return ledger.transitions(_events(spark, d), "user_id", "event_id", "event_type", LEGAL, "draft")


# --- evaluation


GOLD = f"SELECT k.query_id, min(k.rank) FILTER (a.label = b.label AND k.vec_id % 4 <> 1) AS rank, a.label % 5 = 4 AS abstain FROM ({KNN}) k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.rank BETWEEN 2 AND 11 GROUP BY 1, 3"


def _ranked(spark, d):
    """(query_id, rank, abstain): the first rank of a gold row among ten, the query itself left out; queries that should be abstained from are marked."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _nearest(spark, d, 11).where("rank >= 2").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    gold = (F.col("label") == F.col("own")) & (F.col("vec_id") % 4 != 1)
    return found.groupBy("query_id", (F.col("own") % 5 == 4).alias("abstain")).agg(F.min(F.when(gold, F.col("rank"))).cast("long").alias("rank")).select("query_id", "rank", "abstain")


@query(GOLD)
def primary_rank(spark, d):
    return _ranked(spark, d)


@query(f"SELECT count(*) FILTER (NOT abstain) AS scored, count(*) FILTER (abstain) AS abstained, round(avg((coalesce(rank, 99) <= 6)::INT) FILTER (NOT abstain), 6) AS recall_5, round(avg(CASE WHEN rank <= 6 THEN 1.0 / (rank - 1) ELSE 0 END) FILTER (NOT abstain), 6) AS mrr_5, round(avg(CASE WHEN rank <= 6 THEN 1.0 / log2(rank) ELSE 0 END) FILTER (NOT abstain), 6) AS ndcg_5, count(*) FILTER (NOT abstain) < 5 AS few FROM ({GOLD})")
def gold_metrics(spark, d):
    """Recall, reciprocal rank and nDCG at five of the queries that have an answer; too few of them are flagged."""
    r = _ranked(spark, d).withColumn("place", F.col("rank") - 1)
    scored, hit = ~F.col("abstain"), F.coalesce(F.col("place") <= 5, F.lit(False))
    mean = lambda v, n: F.round(F.avg(F.when(scored, F.when(hit, v).otherwise(0.0))), 6).alias(n)
    n = lambda c: F.sum(c.cast("int"))
    return r.agg(n(scored).alias("scored"), n(F.col("abstain")).alias("abstained"), mean(F.lit(1.0), "recall_5"), mean(1.0 / F.col("place"), "mrr_5"), mean(1.0 / F.log2(F.col("place") + 1.0), "ndcg_5"), (n(scored) < 5).alias("few"))


@query(f"SELECT CASE WHEN n < 3 THEN 'insufficient' WHEN recall < 0.2 THEN 'recall' WHEN worst > 12 THEN 'latency' ELSE 'pass' END AS verdict, recall FROM (SELECT count(*) AS n, round(avg((rank IS NOT NULL)::INT), 6) AS recall, max(coalesce(rank, 0)) AS worst FROM ({GOLD}) WHERE NOT abstain)")
def promotion_verdict(spark, d):
    """A gate that fails closed: the first threshold that isn't met, pass only if all are."""
    by = _ranked(spark, d).where("NOT abstain").agg(F.count("*").alias("n"), F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall"), F.max(F.coalesce("rank", F.lit(0))).alias("worst"))
    return by.select(units.first_state([("insufficient", F.col("n") < 3), ("recall", F.col("recall") < 0.2), ("latency", F.col("worst") > 12)], "pass").alias("verdict"), "recall")


@query()
def paired_interval(spark, d):
    """Interval of the mean difference of two rankings on the same queries; resampled pairs, tested against a plain resample."""
    r = _ranked(spark, d).where("NOT abstain")
    gain = F.coalesce(1.0 / (F.col("rank") - 1), F.lit(0.0)) - F.coalesce(1.0 / (12 - F.col("rank")), F.lit(0.0))
    return evaluation.bootstrap(r.select("query_id", gain.alias("gain")), "gain", rounds=200)


@query("""WITH a AS (SELECT event_id, [event_id % 1300, (event_id * 7) % 1300] AS cites, [event_id % 1300, event_id % 11] AS needed FROM events WHERE event_type = 'purchase'), k AS (SELECT list(doc_id) AS ids FROM documents),
c AS (SELECT a.event_id, len(list_filter(cites, x -> list_contains(ids, x))) / 2.0 AS precision, len(list_filter(needed, x -> list_contains(cites, x))) / 2.0 AS coverage FROM a, k) SELECT event_id, precision::DOUBLE AS precision, coverage::DOUBLE AS coverage FROM c""".replace("x -> ", "lambda x: "))
def answer_scores(spark, d):
    """Share of an answer's citations that resolve, and of what it needed that it cites."""
    i = F.col("event_id")
    a = _events(spark, d).where("event_type = 'purchase'").select("event_id", F.array(i % 1300, (i * 7) % 1300).alias("cites"), F.array(i % 1300, i % 11).alias("needed"))
    known = table(spark, d, "documents").select(F.col("doc_id").alias("ref")).withColumn("there", F.lit(1))
    good = a.select("event_id", F.explode("cites").alias("ref")).join(known, "ref", "left").groupBy("event_id").agg((F.count("there") / F.count("*")).alias("precision"))
    cover = F.size(F.filter("needed", lambda x: F.array_contains("cites", x))) / F.size("needed")
    return a.select("event_id", cover.alias("coverage")).join(good, "event_id").select("event_id", "precision", "coverage")


@query("SELECT source, count(*) AS n, round(avg((length(text) BETWEEN 40 AND 8000)::INT), 6) AS normal, round(avg((quality IS NOT NULL)::INT), 6) AS traced, avg((length(text) BETWEEN 40 AND 8000)::INT) >= 0.9 AND avg((quality IS NOT NULL)::INT) >= 0.3 AS passed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def summary_quality(spark, d):
    """Rates of normal and of traced texts by source, and whether they pass."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    normal, traced = F.avg(F.length("text").between(40, 8000).cast("int")), F.avg(F.col("quality").isNotNull().cast("int"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(normal, 6).alias("normal"), F.round(traced, 6).alias("traced"), ((normal >= 0.9) & (traced >= 0.3)).alias("passed"))


@query("WITH o AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), w AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1) SELECT event_type, w.n - o.n AS n_delta, round(w.mean - o.mean, 6) AS mean_delta FROM o JOIN w USING (event_type)")
def old_new(spark, d):
    """Metrics of two periods and their differences."""
    e = _events(spark, d)
    late = F.col("ts") >= F.lit("2024-01-16 00:00:00").cast(dict(e.dtypes)["ts"])
    side = lambda c, k: e.where(c).groupBy("event_type").agg(F.count("*").alias(f"n{k}"), F.avg("value").alias(f"m{k}"))
    both = side(~late, 0).join(side(late, 1), "event_type")
    return both.select("event_type", (F.col("n1") - F.col("n0")).alias("n_delta"), F.round(F.col("m1") - F.col("m0"), 6).alias("mean_delta"))


@query("SELECT doc_id FROM (SELECT doc_id FROM documents ORDER BY md5('1701:' || doc_id), doc_id LIMIT 40)")
def review_sample(spark, d):
    """Forty documents for review, the same ones at every run."""
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.lit("1701:"), F.col("doc_id").cast("string"))), "doc_id").limit(40)


@query("SELECT sha256(lang || '|' || split_part(text, chr(10), 1)) AS unit, count(*) AS refs, array_to_string(list_sort(list(doc_id))[1:5], ',') AS first_refs FROM documents GROUP BY 1 HAVING count(*) > 1")
def evidence_index(spark, d):
    """References of each canonical unit, a first line in its language, the first five listed."""
    unit = F.sha2(F.concat_ws("|", "lang", F.split_part("text", F.lit("\n"), F.lit(1))), 256).alias("unit")
    rows = table(spark, d, "documents").select(unit, "doc_id")
    r = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id"))
    first = rows.withColumn("r", r).where("r <= 5").groupBy("unit").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_refs"))
    return rows.groupBy("unit").agg(F.count("*").alias("refs")).where("refs > 1").join(first, "unit")


@query(f"SELECT mode, count(*) AS queries, round(avg(hit), 6) AS recall, round(avg(mrr), 6) AS mrr FROM (SELECT query_id, mode, max((a.label = b.label)::INT) AS hit, coalesce(max(CASE WHEN a.label = b.label THEN 1.0 / (k.rank - 1) END), 0.0) AS mrr FROM ({KNN}) k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.vec_id JOIN (VALUES ('top3', 4), ('top5', 6), ('top10', 11)) m(mode, upto) ON k.rank <= upto WHERE k.rank >= 2 GROUP BY 1, 2) GROUP BY 1")
def mode_metrics(spark, d):
    """Recall and reciprocal rank of three retrieval modes on the same queries."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _nearest(spark, d, 11).where("rank >= 2").join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(k).alias("upto")) for m, k in (("top3", 4), ("top5", 6), ("top10", 11))))
    rows = found.select("query_id", "rank", (F.col("label") == F.col("own")).alias("good"), F.explode(modes).alias("m")).where("rank <= m.upto")
    by = rows.groupBy("query_id", "m.mode").agg(F.max(F.col("good").cast("int")).alias("hit"), F.coalesce(F.max(F.when(F.col("good"), 1.0 / (F.col("rank") - 1))), F.lit(0.0)).alias("mrr"))
    return by.groupBy("mode").agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("mrr"), 6).alias("mrr"))
