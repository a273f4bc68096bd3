"""Queries: scans, filters, joins, aggregates, order and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, events, graph, incremental, joins, ordered, rules
from ..sources.tables import dangling, insert_absent, table, upsert
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

MONTH = lambda c: F.date_format(c, "yyyy-MM")


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1)::BIGINT AS quality, coalesce(d.source, 'unknown') AS source, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def ev_enriched_scan(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", F.coalesce("quality", F.lit(-1)).cast("long").alias("quality"), F.coalesce("source", F.lit("unknown")).alias("source"), "n_chars")


@query("SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def ev_list_page(spark, d):
    return events.page(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 20, 50).select("event_id", "event_type", "user_id")


@query("SELECT event_id, event_type FROM events WHERE (event_type, event_id) > ('click', 100) ORDER BY event_type, event_id LIMIT 40")
def ev_keyset_page(spark, d):
    return events.after(table(spark, d, "events"), ["event_type", "event_id"], ("click", 100), 40).select("event_id", "event_type")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND lower(text) LIKE '%token%'")
def ev_keyword_filter(spark, d):
    return events.select(table(spark, d, "documents"), {"lang": "en", "source": ""}, keyword=(["text"], "Token")).select("doc_id", "lang", "source")


@query("SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'")
def ev_range_filter(spark, d):
    found = events.select(table(spark, d, "events"), {"event_type": "purchase"}, ("ts", "2024-01-05 00:00:00"), ("ts", "2024-01-20 00:00:00"))
    return found.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_id = 77")
def ev_point_lookup(spark, d):
    found = events.select(table(spark, d, "events"), {"event_id": 77})
    return events.project(found, ["id", "kind", "id"], {"id": "event_id", "kind": "event_type", "user": "user_id"})


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def ev_agg_type(spark, d):
    return events.counts(table(spark, d, "events"), {"event_type": F.col("event_type")}, "event_id")


@query("SELECT event_type, strftime(ts, '%Y-%m') AS month, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def ev_agg_type_month(spark, d):
    return table(spark, d, "events").groupBy("event_type", MONTH("ts").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def ev_timeline_day(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def ev_categories(spark, d):
    return events.counts(table(spark, d, "documents"), {"lang": F.col("lang"), "source": F.col("source")})


@query("SELECT count(*) AS total, sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS no_user, count(*) - count(DISTINCT event_id) AS repeated, min(event_id) AS first_id, max(event_id) AS last_id, count(DISTINCT strftime(ts, '%Y-%m')) AS months FROM events")
def ev_quality_profile(spark, d):
    e = table(spark, d, "events")
    return e.agg(F.count("*").alias("total"), F.sum(F.when(F.col("user_id").isNull(), 1).otherwise(0)).alias("no_user"), (F.count("*") - F.countDistinct("event_id")).alias("repeated"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.countDistinct(MONTH("ts")).alias("months"))


@query("""SELECT column_name, rate FROM (SELECT 'text' AS column_name, round(avg(CASE WHEN text IS NULL OR trim(text) = '' THEN 1.0 ELSE 0.0 END), 4) AS rate FROM documents
UNION ALL SELECT 'lang', round(avg(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1.0 ELSE 0.0 END), 4) FROM documents UNION ALL SELECT 'source', round(avg(CASE WHEN source IS NULL OR trim(source) = '' THEN 1.0 ELSE 0.0 END), 4) FROM documents)""")
def null_rates(spark, d):
    return events.null_rate(table(spark, d, "documents"), ["text", "lang", "source"])


@query("SELECT event_type, sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS k_sum, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY 1")
def ev_props_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(k.try_cast("long"), F.lit(0))).alias("k_sum"), F.count(k).alias("with_k"))


USAGE = """WITH m AS (SELECT c_mktsegment AS service, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT service, sum(n)::BIGINT AS n, count(*) AS months, min(month) AS first_month, max(month) AS last_month FROM m GROUP BY 1) """


def _orders_by_segment(spark, d):
    o, c = table(spark, d, "orders").select("o_custkey", "o_orderdate"), table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return rules.usage(o.join(c, F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", MONTH("o_orderdate"))


@query(USAGE + "SELECT *, round(n / (SELECT sum(n) FROM s), 4) AS share FROM s")
def usage_stats(spark, d):
    return _orders_by_segment(spark, d)


@query(USAGE + "SELECT service, CASE WHEN last_month >= '2001-06' AND months >= 6 AND n >= 100 THEN 'long_term' WHEN last_month >= '2001-06' AND n >= 50 THEN 'frequent' WHEN last_month >= '2001-06' THEN 'recent' WHEN n >= 50 THEN 'dormant' ELSE 'tried' END AS class FROM s")
def usage_class(spark, d):
    return _orders_by_segment(spark, d).select("service", rules.usage_class(F.col("n"), F.col("months"), F.col("last_month"), "2001-06").alias("class"))


TOPICS = {"secrets": ["token", "password"], "licence": ["licen"], "contact": ["@", "(555)"], "articles": [" the ", " la ", " der "]}
TOPIC_SQL = "SELECT doc_id, topic FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{t}' AS topic FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) for t, ws in TOPICS.items()) + ")"


@query(TOPIC_SQL)
def topic_hits(spark, d):
    return joins.keywords(table(spark, d, "documents"), "doc_id", "text", TOPICS)


@query(f"SELECT topic, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'core' WHEN count(*) >= 20 THEN 'regular' ELSE 'rare' END AS class FROM ({TOPIC_SQL}) GROUP BY 1")
def interest_class(spark, d):
    n = F.col("n")
    return topic_hits(spark, d).groupBy("topic").agg(F.count("*").alias("n")).select("topic", "n", F.when(n >= 100, "core").when(n >= 20, "regular").otherwise("rare").alias("class"))


@query("SELECT split_part(p_name, ' ', 1) AS capability, count(*) AS n, CASE WHEN count(*) >= 5 THEN 'core' WHEN count(*) >= 3 THEN 'common' WHEN count(*) >= 2 THEN 'occasional' ELSE 'minor' END AS tier, CASE WHEN count(*) >= 5 THEN 0.9 WHEN count(*) >= 3 THEN 0.8 WHEN count(*) >= 2 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM part GROUP BY 1")
def capability_tier(spark, d):
    by = table(spark, d, "part").groupBy(F.element_at(F.split("p_name", " "), 1).alias("capability")).agg(F.count("*").alias("n"))
    name, confidence = rules.tier(F.col("n"))
    return by.select("capability", "n", name.alias("tier"), confidence.cast("double").alias("confidence"))


@query("""SELECT kind, value, n, refs FROM (
SELECT 'source' AS kind, source AS value, count(*) AS n, array_to_string(list_sort(list(doc_id))[1:5], ',') AS refs FROM documents GROUP BY 2
UNION ALL SELECT 'lang', lang, count(*), array_to_string(list_sort(list(doc_id))[1:5], ',') FROM documents GROUP BY 2
UNION ALL SELECT 'host', lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), count(*), array_to_string(list_sort(list(page_id))[1:5], ',') FROM pages GROUP BY 2) WHERE n >= 3""")
def support_assertions(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    rows = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("source").alias("kind"), F.col("source").alias("value")), F.struct(F.lit("lang").alias("kind"), F.col("lang").alias("value")))).alias("x")).select("x.kind", "x.value", F.col("doc_id").alias("ref"))
    rows = rows.union(pages.select(F.lit("host"), tx.host(F.col("url")), "page_id"))
    n = rows.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n >= 3")
    first = rules.ranked(rows, ["kind", "value"], [F.asc("ref")], 5).groupBy("kind", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ref")), lambda r: r.cast("string")), ",").alias("refs"))
    return n.join(first, n["kind"].eqNullSafe(first["kind"]) & n["value"].eqNullSafe(first["value"])).select(n["kind"], n["value"], "n", "refs")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS p{p[0]}" for p in PRIORITIES) + " FROM orders GROUP BY 1")
def growth_pivot(spark, d):
    by = table(spark, d, "orders").groupBy(MONTH("o_orderdate").alias("month")).pivot("o_orderpriority", PRIORITIES).agg(F.count(F.lit(1)))
    return by.select("month", *(F.coalesce(F.col(f"`{p}`"), F.lit(0)).cast("long").alias(f"p{p[0]}") for p in PRIORITIES))


@query("SELECT source, n, rank FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS rank FROM documents GROUP BY 1) WHERE rank <= 12")
def topn_values(spark, d):
    top = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)
    return rules.ranked(top.withColumn("_all", F.lit(0)), ["_all"], [F.desc("n"), F.asc("source")], 12).select("source", "n", F.col("rank").cast("long").alias("rank"))


@query("SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share, array_to_string(list_sort(list(doc_id))[1:3], ',') AS examples FROM documents GROUP BY 1")
def share_examples(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    by = docs.groupBy("lang").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total"))
    first = rules.ranked(docs, ["lang"], [F.asc("doc_id")], 3).groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return by.join(first, "lang").join(F.broadcast(total)).select("lang", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "examples")


@query("SELECT lang, count(*) AS n, min(length(text)) AS shortest, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean, count(*) FILTER (length(text) < 200) AS small, count(*) FILTER (length(text) >= 200 AND length(text) < 10000) AS middle, count(*) FILTER (length(text) >= 10000) AS large FROM documents GROUP BY 1")
def text_profile(spark, d):
    n = F.length("text")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 4).alias("mean"), one(n < 200).alias("small"), one((n >= 200) & (n < 10000)).alias("middle"), one(n >= 10000).alias("large"))


@query("SELECT l_returnflag, " + ", ".join(f"list_sort(list(l_quantity))[least(count(*) - 1, floor(count(*) * {q})::BIGINT)::BIGINT + 1] AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95)) + " FROM lineitem GROUP BY 1")
def index_percentile(spark, d):
    values = table(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))  # few distinct values, counted
    from pyspark.sql import Window

    up = Window.partitionBy("l_returnflag").orderBy("l_quantity")
    placed = values.withColumn("upto", F.sum("c").over(up)).withColumn("n", F.sum("c").over(Window.partitionBy("l_returnflag")))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("l_quantity")))
    return placed.groupBy("l_returnflag").agg(*(at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95)))


@query("SELECT conv_id, max(turn) FILTER (role = 'user') AS last_user, max(turn) FILTER (role = 'assistant') AS last_assistant, count(*) AS turns FROM conversations GROUP BY 1")
def conditional_max(spark, d):
    last = lambda r: F.max(F.when(F.col("role") == r, F.col("turn")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(last("user").alias("last_user"), last("assistant").alias("last_assistant"), F.count("*").alias("turns"))


@query("SELECT turns, count(*) AS conversations, sum(chars)::BIGINT AS chars FROM (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY 1) GROUP BY 1")
def scope_rollup(spark, d):
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    return by.groupBy("turns").agg(F.count("*").alias("conversations"), F.sum("chars").alias("chars"))


@query("SELECT source, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY 1")
def digest_aggregate(spark, d):
    return incremental.digest(table(spark, d, "documents"), ["source"], "doc_id")


@query("SELECT s.n_name AS supplier_nation, c.n_name AS customer_nation, count(*) AS pairs FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey JOIN nation s ON s_nationkey = s.n_nationkey JOIN nation c ON c_nationkey = c.n_nationkey GROUP BY 1, 2")
def self_join_relations(spark, d):
    line, orders, supplier, customer, nation = (table(spark, d, t) for t in ("lineitem", "orders", "supplier", "customer", "nation"))
    rows = line.select("l_orderkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    rows = rows.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    by = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("pairs"))
    s, c = (nation.select(F.col("n_nationkey").alias(f"{k}_nationkey"), F.col("n_name").alias(n)) for k, n in (("s", "supplier_nation"), ("c", "customer_nation")))
    return by.join(s, "s_nationkey").join(c, "c_nationkey").select("supplier_nation", "customer_nation", "pairs")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_orphans(spark, d):
    return dangling(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id").select("doc_id")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_in(spark, d):
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(back, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT p_partkey, (SELECT arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) FROM lineitem WHERE l_partkey = p_partkey) AS first_supplier FROM part")
def scalar_subquery(spark, d):
    line = table(spark, d, "lineitem")
    first = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("first_supplier"))
    return table(spark, d, "part").select("p_partkey").join(first, "p_partkey", "left")


@query("SELECT a.conv_id, a.turn, (SELECT max(u.turn) FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn <= a.turn) AS asof_user_turn FROM conversations a")
def asof_user_turn(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    users = rows.where("role = 'user'").withColumn("user_turn", F.col("turn"))
    return joins.asof(rows.select("conv_id", "turn"), users, ["conv_id"], "turn", ["user_turn"])


@query("SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND greatest(a.o_orderdate, b.o_orderdate) < least(a.o_orderdate, b.o_orderdate) + INTERVAL 30 DAY")
def interval_overlap(spark, d):
    start = F.col("o_orderdate").cast("timestamp")
    return joins.overlaps(table(spark, d, "orders"), "o_custkey", "o_orderkey", start, start + F.expr("INTERVAL 30 DAYS"), 30)


@query("SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def adjacent_turns(spark, d):
    return joins.adjacent(table(spark, d, "conversations"), "conv_id", "turn", ["role"])


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def join_latest(spark, d):
    return joins.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("""WITH x AS (SELECT c_custkey, c_nationkey || ':' || round(c_acctbal)::BIGINT AS k1, c_nationkey::VARCHAR AS k2 FROM customer), y AS (SELECT s_suppkey, s_nationkey || ':' || round(s_acctbal)::BIGINT AS k1, s_nationkey::VARCHAR AS k2 FROM supplier),
p1 AS (SELECT c_custkey, s_suppkey, 1 AS step FROM (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY c_custkey) AS r FROM x) JOIN (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY s_suppkey) AS r FROM y) USING (k1, r)),
p2 AS (SELECT c_custkey, s_suppkey, 2 AS step FROM (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY c_custkey) AS r FROM x WHERE c_custkey NOT IN (SELECT c_custkey FROM p1)) JOIN (SELECT *, row_number() OVER (PARTITION BY k2 ORDER BY s_suppkey) AS r FROM y WHERE s_suppkey NOT IN (SELECT s_suppkey FROM p1)) USING (k2, r))
SELECT * FROM p1 UNION ALL SELECT * FROM p2""")
def crosswalk(spark, d):
    key = lambda k, b: F.concat(F.col(k).cast("string"), F.lit(":"), F.round(b).cast("long").cast("string"))
    passes = [(key("c_nationkey", "c_acctbal"), key("s_nationkey", "s_acctbal")), (F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string"))]
    return joins.crosswalk(table(spark, d, "customer"), table(spark, d, "supplier"), passes, "c_custkey", "s_suppkey")


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn_no FROM documents")
def round_robin(spark, d):
    return ordered.round_robin(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source", F.col("turn_no").cast("long").alias("turn_no"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents) WHERE k % 20 = 0")
def stratified_sample(spark, d):
    return ordered.every_kth(table(spark, d, "documents").select("doc_id", "lang"), "lang", [F.asc("doc_id")], 20)


@query("""WITH RECURSIVE r AS (SELECT conv_id, turn, length(text)::BIGINT AS used, 0::BIGINT AS chunk FROM conversations c WHERE turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id)
UNION ALL SELECT c.conv_id, c.turn, CASE WHEN r.used > 0 AND r.used + length(c.text) > 1200 THEN length(c.text) ELSE r.used + length(c.text) END, CASE WHEN r.used > 0 AND r.used + length(c.text) > 1200 THEN r.chunk + 1 ELSE r.chunk END FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1) SELECT conv_id, turn, chunk FROM r""")
def running_chunks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return ordered.chunks(rows, "conv_id", "turn", "size", 1200)


@query("""WITH h AS (SELECT conv_id, turn, sha256(conv_id || '|' || turn || '|' || role || '|' || text) AS row_hash FROM conversations) SELECT conv_id, turn, row_hash, coalesce(lag(row_hash) OVER (PARTITION BY conv_id ORDER BY turn), '') AS previous_hash FROM h""")
def hash_chain(spark, d):
    return ordered.chained(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    return ordered.sessions(table(spark, d, "events"), "user_id", "ts", 30)


@query("SELECT user_id, event_id AS after, missing FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id - 1 AS missing FROM events) WHERE missing > 0")
def sequence_gaps(spark, d):
    return ordered.gaps(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT conv_id, turn, role, text FROM conversations EXCEPT SELECT conv_id, turn, role, CASE WHEN turn % 3 = 1 THEN upper(text) ELSE text END FROM conversations")
def gen_changed(spark, d):
    now = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return incremental.changed_rows(now, now.withColumn("text", F.when(F.col("turn") % 3 == 1, F.upper("text")).otherwise(F.col("text"))))


@query("SELECT conv_id, turn FROM conversations WHERE turn % 5 = 2")
def gen_removed(spark, d):
    prior = table(spark, d, "conversations")
    return incremental.removed_keys(prior.where("turn % 5 <> 2"), prior, ["conv_id", "turn"])


@query("SELECT conv_id, turn, CASE WHEN turn % 5 = 2 THEN 'added' WHEN turn % 3 = 1 AND role <> upper(role) THEN 'changed' END AS change FROM conversations WHERE turn % 5 = 2 OR (turn % 3 = 1 AND role <> upper(role))")
def gen_delta(spark, d):
    now = table(spark, d, "conversations")
    prior = now.where("turn % 5 <> 2").withColumn("role", F.when(F.col("turn") % 3 == 1, F.upper("role")).otherwise(F.col("role")))
    return incremental.delta(now, prior, ["conv_id", "turn"], ["role", "text"])


@query("SELECT 'doc' AS layer, doc_id AS id, lang, NULL::VARCHAR AS role, length(text)::BIGINT AS size FROM documents UNION ALL SELECT 'turn', conv_id, NULL, role, length(text) FROM conversations")
def union_layers(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("layer"), F.col("doc_id").alias("id"), "lang", F.length("text").cast("long").alias("size"))
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("layer"), F.col("conv_id").alias("id"), "role", F.length("text").cast("long").alias("size"))
    return docs.unionByName(turns, allowMissingColumns=True)


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def keyed_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return upsert(old, old.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("moved")), ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer")
def insert_if_absent(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    return insert_absent(rows.where("c_custkey % 3 = 0"), rows.union(rows), ["c_custkey"])


@query("SELECT user_id, event_type, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1")
def state_as_of(spark, d):
    return rules.as_of(table(spark, d, "events"), ["user_id", "event_type"], "ts", ["value"], "2024-01-15 00:00:00")


@query("""WITH s AS (SELECT user_id, event_type, t, value FROM (SELECT e.*, t, row_number() OVER (PARTITION BY user_id, event_type, t ORDER BY ts DESC, value DESC) AS r FROM events e JOIN (VALUES (TIMESTAMP '2024-01-10'), (TIMESTAMP '2024-01-20')) x(t) ON ts <= t) WHERE r = 1)
SELECT user_id, event_type, change, before, after FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.value IS NULL THEN 'added' WHEN b.value IS NULL THEN 'removed' WHEN a.value <> b.value THEN 'changed' END AS change, a.value AS before, b.value AS after
FROM (SELECT * FROM s WHERE t = TIMESTAMP '2024-01-10') a FULL JOIN (SELECT * FROM s WHERE t = TIMESTAMP '2024-01-20') b ON a.user_id = b.user_id AND a.event_type = b.event_type) WHERE change IS NOT NULL""")
def state_changes(spark, d):
    e, key = table(spark, d, "events"), ["user_id", "event_type"]
    a, b = (rules.as_of(e, key, "ts", ["value"], t) for t in ("2024-01-10 00:00:00", "2024-01-20 00:00:00"))
    return rules.changes(a, b, key, "value")


@query("""SELECT user_id, event_type, n AS samples, CASE WHEN n >= 3 THEN delta END AS delta, CASE WHEN n < 3 THEN 'insufficient' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT user_id, event_type, count(*) AS n, round(arg_max(value, ts) - arg_min(value, ts), 4) AS delta FROM events GROUP BY 1, 2)""")
def trend_endpoint(spark, d):
    return rules.trend(table(spark, d, "events"), ["user_id", "event_type"], "ts", "value")


@query("""WITH u AS (SELECT user_id, least(1.0, count(*) / 50.0) AS volume, least(1.0, count(DISTINCT event_type) / 5.0) AS variety FROM events GROUP BY 1), s AS (SELECT user_id, round(0.7 * volume + 0.3 * variety, 6) AS score FROM u)
SELECT user_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM s) WHERE rank <= 50""")
def weighted_rank(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg((F.count("*") / 50.0).alias("volume"), (F.countDistinct("event_type") / 5.0).alias("variety"))
    top = by.select("user_id", rules.weighted({"volume": 0.7, "variety": 0.3}).alias("score")).orderBy(F.desc("score"), "user_id").limit(50)
    return rules.ranked(top.withColumn("_all", F.lit(0)), ["_all"], [F.desc("score"), F.asc("user_id")], 50).select("user_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT observed, expected, CASE WHEN expected = 1 THEN 1.0 ELSE round((o - e) / (1 - e), 6) END AS kappa FROM (SELECT o, e, round(o, 6) AS observed, round(e, 6) AS expected FROM (SELECT avg((quality = toxic)::INT) AS o, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels))")
def kappa(spark, d):
    return table(spark, d, "labels").agg(*evaluation.kappa(F.col("quality"), F.col("toxic")))


@query("""SELECT source, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high
FROM (SELECT source, count(*) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def wilson(spark, d):
    from ..functions.numbers import wilson as interval

    by = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("h"))
    low, high = interval(F.col("h"), F.col("n"))
    return by.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("""WITH r AS (SELECT length(text) AS a, n_words AS b FROM (SELECT text, length(text) - length(replace(text, ' ', '')) AS n_words FROM documents)), c AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS y FROM r) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM c""")
def spearman(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("a"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("b"))
    from pyspark.sql import Window

    def ranks(c: str):  # of distinct values, from their counts: the window holds no row twice
        by = docs.groupBy(c).agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.orderBy(c))
        return by.select(c, (upto - (F.col("m") - 1) / 2.0).alias(f"r_{c}"))

    return docs.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.round(F.corr("r_a", "r_b"), 6).alias("rho"), F.count("*").alias("n"))


EDGES = "SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem"
BOTH = f"WITH RECURSIVE e AS ({EDGES}), both_ways AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e)"


def _edges(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst")).distinct()


@query(f"SELECT node, degree FROM (SELECT u AS node, count(*) AS degree, row_number() OVER (ORDER BY count(*) DESC, u) AS r FROM (SELECT src AS u FROM ({EDGES}) UNION ALL SELECT dst FROM ({EDGES})) GROUP BY 1) WHERE r <= 15")
def hub_degree(spark, d):
    return graph.degrees(_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(15)


@query(BOTH + ", r AS (SELECT 's1' AS node, 0 AS level UNION SELECT v, level + 1 FROM r JOIN both_ways ON u = node WHERE level < 2) SELECT node, min(level) AS level FROM r GROUP BY 1")
def two_hop(spark, d):
    return graph.levels(_edges(spark, d), spark.createDataFrame([("s1",)], "node string"), 2)


@query(f"SELECT src AS node FROM ({EDGES}) WHERE dst = 's1' INTERSECT SELECT src FROM ({EDGES}) WHERE dst = 's2'")
def common_neighbours(spark, d):
    return graph.common_neighbours(_edges(spark, d), "s1", "s2")


@query(BOTH + ", r AS (SELECT 's1' AS node, 0 AS level UNION SELECT v, level + 1 FROM r JOIN both_ways ON u = node WHERE level < 4) SELECT 's1' AS a, 's3' AS b, min(level) AS hops FROM r WHERE node = 's3'")
def shortest_path(spark, d):
    found = graph.levels(_edges(spark, d), spark.createDataFrame([("s1",)], "node string"), 4).where("node = 's3'")
    return found.agg(F.min("level").alias("hops")).select(F.lit("s1").alias("a"), F.lit("s3").alias("b"), "hops")


@query(f"SELECT count(DISTINCT src) + count(DISTINCT dst) AS nodes, count(*) AS edges, round(count(*) / (count(DISTINCT src) * count(DISTINCT dst)), 6) AS density FROM ({EDGES})")
def graph_stats(spark, d):
    n, s, t = F.count("*"), F.countDistinct("src"), F.countDistinct("dst")
    return _edges(spark, d).agg((s + t).alias("nodes"), n.alias("edges"), F.round(n / (s * t), 6).alias("density"))


@query("""SELECT src, dst, relation, max(strength) AS strength FROM (
SELECT 'n:' || n_name AS src, 'r:' || r_name AS dst, 'in_region' AS relation, 1.0::DOUBLE AS strength FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's:' || s_name, 'n:' || n_name, 'supplies_from', 0.8 FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'n:' || n_name, 'r:' || r_name, 'sells_in', round(least(1.0, count(*) / 50.0), 4) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY 1, 2, 3""")
def rule_edges(spark, d):
    nation, region, supplier = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    nr = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("n:"), "n_name").alias("n"), F.concat(F.lit("r:"), "r_name").alias("r"))
    sn = supplier.join(nr, F.col("s_nationkey") == F.col("n_nationkey"))
    edge = lambda df, a, b, rel, s: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(rel).alias("relation"), s.cast("double").alias("strength"))
    sells = sn.groupBy("n", "r").agg(F.count("*").alias("c"))
    rows = edge(nr, "n", "r", "in_region", F.lit(1.0)).union(edge(sn.withColumn("s", F.concat(F.lit("s:"), "s_name")), "s", "n", "supplies_from", F.lit(0.8))).union(edge(sells, "n", "r", "sells_in", F.round(F.least(F.lit(1.0), F.col("c") / 50.0), 4)))
    return rows.groupBy("src", "dst", "relation").agg(F.max("strength").alias("strength"))
