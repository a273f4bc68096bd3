"""Queries: histories, lifecycles, budgets, views of conversations, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import history, rules
from ..sources.tables import table
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query


@query("SELECT conv_id, turn, role FROM conversations c WHERE role = 'user' AND NOT (turn % 3 = 0 AND EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.role <> 'user')) ")
def undo_history(spark, d):
    """Answers to every third turn take it back; what is left of the users' turns."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.when((F.col("role") != "user") & ((F.col("turn") - 1) % 3 == 0), F.col("turn") - 1).alias("undoes"))
    return history.effective(rows, "conv_id", "turn", "undoes").where("role = 'user'").select("conv_id", "turn", "role")


@query("""WITH c AS (SELECT conv_id, turn + 1 AS seq, sha256(text) AS own, coalesce(lag(sha256(text)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations), x AS (SELECT conv_id, seq, own, CASE WHEN seq % 4 = 3 THEN 'x' ELSE prev END AS prev FROM c WHERE seq % 5 <> 4),
f AS (SELECT conv_id, (seq - coalesce(lag(seq) OVER w, 0) <> 1)::INT AS g, (prev <> coalesce(lag(own) OVER w, ''))::INT AS b FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY seq)) SELECT conv_id, sum(g)::BIGINT AS gaps, sum(b)::BIGINT AS breaks FROM f GROUP BY 1""")
def chain_faults(spark, d):
    own = F.sha2("text", 256)
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("seq"), own.alias("own"), F.coalesce(F.lag(own).over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("prev"))
    broken = rows.where("seq % 5 <> 4").withColumn("prev", F.when(F.col("seq") % 4 == 3, "x").otherwise(F.col("prev")))
    return history.chain_faults(broken, "conv_id", "seq", "own", "prev")


@query("""WITH x AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, event_id, floor(value / 50)::BIGINT AS level FROM events), t AS (SELECT *, max(day) OVER k AS newest, row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, event_id DESC) AS r FROM x WINDOW k AS (PARTITION BY user_id, event_type)),
h AS (SELECT *, min(CASE WHEN day = newest THEN level END) OVER k AS lo, max(CASE WHEN day = newest THEN level END) OVER k AS hi FROM t WINDOW k AS (PARTITION BY user_id, event_type))
SELECT user_id, event_type, event_id, CASE WHEN day = newest AND lo <> hi THEN 'conflict' WHEN r = 1 THEN 'current' WHEN level = hi THEN 'repeated' ELSE 'superseded' END AS status FROM h""")
def supersede_conflict(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(F.col("value") / 50).alias("level"))
    return history.supersede(rows, ["user_id", "event_type"], "level", "day", "event_id")


@query("""WITH x AS (SELECT user_id, event_type, value, ts AS s, ts + INTERVAL 5 DAY AS e, ts + INTERVAL 1 DAY AS o FROM events), k AS (SELECT * FROM x WHERE o <= TIMESTAMP '2024-01-15' AND s <= TIMESTAMP '2024-01-15' AND e >= TIMESTAMP '2024-01-15')
SELECT user_id, event_type, arg_max(value, (o, value)) AS value, 'valid' AS status FROM k GROUP BY 1, 2""")
def bitemporal_state(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "value", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("e"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("o"))
    return history.valid_as_of(rows, ["user_id", "event_type"], "value", "s", "e", "o", F.lit("2024-01-15 00:00:00").cast(dict(rows.dtypes)["s"]))


@query("""WITH x AS (SELECT user_id, event_id, event_type, value, (value > 99) AS must, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events)
SELECT user_id, event_id, (r <= 3) AS taken FROM x""")
def budget_scan(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_id").alias("domain"), "value", F.lit(False).alias("must"))
    return history.within_budgets(rows, "user_id", "event_id", "domain", "value", "must", 3, 2)


@query()
def budget_scan_by_domain(spark, d):
    """The same with two for each event type and values over 300 always taken: a scan with state, tested against a plain loop."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (F.col("value") > 300).alias("must"))
    return history.within_budgets(rows, "user_id", "event_id", "event_type", "value", "must", 3, 2)


@query("WITH m AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS before FROM m")
def previous_period(spark, d):
    by = table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").cast("double").alias("n"))
    return history.previous_mean(by, "event_type", "day", "n")


@query("WITH x AS (SELECT conv_id, length(text) AS n, sum(length(text)) OVER w AS upto, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, count(*) AS rows, sum(least(n, 1500))::BIGINT AS chars FROM x WHERE upto <= 1500 OR r = 1 GROUP BY 1")
def recent_window(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return history.recent_text(rows, "conv_id", "turn", "size", 1500)


@query(r"SELECT conv_id, substring(arg_min(t, turn), 1, 80) AS title FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g')) AS t FROM conversations WHERE role = 'user') WHERE t <> '' GROUP BY 1")
def session_titles(spark, d):
    return history.first_filled(table(spark, d, "conversations").where("role = 'user'"), "conv_id", "turn", F.col("text"), 80)


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns, count(DISTINCT role) AS kinds, sha256(string_agg(sha256(text), ',' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def session_views(spark, d):
    seq = F.array_sort(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("h"))))
    by = table(spark, d, "conversations").groupBy("conv_id").agg(seq.alias("s"), F.count("*").alias("turns"), F.countDistinct("role").alias("kinds"))
    return by.select("conv_id", F.array_join("s.role", ">").alias("roles"), "turns", "kinds", F.sha2(F.array_join("s.h", ","), 256).alias("digest"))


@query("SELECT a.conv_id, a.turn, length(a.text)::BIGINT AS asked, length(b.text)::BIGINT AS answered FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = (SELECT min(turn) FROM conversations x WHERE x.conv_id = a.conv_id AND x.turn > a.turn AND x.role = 'assistant') WHERE a.role = 'user'")
def question_answers(spark, d):
    """Users' turns with the next answer: the first assistant's turn after them, carried backwards."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, -1)  # a running value, not a frame for each row
    nxt = F.last(F.when(F.col("role") == "assistant", F.col("n")), ignorenulls=True).over(later)
    return rows.withColumn("answered", nxt).where("role = 'user' AND answered IS NOT NULL").select("conv_id", "turn", F.col("n").alias("asked"), "answered")


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, round(least(1.0, count(*) / 40.0) * 0.4 + least(1.0, count(DISTINCT strftime(ts, '%Y-%m-%d')) / 20.0) * 0.4 + least(1.0, count(DISTINCT event_type) / 5.0) * 0.2, 6) AS score, CASE WHEN count(*) < 5 THEN 'reject' WHEN count(DISTINCT event_type) < 3 THEN 'review' ELSE 'promote' END AS decision FROM events GROUP BY 1")
def promotion_gate(spark, d):
    n, days, kinds = F.count("*"), F.countDistinct(F.date_format("ts", "yyyy-MM-dd")), F.countDistinct("event_type")
    by = table(spark, d, "events").groupBy("user_id").agg(n.alias("n"), days.alias("days"), kinds.alias("kinds"))
    by = by.select("user_id", "kinds", "n", (F.col("n") / 40.0).alias("a"), (F.col("days") / 20.0).alias("b"), (F.col("kinds") / 5.0).alias("c"))
    decision = F.when(F.col("n") < 5, "reject").when(F.col("kinds") < 3, "review").otherwise("promote")
    return by.select("user_id", "kinds", rules.weighted({"a": 0.4, "b": 0.4, "c": 0.2}).alias("score"), decision.alias("decision"))


GRAM = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"


@query(f"""WITH d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i:i+7], ' ')))) AS k FROM (SELECT doc_id, {GRAM} AS w FROM documents)), b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i:i+7], ' ')))) AS k FROM (SELECT item_id, {GRAM} AS w FROM benchmark)), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, round(count(*) / max(n), 6) AS containment FROM d JOIN b USING (k) JOIN n USING (item_id) GROUP BY 1, 2""")
def contamination(spark, d):
    """Share of an item's eight-word runs that a document holds; the benchmark's runs are the small side of the join."""

    def runs(df, ident):
        w = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9_]{2,})"), F.lit(1))
        rows = df.select(ident, w.alias("w")).where(F.size("w") >= 8)
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.array_join(F.slice("w", i, 8), " "))
        return rows.select(ident, F.explode(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g)))).alias("k"))  # 64-bit hashes move, not words

    items = runs(table(spark, d, "benchmark"), "item_id")
    n = items.groupBy("item_id").agg(F.count("*").alias("n"))
    found = runs(table(spark, d, "documents"), "doc_id").join(items, "k").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return found.join(n, "item_id").select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


@query("SELECT page_id, length(html)::BIGINT AS size, (length(html) - length(replace(html, '<p', ''))) // 2 AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def page_profile(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.length(html).cast("long").alias("size"), ((F.length(html) - F.length(F.replace(html, F.lit("<p"), F.lit("")))) / 2).cast("long").alias("paragraphs"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"))


@query("SELECT host, count(*) AS pages, min(page_id) AS first_page FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages) GROUP BY 1 HAVING count(*) >= 3")
def host_support(spark, d):
    return table(spark, d, "pages").groupBy(tx.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages >= 3")
