"""Queries: scalar rules over texts, times, names and nested values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as tx
from ..operators import substrings
from ..sources.tables import table
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

TERMS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))"


@query(f"""SELECT doc_id, len({TERMS})::BIGINT AS terms, array_to_string(list_transform(list_sort(list_transform({TERMS}, lambda t: {{'n': -length(t), 't': t}}))[1:4], lambda x: x.t), ',') AS longest,
len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'))::BIGINT AS runs FROM documents""")
def query_terms(spark, d):
    """Search terms of a text with its four most distinctive ones, and its runs of word characters."""
    terms = tx.query_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(terms).cast("long").alias("terms"), F.array_join(tx.distinctive(terms), ",").alias("longest"), F.size(tx.word_runs(F.col("text"))).cast("long").alias("runs"))


TOOLS = ["password", "licen", "http", "token", "@"]


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter({TOOLS!r}, lambda t: contains(lower(text), t))), ',') AS tools FROM documents WHERE len(list_filter({TOOLS!r}, lambda t: contains(lower(text), t))) > 0")
def tool_mentions(spark, d):
    found = tx.mentions(F.col("text"), TOOLS)
    return table(spark, d, "documents").select("doc_id", found.alias("t")).where(F.size("t") > 0).select("doc_id", F.array_join("t", ",").alias("tools"))


@query(r"SELECT page_id FROM pages WHERE html LIKE '%\%\%\%%' ESCAPE '\'")
def like_literal(spark, d):
    """Pages that hold three percent signs in a row, which LIKE would take for wildcards."""
    return table(spark, d, "pages").where(tx.like_any(F.col("html"), "%%%")).select("page_id")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_extract(html, '<p[^>]*>([^<]*)</p>', 1)) AS rich, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS plain FROM pages)
SELECT page_id, trim(title || ' ' || CASE WHEN length(rich) >= 10 THEN rich ELSE plain END) AS body FROM p WHERE length(rich) >= 10 OR length(plain) >= 10""")
def embedding_texts(spark, d):
    """What of a page is embedded: its title with the first paragraph, or the heading where that is too short; else nothing."""
    part = lambda tag: F.regexp_extract("html", rf"<{tag}[^>]*>([^<]*)</{tag}>", 1)
    body = tx.embedding_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1), part("p"), part("h1"))
    return table(spark, d, "pages").select("page_id", body.alias("body")).where("body IS NOT NULL")


LAST = r"lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[/\\]+$', ''), '([^/\\]*)$', 1))"


@query(f"""SELECT page_id, name, length(name) BETWEEN 2 AND 40 AND name NOT IN ('index', 'en', 'de') AND NOT regexp_full_match(name, '([0-9a-f]{{7,}}|[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f-]*|[0-9]+|.*\\.(html?|php|js|css|png|jpg|json|xml|txt|md|py))') AS valid FROM (SELECT page_id, {LAST} AS name FROM pages)""")
def entity_names(spark, d):
    """The entity that an address names, and whether that is a name at all."""
    rows = table(spark, d, "pages").select("page_id", tx.last_segment(F.col("url")).alias("name"))
    return rows.withColumn("valid", tx.valid_name(F.col("name"), ["index", "en", "de"]))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.5Z' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d/%m/%Y') END AS t FROM events)
SELECT event_id, coalesce(try_strptime(t[1:19], '%Y-%m-%dT%H:%M:%S'), try_strptime(t[1:19], '%Y-%m-%d %H:%M:%S'), try_strptime(t[1:19], '%Y-%m-%d')) AS loose, (event_id % 4 = 0) AS zoned FROM s""")
def parsed_times(spark, d):
    """Times in four notations: three are read loosely, the one with a zone strictly too."""
    form = lambda f: F.date_format("ts", f)
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(form("yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5Z"))).when(k == 1, form("yyyy-MM-dd HH:mm:ss")).when(k == 2, form("yyyy-MM-dd")).otherwise(form("dd/MM/yyyy"))
    rows = table(spark, d, "events").select("event_id", text.alias("t"))
    return rows.select("event_id", tx.timestamp_loose(F.col("t")).alias("loose"), tx.timestamp_zoned(F.col("t")).isNotNull().alias("zoned"))


@query("""WITH l AS (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS t FROM events)
SELECT event_id, CASE WHEN hour(t) >= 22 THEN date_trunc('day', t) + INTERVAL 31 HOUR - INTERVAL 8 HOUR WHEN hour(t) < 7 THEN date_trunc('day', t) + INTERVAL 7 HOUR - INTERVAL 8 HOUR ELSE ts END AS due FROM l""")
def quiet_hours(spark, d):
    """When a notice about an event may go out: not from 22 to 7 o'clock in Shanghai."""
    return table(spark, d, "events").select("event_id", tx.after_quiet_hours(F.col("ts").cast("timestamp"), "Asia/Shanghai").alias("due"))


@query("""WITH o AS (SELECT event_id, user_id, event_type FROM events) SELECT least(a.event_type, b.event_type) AS a, greatest(a.event_type, b.event_type) AS b, count(*) AS n FROM o a JOIN o b ON a.user_id = b.user_id AND b.event_id = (SELECT min(event_id) FROM o c WHERE c.user_id = a.user_id AND c.event_id > a.event_id) GROUP BY 1, 2""")
def canonical_pairs(spark, d):
    """Types that follow each other at a user, the pair in one order whichever came first."""
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select("event_type", nxt.alias("nxt")).where("nxt IS NOT NULL")
    return rows.groupBy(F.least("event_type", "nxt").alias("a"), F.greatest("event_type", "nxt").alias("b")).agg(F.count("*").alias("n"))


@query("SELECT user_id, array_to_string(list_transform(list_sort(list({'i': i, 't': event_type})), lambda x: x.t)[1:3], '>') AS first_types FROM (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    """The first three different types of each user, in the order they came: a minimum by type, so no user's rows are gathered."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("i"))
    by = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", F.col("event_type").alias("t")))).alias("s"))
    return by.select("user_id", F.array_join(tx.first_distinct(F.transform("s", lambda x: x["t"]), 3), ">").alias("first_types"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def reply_objects(spark, d):
    """The object in replies of three kinds: fenced, in prose, and cut off before its end."""
    kind = F.col("event_id") % 3
    reply = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" - done."))).otherwise(F.expr("rtrim('}', props)"))
    return table(spark, d, "events").select("event_id", tx.reply_json(reply, "k long")["k"].alias("k"))


@query("SELECT conv_id, turn, trim(text) AS clean FROM conversations")
def reminders_out(spark, d):
    """Turns with injected blocks taken out again: they are the turns as they were."""
    put = F.concat(F.lit("<system-reminder>note "), F.col("turn").cast("string"), F.lit("\nmore</system-reminder>"), "text", F.lit("<system-reminder></system-reminder>"))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.without_reminders(put).alias("clean"))


@query(r"SELECT k AS fact_key, count(*) AS versions, max(doc_id) AS newest FROM (SELECT doc_id, substring(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g'), 1, 40) AS k FROM documents) GROUP BY 1 HAVING count(*) > 1")
def fact_versions(spark, d):
    """Facts that begin alike are versions of one; the newest holds."""
    by = table(spark, d, "documents").groupBy(tx.fact_key(F.col("text")).alias("fact_key")).agg(F.count("*").alias("versions"), F.max("doc_id").alias("newest"))
    return by.where("versions > 1")


@query("SELECT conv_id, turn, '[' || turn || '] [' || role || '] [] ' || text AS line FROM conversations")
def turn_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.turn_line(F.col("turn"), F.col("role"), F.lit(None), F.col("text")).alias("line"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'no_relation' END AS relation, greatest(0.0, least(1.0, value / 100))::DOUBLE AS confidence FROM events")
def judgments(spark, d):
    relation, confidence = tx.judgment(F.concat(F.lit(" "), F.upper("event_type")), (F.col("value") / 100).cast("string"), ["click", "view"])
    return table(spark, d, "events").select("event_id", relation.alias("relation"), confidence.alias("confidence"))


REFERENCES = "'[' || string_agg('\"e' || event_id || '\"', ',' ORDER BY event_id) || ']'"


@query(f"""WITH r AS (SELECT user_id, {REFERENCES} AS box, count(*) AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 3 = 2 THEN NULL WHEN user_id % 3 = 1 THEN 1 ELSE json_array_length(box) END::BIGINT AS n FROM r""")
def reference_containers(spark, d):
    """References to each user's events: an array, its first one alone as an object, or an array that was cut off."""
    ids = F.array_sort(F.collect_list("event_id"))
    by = table(spark, d, "events").groupBy("user_id").agg(F.concat(F.lit('["e'), F.array_join(F.transform(ids, lambda i: i.cast("string")), '","e'), F.lit('"]')).alias("box"), F.min("event_id").alias("first"))
    k = F.col("user_id") % 3
    one = F.concat(F.lit('{"id": "e'), F.col("first").cast("string"), F.lit('"}'))
    refs = tx.reference_list(F.when(k == 0, F.col("box")).when(k == 1, one).otherwise(F.expr("substring(box, 1, length(box) - 2)")))
    return by.select("user_id", F.when(refs.isNotNull(), F.size(refs)).cast("long").alias("n"))


@query("""WITH c AS (SELECT conv_id, turn, text, substring(text, 5, 14) AS quote, length(text) AS n FROM conversations), q AS (SELECT conv_id, quote, turn FROM c WHERE length(quote) = 14),
p AS (SELECT q.conv_id, q.turn, c.turn AS source, contains(c.text, q.quote) AS exact, c.n FROM q JOIN c ON q.conv_id = c.conv_id AND q.turn <> c.turn WHERE contains(c.text, q.quote) OR len(list_filter(range(1, 6), lambda i: contains(c.text, substring(q.quote, i, 10)))) > 0)
SELECT conv_id, turn, arg_max(source, (exact::INT, n, -source)) AS source, max(exact::INT)::BIGINT AS exact FROM p GROUP BY 1, 2""")
def quote_support(spark, d):
    """For a quote of each turn the other turn of its conversation that supports it best: exact before partial, long before short.

    Partial support is any run of ten characters of the quote.
    """
    return substrings.best_sources(table(spark, d, "conversations"), "conv_id", "turn", "text", start=5, length=14, run=10)


@query("""SELECT event_id, sha256('{"event":' || event_id || ',"k":' || json_extract(props, '$.k') || '}') AS checksum FROM events""")
def canonical_checksums(spark, d):
    """Checksum of an event's object, whatever order and white space its keys came in."""
    raw = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(' , "event" : '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.sha2(tx.canonical_json(raw), 256).alias("checksum"))


@query("""SELECT event_id, '{"outer":{"token":"[SEALED]","kind":"' || event_type || '"},"checksum":{"token":' || user_id || '}}' AS sealed FROM events""")
def sealed_keys(spark, d):
    """Nested values with a sensitive key's value sealed at any depth; the checksum's are exempt."""
    user = F.col("user_id").cast("string")
    raw = F.concat(F.lit('{"outer": {"token": {"id": '), user, F.lit('}, "kind": "'), "event_type", F.lit('"}, "checksum": {"token": '), user, F.lit("}}"))
    return table(spark, d, "events").select("event_id", nested.seal_keys(raw, {"Token"}, {"checksum"}).alias("sealed"))


@query("""SELECT conv_id, bool_or(role = 'user') AS refused FROM conversations GROUP BY 1""")
def private_payloads(spark, d):
    """Conversations as nested payloads, a turn under its role; those that hold what a user wrote are refused."""
    turn = F.to_json(F.map_from_arrays(F.array("role"), F.array(F.map_from_arrays(F.array(F.lit("text")), F.array("text")))))
    by = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list(turn), ",").alias("turns"))
    raw = F.concat(F.lit('{"session": {"turns": ['), "turns", F.lit("]}}"))
    return by.select("conv_id", nested.has_key(raw, {"user", "prompt"}).alias("refused"))


def _sql_redacted(mark) -> str:
    out = "text"
    for name, pattern in tx.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mark(name)}', 'g')"
    return out


@query(f"SELECT doc_id, redacted, masked FROM (SELECT doc_id, text, {_sql_redacted(lambda n: f'[{n}]')} AS redacted, sha256({_sql_redacted(lambda n: '***')}) AS masked FROM documents) WHERE redacted <> text")
def redaction_modes(spark, d):
    """Texts that the ordered rules change: with labels, and the digest of the masked text."""
    text = F.col("text")
    rows = table(spark, d, "documents").select("doc_id", "text", tx.redact_by(text).alias("redacted"), F.sha2(tx.redact_by(text, "mask"), 256).alias("masked"))
    return rows.where("redacted <> text").drop("text")


@query("SELECT doc_id, rules FROM (SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in tx.REDACTIONS) + "], lambda x: x IS NOT NULL), ',') AS rules FROM documents) WHERE rules <> ''")
def secret_rules(spark, d):
    """Names of the rules that find something in a text, private keys, mail addresses and credentials among them."""
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.rules_hit(F.col("text")), ",").alias("rules")).where("rules <> ''")


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system' WHEN length(text) < 40 AND role = 'assistant' THEN 'sidechain' WHEN role = 'user' THEN 'user' WHEN role = 'assistant' THEN 'assistant' ELSE 'other' END AS scope FROM conversations""")
def evidence_scope(spark, d):
    """Where a turn's words come from, the first rule that fits: system, side branch, user, assistant."""
    role = F.col("role")
    scope = F.when(role == "system", "system").when((F.length("text") < 40) & (role == "assistant"), "sidechain").when(role == "user", "user").when(role == "assistant", "assistant").otherwise("other")
    return table(spark, d, "conversations").select("conv_id", "turn", scope.alias("scope"))


@query("SELECT doc_id FROM documents WHERE NOT (source IN ('src3', 'src7') OR contains(lower(text), 'password') OR contains(lower(text), '@'))")
def unrestricted(spark, d):
    """Documents that are of no restricted source and hold no word of a restricted category."""
    words = F.contains(F.lower("text"), F.lit("password")) | F.contains(F.lower("text"), F.lit("@"))
    return table(spark, d, "documents").where(~(F.col("source").isin("src3", "src7") | words)).select("doc_id")


@query("""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - d, 12) DESC, vec_id) AS r FROM d)
SELECT query_id, vec_id, round(greatest(0.0, 1 - d / 2), 4) AS event_score, round(1 - d, 4) AS unit_score FROM r WHERE r <= 4""")
def layer_scores(spark, d):
    """One distance on the scales of two layers, which aren't comparable: half of it from one, and all of it."""
    from ..operators import vectors

    e = table(spark, d, "embeddings")
    near = vectors.nearest(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).where("vec_id <> query_id")
    from pyspark.sql import Window

    first = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 4")
    away = 1 - F.col("score")
    return first.select("query_id", "vec_id", F.round(F.greatest(F.lit(0.0), 1 - away / 2), 4).alias("event_score"), F.round(1 - away, 4).alias("unit_score"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'd' || (event_id % 1500) WHEN 1 THEN 'd' || (event_id % 1500) || '-part' ELSE 'x' || event_id END AS ref FROM events), k AS (SELECT 'd' || doc_id AS id FROM documents)
SELECT CASE WHEN ref IN (SELECT id FROM k) THEN 'valid' WHEN split_part(ref, '-', 1) IN (SELECT id FROM k) THEN 'repaired' ELSE 'dropped' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def reference_repair(spark, d):
    """References that are known, those known once what follows their first dash is cut off, and the rest."""
    i = F.col("event_id")
    ref = F.when(i % 3 == 0, F.concat(F.lit("d"), (i % 1500).cast("string"))).when(i % 3 == 1, F.concat(F.lit("d"), (i % 1500).cast("string"), F.lit("-part"))).otherwise(F.concat(F.lit("x"), i.cast("string")))
    rows = table(spark, d, "events").select(ref.alias("ref")).withColumn("head", F.split_part("ref", F.lit("-"), F.lit(1)))
    known = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("head")).withColumn("there", F.lit(True))
    outcome = F.when(F.col("there").isNull(), "dropped").when(F.col("ref") == F.col("head"), "valid").otherwise("repaired")
    return rows.join(known, "head", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(DISTINCT source) AS sources, sum(n)::BIGINT AS documents, sum(chars)::BIGINT AS chars FROM (SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1, 2) GROUP BY 1")
def flow_rollup(spark, d):
    """Sums of sums: what each language's sources hold."""
    by = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return by.groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.sum("n").alias("documents"), F.sum("chars").alias("chars"))
