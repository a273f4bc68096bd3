"""Queries: views of conversations and joins over their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, graph, ledger
from ..runtime import materialize
from ..sources.tables import table
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


EPISODES = """WITH t AS (SELECT conv_id, turn, role, lag(turn) OVER w AS before, lag(role) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), l AS (SELECT conv_id, turn, (before = turn - 1 AND asked = 'user' AND role = 'assistant') AS linked FROM t),
s AS (SELECT conv_id, count(*) FILTER (linked) AS links FROM l GROUP BY 1), e AS (SELECT l.conv_id, l.turn, CASE WHEN links = 0 THEN 0 ELSE sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY l.conv_id ORDER BY l.turn) END AS k FROM l JOIN s USING (conv_id)), f AS (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id, k) AS episode FROM e) """


def _episodes(spark, d):
    """(conv_id, turn, episode): turns that an answer links to its question; a conversation without a link is one episode."""
    t = _turns(spark, d).select("conv_id", "turn", "role")
    asked = t.where("role = 'user'").select("conv_id", F.col("turn").alias("src"))
    answers = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("src"))
    links = materialize(asked.join(answers, ["conv_id", "src"]))
    edges = links.select(F.struct("conv_id", F.col("src").alias("turn")).alias("src"), F.struct("conv_id", (F.col("src") + 1).alias("turn")).alias("dst"))
    parts = graph.components(edges).select("node.conv_id", "node.turn", F.col("component.turn").alias("episode"))
    linked = links.select("conv_id").distinct().withColumn("linked", F.lit(True))
    first = t.groupBy("conv_id").agg(F.min("turn").alias("start"))
    rows = t.select("conv_id", "turn").join(parts, ["conv_id", "turn"], "left").join(linked, "conv_id", "left").join(first, "conv_id")
    return rows.select("conv_id", "turn", F.when(F.col("linked"), F.coalesce("episode", "turn")).otherwise(F.col("start")).alias("episode"))


@query(EPISODES + "SELECT conv_id, turn, episode FROM f")
def episode_views(spark, d):
    return _episodes(spark, d)


@query("""WITH m AS (SELECT c.conv_id, s.turn AS marker, c.turn, c.turn < s.turn AS compacted, c.turn > s.turn OR (c.turn = s.turn - 1 AND s.turn % 2 = 0) AS retained FROM conversations c JOIN conversations s ON c.conv_id = s.conv_id AND s.role = 'system')
SELECT conv_id, marker, count(*) FILTER (compacted) AS compacted, count(*) FILTER (retained) AS retained, count(*) FILTER (compacted AND retained) AS overlap, count(*) FILTER (compacted AND retained) > 0 AS contradiction FROM m GROUP BY 1, 2""")
def compaction_windows(spark, d):
    """At each marker the turns that went into a summary and those kept; a turn in both contradicts.

    Turns before a marker are counted by a running sum, so the work is linear in a conversation.
    """
    rows = _turns(spark, d).groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.sum((F.col("role") == "system").cast("int")).alias("m"))
    by, order = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("turn")
    below = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.when((F.lag("turn").over(order) == F.col("turn") - 1) & (F.col("turn") % 2 == 0), F.lag("n").over(order)).otherwise(0)
    at = rows.select("conv_id", F.col("turn").alias("marker"), "m", "n", below.alias("below"), before.alias("overlap"), F.sum("n").over(by).alias("total")).where("m > 0")
    kept = F.col("total") - F.col("below") - F.col("n") + F.col("overlap")
    times = lambda c: (c * F.col("m")).cast("long")
    return at.select("conv_id", "marker", times(F.col("below")).alias("compacted"), times(kept).alias("retained"), times(F.col("overlap")).alias("overlap"), (F.col("overlap") > 0).alias("contradiction"))


CROSS = """WITH RECURSIVE k AS (SELECT DISTINCT conv_id, lower(split_part(text, ' ', 1)) AS k FROM conversations WHERE role = 'user' AND turn = 0), u AS MATERIALIZED (SELECT DISTINCT a.conv_id AS x, b.conv_id AS y FROM k a JOIN k b USING (k)), r AS (SELECT x AS node, x AS seen FROM u UNION SELECT node, y FROM r JOIN u ON seen = x), c AS (SELECT node AS conv_id, min(seen) AS family FROM r GROUP BY 1) """


def _families(spark, d):
    """(conv_id, family): conversations that begin alike, linked through their common beginnings instead of in pairs."""
    key = F.lower(F.split_part("text", F.lit(" "), F.lit(1)))
    k = _turns(spark, d).where("role = 'user' AND turn = 0").select("conv_id", key.alias("k")).distinct()
    hub = k.groupBy("k").agg(F.min("conv_id").alias("hub"))
    parts = graph.components(k.join(hub, "k").select(F.col("conv_id").alias("src"), F.col("hub").alias("dst")))
    return parts.select(F.col("node").alias("conv_id"), F.col("component").alias("family"))


@query(CROSS + "SELECT family, count(*) AS conversations, max(conv_id) AS newest FROM c GROUP BY 1")
def cross_session_views(spark, d):
    return _families(spark, d).groupBy("family").agg(F.count("*").alias("conversations"), F.max("conv_id").alias("newest"))


@query("SELECT sha256(lower(split_part(text, ' ', 1))) AS topic, count(DISTINCT conv_id) AS members, sha256(array_to_string(list_sort(list(DISTINCT conv_id)), ',')) AS member_digest, count(*) AS anchors FROM conversations WHERE role = 'user' GROUP BY 1")
def topic_registry(spark, d):
    """Topics by the hash of what a question begins with; members of all anchors of one key are one set.

    The digest is of all members in order: a topic's rows go through it as a sorted stream, and none are held.
    """
    topic = F.sha2(F.lower(F.split_part("text", F.lit(" "), F.lit(1))), 256)
    rows = _turns(spark, d).where("role = 'user'").groupBy(topic.alias("topic"), "conv_id").agg(F.count("*").alias("n"))
    return rows.repartition("topic").sortWithinPartitions("topic", "conv_id").mapInPandas(ledger.ordered_digests, "topic string, members long, member_digest string, anchors long")


@query("SELECT conv_id, 'view_' || substring(sha256(string_agg(turn || ':' || sha256(text), '|' ORDER BY turn)), 1, 24) AS view_id, bool_and(length(text) < 2000) AS faithful FROM conversations GROUP BY 1")
def view_digests(spark, d):
    """A view's id from its turns in order, and whether all of them came whole."""
    part = F.array_sort(F.collect_list(F.struct("turn", F.sha2("text", 256).alias("h"))))
    by = _turns(spark, d).groupBy("conv_id").agg(part.alias("s"), F.bool_and(F.length("text") < 2000).alias("faithful"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["h"])), "|")
    return by.select("conv_id", F.concat(F.lit("view_"), F.substring(F.sha2(text, 256), 1, 24)).alias("view_id"), "faithful")


@query(EPISODES.replace("WITH t AS", "WITH RECURSIVE t AS") + ", k AS " + CROSS.split("k AS ", 1)[1].replace("r AS (SELECT x AS node", "rr AS (SELECT x AS node").replace("FROM r JOIN u", "FROM rr JOIN u").replace("FROM r GROUP BY", "FROM rr GROUP BY") + """SELECT 'turn' AS family, count(*) AS views FROM conversations UNION ALL SELECT 'episode', count(DISTINCT (conv_id, episode)) FROM f UNION ALL SELECT 'session', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'cross_session', count(DISTINCT family) FROM c UNION ALL SELECT 'topic', count(DISTINCT lower(split_part(text, ' ', 1))) FROM conversations WHERE role = 'user'""")
def all_views(spark, d):
    """How many views each family gives of one state of the conversations."""
    t = _turns(spark, d)
    parts = [
        t.agg(F.count("*").alias("views")).select(F.lit("turn").alias("family"), "views"),
        _episodes(spark, d).agg(F.countDistinct("conv_id", "episode").alias("views")).select(F.lit("episode").alias("family"), "views"),
        t.agg(F.countDistinct("conv_id").alias("views")).select(F.lit("session").alias("family"), "views"),
        _families(spark, d).agg(F.countDistinct("family").alias("views")).select(F.lit("cross_session").alias("family"), "views"),
        t.where("role = 'user'").agg(F.countDistinct(F.lower(F.split_part("text", F.lit(" "), F.lit(1)))).alias("views")).select(F.lit("topic").alias("family"), "views"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations, round(avg(length(text)), 4) AS size FROM conversations GROUP BY 1")
def graph_type_counts(spark, d):
    return _turns(spark, d).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.round(F.avg(F.length("text")), 4).alias("size"))


EDGES = "SELECT user_id AS u, event_type AS t, count(*) AS w FROM events GROUP BY 1, 2"


@query(f"WITH e AS ({EDGES}), n AS (SELECT 'u' || u AS node, w FROM e UNION ALL SELECT 't' || t, w FROM e) SELECT node, count(*) AS degree, 15 + 4 * count(*) AS size, sum(w)::BIGINT AS strength FROM n GROUP BY 1")
def graph_export(spark, d):
    """Nodes of the user and type graph for display, sized by their degree."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("w"))
    ends = F.array(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("t"), "event_type"))
    n = e.select(F.explode(ends).alias("node"), "w")
    return n.groupBy("node").agg(F.count("*").alias("degree"), (15 + 4 * F.count("*")).alias("size"), F.sum("w").alias("strength"))


@query(f"WITH e AS ({EDGES}) SELECT u, t, w, place FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, t) AS place FROM e) WHERE place <= 3")
def neighbour_profile(spark, d):
    """The strongest neighbours of each node, one row for each."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.count("*").alias("w"))
    return e.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("w"), "t")).cast("long")).where("place <= 3")


@query(f"WITH e AS ({EDGES}), s AS (SELECT u, sum(w) AS w FROM e GROUP BY 1), k AS (SELECT u FROM s ORDER BY w DESC, u LIMIT 10) SELECT u, t, w FROM e WHERE u IN (SELECT u FROM k)")
def bounded_graph(spark, d):
    """The ten strongest users and the edges that stay inside what is kept."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("t")).agg(F.count("*").alias("w"))
    kept = e.groupBy("u").agg(F.sum("w").alias("s")).orderBy(F.desc("s"), "u").limit(10)
    return e.join(kept.select("u"), "u", "left_semi")


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'gear' OR (NOT EXISTS (SELECT 1 FROM part WHERE lower(p_name) = 'gear') AND contains(lower(p_name), 'gear'))")
def node_by_subject(spark, d):
    """Parts of exactly that name in any case; only if there is none, those whose name holds its last word."""
    rows = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"))
    exact = rows.where("n = 'gear'").select("p_partkey", F.lit(1).alias("step"))
    near = rows.where("n <> 'gear' AND contains(n, 'gear')").select("p_partkey", F.lit(2).alias("step"))
    both = exact.union(near)
    first = both.agg(F.min("step").alias("step"))
    return both.join(F.broadcast(first), "step").select("p_partkey")


# --- joins


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS kind, round(c_acctbal / 100)::BIGINT AS tok, c_nationkey AS ref FROM customer WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL), r AS (SELECT min(id) AS id, kind, tok, ref FROM c GROUP BY kind, tok, ref),
p AS (SELECT a.id AS a, b.id AS b, (a.kind = b.kind AND a.ref = b.ref)::INT AS s1, (a.tok = b.tok)::INT AS s2, (a.ref = b.ref AND a.tok % 10 = b.tok % 10)::INT AS s3 FROM r a JOIN r b ON a.id < b.id)
SELECT a, b, (s1 + s2 + s3)::BIGINT AS signals FROM p WHERE s1 + s2 + s3 > 0 UNION ALL SELECT r.id, c.id, 3 FROM c JOIN r USING (kind, tok, ref) WHERE c.id <> r.id""")
def signal_pairs(spark, d):
    """Pairs of customers that share one of three signals and how many of them agree: one equi join for each signal.

    Customers of equal kind, amount and nation agree in all that is compared; the first of them stands for the others
    in the pairs of one or two signals, and its pairs of three signals say whom it stands for. So no link is lost,
    and pairs grow with the classes, not with the square of the customers.
    """
    key = ["kind", "tok", "ref"]
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.round(F.col("c_acctbal") / 100).cast("long").alias("tok"), F.col("c_nationkey").alias("ref")).dropna(subset=key)
    r = materialize(c.groupBy(*key).agg(F.min("id").alias("id")))
    out = None
    for k in (F.struct("kind", "ref"), F.struct("tok"), F.struct("ref", (F.col("tok") % 10).alias("t"))):
        s = r.select("id", k.alias("k"))
        x, y = s.alias("x"), s.alias("y")
        found = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        out = found if out is None else out.union(found)
    same = c.withColumnRenamed("id", "b").join(r.withColumnRenamed("id", "a"), key).where("a <> b").select("a", "b", F.lit(3).cast("long").alias("signals"))
    return out.groupBy("a", "b").agg(F.count("*").alias("signals")).union(same)


@query("""WITH s AS (SELECT DISTINCT split_part(p_type, ' ', -1) AS subject FROM part), n AS (SELECT p_partkey, p_type, lower(p_brand) || ':' || split_part(p_type, ' ', -1) AS name FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, subject, CASE WHEN name = subject THEN 'equal' ELSE 'suffix' END AS how FROM n JOIN s ON name = subject OR suffix(name, ':' || subject)""")
def suffix_join(spark, d):
    """Names that equal a subject or end with a colon and it: what follows the last colon is the key of an equi join."""
    part = table(spark, d, "part")
    last = F.element_at(F.split("p_type", " "), -1)
    s = part.select(last.alias("subject")).distinct()
    n = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lower("p_brand"), F.lit(":"), last).alias("name"))
    keyed = n.withColumn("subject", F.substring_index("name", ":", -1))
    return keyed.join(s, "subject").select("p_partkey", "subject", F.when(F.col("name") == F.col("subject"), "equal").otherwise("suffix").alias("how"))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(regexp_replace(replace('raw\' || regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1), '\', '/'), '^(Agent/)?raw/', ''), '/+$', '') AS path FROM pages) SELECT a.page_id AS a, b.page_id AS b FROM n a JOIN n b ON a.path = b.path AND a.page_id < b.page_id AND a.path <> ''""")
def path_join(spark, d):
    """Addresses of one path, written with either slash and with or without a store's prefix."""
    raw = F.concat(F.lit("raw\\"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*/?([^?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), "^(Agent/)?raw/", ""), "/+$", "")
    n = table(spark, d, "pages").select("page_id", path.alias("path")).where("path <> ''")
    x, y = n.alias("x"), n.alias("y")
    return x.join(y, (F.col("x.path") == F.col("y.path")) & (F.col("x.page_id") < F.col("y.page_id"))).select(F.col("x.page_id").alias("a"), F.col("y.page_id").alias("b"))


@query("""WITH u AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS entity FROM conversations), x AS (SELECT conv_id, turn, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}'))) AS n FROM conversations)
SELECT 'bound' AS kind, count(*) AS n FROM u JOIN documents ON doc_id = conv_id UNION ALL SELECT 'no_entity', count(*) FROM x WHERE n = 0 UNION ALL SELECT 'no_document', count(*) FROM x LEFT JOIN documents ON doc_id = conv_id WHERE doc_id IS NULL AND n > 0""")
def entity_bindings(spark, d):
    """Turns joined to their documents, a row for each entity, and the turns left out by why."""
    t = _turns(spark, d).select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]{5,})"), F.lit(1))).alias("e"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("there"))
    rows = t.join(docs, "conv_id", "left")
    n = F.size("e")
    kind = F.when(n == 0, "no_entity").when(F.col("there").isNull(), "no_document").otherwise("bound")
    by = rows.groupBy(kind.alias("kind")).agg(F.sum(F.when(n == 0, 1).when(F.col("there").isNull(), 1).otherwise(n)).alias("n"))
    kinds = by.sparkSession.range(3).select(F.element_at(F.array(*map(F.lit, ("bound", "no_entity", "no_document"))), (F.col("id") + 1).cast("int")).alias("kind"))
    return kinds.join(by, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.w) + len(b.w) > 0)
SELECT conv_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, b DESC, a) AS r FROM p WHERE score < 0.75) WHERE r = 1""")
def best_pairs(spark, d):
    """The most alike but not equal turns of each conversation, the later pair of equals."""
    t = _turns(spark, d).select("conv_id", "turn", tx.tokens(F.col("text")).alias("w"))
    x, y = t.alias("x"), t.alias("y")
    p = x.join(y, (F.col("x.conv_id") == F.col("y.conv_id")) & (F.col("x.turn") < F.col("y.turn"))).where(F.size("x.w") + F.size("y.w") > 0)
    p = p.select(F.col("x.conv_id").alias("conv_id"), F.col("x.turn").alias("a"), F.col("y.turn").alias("b"), F.round(tx.jaccard(F.col("x.w"), F.col("y.w")), 6).alias("score")).where("score < 0.75")
    return dedup.first_of(p, ["conv_id"], [-F.col("score"), -F.col("b"), F.col("a")])


@query("""WITH r AS (SELECT event_id, unnest(CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['d' || event_id % 1500] WHEN 2 THEN ['d' || event_id % 700, 'u' || user_id] ELSE ['u' || (event_id % 200), 'bad'] END) AS ref FROM events), c AS (SELECT event_id, ref, CASE WHEN ref LIKE 'd%' THEN doc_id IS NOT NULL WHEN ref LIKE 'u%' THEN u.user_id IS NOT NULL ELSE false END AS ok, ref LIKE 'd%' OR ref LIKE 'u%' AS parsed FROM r LEFT JOIN documents ON ref = 'd' || doc_id LEFT JOIN (SELECT DISTINCT user_id FROM events) u ON ref = 'u' || u.user_id)
SELECT e.event_id, coalesce(bool_and(parsed), false) AS all_parseable, coalesce(bool_and(ok), false) AS all_resolved FROM events e LEFT JOIN c USING (event_id) GROUP BY 1""")
def exploded_references(spark, d):
    """Whether all references of a row can be read, and resolve in their own tables; a row without any does neither."""
    e = table(spark, d, "events").select("event_id", "user_id")
    k, i = F.col("event_id") % 4, F.col("event_id")
    ref = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    refs = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(ref("d", i % 1500))).when(k == 2, F.array(ref("d", i % 700), ref("u", F.col("user_id")))).otherwise(F.array(ref("u", i % 200), F.lit("bad")))
    r = e.select("event_id", F.explode_outer(refs).alias("ref"))
    known = table(spark, d, "documents").select(ref("d", F.col("doc_id")).alias("ref")).union(e.select(ref("u", F.col("user_id")))).distinct().withColumn("there", F.lit(True))
    rows = r.join(known, "ref", "left")
    return rows.groupBy("event_id").agg(F.coalesce(F.bool_and(F.col("ref").rlike("^[du]")), F.lit(False)).alias("all_parseable"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_resolved"))


@query("SELECT user_id, event_id, strftime(ts, '%Y-%m') AS month FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m') DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def top_evidence(spark, d):
    """The twenty newest rows of each user, months first and then ids."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM").alias("month"))
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("month"), F.desc("event_id")))
    return rows.withColumn("r", r).where("r <= 20").drop("r")
