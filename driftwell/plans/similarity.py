"""Queries: text functions, duplicates, vectors, retrieval and its metrics."""

from __future__ import annotations

from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, evaluation, graph, vector_index, vectors
from ..runtime import shared_folder
from ..sources.tables import table
from ..streaming import feeds
from .catalogue import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.query

GRAMS = "(CASE WHEN length({0}) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, length({0}) - 3) + 1), lambda i: substring({0}, i, 4))) END)"
BARE = r"lower(regexp_replace(text, '\s+', '', 'g'))"
GRAM_SETS = f"SELECT item_id, {GRAMS.format(BARE)} AS g FROM benchmark"


@query(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g')) AS clean FROM documents")
def squeeze(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.squeeze(F.col("text")).alias("clean"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', 'UUID', 'g'), 'https?://[^ \n\t]+', 'URL', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 'MAIL', 'g'), '[0-9a-f]{16,}', 'HEX', 'g'), '[0-9]+', 'N', 'g') AS skeleton FROM documents""")
def skeleton(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.skeleton(F.col("text")).alias("skeleton"))


@query(r"""SELECT doc_id, redacted FROM (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9]{13,19}', '[CARD]', 'g'), '\+?[0-9]{1,3}[ -]?\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}', '[PHONE]', 'g') AS redacted FROM documents) WHERE redacted <> text""")
def pii_redact(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", tx.redact(F.col("text")).alias("redacted"))
    return rows.where("redacted <> text").select("doc_id", "redacted")


@query()
def luhn_cards(spark, d):
    """Card-like numbers that pass the check digit; DuckDB has no such function."""
    numbers = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1))).alias("number"))
    return numbers.where(F.length("number").between(13, 19)).where(F.expr("luhn_check(number)")).distinct()


RULES = [("table", [" | "]), ("shout", ["!!"]), ("marks", ["###", "$$$"]), ("mail", ["@"])]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), {w!r})' for w in ws)} THEN '{n}'" for n, ws in RULES) + " ELSE 'prose' END AS kind FROM documents")
def rule_classify(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_rule(F.col("text"), RULES, "prose").alias("kind"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", tx.host(F.col("url")).alias("host"))


@query("SELECT event_id, 'ev_' || substring(sha256(event_id || '|' || user_id || '|' || event_type), 1, 24) AS stable_id FROM events")
def deterministic_ids(spark, d):
    return table(spark, d, "events").select("event_id", tx.stable_id("ev_", F.col("event_id"), F.col("user_id"), F.col("event_type")).alias("stable_id"))


@query("SELECT doc_id, (length(text) - length(replace(lower(text), 'the', ''))) // 3 AS hits FROM documents WHERE contains(lower(text), 'the')")
def hit_count(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.hits("the", F.col("text")).alias("hits")).where("hits > 0")


@query(f"WITH s AS ({GRAM_SETS}) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS jaccard FROM s a JOIN s b ON a.item_id < b.item_id AND len(list_intersect(a.g, b.g)) > 0 WHERE round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) >= 0.12")
def jaccard_pairs(spark, d):
    """Pairs of similar gram sets, by their rare grams first."""
    sets = table(spark, d, "benchmark").select("item_id", tx.ngrams(F.col("text")).alias("g"))
    found = dedup.similar_sets(sets, "item_id", "g", 0.119)
    return found.select("a", "b", F.round(F.col("common") / (F.col("m") + F.col("n") - F.col("common")), 6).alias("jaccard")).where("jaccard >= 0.12")


@query("WITH t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '([a-z0-9_]{2,})', 1))) AS k FROM benchmark) SELECT k AS token, count(*) AS items FROM t GROUP BY 1 HAVING count(*) >= 5")
def token_overlap(spark, d):
    words = table(spark, d, "benchmark").select("item_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("items")).where("items >= 5")


SQUEEZED = r"lower(trim(regexp_replace(text, '[ \t\n\f\r\v]+', ' ', 'g')))"


@query(f"SELECT sha256({SQUEEZED}) AS key_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_dup_groups(spark, d):
    return dedup.equal_groups(table(spark, d, "documents"), "doc_id", F.lower(tx.squeeze(F.col("text"))))


@query(f"SELECT doc_id, source, merged_count FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY {SQUEEZED}) AS merged_count, row_number() OVER (PARTITION BY {SQUEEZED} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dup_fold(spark, d):
    return dedup.fold(table(spark, d, "documents"), "doc_id", F.lower(tx.squeeze(F.col("text"))), [F.col("doc_id")]).select("doc_id", "source", "merged_count")


@query(f"""SELECT sha256(k) AS key_hash, arg_max(doc_id, (length(text), -doc_id)) AS longest, min(coalesce(quality, 1)) AS quality FROM (SELECT d.doc_id, text, {SQUEEZED} AS k, quality FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY k""")
def merge_rule(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.sha2(F.lower(tx.squeeze(F.col("text"))), 256).alias("key_hash"), F.length("text").alias("n"), F.coalesce("quality", F.lit(1)).alias("quality"))
    return rows.groupBy("key_hash").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("longest"), F.min("quality").alias("quality"))


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def strongest_twin(spark, d):
    return dedup.first_of(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [-F.col("n_chars"), F.col("doc_id")]).select("source", "doc_id")


@query()
def greedy_leader(spark, d):
    """Items joined to the first leader of their length bucket; sequential, tested against a plain loop."""
    items = table(spark, d, "benchmark").select("item_id", F.floor(F.length("text") / 40).alias("bucket"), tx.ngrams(F.col("text"), 3).alias("g"))
    return dedup.leaders(items, ["bucket"], "item_id", "g", 0.3)


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
KNN = f"SELECT query_id, vec_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round({COS}, 4) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 12) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON true WHERE a.vec_id % 100 = 0)"


def _nearest(spark, d, k):
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


@query(KNN + " WHERE rank <= 5")
def knn_topk(spark, d):
    return _nearest(spark, d, 5).select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(KNN + " WHERE rank <= 10")
def vector_search(spark, d):
    """The ten nearest by the clustered index's exact search."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search(vector_index.build(rows), asked, 10, probes=None)
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def vector_recall(spark, d):
    """Share of the exact results that three quarters of the lists give; these vectors are hardly clustered."""
    rows = table(spark, d, "embeddings")
    index = vector_index.build(rows)
    return vector_index.recall(index, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, -(-3 * len(index.centroids) // 4))


@query(f"SELECT k.query_id, k.vec_id, k.score FROM ({KNN}) k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE rank <= 6 AND k.query_id <> k.vec_id AND a.label <> b.label")
def knn_join_filtered(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    found = _nearest(spark, d, 6).where("query_id <> vec_id")
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return both.where("label <> own").select("query_id", "vec_id", F.round("score", 4).alias("score"))


SIM = f"SELECT a.vec_id AS a, b.vec_id AS b, round({COS}, 4) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COS} >= 0.4"


@query(SIM)
def sim_edges(spark, d):
    return vectors.similar(table(spark, d, "embeddings"), 0.4).select("a", "b", F.round("score", 4).alias("score"))


@query(f"WITH RECURSIVE e AS ({SIM}), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS seen FROM u UNION SELECT node, y FROM r JOIN u ON seen = x) SELECT node, min(seen) AS component FROM r GROUP BY 1")
def sim_components(spark, d):
    return graph.components(vectors.links(table(spark, d, "embeddings"), [0.4]).select("src", "dst"))


@query("""WITH x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings, range(1, 65) t(i)), c AS (SELECT label, i, sum(v) AS s, count(*) AS n FROM x GROUP BY 1, 2), m AS (SELECT vec_id, x.label, round((sum(v * s) - 1) / (max(n) - 1), 6) AS mean FROM x JOIN c ON x.label = c.label AND x.i = c.i GROUP BY 1, 2)
SELECT label, vec_id, mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, vec_id) AS r FROM m) WHERE r = 1""")
def central_representative(spark, d):
    """The row with the greatest mean cosine to the others of its label: the mean of dot products is the dot product with the sum, so no pairs are made."""
    rows = table(spark, d, "embeddings")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v))
    flat = rows.select("vec_id", "label", norm.alias("norm"), F.posexplode("embedding").alias("i", "v")).select("vec_id", "label", "i", (F.col("v").cast("double") / F.col("norm")).alias("v"))
    sums = flat.groupBy("label", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    mean = flat.join(sums, ["label", "i"]).groupBy("vec_id", "label").agg(F.round((F.sum(F.col("v") * F.col("s")) - 1) / (F.max("n") - 1), 6).alias("mean"))
    best = mean.groupBy("label").agg(F.max(F.struct("mean", (-F.col("vec_id")).alias("minus"))).alias("b"))
    return best.select("label", (-F.col("b.minus")).alias("vec_id"), F.col("b.mean").alias("mean"))


HITS = f"SELECT k.query_id, k.rank, (a.label = b.label)::INT AS relevant, a.label FROM ({KNN}) k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.vec_id WHERE k.rank <= 20"
SCORES = f"SELECT query_id, label, max(relevant) AS hit, coalesce(max(CASE WHEN relevant = 1 THEN 1.0 / rank END), 0.0) AS reciprocal, CASE WHEN sum(relevant) > 0 THEN sum(relevant / log2(rank + 1.0)) / list_sum(list_transform(range(1, sum(relevant)::BIGINT + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END AS ndcg FROM ({HITS}) GROUP BY 1, 2"


def _hits(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    both = _nearest(spark, d, 20).join(labels, "vec_id").join(own, "query_id")
    return both.select("query_id", "rank", (F.col("label") == F.col("own")).cast("int").alias("relevant"), F.col("own").alias("label"))


@query(f"SELECT count(*) AS queries, round(avg(hit), 6) AS recall, round(avg(reciprocal), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({SCORES})")
def recall_mrr_ndcg(spark, d):
    return evaluation.summary(evaluation.per_query(_hits(spark, d), 20))


@query(f"SELECT label, count(*) AS queries, round(avg(hit), 6) AS recall, round(avg(reciprocal), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({SCORES}) GROUP BY 1")
def per_scenario(spark, d):
    hits = _hits(spark, d)
    return evaluation.summary(evaluation.per_query(hits, 20).join(hits.select("query_id", "label").distinct(), "query_id"), ["label"])


@query(f"WITH a AS ({SCORES}), b AS (SELECT query_id, max(relevant) AS hit, coalesce(max(CASE WHEN relevant = 1 THEN 1.0 / (21 - rank) END), 0.0) AS reciprocal FROM ({HITS}) GROUP BY 1) SELECT count(*) FILTER (b.reciprocal > a.reciprocal) AS wins, count(*) FILTER (b.reciprocal < a.reciprocal) AS losses, count(*) FILTER (b.reciprocal = a.reciprocal) AS ties FROM a JOIN b USING (query_id)")
def win_loss(spark, d):
    hits = _hits(spark, d)
    return evaluation.win_loss(evaluation.per_query(hits, 20), evaluation.per_query(hits.withColumn("rank", 21 - F.col("rank")), 20), "reciprocal")


@query()
def bootstrap_ci(spark, d):
    """Interval of the mean reciprocal rank by resampled queries; the draws are hashes, which DuckDB lacks."""
    return evaluation.bootstrap(evaluation.per_query(_hits(spark, d), 20), "reciprocal", rounds=200)


@query("""WITH t AS (SELECT quality, length(text) AS n FROM documents JOIN labels USING (doc_id)), c AS (SELECT n AS cut, sum(quality) OVER w AS kept_good, sum(1 - quality) OVER w AS kept_bad, sum(quality) OVER () AS good, sum(1 - quality) OVER () AS bad FROM t WINDOW w AS (ORDER BY n DESC RANGE UNBOUNDED PRECEDING))
SELECT arg_max(cut, (kept_good, cut)) AS cut, round(max(kept_good) / max(good), 6) AS retention FROM c WHERE kept_bad <= 0.5 * bad""")
def threshold_select(spark, d):
    """The length bound that keeps most good documents while at most half of the bad ones stay; counts by distinct length."""
    rows = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("cut")).join(table(spark, d, "labels"), "doc_id")
    by = rows.groupBy("cut").agg(F.sum("quality").alias("g"), F.sum(1 - F.col("quality")).alias("b"))
    down = Window.orderBy(F.desc("cut"))
    c = by.select("cut", F.sum("g").over(down).alias("kept_good"), F.sum("b").over(down).alias("kept_bad"), F.sum("g").over(Window.partitionBy()).alias("good"), F.sum("b").over(Window.partitionBy()).alias("bad"))
    ok = c.where(F.col("kept_bad") <= 0.5 * F.col("bad"))
    return ok.agg(F.max_by("cut", F.struct("kept_good", "cut")).alias("cut"), F.round(F.max("kept_good") / F.max("good"), 6).alias("retention"))


LAYERS = "SELECT 1 AS layer, 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 2, 'c' || conv_id || ':' || turn, text FROM conversations UNION ALL SELECT 3, 'p' || page_id, html FROM pages"


@query(f"""WITH a AS (SELECT layer, id, (length(text) - length(replace(lower(text), 'token', ''))) // 5 AS hits FROM ({LAYERS})), q AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY hits DESC, id) AS place FROM a WHERE hits > 0)
SELECT layer, id, hits, row_number() OVER (ORDER BY layer, place) AS rank FROM q WHERE place <= CASE layer WHEN 1 THEN 10 WHEN 2 THEN 6 ELSE 4 END""")
def hybrid_search(spark, d):
    """Keyword search over three layers with a quota each; what is ranked together is the quotas' sum."""
    docs = table(spark, d, "documents").select(F.lit(1).alias("layer"), F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit(2).alias("layer"), F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.lit(3).alias("layer"), F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    found = None
    for rows, quota in ((docs, 10), (turns, 6), (pages, 4)):
        top = rows.select("layer", "id", tx.hits("token", F.col("text")).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(quota)
        found = top if found is None else found.union(top)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("layer", F.desc("hits"), "id")).cast("long"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'excluded' WHEN quality = 0 THEN 'weak' WHEN length(text) < 40 THEN 'short' ELSE 'ok' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def evidence_gate(spark, d):
    labels = table(spark, d, "labels").withColumn("known", F.lit(True))
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 0, "weak").when(F.length("text") < 40, "short").otherwise("ok")
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", reason.alias("reason"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def incremental_agg(spark, d):
    """The same counts through a file stream that goes on where it stopped; a batch that comes again replaces its part."""
    source = table(spark, d, "events")
    rows = feeds.read(spark, f"{d}/events.parquet*", source.schema)
    # The state belongs to the table whose first file this is: one written anew under the same path starts afresh.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{d}/events.parquet*")
    first = files.select("path", "length", F.col("modificationTime").cast("string").alias("at")).orderBy("path").first()
    name = f"incremental_agg/{sha256('|'.join([d, *map(str, first or ())]).encode()).hexdigest()[:16]}"
    parts = f"{shared_folder(spark)}/streams/{name}/parts"
    schema = source.limit(0).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).schema

    def merge(batch, batch_id):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{parts}/batch={batch_id}")

    feeds.fold(rows, name, merge)
    try:
        found = spark.read.schema(schema).parquet(parts)
    except AnalysisException:  # no file has come yet
        found = spark.createDataFrame([], schema)
    return found.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))
