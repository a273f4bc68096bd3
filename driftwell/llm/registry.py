"""Queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chosen_path, decontaminate, fingerprint, jaccard_join, lexical_search, licenses, line_dedup, lm, mixing, quality, secrets, token_counts
from ._shared import documents, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.joined("base_spans"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"), "n_random")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.EVERY)


PIECES = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # unless spark.driftwell.pieces names another file


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), token_counts.read_pieces(spark.conf.get("spark.driftwell.pieces", PIECES)))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(documents(spark, sf_dir), width=3, similarity=(90, 100))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(documents(spark, sf_dir), line_dedup.ONE_EDIT)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(documents(spark, sf_dir))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), width=4, similarity=(80, 100))


TOKENIZERS = "/opt/tokenizers"  # unless spark.driftwell.tokenizers names another folder


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = spark.conf.get("spark.driftwell.tokenizers", TOKENIZERS)
    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(f"{folder}/{name}", "rb") as f:
            files.append(f.read())
    both = alignment.Alignment(*files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return both.with_counts(both.groups(documents(spark, sf_dir)).withColumn("groups_sha256", digest).drop("groups"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), k=20)


OP2_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, left(md5('17:' || coalesce(doc_id::VARCHAR, '')), 16) AS key
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), src AS (
  SELECT source, source_size, 3.0 * source_size::DOUBLE AS most, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM by_source
), level AS (
  SELECT 0 AS i, 0.0::DOUBLE AS level
  UNION ALL
  SELECT i + 1, greatest(level, coalesce((SELECT ((SELECT sum(source_size) FROM src)::DOUBLE - sum(CASE WHEN w * level < most THEN 0.0 ELSE most END)) / nullif(sum(CASE WHEN w * level < most THEN w ELSE 0.0 END), 0) FROM src), level))
  FROM level WHERE i < 60
), goal AS (
  SELECT source, source_size, least(w * (SELECT max(level) FROM level), most) AS target, round(least(w * (SELECT max(level) FROM level), most))::BIGINT AS budget FROM src
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.budget // g.source_size ELSE 0 END AS epochs, g.budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM placed
"""


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.k = b.k AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM sets s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


OP11_SQL = OP10_SQL.replace("len(w) < 3", "len(w) < 4").replace("len(w) - 1", "len(w) - 2").replace("|| ' ' || w[i + 2])", "|| ' ' || w[i + 2] || ' ' || w[i + 3])").replace("90 *", "80 *").replace("m.component_id FROM", "m.component_id, s.doc_id = m.component_id AS kept FROM")


OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sized AS (
  SELECT doc_id, t, len(t)::BIGINT AS n FROM terms WHERE len(t) > 0
), total AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sized
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term
), postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total
), scored AS (
  SELECT a.item_id, p.doc_id, sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * nd) // l))))::BIGINT AS score
  FROM asked a JOIN postings p USING (term) JOIN weights w USING (term), total GROUP BY a.item_id, p.doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_line_dedup, op4_lm_score, op5_decontaminate, op6_license_scan, op7_token_counts, op8_fingerprint, op9_quality, op10_ngram_jaccard_join, op11_minhash_near_dedup, op12_align_tokenizers, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_minhash_near_dedup": OP11_SQL, "op13_lexical_search": OP13_SQL}
