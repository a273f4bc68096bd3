"""A term index in tables: postings in blocks of like score, and exact best rows that read few of them.

A posting is (id, term, score): what a term's occurrences in a row are worth. The index keeps

- ``terms``: (term, df, most), how many rows have the term and its greatest score;
- ``heads``: (term, id, score), each term's HEAD best postings;
- ``blocks``: (bucket, term, most, ids, scores), some BLOCK postings each. A term of many postings has blocks of
  one score, dealt by the hash of the id, so the most frequent term is many rows and its blocks sort by their bound;
- ``rows``: (id, term, score), the postings by row, for the exact score of a candidate.

A search first sums the heads: the k-th best sum is a score that the result surely reaches. Terms that together
can't reach it bring no candidates, which are mostly the frequent ones, and of the others only blocks whose greatest
score could reach it with the help of the other terms are opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import scratch

HEAD, BLOCK, BUCKETS = 128, 256, 32


@dataclass(frozen=True)
class TermIndex:
    terms: DataFrame
    heads: DataFrame
    blocks: DataFrame
    rows: DataFrame


def bucket(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def field_postings(rows: DataFrame, ident: str, weights: dict[str, int], pattern: str = r"([a-z0-9_]{2,})") -> DataFrame:
    """(id, term, score): the lower-case runs of ``pattern`` in the columns of ``weights``; an occurrence is worth its column's weight.

    Null fields have no terms. Rows that share an id are one row of the index.
    """
    found = lambda c, w: F.transform(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(pattern), F.lit(1)), lambda t: F.struct(t.alias("term"), F.lit(w).cast("long").alias("w")))
    every = F.concat(*(found(c, w) for c, w in weights.items()))
    return rows.select(F.col(ident).alias("id"), F.explode(every).alias("x")).groupBy("id", "x.term").agg(F.sum("x.w").alias("score"))


def build(postings: DataFrame, path: str) -> TermIndex:
    """Writes the index of (id, term, score), score a long above 0, under ``path``; postings without an id or term are left out.

    Postings of one row and term are summed. Nothing is grouped whole by term but blocks of bounded size: a block's
    key holds its term, score and a part of the ids, as many parts as that score has blocks.
    """
    spark = postings.sparkSession
    given = postings.where(F.col("id").isNotNull() & F.col("term").isNotNull() & (F.col("score") > 0))
    given.groupBy("id", "term").agg(F.sum("score").cast("long").alias("score")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    rows.groupBy("term").agg(F.count("*").alias("df"), F.max("score").alias("most")).write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "id"))
    rows.withColumn("place", place).where(F.col("place") <= HEAD).drop("place").write.parquet(f"{path}/heads")
    large = terms.where(F.col("df") > BLOCK).select("term")
    levels = rows.join(large, "term", "left_semi").groupBy("term", "score").agg(F.count("*").alias("n"))
    levels = levels.select("term", "score", F.ceil(F.col("n") / BLOCK).alias("parts"))
    dealt = rows.join(levels, ["term", "score"], "left")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    keyed = dealt.select("term", "id", "score", F.when(F.col("parts").isNotNull(), F.col("score")).alias("level"), part.alias("part"))
    grouped = keyed.groupBy("term", "level", "part").agg(F.collect_list(F.struct("id", "score")).alias("x"))
    blocks = grouped.select(bucket(F.col("term")).alias("bucket"), "term", F.array_max("x.score").alias("most"), F.col("x.id").alias("ids"), F.col("x.score").alias("scores"))
    # Sorted by term inside a file, so that a file's statistics tell which of its row groups a search needs.
    blocks.repartition("bucket", F.pmod(F.xxhash64("term", "most"), F.lit(8))).sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/blocks")
    return load(spark, path)


def build_scratch(postings: DataFrame, name: str) -> TermIndex:
    """``build`` in a new folder of the shared scratch space."""
    return build(postings, scratch(postings.sparkSession, name))


def load(spark: SparkSession, path: str) -> TermIndex:
    terms, heads, rows = (spark.read.parquet(f"{path}/{p}") for p in ("terms", "heads", "rows"))
    # An index of nothing has no block file that could tell the schema.
    kind = rows.schema["id"].dataType.simpleString()
    blocks = spark.read.schema(f"term string, most long, ids array<{kind}>, scores array<long>, bucket int").parquet(f"{path}/blocks")
    return TermIndex(terms, heads, blocks, rows)


def candidates(index: TermIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id) of all rows that may be among a query's k best; ``asked`` has (query_id, term), each pair once."""
    if k > HEAD:
        raise ValueError(f"heads hold {HEAD} postings, too few for the {k} best")
    known = asked.join(index.terms, "term").select("query_id", "term", "most")
    sums = asked.join(index.heads, "term").groupBy("query_id", "id").agg(F.sum("score").alias("s"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    sure = sums.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("s")).otherwise(F.lit(1)).alias("least"))
    by = Window.partitionBy("query_id")
    upto = F.sum("most").over(by.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
    able = known.join(sure, "query_id").select("query_id", "term", "least", upto.alias("upto"), (F.sum("most").over(by) - F.col("most")).alias("others"))
    able = able.where(F.col("upto") >= F.col("least"))
    blocks = index.blocks.select("bucket", "term", F.col("most").alias("bound"), "ids")
    opened = blocks.join(able.withColumn("bucket", bucket(F.col("term"))), ["bucket", "term"]).where(F.col("bound") + F.col("others") >= F.col("least"))
    return opened.select("query_id", F.explode("ids").alias("id")).distinct()


def search(index: TermIndex, asked: DataFrame, k: int, every_term: bool = False, least: int = 1) -> DataFrame:
    """(query_id, id, score, hits, rank): for each query the k rows of the greatest sums of scores, equal ones by id.

    asked: (query_id, term), pairs once. hits: how many of the query's terms a row has. ``least``: the smallest sum
    that counts. With ``every_term`` rows that lack a term are no results; only the blocks of a query's rarest term
    are opened then. A condition on rows that are searched often belongs into the term (``src1:word``), so that heads
    and blocks know it.
    """
    if every_term:
        rare = Window.partitionBy("query_id").orderBy("df", "term")
        n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
        known = asked.join(index.terms, "term", "left").withColumn("place", F.row_number().over(rare)).where("place = 1 AND df IS NOT NULL")
        opened = index.blocks.join(known.select("query_id", "term", bucket(F.col("term")).alias("bucket")), ["bucket", "term"])
        found = opened.select("query_id", F.explode("ids").alias("id"))
    else:
        found = candidates(index, asked, k)
    scored = found.join(asked, "query_id").join(index.rows, ["id", "term"]).groupBy("query_id", "id").agg(F.sum("score").alias("score"), F.count("*").alias("hits"))
    if every_term:
        scored = scored.join(n, "query_id").where(F.col("hits") == F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)
