"""A corpus pipeline of the training-data operators: each stage works on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwell.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from driftwell.llm._shared import documents, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant, trained on the labels of those at hand, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has, nearly or exactly; those left without a line go."""
    return line_dedup.dedup_lines(docs, line_dedup.ONE_EDIT)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that five-word shingles link at a Jaccard similarity of 0.8."""
    return jaccard_join.one_of_each(docs, width=5, similarity=(80, 100))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles don't cover half of any benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, with size, source_size, target and taken; a text stays whole, taken says how much of it counts."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("n-gram jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed),
]

#: SQL has no discriminant with Cholesky factors; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
