"""Readers and writers.

Readers take explicit schemas where the format carries none. Writers partition by what readers filter on, and a
published store is a new folder and then one new pointer file, so readers see a whole generation or the one before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize
from . import pointers

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One record of a session export, whatever family wrote it; what a family lacks is null.
SESSION_RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "session_id", "conversation_id", "message_id", "turn_id", "uuid", "parentUuid", "role", "timestamp", "title", "name", "content", "sessionId", "prompt")] + [T.StructField("message", T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))])

EXPORT_FORMATS = ("json", "jsonl", "csv")
EXPORT_MOST = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session exports in JSON lines, (session_id, message_id, parent_id, role, kind, timestamp, content, blocks).

    A record's session is session_id, conversation_id or sessionId, its id message_id, uuid or turn_id; role and
    content may be in its message, and the content may be a list of blocks: then ``content`` is their text, thoughts
    left out, and ``blocks`` has their types. Records that aren't JSON objects keep their text in ``content`` with
    kind "unreadable".
    """
    raw = spark.read.schema(T.StructType([*SESSION_RECORD.fields, T.StructField("_bad", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    bad = F.col("_bad").isNotNull()
    said = F.coalesce("content", "message.content", "prompt")
    blocks = F.when(said.startswith("["), F.from_json(said, "array<struct<type:string,text:string,name:string>>"))
    texts = F.array_join(F.array_compact(F.transform(F.filter(blocks, lambda x: F.coalesce(x["type"], F.lit("text")).isin("text", "input_text", "output_text")), lambda x: x["text"])), "\n")
    return raw.select(
        F.coalesce("session_id", "conversation_id", "sessionId").alias("session_id"),
        F.coalesce("message_id", "uuid", "turn_id").alias("message_id"),
        F.col("parentUuid").alias("parent_id"),
        F.coalesce("role", "message.role").alias("role"),
        F.when(bad, "unreadable").otherwise(F.col("type")).alias("kind"),
        "timestamp",
        F.when(bad, F.col("_bad")).when(blocks.isNotNull(), texts).otherwise(said).alias("content"),
        F.when(blocks.isNotNull(), F.transform(blocks, lambda x: x["type"])).alias("blocks"),
    )


def read_turns(spark: SparkSession, path: str, least: int = 20) -> DataFrame:
    """Whole-file JSON artifacts, sessions with turns in them, as rows (session_id, turn, role, narrative), turns from 1.

    Narratives of fewer than ``least`` characters, or of asterisks alone, are dropped; the numbers stay.
    """
    schema = "sessions array<struct<session_id:string,turns:array<struct<role:string,narrative:string>>>>"
    s = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("sessions").alias("s"))
    rows = s.select("s.session_id", F.posexplode("s.turns").alias("at", "t")).select("session_id", (F.col("at") + 1).alias("turn"), "t.role", F.trim("t.narrative").alias("narrative"))
    return rows.where((F.length("narrative") >= least) & ~F.col("narrative").rlike(r"^[*\s]*$"))


def scan_files(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """(path, family, size, modified, fingerprint, change) of the files under family folders of ``root``.

    ``known`` is an earlier scan. A file is unchanged if its content's sha256 is; its time alone proves nothing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select("path", F.element_at(F.split("path", "/"), -2).alias("family"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("fingerprint"))
    if known is None:
        return found.withColumn("change", F.lit("added"))
    old = known.select("path", F.col("fingerprint").alias("_was"))
    change = F.when(F.col("fingerprint").isNull(), "removed").when(F.col("_was").isNull(), "added").when(F.col("_was") == F.col("fingerprint"), "unchanged").otherwise("changed")
    return found.join(old, "path", "full_outer").withColumn("change", change).drop("_was")


def snapshot(df: DataFrame, columns: list[str], key: str, wanted: DataFrame, path: str) -> None:
    """Copy the allowed columns of the wanted keys' rows; an unknown column is an error, and so is a copy that exists."""
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    df.join(wanted.select(key).distinct(), key, "left_semi").select(*columns).write.mode("error").parquet(path)


def split_store(df: DataFrame, condition: Column, path: str) -> None:
    """Rows of one table in two halves by a condition, ``half=true`` and ``half=false``; null counts as false."""
    df.withColumn("half", F.coalesce(condition, F.lit(False))).write.mode("error").partitionBy("half").parquet(path)


def write_vectors(df: DataFrame, path: str, document: int = 2000, title: int = 100) -> int:
    """Append (id, embedding, document, title) rows whose id the collection lacks, texts cut to their limits; how many."""
    spark = df.sparkSession
    rows = df.select("id", "embedding", F.substring("document", 1, document).alias("document"), F.substring("title", 1, title).alias("title")).dropDuplicates(["id"])
    try:
        rows = rows.join(spark.read.parquet(path).select("id"), "id", "left_anti")
    except AnalysisException:  # no collection yet
        pass
    rows = materialize(rows)
    rows.write.mode("append").parquet(path)
    return rows.count()


def write_graph(edges: DataFrame, path: str) -> None:
    """Node and edge tables of the accepted (src, dst, kind, accepted) edges; nodes that no accepted edge has aren't written."""
    kept = edges.where("accepted").select("src", "dst", "kind").distinct()
    kept.write.mode("error").partitionBy("kind").parquet(f"{path}/edges")
    kept.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.mode("error").parquet(f"{path}/nodes")


def register_run(df: DataFrame, store: str, run_id: str) -> None:
    """Results of an evaluation run, which can't be written twice."""
    df.write.mode("error").parquet(f"{store}/run_id={run_id}")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases in JSON lines; a record that doesn't fit the schema fails the read."""
    schema = "id string, split string, query string, gold_evidence_refs array<string>, allowed_unit_types array<string>, expected_abstain boolean, expected_conflict boolean, group string"
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def export(df: DataFrame, path: str, fmt: str, order: list[Column], limit: int = EXPORT_MOST) -> None:
    """At most EXPORT_MOST ordered rows as JSON, JSON lines or CSV with a header."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    rows = df.orderBy(*order).limit(max(1, min(limit, EXPORT_MOST)))
    if fmt == "csv":
        rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def publish(df: DataFrame, store: str, generation: str, keys: list[str]) -> None:
    """Write a generation and point to it; a generation that exists, or has a key twice or null, is refused, and so is one that another publisher got ahead of."""
    spark = df.sparkSession
    seen = pointers.newest(spark, store)
    twice = df.groupBy(*keys).count().where("count > 1")
    null = df.where(" OR ".join(f"{k} IS NULL" for k in keys))
    if not twice.isEmpty() or not null.isEmpty():
        raise ValueError("keys are null or not unique")
    df.write.mode("error").parquet(f"{store}/generation={generation}")
    pointers.move(spark, store, generation, seen.n if seen else 0)


def current(spark: SparkSession, store: str) -> DataFrame:
    """The generation of the newest pointer; a publication that failed before its pointer never shows."""
    newest = pointers.newest(spark, store)
    return spark.read.parquet(f"{store}/generation={newest.target if newest else None}")


def rollback(spark: SparkSession, store: str, generation: str) -> None:
    """Point to a generation that was published before; the pointers stay as the store's history."""
    old = pointers.history(spark, store)
    if generation not in {p.target for p in old}:
        raise ValueError(f"generation {generation!r} was never published")
    pointers.move(spark, store, generation, max(p.n for p in old))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it lacks, one of each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def dangling(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key isn't null and has no parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
