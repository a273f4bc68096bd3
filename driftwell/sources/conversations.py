"""Conversation stores: activities as records, a normalised build behind gates, whole sessions around events, imports of generations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from . import pointers

CONTENT = 4000  # code points of an activity's content
ACTIVITY = ("id", "service", "event_at", "action", "title", "excerpt", "created_at")


def activities(df: DataFrame, source: str = "activities") -> DataFrame:
    """(source_id, title, content, created_at, updated_at, source_hash) of rows with the columns ACTIVITY.

    The title is the first of title, action and service that isn't blank, the content the excerpt or else the title;
    either time stands in for the other. The hash is over source, id, time, title and content, so it changes with them.
    """
    missing = [c for c in ACTIVITY if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    filled = lambda c: F.nullif(tx.squeeze(F.col(c)), F.lit(""))
    title = F.coalesce(*map(filled, ("title", "action", "service")), F.lit(""))
    rows = df.select("id", "event_at", "created_at", title.alias("title"), tx.short(F.coalesce(filled("excerpt"), title), CONTENT).alias("content"))
    ident = F.concat(F.lit(f"{source}:"), F.col("id").cast("string"))
    stamp = F.coalesce(F.col("event_at").cast("string"), F.lit(""))
    return rows.select(
        ident.alias("source_id"), "title", "content", F.coalesce("event_at", "created_at").alias("created_at"), F.coalesce("created_at", "event_at").alias("updated_at"),
        F.sha2(F.concat_ws("|", F.lit(source), ident, stamp, "title", "content"), 256).alias("source_hash"),
    )


class GateFailed(ValueError):
    """What was built isn't fit to be published."""


def normalized(sessions: DataFrame, messages: DataFrame, excluded: DataFrame, columns: list[str], secret: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, messages, tombstones) of sessions (session_id, deleted, ..), messages (session_id, ..) and excluded (session_id).

    A session with a secret in any message, one that is excluded and one that is deleted aren't eligible: their
    messages stay out whole, and a tombstone for each reason says why. Sessions keep the allowed ``columns`` and
    messages lose what isn't among them too; a column that neither has is an error. The gates: an exclusion list of
    which no session is known means that it speaks of other ids; a message without a session has lost its own; ids
    are there and unique. Each fails the build before anything is handed on.
    """
    unknown = [c for c in columns if c not in sessions.columns and c not in messages.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    ids = sessions.select("session_id")
    gone = excluded.select("session_id").distinct()
    if not sessions.where("session_id IS NULL").isEmpty() or not ids.groupBy("session_id").count().where("count > 1").isEmpty():
        raise GateFailed("session ids are null or not unique")
    if not gone.isEmpty() and gone.join(ids, "session_id", "left_semi").isEmpty():
        raise GateFailed("no excluded session is known")
    if not messages.join(ids, "session_id", "left_anti").isEmpty():
        raise GateFailed("messages without a session")
    leaks = messages.groupBy("session_id").agg(F.sum(F.when(secret, 1).otherwise(0)).alias("secrets"))
    marked = sessions.join(leaks, "session_id", "left").join(gone.withColumn("excluded", F.lit(True)), "session_id", "left")
    why = F.array_compact(F.array(F.when(F.col("secrets") > 0, "secret"), F.when(F.col("excluded"), "excluded"), F.when(F.coalesce(F.col("deleted"), F.lit(False)), "deleted")))
    judged = materialize(marked.select(*[c for c in columns if c in sessions.columns and c != "session_id"], "session_id", why.alias("reasons")))
    out = judged.withColumn("eligible", F.size("reasons") == 0)
    kept = messages.select("session_id", *[c for c in columns if c in messages.columns and c != "session_id"]).join(out.where("eligible").select("session_id"), "session_id", "left_semi")
    tombs = judged.select("session_id", F.explode("reasons").alias("reason"))
    return out, kept, tombs.select(tx.stable_id("tomb|", F.col("session_id"), F.col("reason")).alias("tombstone_id"), "session_id", "reason")


def around(events: DataFrame, wanted: DataFrame, session: str, ident: str, most: int) -> DataFrame:
    """All events of the sessions that hold a wanted event; more than ``most`` of them is an error, and nothing is cut off."""
    touched = events.join(wanted.select(ident).distinct(), ident, "left_semi").select(session).distinct()
    found = materialize(events.join(touched, session, "left_semi"))
    n = found.count()
    if n > most:
        raise ValueError(f"{n} events are around the wanted ones, more than {most}")
    return found


class Contract:
    """Tables of a generation in the order in which they refer to each other: name to (schema, columns that older sources lack)."""

    def __init__(self, tables: dict[str, tuple[str, frozenset[str]]]):
        self.tables = tables

    def aligned(self, name: str, df: DataFrame) -> DataFrame:
        """The contract's columns by name and type; a column that may lack is null, any other that does is an error, others stay behind."""
        schema, optional = self.tables[name]
        want = df.sparkSession.createDataFrame([], schema).schema
        missing = [f.name for f in want if f.name not in df.columns and f.name not in optional]
        if missing:
            raise ValueError(f"{name} lacks columns {missing}")
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def import_generation(spark: SparkSession, contract: Contract, source: str, target: str, generation: str) -> dict[str, int]:
    """Copy a generation's tables from one store to another and give their row counts.

    Tables lie under ``<store>/<table>/generation=<name>``. Each is aligned with the contract, written, and counted
    on both sides; where a count differs, or a table is missing, what was written goes and the import fails. A
    generation that the target has isn't written again but must have the source's counts. Nothing is activated: a
    pointer does that.
    """
    at = lambda store, name: f"{store}/{name}/generation={generation}"
    counts, written = {}, []
    try:
        for name in contract.tables:
            try:
                rows = spark.read.parquet(at(source, name))
            except AnalysisException as e:
                raise ValueError(f"{name} of {generation} isn't in the source") from e
            aligned = contract.aligned(name, rows)
            try:
                spark.read.parquet(at(target, name)).limit(0).collect()
            except AnalysisException:
                written.append(name)
                aligned.write.mode("error").parquet(at(target, name))
            counts[name] = rows.count()
            if (there := spark.read.parquet(at(target, name)).count()) != counts[name]:
                raise ValueError(f"{name} has {there} rows of {counts[name]}")
    except Exception:
        for name in written:
            pointers.remove(spark, at(target, name))
        raise
    return counts
