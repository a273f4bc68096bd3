"""Long-term memory: names of projects from paths, what is known of a subject, and lifecycle changes that are applied as they were previewed or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.runs import row_digest

#: A folder for projects in a path, and the name after it.
PROJECT = r"(?i)(?:^|[/\\])(?:projects?|repos?|src|work(?:space)?s?|code)[/\\]+([^/\\\s:?#\"'<>|]{2,64})"


class Stale(ValueError):
    """The store isn't what the preview saw."""


def projects(df: DataFrame, text: Column, by: list[str], blocked: list[str]) -> DataFrame:
    """(by.., project, mentions): valid names after a project folder in paths of the text, in lower case."""
    names = F.transform(F.regexp_extract_all(text, F.lit(PROJECT), F.lit(1)), lambda x: F.lower(x))
    rows = df.select(*by, F.explode(names).alias("project")).where(tx.valid_name(F.col("project"), blocked))
    return rows.groupBy(*by, "project").agg(F.count("*").alias("mentions"))


def profile(memories: DataFrame, kind: str, limit: int) -> DataFrame:
    """The surest current memories of a kind, ``limit`` of them; equal ones by the newest, then by id."""
    rows = memories.where((F.col("kind") == F.lit(kind)) & (F.col("lifecycle") == "current"))
    return rows.orderBy(F.desc("confidence"), F.desc("updated"), "memory_id").limit(max(1, limit))


def with_evidence(memories: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """Memories with ``refs``, how much evidence they have, and ``first_refs``, the first few references; those without any stay."""
    from pyspark.sql import Window

    ranked = evidence.select("memory_id", "ref").distinct().withColumn("r", F.row_number().over(Window.partitionBy("memory_id").orderBy("ref")))
    by = ranked.groupBy("memory_id").agg(F.count("*").alias("refs"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("ref")))).alias("first_refs"))
    return memories.join(by, "memory_id", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))


LIFECYCLE = {("current", "expire"): "expired", ("current", "conflict"): "conflict", ("conflict", "resolve"): "current", ("expired", "renew"): "current", ("current", "retract"): "retracted", ("conflict", "retract"): "retracted"}


def planned(memories: DataFrame, actions: DataFrame) -> DataFrame:
    """(memory_id, was, action, becomes, refusal) of actions (memory_id, action): unknown memories, several actions on one, and steps that aren't legal are refused."""
    pairs = [F.struct(F.lit(a).alias("was"), F.lit(b).alias("action"), F.lit(c).alias("becomes")) for (a, b), c in LIFECYCLE.items()]
    legal = F.filter(F.array(*pairs), lambda p: (p["was"] == F.col("was")) & (p["action"] == F.col("action")))
    one = actions.groupBy("memory_id").agg(F.min("action").alias("action"), F.countDistinct("action").alias("n"))
    rows = one.join(memories.select("memory_id", F.col("lifecycle").alias("was")), "memory_id", "left").withColumn("becomes", F.try_element_at(legal, F.lit(1))["becomes"])
    refusal = F.when(F.col("was").isNull(), "unknown").when(F.col("n") > 1, "ambiguous").when(F.col("becomes").isNull(), "illegal")
    return rows.select("memory_id", "was", "action", F.when(refusal.isNull(), F.col("becomes")).alias("becomes"), refusal.alias("refusal"))


def preview(memories: DataFrame, actions: DataFrame) -> str:
    """A hash of the store's state and of what the actions would do to it."""
    state = memories.agg(row_digest(*sorted(memories.columns))).first()[0]
    plan = planned(memories, actions).agg(row_digest("memory_id", "was", "action", "becomes", "refusal")).first()[0]
    from ..sources.runs import checksum

    return checksum({"state": state, "plan": plan})


def applied(memories: DataFrame, actions: DataFrame, seen: str) -> DataFrame:
    """The memories after the actions, if both are still what ``preview`` hashed as ``seen``; refused actions change nothing."""
    if preview(memories, actions) != seen:
        raise Stale("the preview is of another state or of other actions")
    done = planned(memories, actions).where("refusal IS NULL").select("memory_id", "becomes")
    return memories.join(done, "memory_id", "left").withColumn("lifecycle", F.coalesce("becomes", "lifecycle")).select(*memories.columns)
