"""External facts: sources that are allowed, snapshots of facts known by a hash of their members, and the policy that a snapshot must meet when it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.runs import row_digest

#: What is wrong with a fact, the first that holds.
REFUSALS = ("unknown_source", "source_disabled", "kind_not_allowed", "value_missing", "window_invalid", "observed_after_ingest")


def admitted(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """``facts`` (source_id, fact_id, kind, value, valid_from, valid_to, observed_at, ingested_at, ..) with ``refusal``, null for those that may come in.

    registry: (source_id, enabled, kinds); a source that isn't in it is refused. A fact is valid from before its end,
    and was observed before it was taken in.
    """
    known = registry.select("source_id", F.col("enabled").alias("_on"), F.col("kinds").alias("_kinds"), F.lit(True).alias("_known"))
    code = (
        F.when(F.col("_known").isNull(), REFUSALS[0])
        .when(~F.coalesce("_on", F.lit(False)), REFUSALS[1])
        .when(~F.coalesce(F.array_contains("_kinds", F.col("kind")), F.lit(False)), REFUSALS[2])
        .when(F.col("value").isNull(), REFUSALS[3])
        .when(F.col("valid_from").isNull() | (F.col("valid_to") < F.col("valid_from")), REFUSALS[4])
        .when(F.col("observed_at").isNull() | F.col("ingested_at").isNull() | (F.col("observed_at") > F.col("ingested_at")), REFUSALS[5])
    )
    return facts.join(known, "source_id", "left").withColumn("refusal", code).drop("_on", "_kinds", "_known")


def snapshot(members: DataFrame, by: list[str]) -> DataFrame:
    """(by.., members, regions, region, oldest_ingest, member_hash): snapshots of facts, with a hash that no order of members changes."""
    named = [c for c in members.columns if c not in by]
    return members.groupBy(*by).agg(
        F.count("*").alias("members"), F.countDistinct("region").alias("regions"), F.min("region").alias("region"), F.min("ingested_at").alias("oldest_ingest"), F.max("ingested_at").alias("newest_ingest"),
        F.sha2(row_digest(*named), 256).alias("member_hash"),
    )


def policy(members: DataFrame, by: list[str], expected: DataFrame, region: str, now: Column, most_seconds: int) -> DataFrame:
    """(by.., verdict) of each expected snapshot (by.., member_hash): what stops its use at ``now``, the first that holds, or ok.

    missing: no member; drift: its members aren't those expected; region: a member of another region, or several;
    conflict: a member whose lifecycle is; lifecycle: one that isn't current; future: taken in after now; stale: taken
    in more than ``most_seconds`` ago; expired: a member whose validity ended before now, where an end at now still
    counts.
    """
    if most_seconds < 0:
        raise ValueError("a snapshot's age can't be limited below 0")
    one = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    seconds = now.cast("timestamp").cast("long") - F.col("ingested_at").cast("timestamp").cast("long")
    state = members.groupBy(*by).agg(
        one(~F.coalesce(F.col("region") == F.lit(region), F.lit(False))).alias("elsewhere"), one(F.col("lifecycle") == "conflict").alias("conflict"), one(~F.coalesce(F.col("lifecycle") == "current", F.lit(False))).alias("other"),
        one(seconds < 0).alias("future"), one(seconds > most_seconds).alias("stale"), one(F.col("valid_to") < now).alias("expired"),
    )
    held = snapshot(members, by).select(*by, F.col("member_hash").alias("_now"))
    rows = expected.select(*by, "member_hash").join(held, by, "left").join(state, by, "left")
    on = lambda c: F.col(c) == 1
    verdict = (
        F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("member_hash"), "drift").when(on("elsewhere"), "region").when(on("conflict"), "conflict")
        .when(on("other"), "lifecycle").when(on("future"), "future").when(on("stale"), "stale").when(on("expired"), "expired").otherwise("ok")
    )
    return rows.select(*by, verdict.alias("verdict"))
