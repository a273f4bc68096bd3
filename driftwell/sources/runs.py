"""Content-addressed runs: what a run is made of and what it holds give its name, so that it is written once and can be checked.

A run's manifest has its schema, its row count and a digest of its rows that no order changes. Its id is the hash of
the producer, the inputs and that manifest. A store serves the run that its newest pointer names; ``drift`` tells
whether what lies there is still what the manifest says.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize
from . import pointers

FORBIDDEN = frozenset({"prompt", "raw_text", "content", "message", "password", "secret", "token", "api_key"})


def row_digest(*columns: str) -> Column:
    """Aggregate: two sums over the rows' sha256, 60 bits of each, alike in any order and added up by partitions.

    The sums are decimals, so that no number of rows overflows them; nulls differ from every text.
    """
    whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(whole, at, 15), 16, 10).cast("decimal(20,0)"))
    return F.concat_ws("-", F.coalesce(part(1), F.lit(0)).cast("string"), F.coalesce(part(16), F.lit(0)).cast("string"))


def manifest(df: DataFrame) -> dict:
    """{"columns", "rows", "digest"} of a table; columns count in the order of their names."""
    names = sorted(df.columns)
    n, digest = df.agg(F.count("*"), row_digest(*names)).first()
    return {"columns": [[c, df.schema[c].dataType.simpleString()] for c in names], "rows": n, "digest": digest}


def checksum(value: object) -> str:
    return sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _private(value: object) -> str | None:
    """A forbidden key anywhere in an input manifest."""
    if isinstance(value, dict):
        return next((k for k in value if str(k).lower() in FORBIDDEN), None) or next((f for v in value.values() if (f := _private(v))), None)
    return next((f for v in value if (f := _private(v))), None) if isinstance(value, list | tuple) else None


def plan(df: DataFrame, producer: str, inputs: dict) -> tuple[str, dict]:
    """The id and manifest that a run would have; nothing is written. Inputs may hold names and checksums, no payloads."""
    if not producer.strip():
        raise ValueError("a run needs a producer")
    if (key := _private(inputs)) is not None:
        raise ValueError(f"private key {key!r} in the inputs")
    whole = {"producer": producer, "inputs": inputs, "output": manifest(df)}
    return f"run-{checksum(whole)[:24]}", whole


def write(df: DataFrame, store: str, producer: str, inputs: dict) -> str:
    """Write a run under its id, with its manifest beside it last of all, and give the id; a run that is there whole is left as it is.

    Rows that an attempt without a manifest left behind are replaced: they never counted.
    """
    df = materialize(df)
    run, whole = plan(df, producer, inputs)
    if read_manifest(df.sparkSession, store, run) is None:
        df.write.mode("overwrite").parquet(f"{store}/runs/{run}")
        pointers.create(df.sparkSession, f"{store}/manifests/{run}.json", json.dumps(whole, sort_keys=True))
    return run


def read_manifest(spark: SparkSession, store: str, run: str) -> dict | None:
    try:
        lines = [r.value for r in spark.read.text(f"{store}/manifests/{run}.json").collect()]
    except AnalysisException:
        return None
    try:
        return json.loads("\n".join(lines))
    except ValueError:  # still being written
        return None


def serve(spark: SparkSession, store: str, run: str, seen: int) -> pointers.Pointer:
    """Point the store to a run that is there and whole, if its newest pointer is still the one ``seen``."""
    state = status(spark, store, run)
    if state != "ok":
        raise ValueError(f"run {run!r} is {state}")
    return pointers.move(spark, store, run, seen)


def status(spark: SparkSession, store: str, run: str) -> str:
    """ok, missing (no manifest or no rows), columns, rows or digest: the first thing in which the run isn't what its manifest says."""
    known = read_manifest(spark, store, run)
    if known is None:
        return "missing"
    try:
        now = manifest(spark.read.parquet(f"{store}/runs/{run}"))
    except AnalysisException:
        return "missing"
    return next((k for k in ("columns", "rows", "digest") if now[k] != known["output"][k]), "ok")


def serving(spark: SparkSession, store: str) -> DataFrame:
    """The rows that the store serves."""
    now = pointers.newest(spark, store)
    if now is None:
        raise ValueError("the store serves nothing")
    return spark.read.parquet(f"{store}/runs/{now.target}")


def drift(spark: SparkSession, store: str, projected: str | None = None) -> list[str]:
    """What is wrong with what the store serves: the run's ``status`` unless it is ok, and ``pointer`` if a copy of the pointer elsewhere names another run."""
    now = pointers.newest(spark, store)
    if now is None:
        return ["nothing"]
    state = status(spark, store, now.target)
    return ([] if state == "ok" else [state]) + (["pointer"] if projected is not None and projected != now.target else [])
