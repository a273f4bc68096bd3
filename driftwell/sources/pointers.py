"""Pointers of a store: numbered files of which each can be created once, so that of two publishers one wins.

Pointer n is the file ``_pointers/<n>.json``. A publisher says which pointer it has seen and creates the next one;
if that exists, someone was ahead, and nothing is overwritten. The newest whole pointer is what the store serves.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

FOLDER = "_pointers"


class Pointer(NamedTuple):
    n: int
    target: str
    note: str


class Conflict(RuntimeError):
    """Another publisher moved the pointer first."""


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that mustn't exist yet, through the file system of its path; False if it does."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    try:
        out = files.create(target, False)
    except Exception as e:  # noqa: BLE001  a Py4J error; only that of a file that is there by now means a lost race
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def history(spark: SparkSession, store: str) -> list[Pointer]:
    """All pointers in order, one row for each publication; a file that is still being written isn't one yet."""
    try:
        rows = spark.read.schema("n long, target string, note string").json(f"{store}/{FOLDER}").where("n IS NOT NULL AND target IS NOT NULL").collect()
    except AnalysisException:  # nothing published yet
        return []
    return sorted(Pointer(r.n, r.target, r.note) for r in rows)


def newest(spark: SparkSession, store: str) -> Pointer | None:
    return max(history(spark, store), default=None)


def move(spark: SparkSession, store: str, target: str, seen: int, note: str = "") -> Pointer:
    """Point to ``target`` if the newest pointer is still the one ``seen``, 0 for none; else a ``Conflict``."""
    now = newest(spark, store)
    if (now.n if now else 0) != seen:
        raise Conflict(f"pointer {now.n} is newer than {seen}")
    n = seen + 1
    if not create(spark, f"{store}/{FOLDER}/{n:08d}.json", json.dumps({"n": n, "target": target, "note": note})):
        raise Conflict(f"pointer {n} was created by another publisher")
    return Pointer(n, target, note)
