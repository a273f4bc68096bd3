"""Exact queries over events: projection by name, conjunctive filters, counts by dimensions, pages."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, fields: list[str], allowed: dict[str, str]) -> DataFrame:
    """Fields by name in the order given, each once; an unknown one is an error."""
    unknown = [f for f in fields if f not in allowed]
    if unknown:
        raise ValueError(f"unknown fields {unknown}")
    return df.select(*(F.col(allowed[f]).alias(f) for f in dict.fromkeys(fields)))


def select(df: DataFrame, equal: dict[str, object] | None = None, start: tuple[str, object] | None = None, end: tuple[str, object] | None = None, keyword: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows that meet all conditions; an empty condition is none. Bounds are inclusive; the keyword may be in any column, in either case."""
    for column, value in (equal or {}).items():
        if value not in (None, ""):
            df = df.where(F.col(column) == F.lit(value))
    if start and start[1]:
        df = df.where(F.col(start[0]) >= F.lit(start[1]))
    if end and end[1]:
        df = df.where(F.col(end[0]) <= F.lit(end[1]))
    if keyword and keyword[1]:
        word = F.lower(F.lit(keyword[1]))
        found = F.lit(False)
        for c in keyword[0]:
            found = found | F.coalesce(F.contains(F.lower(F.col(c)), word), F.lit(False))
        df = df.where(found)
    return df


def counts(df: DataFrame, dims: dict[str, Column], unique: str | None = None) -> DataFrame:
    """Rows, or distinct values of ``unique``, by the dimensions."""
    n = F.countDistinct(unique) if unique else F.count("*")
    return df.groupBy(*(c.alias(k) for k, c in dims.items())).agg(n.alias("n"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int, most: int = 200) -> DataFrame:
    """Rows offset .. offset + limit of a total order."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def after(df: DataFrame, key: list[str], last: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows by ``key`` after the values ``last``: unlike an offset, the cost doesn't grow with the place."""
    if last is not None:
        types = dict(df.dtypes)
        df = df.where(F.struct(*key) > F.struct(*(F.lit(v).cast(types[k]).alias(k) for k, v in zip(key, last, strict=True))))
    return df.orderBy(*key).limit(limit)


def encode_cursor(last: tuple) -> str:
    """An opaque text for the key that a page ended with."""
    return base64.urlsafe_b64encode(json.dumps(list(last)).encode()).decode()


def decode_cursor(cursor: str | None) -> tuple | None:
    """The key in a cursor, None for the first page; anything else is an error."""
    if not cursor:
        return None
    try:
        key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except ValueError as e:
        raise ValueError("bad cursor") from e
    if not isinstance(key, list):
        raise ValueError("bad cursor")
    return tuple(key)


def null_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column the share of rows that are null or blank: one pass, one row for each column."""
    blank = [F.round(F.avg(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1.0).otherwise(0.0)), 4).alias(c) for c in columns]
    one = df.agg(*blank)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rate")) for c in columns))).alias("x")).select("x.*")
