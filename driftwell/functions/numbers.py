"""Number and vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a zero vector has 0 with any other."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of Wilson's interval of a share; null without trials."""
    p = hits / n
    centre = p + z * z / (2 * n)
    wide = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - wide) / scale, (centre + wide) / scale


def index_percentile(sorted_values: Column, q: float) -> Column:
    """The element at index floor(q * n), the last at most, of a sorted array; null of an empty one."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(n - 1, F.floor(n * q).cast("int")))
