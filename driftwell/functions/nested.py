"""Nested JSON values by Arrow batches, where an expression can't walk a value of any depth."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEALED = "[SEALED]"


def seal_keys(x: Column, sensitive: set[str], exempt: set[str] = frozenset()) -> Column:
    """JSON text in which the whole value of each sensitive key, at any depth, is sealed; exempt keys and what is in them stay.

    Keys are compared without case. Text that isn't JSON is sealed whole; null stays null.
    """
    sensitive, exempt = ({k.lower() for k in keys} for keys in (sensitive, exempt))

    def walk(v):
        if isinstance(v, dict):
            return {k: w if k.lower() in exempt else SEALED if k.lower() in sensitive else walk(w) for k, w in v.items()}
        return [walk(w) for w in v] if isinstance(v, list) else v

    def sealed(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(walk(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return SEALED

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(sealed, na_action="ignore")

    return run(x)


def has_key(x: Column, forbidden: set[str]) -> Column:
    """Whether a forbidden key is anywhere in JSON text; text that isn't JSON has none."""
    keys = {k.lower() for k in forbidden}

    def walk(v) -> bool:
        if isinstance(v, dict):
            return any(k.lower() in keys or walk(w) for k, w in v.items())
        return isinstance(v, list) and any(map(walk, v))

    def found(t: str | None) -> bool:
        try:
            return t is not None and walk(json.loads(t))
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(found)

    # Only values that hold a key's name somewhere are parsed.
    names = "(?i)" + "|".join(re.escape(k) for k in sorted(keys)) if keys else "$^"
    return run(F.when(x.rlike(names) | F.contains(x, F.lit("\\")), x))
