"""Lookup of one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join ``rows`` (any skew) with ``lookup`` (one row per ``key``); both inputs are read once.

    A key that holds many rows makes one side of a sort-merge join large, which adaptive execution splits. Rows without
    a key match nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how}")
    values = [c for c in lookup.columns if c != key]
    return rows.join(lookup, key, how).select(*[F.col(f"`{c}`") for c in [*rows.columns, *values]])
