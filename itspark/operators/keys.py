"""Joins on equally named columns where null equals null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null matching null; the key columns come once, as with a join by name."""
    new = [c for c in right.columns if c not in keys]
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(right, same, how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in keys})
    return joined.select(*left.columns, *new)
