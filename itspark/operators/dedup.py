"""Exact de-duplication and removal of conflicting records.

Both steps are aggregates with map-side combining: a key that holds a third of all rows reaches the
shuffle as one row per map task, so no task ever sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


# Types whose min and max fit a hash aggregate; any other column makes it a sort aggregate.
_FIXED_WIDTH = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _one_row_per_key(df: DataFrame, keys: Sequence[str]):
    """The grouped table, whether all rows of a key agree, and how to get a column of them."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    fixed = all(isinstance(f.dataType, _FIXED_WIDTH) for f in rest)
    return (_agree_by_column if fixed else _agree_by_row)(df, keys, [f.name for f in rest])


def collapse_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the other columns, nulled where copies of the key disagree, and ``conflicted``.

    Exact copies agree with themselves, so they are removed in the same shuffle. Null keys form one group.
    """
    grouped, agreed, value = _one_row_per_key(df, keys)
    kept = ~F.col("conflicted")
    return grouped.withColumn("conflicted", ~agreed).select(
        *keys, *[F.when(kept, value(c)).alias(c) for c in df.columns if c not in keys], "conflicted"
    )


def _agree_by_row(df: DataFrame, keys: Sequence[str], names: Sequence[str]):
    """All rows of a key are equal when the smallest and the largest are."""
    payload = F.struct(*[F.col(c) for c in names])
    grouped = df.groupBy(*keys).agg(F.min(payload).alias("_low"), F.max(payload).alias("_high"))
    return grouped, F.col("_low").eqNullSafe(F.col("_high")), lambda c: F.col("_low").getField(c)


def _agree_by_column(df: DataFrame, keys: Sequence[str], names: Sequence[str]):
    """All rows of a key are equal when each column has one value, or none at all, in all of them."""
    sums = [F.count(F.lit(1)).alias("_n")]
    agreed = F.lit(True)
    for c in names:
        sums += [F.min(c).alias(f"_low_{c}"), F.max(c).alias(f"_high_{c}"), F.count(c).alias(f"_n_{c}")]
        known = F.col(f"_n_{c}")
        one_value = (known == F.col("_n")) & (F.col(f"_low_{c}") == F.col(f"_high_{c}"))
        agreed = agreed & F.coalesce((known == 0) | one_value, F.lit(False))
    return df.groupBy(*keys).agg(*sums), agreed, lambda c: F.col(f"_low_{c}")


def drop_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove exact copies, then every row of a key that still has more than one row."""
    grouped, agreed, value = _one_row_per_key(df, keys)
    return grouped.filter(agreed).select(*[F.col(c) if c in keys else value(c).alias(c) for c in df.columns])


def drop_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove every row of a key with more than one row, exact copies included."""
    rest = [c for c in df.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("_one"))
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(payload).alias("_row"))
    return once.filter(F.col("_n") == 1).select(
        *[F.col("_row").getField(c).alias(c) if c in rest else F.col(c) for c in df.columns]
    )


def conflict_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts: rows in, distinct rows, keys, keys in conflict, rows lost to each step, rows kept."""
    versions = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    per_key = versions.groupBy(*keys).agg(
        F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_versions")
    )
    conflicted = F.col("_versions") > 1
    totals = per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows_in"),
        F.coalesce(F.sum("_versions"), F.lit(0)).alias("rows_distinct"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(conflicted).alias("keys_conflicted"),
        F.coalesce(F.sum(F.when(conflicted, F.col("_versions"))), F.lit(0)).alias("rows_conflicted"),
    )
    return totals.select(
        "rows_in",
        "rows_distinct",
        (F.col("rows_in") - F.col("rows_distinct")).alias("copies_dropped"),
        "keys",
        "keys_conflicted",
        "rows_conflicted",
        (F.col("rows_distinct") - F.col("rows_conflicted")).alias("rows_kept"),
    )
