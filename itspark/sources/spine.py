"""Period spine: the lookup tables of the study axis, generated."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.functions.axis import N_PERIODS, N_PRE, its_terms


def spine_columns(df: DataFrame, origin, start: int = 0, n_pre: int = N_PRE, n: int = N_PERIODS) -> DataFrame:
    """Add terms, truncated index and first day of the period to a table with a ``period`` column.

    ``origin`` is the first day of period 1, as a date or a Column.
    """
    first = origin if not isinstance(origin, (date, str)) else F.lit(str(origin)).cast("date")
    truncated = F.when(F.col("period") > start, F.col("period") - start)
    return its_terms(df, "period", n_pre, n).withColumns(
        {
            "time_truncated": truncated.cast("int"),
            "week_start": F.date_add(first, ((F.col("period") - 1) * 7).cast("int")),
        }
    )


def period_spine(
    spark: SparkSession, n: int = N_PERIODS, origin="2015-08-10", n_pre: int = N_PRE, start: int = 0
) -> DataFrame:
    """One row per period 1..n."""
    periods = spark.range(1, n + 1).select(F.col("id").cast("int").alias("period"))
    return spine_columns(periods, origin, start, n_pre, n)
