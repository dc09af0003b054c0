"""Serial correlation of residuals, per series, without leaving the JVM.

A series has at most one value per period, so the arrays here are as long as the study.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.functions.arrays import dot, let, total


def acf_arrays(
    df: DataFrame, value: str = "residual", by: Sequence[str] = ("series", "model"), order: str = "period",
    max_lag: int | None = None,
) -> DataFrame:
    """One row per series: ``n`` and ``acf``, the array of correlations at lags 0, 1, ...

    Values are taken in order of ``order``, demeaned, and lag sums divided by the lag-0 sum. The default
    number of lags follows the length of each series.
    """
    known = df.filter(F.col(value).isNotNull())
    series = known.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("v")
    )
    n = F.size("v")
    mean = F.try_divide(total(F.col("v")), n)
    centred = series.select(*by, n.cast("long").alias("n"), let(mean, lambda m: F.transform("v", lambda x: x - m)).alias("d"))
    asked = F.lit(max_lag) if max_lag is not None else F.floor(10 * F.log10("n"))
    last = F.least(asked, F.col("n") - 1).cast("int")
    squares = dot(F.col("d"), F.col("d"))

    def at_lag(k: Column) -> Column:
        left = (F.col("n") - k).cast("int")
        return dot(F.slice("d", F.lit(1), left), F.slice("d", k + 1, left))

    lags = let(squares, lambda s0: F.transform(F.sequence(F.lit(0), last), lambda k: F.try_divide(at_lag(k), s0)))
    return centred.select(*by, "n", lags.alias("acf"))


def acf(df: DataFrame, value: str = "residual", by: Sequence[str] = ("series", "model"), **kwargs) -> DataFrame:
    """Autocorrelation in long form: ``lag, acf``, with the white-noise limit ``band``."""
    rows = acf_arrays(df, value, by, **kwargs)
    return rows.select(*by, "n", F.posexplode("acf").alias("lag", "acf")).withColumn("band", 1.96 / F.sqrt("n"))


def partial_from_acf(r: Column) -> Column:
    """Partial autocorrelations at lags 1, 2, ... from the array of autocorrelations from lag 0 on.

    The coefficients of each order follow from those of the order before: the new last coefficient is the
    part of the lag the lower order leaves unexplained, and it corrects the others in mirrored pairs.
    """
    start = F.struct(
        F.expr("cast(array() as array<double>)").alias("phi"), F.expr("cast(array() as array<double>)").alias("pacf")
    )

    def next_order(state: Column, k: Column) -> Column:
        phi = state["phi"]
        nearest_last = F.slice(r, F.lit(2), k - 1)
        unexplained = F.get(r, k) - dot(phi, F.reverse(nearest_last))
        left_over = F.lit(1.0) - dot(phi, nearest_last)

        def extend(last: Column) -> Column:
            corrected = F.zip_with(phi, F.reverse(phi), lambda own, mirrored: own - last * mirrored)
            return F.struct(
                F.concat(corrected, F.array(last)).cast("array<double>").alias("phi"),
                F.concat(state["pacf"], F.array(last)).cast("array<double>").alias("pacf"),
            )

        return let(F.try_divide(unexplained, left_over), extend)

    orders = F.slice(F.sequence(F.lit(0), F.size(r)), F.lit(2), F.size(r) - 1)
    return F.aggregate(orders, start, next_order, lambda s: s["pacf"])


def pacf(df: DataFrame, value: str = "residual", by: Sequence[str] = ("series", "model"), **kwargs) -> DataFrame:
    """Partial autocorrelation in long form, from lag 1, with the white-noise limit ``band``."""
    rows = acf_arrays(df, value, by, **kwargs).select(*by, "n", partial_from_acf(F.col("acf")).alias("p"))
    long = rows.select(*by, "n", F.posexplode("p").alias("i", "pacf"))
    return long.select(*by, "n", (F.col("i") + 1).alias("lag"), "pacf", (1.96 / F.sqrt("n")).alias("band"))
