"""Six-number summaries with exact quantiles (linear interpolation between order statistics)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itspark.operators.keys import join_keys
from itspark.sources.stage import new_stage_path, remove, write_stage

#: Cells of a histogram, and the most values that are gathered and sorted.
CELLS, FEW = 4096, 50_000
QUARTILES = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    return values.unpivot(list(by), list(cols), "variable", "value")


def summary6(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Min, quartiles, mean, max and null count per column, within ``by``.

    ``bounded`` is for tables whose groups cannot grow with the data, such as a panel (one row per period):
    the quantiles are then taken by one aggregate. Record tables use histograms, which never hold a group in
    one task; the table is read once for each of a few passes.
    """
    group = [*by, "variable"]
    long = _long(df, cols, by)
    return _summary_bounded(long, group) if bounded else _summary_refined(long, group)


def _summary_bounded(long: DataFrame, group: Sequence[str]) -> DataFrame:
    return long.groupBy(*group).agg(
        F.min("value").alias("min"),
        *[F.percentile("value", F.lit(p)).alias(name) for name, p in QUARTILES],
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )


def _position(p: float) -> Column:
    return (F.col("n_all") - 1) * F.lit(p)


def _summary_refined(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Order statistics by histograms that are refined only where a wanted one lies; no value is sorted or moved.

    First the range of each variable. Then, pass by pass, the values in the interval that holds a wanted rank are
    counted in ``CELLS`` equal cells, map-side, and the cell with the rank, from its smallest to its largest
    value, is the next interval. An interval of one value is settled; one of at most ``FEW`` values is gathered
    and sorted in the end. Values that are far apart take more passes, never a larger task.
    """
    spark = long.sparkSession
    written: list[str] = []

    def staged(df: DataFrame, name: str) -> DataFrame:
        written.append(new_stage_path(spark, name))
        return write_stage(df, written[-1])

    value, least, most = F.col("value"), F.lit(float("-inf")), F.lit(float("inf"))
    finite = (value > least) & (value < most)
    whole = staged(
        long.groupBy(*group).agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.count("value").alias("n_all"),
            F.count_if(value.isNull()).alias("n_missing"),
            F.min(F.when(finite, value)).alias("lo"),
            F.max(F.when(finite, value)).alias("hi"),
            F.count_if(value == least).alias("before"),
            F.count_if(finite).alias("n"),
            F.count_if(value == most).alias("n_above"),
        ),
        "ranges",
    )
    places = F.array_distinct(F.array(*[f(_position(p)).cast("long") for _, p in QUARTILES for f in (F.floor, F.ceil)]))
    ranks = whole.filter("n_all > 0").select(*group, F.explode(places).alias("rank"), "lo", "hi", "before", "n", "n_above")
    beyond = F.when(F.col("rank") < F.col("before"), least).when(F.col("rank") < F.col("before") + F.col("n") + F.col("n_above"), most).otherwise(F.lit(float("nan")))
    inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    settled = [ranks.filter(~inside).select(*group, "rank", beyond.alias("value"))]
    open_ = staged(ranks.filter(inside).drop("n_above"), "open")
    values = long.filter(finite)
    while True:
        wide = open_.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if wide.isEmpty():
            break
        intervals = wide.select(*group, "lo", "hi", "before").distinct()
        held = join_keys(values, intervals, group).filter(value.between(F.col("lo"), F.col("hi")))
        # Rounding keeps the order, so cells do too; halves keep the differences finite.
        width = F.col("hi") / 2 - F.col("lo") / 2
        share = F.when(width > 0, (value / 2 - F.col("lo") / 2) / width).otherwise((value > F.col("lo")).cast("double"))
        cell = F.least(F.lit(CELLS - 1), F.floor(share * CELLS)).cast("int")
        counts = held.groupBy(*group, "lo", "before", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first"), F.max("value").alias("last"))
        counts = staged(counts, "cells")
        upto = F.sum("n").over(Window.partitionBy(*group, "lo").orderBy("cell"))
        counts = counts.withColumn("offset", F.col("before") + upto - F.col("n")).drop("before")
        found = join_keys(wide.select(*group, "rank", "lo"), counts, [*group, "lo"])
        found = found.filter((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("n")))
        found = found.select(*group, "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("offset").alias("before"), "n")
        rest = open_.filter((F.col("lo") == F.col("hi")) | (F.col("n") <= FEW))
        open_ = staged(rest.select(found.columns).unionAll(found), "open")
    settled.append(open_.filter("lo = hi").select(*group, "rank", F.col("lo").alias("value")))
    few = open_.filter("lo < hi")
    held = join_keys(values, few.select(*group, "lo", "hi").distinct(), group).filter(value.between(F.col("lo"), F.col("hi")))
    gathered = held.groupBy(*group, "lo").agg(F.array_sort(F.collect_list("value")).alias("values"))
    last = join_keys(few.select(*group, "rank", "lo", "before"), gathered, [*group, "lo"])
    settled.append(last.select(*group, "rank", F.expr("values[cast(rank - before as int)]").alias("value")))

    known = settled[0].unionAll(settled[1]).unionAll(settled[2])
    joined = join_keys(whole, known.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")), group, "left")

    def interpolated(name: str, p: float) -> Column:
        lo, hi = (F.element_at("at", f(_position(p)).cast("long")) for f in (F.floor, F.ceil))
        return (lo + (hi - lo) * (_position(p) - F.floor(_position(p)))).alias(name)

    # One row per group: all that stays of the passes.
    out = write_stage(joined.select(*group, "min", *[interpolated(n, p) for n, p in QUARTILES], "mean", "max", "n_missing"), new_stage_path(spark, "summary"))
    for path in written:
        remove(spark, path)
    return out


def summary_by_level(
    panel: DataFrame, cols: Sequence[str] = ("numerator", "rate"), by: Sequence[str] = ("series",)
) -> DataFrame:
    """Summaries of a panel before, after and over both (``level`` null), in one aggregate."""
    long = _long(panel, cols, [*by, "level"])
    sets = [[*by, "level", "variable"], [*by, "variable"]]
    stats = long.groupingSets(sets, *by, "level", "variable").agg(
        F.min("value").alias("min"),
        *[F.percentile("value", F.lit(p)).alias(name) for name, p in QUARTILES],
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.grouping("level").alias("_both"),
    )
    phase = F.when(F.col("_both") == 1, "all").when(F.col("level") == 0, "pre").when(F.col("level") == 1, "post")
    return stats.withColumn("phase", phase).drop("level", "_both")
