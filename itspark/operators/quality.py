"""Attrition, frequency tables, crosstabs and missingness profiles."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.operators.keys import join_keys


#: Of the width of a bin.
FUZZ = 1e-7


def any_null(cols: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(c).isNull() for c in cols])


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(cols) if cols else None)


def include(df: DataFrame, *criteria: Column) -> DataFrame:
    """Keep rows meeting every criterion; an unknown one drops the row."""
    return df.filter(reduce(Column.__and__, criteria))


def attrition(df: DataFrame, criteria: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """Per step: rows known to fail the criterion, rows where it is unknown, and rows and distinct keys left
    after it and all before it.

    Counted per key first, so a key of any size crosses the shuffle as partial sums, and keys are counted
    without a distinct aggregate.
    """
    passed = F.lit(True)
    sums = [F.count(F.lit(1)).alias("left_0"), F.count_if(F.lit(False)).alias("fail_0"), F.count_if(F.lit(False)).alias("unknown_0")]
    for i, criterion in enumerate(criteria.values(), start=1):
        ok = F.coalesce(criterion, F.lit(False))
        passed = passed & ok
        sums += [F.count_if(passed).alias(f"left_{i}"), F.count_if(~criterion).alias(f"fail_{i}"), F.count_if(criterion.isNull()).alias(f"unknown_{i}")]
    per_key = df.groupBy(*keys).agg(*sums)
    steps = range(len(criteria) + 1)
    totals = per_key.agg(
        *[F.coalesce(F.sum(f"{what}_{i}"), F.lit(0)).alias(f"{what}_{i}") for i in steps for what in ("fail", "unknown", "left")],
        *[F.count_if(F.col(f"left_{i}") > 0).alias(f"keys_{i}") for i in steps],
    )
    names = ["all records", *criteria]
    cells = ", ".join(f"{i}, '{n}', fail_{i}, unknown_{i}, left_{i}, keys_{i}" for i, n in enumerate(names))
    return totals.selectExpr(f"stack({len(names)}, {cells}) as (step_no, step, n_failing, n_unknown, n_rows, n_keys)")


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, and rows with a null in any of the columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null(cols)).alias("n_incomplete"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, one row each, from one aggregate."""
    cols = list(cols) if cols else df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "variable", "n_missing")


def reduced(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Combinations of categories with the number ``n`` of their rows: a small table that frequencies and
    crosstabs of any of the columns can be taken from, with ``weight="n"``."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def _rows(weight: str | None) -> Column:
    """Number of records, where a row may stand for several."""
    return F.sum(weight) if weight else F.count(F.lit(1))


def freq(df: DataFrame, cols: str | Sequence[str], use_na: bool = True, weight: str | None = None) -> DataFrame:
    """Frequency of every value, for several columns in one pass: ``variable, value, n``.

    With ``use_na`` each variable has a null row even at count 0; without it nulls are left out. ``weight``
    is a column of numbers of records.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    kept = [weight] if weight else []
    text = df.select(*kept, *[F.col(c).cast("string").alias(c) for c in cols])
    counts = text.unpivot(kept, cols, "variable", "value").groupBy("variable", "value").agg(_rows(weight).alias("n"))
    if not use_na:
        return counts.filter(F.col("value").isNotNull())
    null_row = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("n"))
    rows = F.array(F.struct("value", "n"), null_row)
    # Every value brings a zero null row along; the sum folds them into one per variable.
    padded = counts.select("variable", F.explode(rows).alias("r")).select("variable", "r.*")
    return padded.groupBy("variable", "value").agg(F.sum("n").alias("n"))


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Bins closed on the right, the first one on both sides; empty bins are listed.

    With ``bins`` that many of equal width between the extremes. Without, about as many as Sturges' rule says
    (one and the logarithm of the number of values to base 2), between round break points: multiples of 1, 2 or
    5 times a power of ten. Equal values are one bin of width 1 around them then. Nulls are left out.
    """
    x = F.col(col).cast("double")
    extremes = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"))
    if bins is None:
        wanted = F.ceil(F.log2(F.col("n").cast("double")) + 1)
        share = (F.col("hi") - F.col("lo")) / wanted
        power = F.pow(F.lit(10.0), F.floor(F.log10(share)))
        times = share / power
        step = power * F.when(times <= 1.4, 1.0).when(times <= 2.8, 2.0).when(times <= 7, 5.0).otherwise(10.0)
        step = F.when(F.col("hi") > F.col("lo"), step).otherwise(1.0)
        layout = extremes.withColumn("width", step)
        # What rounding leaves beside a break point counts as on it.
        first = F.when(F.col("hi") > F.col("lo"), F.floor(F.col("lo") / F.col("width") + FUZZ).cast("double")).otherwise(F.col("lo") - 0.5)
        last = F.when(F.col("hi") > F.col("lo"), F.ceil(F.col("hi") / F.col("width") - FUZZ).cast("double")).otherwise(F.col("hi") + 0.5)
        layout = layout.withColumns({"first": first, "last": last})
        place = layout.agg(F.struct(F.first("width").alias("width"), F.first("first").alias("first"), (F.first("last") - F.first("first")).cast("int").alias("bins"))).scalar()
        width, first, bins_ = place["width"], place["first"], place["bins"]
        index = F.greatest(F.lit(1), F.ceil(x / width - first - FUZZ))
        spine = layout.filter("n > 0").select(F.explode(F.sequence(F.lit(1), (F.col("last") - F.col("first")).cast("int"))).alias("bin"))
        lower, upper = (first + F.col("bin") - 1) * width, (first + F.col("bin")) * width
    else:
        bounds = extremes.agg(F.struct(F.first("lo").alias("lo"), F.first("hi").alias("hi"))).scalar()
        lo, bins_ = bounds["lo"], F.lit(bins)
        width = (bounds["hi"] - lo) / bins
        index = F.when(width > 0, F.greatest(F.lit(1), F.ceil((x - lo) / width))).otherwise(1)
        spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
        lower, upper = lo + (F.col("bin") - 1) * width, lo + F.col("bin") * width
    values = df.filter(x.isNotNull()).select(F.least(bins_, index).cast("int").alias("bin"))
    counts = values.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "bin", "left").select("bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def crosstab(df: DataFrame, x: str, y: str, use_na: bool = False, zero_cells: bool = True, weight: str | None = None) -> DataFrame:
    """Two-way table in long form with row, column and total per cent and chi-square share per cell.

    Records are reduced to cells first; everything after that works on the printed table, and the margins
    meet the cells by key. ``zero_cells`` lists cells with no record as well: the levels of both variables are
    dealt to the rows and the columns of a grid of blocks, and two levels meet in the one block that both are
    in, so no list of levels is made. With ``use_na`` null is a level of its own. ``weight`` is a column of
    numbers of records.
    """
    rows = df if use_na else df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    found = rows.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(_rows(weight).alias("n"))
    by_x = found.groupBy("x").agg(F.sum("n").alias("row_n"))
    by_y = found.groupBy("y").agg(F.sum("n").alias("col_n"))
    if zero_cells:
        ways = max(1, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        every = F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
        rows_of = by_x.select("*", F.pmod(F.xxhash64("x"), F.lit(ways)).cast("int").alias("_across"), every.alias("_down"))
        columns_of = by_y.select("*", F.pmod(F.xxhash64("y"), F.lit(ways)).cast("int").alias("_down"), every.alias("_across"))
        cells = rows_of.join(columns_of, ["_across", "_down"]).drop("_across", "_down")
        table = join_keys(cells, found, ["x", "y"], "left")
    else:
        table = join_keys(join_keys(found, by_x, ["x"]), by_y, ["y"])
    table = table.withColumns({"n": F.coalesce("n", F.lit(0)), "total_n": by_y.agg(F.sum("col_n")).scalar()})
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("total_n")
    n = F.col("n").cast("double")
    return table.select(
        "x",
        "y",
        "n",
        (100 * n / F.col("row_n")).alias("row_pct"),
        (100 * n / F.col("col_n")).alias("col_pct"),
        (100 * n / F.col("total_n")).alias("total_pct"),
        ((n - expected) * (n - expected) / expected).alias("chisq"),
    )


def miss_by(df: DataFrame, factor: str, cols: Sequence[str]) -> DataFrame:
    """Per cent missing per variable within each level of a factor."""
    shares = df.groupBy(F.col(factor)).agg(
        *[(F.count_if(F.col(c).isNull()) * 100.0 / F.count(F.lit(1))).alias(c) for c in cols]
    )
    return shares.unpivot([factor], list(cols), "variable", "pct_missing")


#: Variables in one whole number of a combination.
CHUNK = 60


def miss_patterns(df: DataFrame, cols: Sequence[str], max_sets: int | None = 10, top: int | None = 50) -> DataFrame:
    """Largest combinations of variables missing together: ``pattern`` (names joined by ``&``) and ``n``.

    The ``max_sets`` variables missing most often take part, all of them if it is None. Only the table of
    combinations, never the records, is ranked; ``top`` is the length of the report, None for all of it.
    """
    # A combination is a bit per variable, so the records are reduced on a few whole numbers.
    chunks = [list(cols[i : i + CHUNK]) for i in range(0, len(cols), CHUNK)]
    bits = {
        f"bits_{k}": reduce(Column.bitwiseOR, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(chunk)])
        for k, chunk in enumerate(chunks)
    }
    counts = df.groupBy(*[b.alias(name) for name, b in bits.items()]).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(
        *[F.when(F.col(f"bits_{k}").bitwiseAND(F.lit(1 << i)) > 0, F.lit(c)) for k, chunk in enumerate(chunks) for i, c in enumerate(chunk)]
    )
    sets = counts.select(F.filter(names, lambda c: c.isNotNull()).alias("missing"), "n").filter(F.size("missing") > 0)
    if max_sets is not None and len(cols) > max_sets:
        sizes = sets.select(F.explode("missing").alias("variable"), "n").groupBy("variable").agg(F.sum("n").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "variable").limit(max_sets).agg(F.collect_list("variable")).scalar()
        kept = sets.select(F.array_intersect("missing", largest).alias("missing"), "n")
        sets = kept.filter(F.size("missing") > 0).groupBy("missing").agg(F.sum("n").alias("n"))
    named = sets.select(F.array_join("missing", "&").alias("pattern"), F.size("missing").alias("n_variables"), "n")
    ranked = named.orderBy(F.desc("n"), "pattern")
    return ranked if top is None else ranked.limit(top)
