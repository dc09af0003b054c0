"""From records to one long panel: a row per series and period, all series in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.functions.axis import N_PERIODS, N_PRE, level_term, trend_term
from itspark.operators.link import link_left
from itspark.operators.keys import join_keys

PERSON_TIME = "person-time"
PREVALENCE = "prevalence"


@dataclass(frozen=True)
class OutcomeSpec:
    """One outcome series.

    ``value`` is a SQL expression over the records, null where the outcome is unknown. ``complete`` lists
    further columns that must be known. ``horizon`` turns the number of records into person-weeks. ``start``
    cuts off the first periods and restarts the model time. ``models`` names the fitted models, ``primary``
    the one used for trends and effects.
    """

    name: str
    value: str
    kind: str = PREVALENCE
    complete: Sequence[str] = ()
    horizon: int = 1
    start: int = 0
    models: Sequence[str] = ("poisson", "quasi")
    primary: str = "quasi"

    @property
    def scale(self) -> int:
        return 1000 if self.kind == PERSON_TIME else 100

    def known(self) -> Column:
        ok = F.expr(self.value).isNotNull()
        for c in self.complete:
            ok = ok & F.col(c).isNotNull()
        return ok


def count_by(df: DataFrame, *by: str) -> DataFrame:
    """Records per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def with_group_count(df: DataFrame, *by: str, out: str = "n", spread: int = 0) -> DataFrame:
    """Every record with the size of its group.

    The sizes are aggregated (map-side first) and joined back, so a group is not gathered in one task as a
    window over it would be; ``spread`` splits heavy groups in the join, as in ``link_left``.
    """
    return link_left(df, df.groupBy(*by).agg(F.count(F.lit(1)).alias(out)), by, spread=spread)


def with_period_count(df: DataFrame, period: str = "time_weeks", out: str = "n", n: int = N_PERIODS) -> DataFrame:
    """Records of the periods 1..n with the size of their period.

    The sizes are at most ``n`` rows by the filter, so they are broadcast and the records are not shuffled.
    """
    inside = df.filter(F.col(period).between(1, n))
    sizes = inside.groupBy(period).agg(F.count(F.lit(1)).alias(out))
    return link_left(inside, F.broadcast(sizes), [period], na_matches=False)


def panel(
    df: DataFrame,
    outcomes: Sequence[OutcomeSpec],
    period: str = "time_weeks",
    by: Sequence[str] = (),
    n_pre: int = N_PRE,
    n: int = N_PERIODS,
) -> DataFrame:
    """Panel of every outcome: ``series, period, t, level, trend, denominator, numerator, rate``.

    One scan and one aggregate over the period give all denominators and numerators; the wide result, a row
    per period, is then turned long. ``t`` is the model time: the period, or the truncated index where the
    outcome has a ``start``. A period in which no record has the outcome known gives no row.
    """
    p = F.col(period)
    sums = []
    for i, o in enumerate(outcomes):
        known = o.known()
        sums.append(F.count_if(known).alias(f"den_{i}"))
        sums.append(F.sum(F.when(known, F.expr(o.value).cast("double"))).alias(f"num_{i}"))
    wide = df.filter(p.between(1, n)).groupBy(*by, p.cast("int").alias("period")).agg(*sums)
    cells = ", ".join(
        f"'{o.name}', {o.start}, {o.scale}, den_{i} * {o.horizon}L, num_{i}" for i, o in enumerate(outcomes)
    )
    long = wide.selectExpr(
        *by, "period", f"stack({len(outcomes)}, {cells}) as (series, start, scale, denominator, numerator)"
    ).filter((F.col("period") > F.col("start")) & (F.col("denominator") > 0))
    return long.select(
        *by,
        "series",
        "period",
        (F.col("period") - F.col("start")).cast("int").alias("t"),
        level_term(F.col("period"), n_pre, n).cast("int").alias("level"),
        trend_term(F.col("period"), n_pre, n).cast("int").alias("trend"),
        "denominator",
        "numerator",
        (F.try_divide(F.col("numerator"), F.col("denominator")) * F.col("scale")).alias("rate"),
        "scale",
    )


def fill_periods(
    panel: DataFrame, by: Sequence[str] = ("series",), n_pre: int = N_PRE, n: int = N_PERIODS
) -> DataFrame:
    """The panel with a row for every period of every series; absent periods have denominator 0, no rate."""
    spine = panel.groupBy(*by).agg(
        F.first("scale").alias("scale"), F.min(F.col("period") - F.col("t")).alias("start")
    )
    spine = spine.select(
        *by, "scale", "start", F.explode(F.sequence(F.col("start") + 1, F.lit(n))).alias("period")
    )
    values = panel.select(*by, "period", "denominator", "numerator", "rate")
    return join_keys(spine, values, [*by, "period"], "left").select(
        *by,
        "period",
        (F.col("period") - F.col("start")).alias("t"),
        level_term(F.col("period"), n_pre, n).cast("int").alias("level"),
        trend_term(F.col("period"), n_pre, n).cast("int").alias("trend"),
        F.coalesce("denominator", F.lit(0)).alias("denominator"),
        F.coalesce("numerator", F.lit(0.0)).alias("numerator"),
        "rate",
        "scale",
    )


def design_grid(
    panel: DataFrame,
    scenario: str = "factual",
    by: Sequence[str] = ("series",),
    n_pre: int = N_PRE,
    n: int = N_PERIODS,
) -> DataFrame:
    """Prediction rows of every series: all periods, the mean denominator, and the terms of the scenario.

    ``counterfactual`` has level and trend 0 throughout: the intervention never happened.
    """
    if scenario not in ("factual", "counterfactual"):
        raise ValueError(f"unknown scenario {scenario!r}")
    means = panel.groupBy(*by).agg(
        F.avg("denominator").alias("mean_denominator"),
        F.first("scale").alias("scale"),
        F.min(F.col("period") - F.col("t")).alias("start"),
    )
    grid = means.withColumn("period", F.explode(F.sequence(F.col("start") + 1, F.lit(n))))
    happened = F.lit(1 if scenario == "factual" else 0)
    return grid.select(
        *by,
        F.lit(scenario).alias("scenario"),
        "period",
        (F.col("period") - F.col("start")).cast("int").alias("t"),
        (level_term(F.col("period"), n_pre, n) * happened).cast("int").alias("level"),
        (trend_term(F.col("period"), n_pre, n) * happened).cast("int").alias("trend"),
        "mean_denominator",
        "scale",
    )
