"""Fitted values, residuals, factual and counterfactual trends, bands and absolute effects.

All of it is column arithmetic on the panel or grid joined with the coefficients of its series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.functions.arrays import dot, let, quadratic_form
from itspark.functions.axis import N_PRE
from itspark.functions.harmonic import harmonic_value
from itspark.operators.keys import join_keys
from itspark.operators.model import design_terms
from itspark.operators.panel import design_grid


def _design(**fixed: Column) -> Column:
    """Values of the terms a model has, in the order of its coefficients; ``fixed`` replaces some."""
    values = design_terms(F.col("t"), F.col("level"), F.col("trend")) | fixed
    by_name = F.create_map(*[c for name, value in values.items() for c in (F.lit(name), value)])
    return F.transform("terms", lambda name: F.coalesce(F.try_element_at(by_name, name), harmonic_value(name, F.col("t"))))


def linear_predictor(**fixed: Column) -> Column:
    """Log rate: the terms times their coefficients."""
    return dot(F.col("coef"), _design(**fixed))


def predictor_variance() -> Column:
    """Variance of the log rate: the quadratic form of the terms in ``vcov``."""
    return let(_design(), lambda x: quadratic_form(F.col("vcov"), x))


def _with_fit(rows: DataFrame, fit: DataFrame, by: Sequence[str], *cols: str) -> DataFrame:
    return join_keys(rows, fit.filter("fit_ok").select(*by, "model", "terms", "coef", *cols), by)


def residuals(panel: DataFrame, fit: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Fitted mean and deviance residual of every panel row under every model of its series."""
    y = F.col("numerator")
    mu = F.col("fitted")
    gap = F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)
    rows = _with_fit(panel, fit, by).withColumn("fitted", F.col("denominator") * F.exp(linear_predictor()))
    # The half deviance of a point is never below 0 but can round to just under it.
    deviance = F.signum(y - mu) * F.sqrt(2.0 * F.greatest(gap, F.lit(0.0)))
    return rows.select(*by, "model", "period", "t", "numerator", "fitted", deviance.alias("residual"))


def predict(
    panel: DataFrame, fit: DataFrame, scenario: str = "factual", by: Sequence[str] = ("series",), **axis
) -> DataFrame:
    """Predicted rate of every period; the mean denominator of the grid cancels out."""
    grid = design_grid(panel, scenario, by, **axis)
    return _with_fit(grid, fit, by).select(
        *by, "model", "scenario", "period", "t", "level", "trend",
        (F.exp(linear_predictor()) * F.col("scale")).alias("rate_fit"),
    )


def confidence_band(panel: DataFrame, fit: DataFrame, by: Sequence[str] = ("series",), **axis) -> DataFrame:
    """Factual rate with pointwise limits; only the rates are brought to the scale of the outcome."""
    grid = _with_fit(design_grid(panel, "factual", by, **axis), fit, by, "vcov", "crit")
    eta, half = F.col("eta"), F.col("crit") * F.col("se_eta")
    scored = grid.withColumns(
        {"eta": linear_predictor(), "se_eta": F.sqrt(F.greatest(predictor_variance(), F.lit(0.0)))}
    )
    return scored.select(
        *by, "model", "period", "t", "level", "trend",
        (F.exp(eta) * F.col("scale")).alias("pred"),
        (F.exp(eta - half) * F.col("scale")).alias("lcb"),
        (F.exp(eta + half) * F.col("scale")).alias("ucb"),
    )


def segment_columns(band: DataFrame) -> DataFrame:
    """Fit and limits before the intervention in one set of columns, from it on in another."""
    before, after = F.col("trend") == 0, F.col("trend") > 0
    parts = {"seg": "pred", "lcb": "lcb", "ucb": "ucb"}
    return band.withColumns(
        {
            **{f"first_{k}": F.when(before, F.nullif(F.col(c), F.lit(0.0))) for k, c in parts.items()},
            **{f"second_{k}": F.when(after, F.nullif(F.col(c), F.lit(0.0))) for k, c in parts.items()},
        }
    )


def trends(panel: DataFrame, fit: DataFrame, by: Sequence[str] = ("series",), **axis) -> DataFrame:
    """Factual and counterfactual rate side by side, from one grid."""
    grid = _with_fit(design_grid(panel, "factual", by, **axis), fit, by)
    factual = linear_predictor()
    counterfactual = linear_predictor(level=F.lit(0.0), trend=F.lit(0.0))
    return grid.select(
        *by, "model", "period", "t", "level", "trend",
        (F.exp(factual) * F.col("scale")).alias("factual"),
        (F.exp(counterfactual) * F.col("scale")).alias("counterfactual"),
    )


def absolute_effects(
    trend_rows: DataFrame, post_weeks: Sequence[int] = (5, 25), n_pre: int = N_PRE
) -> DataFrame:
    """Factual minus counterfactual at the given numbers of weeks into the intervention."""
    week = F.col("period") - n_pre
    return trend_rows.filter(week.isin(*post_weeks)).select(
        *[c for c in trend_rows.columns if c not in ("level", "trend", "t")],
        week.cast("int").alias("post_week"),
        (F.col("factual") - F.col("counterfactual")).alias("effect"),
    )
