"""The outcome series and the analysis that every one of them goes through."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itspark.functions.recode import binary
from itspark.operators import effects, model, serial
from itspark.operators.model import MODELS
from itspark.operators.panel import PERSON_TIME, OutcomeSpec, panel

FIRST_TRUNCATED = 25
STRATA = ("simd_quintile", "mother_age", "tpp_bin")

P, Q, PH, QH = "poisson", "quasi", "poisson_harmonic", "quasi_harmonic"

OUTCOMES = (
    OutcomeSpec("child_admissions_26w", "episodes_26w_child", PERSON_TIME, horizon=26, models=(P, Q, QH), primary=QH),
    OutcomeSpec("child_admissions_52w", "episodes_52w_child", PERSON_TIME, horizon=52, models=(P, Q), primary=Q),
    OutcomeSpec("mother_admissions_26w", "episodes_26w_mother", PERSON_TIME, horizon=26, models=(P, Q), primary=Q),
    OutcomeSpec("mother_admissions_52w", "episodes_52w_mother", PERSON_TIME, horizon=52, models=(P, Q), primary=Q),
    OutcomeSpec("carer_smokes_fv", "int(smoke_pc_fv = 'Y')", models=(P, Q, QH), primary=QH),
    OutcomeSpec(
        "carer_smokes_68", "int(smoke_pc_68 = 'Y')", complete=STRATA, start=FIRST_TRUNCATED, models=(P, Q), primary=Q
    ),
    OutcomeSpec("second_hand_smoke_fv", "int(smoke_sh_fv = 'Y')", models=(P, PH), primary=PH),
    OutcomeSpec("second_hand_smoke_68", "int(smoke_sh_68 = 'Y')", complete=STRATA, models=(P, Q, QH), primary=QH),
    OutcomeSpec(
        "second_hand_smoke_68_truncated", "int(smoke_sh_68 = 'Y')", complete=STRATA[:2], start=FIRST_TRUNCATED,
        models=(Q,), primary=Q,
    ),
    OutcomeSpec("smoker_at_booking", "int(book_smoking_history = 1)", models=(P, Q, QH), primary=QH),
    OutcomeSpec("smoked_in_pregnancy", "smoking_during_pregnancy", models=(P, Q, QH), primary=QH),
    OutcomeSpec("breastfed_fv", "int(feed_fv = 'Breast')", models=(P, PH), primary=PH),
    OutcomeSpec("breastfed_68", "int(feed_68 = 'Breast')", complete=STRATA, models=(P, PH), primary=PH),
    OutcomeSpec("supine_sleep_68", "sleep_bin_su", models=(P,), primary=P),
)


def with_parity(linked: DataFrame) -> DataFrame:
    return linked.withColumn("tpp_bin", binary(F.col("total_previous_pregnancies") > 0))


def _by_series(outcomes: Sequence[OutcomeSpec], pick) -> Column:
    choice = F.lit(None)
    for o in reversed(outcomes):
        choice = F.when(F.col("series") == o.name, pick(o)).otherwise(choice)
    return choice


def outcome_panel(linked: DataFrame, outcomes: Sequence[OutcomeSpec] = OUTCOMES, by: Sequence[str] = ()) -> DataFrame:
    return panel(with_parity(linked), outcomes, by=by)


def fit_ladder(
    rows: DataFrame, outcomes: Sequence[OutcomeSpec] = OUTCOMES, by: Sequence[str] = ("series",), **options
) -> DataFrame:
    """All models of all outcomes, each series with its own list; ``is_primary`` marks the one in use."""
    wanted = _by_series(outcomes, lambda o: F.array(*[F.lit(m) for m in o.models]))
    used = [m for name, m in MODELS.items() if any(name in o.models for o in outcomes)]
    fit = model.fit_its(rows, used, by, chosen=wanted, **options)
    return fit.withColumn("is_primary", F.col("model") == _by_series(outcomes, lambda o: F.lit(o.primary)))


@dataclass(frozen=True)
class Analysis:
    """Tables of an outcome analysis; all are lazy and start from the same panel."""

    panel: DataFrame
    fit: DataFrame
    coefficients: DataFrame
    ratios: DataFrame
    robust: DataFrame
    statistics: DataFrame
    explained: DataFrame
    residuals: DataFrame
    acf: DataFrame
    pacf: DataFrame
    trends: DataFrame
    bands: DataFrame
    effects: DataFrame


def analyse(
    panel_rows: DataFrame, outcomes: Sequence[OutcomeSpec] = OUTCOMES, keep: Callable[[DataFrame], DataFrame] = lambda fit: fit
) -> Analysis:
    """Ladder, diagnostics, trends and effects from a panel.

    Give it a panel read back from ``write_stage`` when several of the tables are wanted, and a ``keep`` that
    writes the fits and reads them back: the records are then scanned and the models fitted once.
    """
    fit = keep(fit_ladder(panel_rows, outcomes))
    primary = fit.filter("is_primary")
    residual = effects.residuals(panel_rows, fit)
    trend = effects.trends(panel_rows, primary)
    return Analysis(
        panel=panel_rows,
        fit=fit,
        coefficients=model.coefficients(fit),
        ratios=model.irr(fit),
        robust=model.irr(fit, robust=True),
        statistics=model.fit_statistics(fit),
        explained=model.explained(fit),
        residuals=residual,
        acf=serial.acf(residual),
        pacf=serial.pacf(residual),
        trends=trend,
        bands=effects.segment_columns(effects.confidence_band(panel_rows, primary)),
        effects=effects.absolute_effects(trend),
    )
