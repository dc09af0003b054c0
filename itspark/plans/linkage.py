"""The four sources linked to the cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.functions.recode import exclusive_flag, sentinel_to_null, yes_no_to_int
from itspark.operators.link import SourceSpec, link_sources
from itspark.sources.schemas import KEYS, key_columns

UNKNOWN_TEXT = "Unknown/Invalid"


def _unknown_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(F.col(c), UNKNOWN_TEXT) for c in cols})


def admissions(name: str, df: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER") -> SourceSpec:
    """Hospital episodes of the child or the mother; nobody in the source means none."""
    counts = {
        "EPISODES_WITHIN_26_WEEKS": f"episodes_26w_{name}",
        "EPISODES_WITHIN_52_WEEKS": f"episodes_52w_{name}",
    }
    return SourceSpec(
        f"admissions_{name}", df, {**key_columns(week_column), **counts}, fill={c: 0 for c in counts.values()}
    )


def _visit_columns(suffix: str) -> dict[str, str]:
    return {"smoker_pc": f"smoke_pc_{suffix}", "second_hand_smoke": f"smoke_sh_{suffix}", "feed_2016": f"feed_{suffix}"}


def first_visit(df: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER") -> SourceSpec:
    answers = _visit_columns("fv")
    return SourceSpec(
        "first_visit",
        df,
        {**key_columns(week_column), **answers},
        recode=lambda d: _unknown_to_null(d, list(answers.values())),
    )


def six_week_visit(df: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER") -> SourceSpec:
    answers = _visit_columns("68")
    boxes = {f"sleep_{p}": f"sleep_{p}_68" for p in ("pr", "su", "si")}

    def recode(d: DataFrame) -> DataFrame:
        d = _unknown_to_null(d, list(answers.values()))
        ticks = [yes_no_to_int(F.col(f"sleep_{p}_68")) for p in ("su", "pr", "si")]
        return d.withColumn("sleep_bin_su", exclusive_flag(*ticks))

    return SourceSpec(
        "six_week_visit",
        df,
        {**key_columns(week_column), **answers, **boxes},
        recode=recode,
        keep=["smoke_sh_68", "smoke_pc_68", "feed_68", "sleep_bin_su"],
    )


def default_sources(
    children: DataFrame,
    mothers: DataFrame,
    first: DataFrame,
    six_week: DataFrame,
    week_column: str = "WEEKS_BEFORE_AFTER",
) -> list[SourceSpec]:
    return [
        admissions("child", children, week_column),
        admissions("mother", mothers, week_column),
        first_visit(first, week_column),
        six_week_visit(six_week, week_column),
    ]


def link_cohort(
    cohort: DataFrame, sources: Sequence[SourceSpec], status: bool = False, trim: bool = True, trim_to: int = 6, spread: int = 0
) -> DataFrame:
    """Link by the composite key; ``trim`` and ``trim_to`` must be what was done to the cohort's ids."""
    return link_sources(cohort, sources, KEYS, trim="mother_id" if trim else None, trim_to=trim_to, status=status, spread=spread)
