"""Study-time axis and intervention coding.

The axis has ``n_pre`` whole periods before the intervention and the rest of ``n`` after it. Records
arrive with a distance to the intervention counted away from it in both arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_PERIODS = 207
N_PRE = 104


def raw_study_time(rel: Column, arm: Column, unexposed: str = "UNEXPOSED", n_pre: int = N_PRE) -> Column:
    """Both arms on one axis, still with the partial first and last period; null for a null arm."""
    before = F.lit(n_pre + 2) - rel
    after = rel + F.lit(n_pre + 1)
    return F.when(arm == unexposed, before).when(arm != unexposed, after)


def study_window(
    df: DataFrame,
    rel: str = "weeks_rel",
    arm: str = "cohort_id",
    out: str = "time_weeks",
    unexposed: str = "UNEXPOSED",
    n_pre: int = N_PRE,
    n: int = N_PERIODS,
) -> DataFrame:
    """Keep the records of whole periods and number those periods 1..n.

    The period of the intervention itself (distance 0) and the two partial periods at the ends drop out.
    On the raw axis the condition is ``1 < time < n + 2``; here it is put on the distance of each arm, in
    which form it can be pushed down to the scan.
    """
    r, exposed = F.col(rel), F.col(arm) != unexposed
    whole = (r > 0) & ((~exposed & (r <= n_pre)) | (exposed & (r <= n - n_pre)))
    raw = raw_study_time(r, F.col(arm), unexposed, n_pre)
    return df.filter(whole).withColumn(out, (raw - 1).cast("int"))


def level_term(period: Column, n_pre: int = N_PRE, n: int = N_PERIODS) -> Column:
    return F.when(period.between(1, n_pre), 0).when(period.between(n_pre + 1, n), 1)


def trend_term(period: Column, n_pre: int = N_PRE, n: int = N_PERIODS) -> Column:
    return F.when(period.between(1, n), F.greatest(F.lit(0), period - n_pre))


def its_terms(
    df: DataFrame, period: str = "time_weeks", n_pre: int = N_PRE, n: int = N_PERIODS
) -> DataFrame:
    """Add ``level`` (0 before, 1 after) and ``trend_weeks`` (0 before, then 1, 2, ...)."""
    t = F.col(period)
    return df.withColumns(
        {
            "level": level_term(t, n_pre, n).cast("int"),
            "trend_weeks": trend_term(t, n_pre, n).cast("int"),
        }
    )


def window_from(df: DataFrame, start: int, period: str = "period", out: str = "time_truncated") -> DataFrame:
    """Keep the periods after ``start`` and add an index that begins at 1."""
    return df.filter(F.col(period) > start).withColumn(out, (F.col(period) - start).cast("int"))
