"""Birth records to a complete-case cohort with intervention terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itspark.functions.axis import its_terms, study_window
from itspark.functions.recode import key_suffix, null_where, sentinel_to_null
from itspark.operators.dedup import drop_conflicts
from itspark.operators.quality import complete_cases, include
from itspark.sources.schemas import BIRTH_COLUMNS, KEYS, key_columns

COHORT_COLUMNS = (
    *KEYS,
    "feed_on_discharge",
    "total_previous_pregnancies",
    "book_smoking_history",
    "smoking_during_pregnancy",
    "mother_age",
    "simd_quintile",
    "time_weeks",
    "sex",
)

# Codes that stand for "not known" or "not specified".
SENTINELS = {
    "feed_on_discharge": (9, 3),
    "total_previous_pregnancies": (99,),
    "book_smoking_history": (9,),
    "smoking_during_pregnancy": (9,),
    "sex": (9, 0),
}
MOST_PREGNANCIES = 15

PROFILED = (
    "feed_on_discharge",
    "total_previous_pregnancies",
    "smoking_during_pregnancy",
    "book_smoking_history",
    "simd_quintile",
)


def criteria() -> dict:
    """Inclusion: a single, live-born child, alive at discharge."""
    return {
        "single birth": F.col("number_births") == 1,
        "live birth": F.col("pregnancy_outcome") == 1,
        "alive at discharge": F.col("discharge_condition") == 3,
    }


def on_study_axis(records: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER") -> DataFrame:
    """Raw records under their analysis names, limited to whole study weeks."""
    names = {**key_columns(week_column), **BIRTH_COLUMNS}
    return study_window(records.select(*names).withColumnsRenamed(names))


def recode_records(records: DataFrame) -> DataFrame:
    """Unknown codes as null. The stated number of previous pregnancies stays beside the one without impossible values."""
    recoded = records.withColumns({c: sentinel_to_null(F.col(c), *codes) for c, codes in SENTINELS.items()})
    previous = F.col("total_previous_pregnancies")
    return recoded.withColumns(
        {"stated_previous_pregnancies": previous, "total_previous_pregnancies": null_where(previous, previous > MOST_PREGNANCIES)}
    )


def clean_records(
    records: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER", trim: str | None = "after", trim_to: int = 6
) -> DataFrame:
    """Included records, one per key, unknown codes as null.

    De-duplication runs before recoding, so two records that differ only in how they say "unknown" are a
    conflict. ``trim`` tells whether the id is cut ``before`` or ``after`` it; cut after, two ids can become
    equal (``conflict_report`` on the result counts them). None leaves the ids whole.
    """
    return clean_axis(on_study_axis(records, week_column), trim, trim_to)


def clean_axis(axis_rows: DataFrame, trim: str | None = "after", trim_to: int = 6) -> DataFrame:
    """``clean_records`` from rows that are on the study axis already."""
    if trim not in ("before", "after", None):
        raise ValueError(f"trim is before, after or None, not {trim!r}")
    included = include(axis_rows, *criteria().values())
    if trim is None:
        return recode_records(drop_conflicts(included, KEYS))
    suffix = {"mother_id": key_suffix(F.col("mother_id"), trim_to)}
    if trim == "before":
        return recode_records(drop_conflicts(included.withColumns(suffix), KEYS))
    return recode_records(drop_conflicts(included, KEYS).withColumns(suffix))


def complete_cohort(clean: DataFrame) -> DataFrame:
    """Complete cases of the cohort columns, with ``level`` and ``trend_weeks``."""
    return its_terms(complete_cases(clean.select(*COHORT_COLUMNS)))


def build_cohort(records: DataFrame, **options) -> DataFrame:
    return complete_cohort(clean_records(records, **options))
