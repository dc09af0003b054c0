"""Declared input schemas. Identifiers are text because they are cut as text."""

from __future__ import annotations

KEYS = ("mother_id", "weeks_rel", "cohort_id")


def key_columns(week_column: str = "WEEKS_BEFORE_AFTER") -> dict[str, str]:
    """Raw to analysis names of the linkage key; the name of the week column differs between extracts."""
    return {"MOTHERID": "mother_id", week_column: "weeks_rel", "COHORT_IDENTIFIER": "cohort_id"}


# Raw names of the birth record and the names used in the analysis.
BIRTH_COLUMNS = {
    "num_of_births_this_pregnancy": "number_births",
    "outcome_of_pregnancy_baby_1": "pregnancy_outcome",
    "sex_baby_1": "sex",
    "condition_on_discharge": "discharge_condition",
    "APGAR_5_MINUTES_BABY_1": "apgar_5min",
    "BIRTHWEIGHT_BABY_1": "birthweight",
    "FEED_ON_DISCHARGE_BABY1": "feed_on_discharge",
    "MARITAL_STATUS": "marital_status",
    "TOTAL_PREVIOUS_PREGNANCIES": "total_previous_pregnancies",
    "BOOKING_SMOKING_HISTORY": "book_smoking_history",
    "SMOKER_DURING_PREGNANCY": "smoking_during_pregnancy",
    "MODE_OF_DELIVERY_BABY_1": "delivery_mode",
    "ETHNIC_GROUP": "ethnic_group",
    "MOTHER_AGE_GRPS": "mother_age",
    "simd2016_sc_quintile": "simd_quintile",
}

TEXT_COLUMNS = {
    "MOTHERID", "COHORT_IDENTIFIER", "MOTHER_AGE_GRPS",
    "smoker_pc", "second_hand_smoke", "feed_2016", "sleep_pr", "sleep_su", "sleep_si",
}


def ddl(columns) -> str:
    """Schema string for raw columns: text where listed above, whole numbers otherwise."""
    return ", ".join(f"`{c}` {'string' if c in TEXT_COLUMNS else 'int'}" for c in columns)


def birth_schema(week_column: str = "WEEKS_BEFORE_AFTER") -> str:
    return ddl([*key_columns(week_column), *BIRTH_COLUMNS])


def admissions_schema(week_column: str = "WEEKS_BEFORE_AFTER") -> str:
    return ddl([*key_columns(week_column), "EPISODES_WITHIN_26_WEEKS", "EPISODES_WITHIN_52_WEEKS"])


def first_visit_schema(week_column: str = "WEEKS_BEFORE_AFTER") -> str:
    return ddl([*key_columns(week_column), "smoker_pc", "second_hand_smoke", "feed_2016"])


def six_week_visit_schema(week_column: str = "WEEKS_BEFORE_AFTER") -> str:
    return first_visit_schema(week_column) + ", " + ddl(["sleep_pr", "sleep_su", "sleep_si"])
