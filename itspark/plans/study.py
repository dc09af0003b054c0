"""A whole study from five delimited files to result tables.

Each step writes a stage and the next one reads it, so a lost executor costs a step at most, and a study that
was ended early goes on from the last step that it finished. The files of text are read once; the models are
fitted once; frequencies and crosstabs come from one reduction of the linked records, and each other report is
one pass over the stage it describes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itspark.functions import axis
from itspark.functions.recode import observed_flag
from itspark.operators import quality, summary
from itspark.operators.dedup import conflict_report
from itspark.operators.effects import absolute_effects
from itspark.operators.link import link_report
from itspark.operators.panel import count_by
from itspark.plans import cohort, linkage, outcomes
from itspark.sources import delimited, schemas, spine, stage

INPUTS = ("births", "children", "mothers", "first_visit", "six_week_visit")

# Answers at the visits, and the smoking questions asked in pregnancy.
ANSWERS = (
    "smoke_pc_fv", "smoke_sh_fv", "feed_fv", "smoke_pc_68", "smoke_sh_68", "feed_68", "sleep_bin_su",
    "book_smoking_history", "smoking_during_pregnancy",
)

# Outcome of the later visit whose non-response is tabulated, and whether null levels are shown.
NON_RESPONSE = {"smoke_pc_68": False, "smoke_sh_68": False, "feed_68": True}


def read_inputs(
    spark: SparkSession, paths: Mapping[str, str], week_column: str = "WEEKS_BEFORE_AFTER", line_breaks: bool = True
) -> dict[str, DataFrame]:
    """The given ones of the five tables as typed DataFrames. In the first-visit file blank text is an answer, not a
    null. Text in quotes may hold line breaks; files known to have none are read in one pass without ``line_breaks``.
    """
    declared = {
        "births": schemas.birth_schema,
        "children": schemas.admissions_schema,
        "mothers": schemas.admissions_schema,
        "first_visit": schemas.first_visit_schema,
        "six_week_visit": schemas.six_week_visit_schema,
    }
    return {
        name: delimited.read_delimited(
            spark, paths[name], declared[name](week_column), blank_is_null=name != "first_visit", multi_line=line_breaks
        )
        for name in INPUTS
        if name in paths
    }


def cohort_reports(births: DataFrame, axis_rows: DataFrame, clean: DataFrame, week_column: str = "WEEKS_BEFORE_AFTER") -> dict[str, DataFrame]:
    """What is printed while the cohort is built: records by week, attrition, conflicts, frequencies, missingness."""
    before = births.withColumn("time_raw", axis.raw_study_time(F.col(week_column), F.col("COHORT_IDENTIFIER")))
    included = quality.include(axis_rows, *cohort.criteria().values())
    return {
        "records_by_raw_week": count_by(before, "time_raw"),
        "records_by_week": count_by(axis_rows, "time_weeks"),
        "attrition": quality.attrition(axis_rows, cohort.criteria(), schemas.KEYS),
        "conflicts": conflict_report(included, schemas.KEYS),
        "trimmed_key_conflicts": conflict_report(clean, schemas.KEYS),
        "codes": quality.freq(clean, ["number_births", "pregnancy_outcome"]),
        "frequencies": quality.freq(clean, [c for c in cohort.COHORT_COLUMNS[3:] if c != "time_weeks"]),
        "previous_pregnancies": summary.summary6(clean, ["stated_previous_pregnancies", "total_previous_pregnancies"]),
        "nulls": quality.null_counts(clean),
        "missing_by_week": quality.miss_by(clean, "time_weeks", cohort.PROFILED),
        "missing_patterns": quality.miss_patterns(clean, cohort.PROFILED, max_sets=None, top=None),
    }


def linked_reports(linked: DataFrame, categories: DataFrame, sources: Sequence[str]) -> dict[str, DataFrame]:
    """Links, answers, missing answers by week, and non-response at the later visit against each stratum.

    ``categories`` has the combinations of strata and answers with their numbers of records: all frequencies
    and crosstabs come from it. The response flag is 1 where an answer is there.
    """
    tables = {
        "links": link_report(linked, sources),
        "characteristics": quality.freq(categories, list(outcomes.STRATA), weight="n"),
        "answers": quality.freq(categories, list(ANSWERS), weight="n"),
        "answers_missing_by_week": quality.miss_by(linked, "time_weeks", ANSWERS),
        "answers_incomplete": incomplete_answers(categories),
    }
    for outcome, use_na in NON_RESPONSE.items():
        flagged = categories.withColumn("observed", observed_flag(F.col(outcome)))
        for stratum in outcomes.STRATA:
            tables[f"{outcome}_by_{stratum}"] = quality.crosstab(flagged, stratum, "observed", use_na, weight="n")
    return tables


def incomplete_answers(categories: DataFrame) -> DataFrame:
    """Records, and records without an answer, per outcome."""
    sums = categories.agg(
        F.sum("n").alias("n_rows"), *[F.coalesce(F.sum(F.when(F.col(a).isNull(), F.col("n"))), F.lit(0)).alias(a) for a in ANSWERS]
    )
    return sums.unpivot(["n_rows"], list(ANSWERS), "variable", "n_incomplete")


def analysis_tables(panel_rows: DataFrame, fit: DataFrame, first_day: str) -> dict[str, DataFrame]:
    done = outcomes.analyse(panel_rows, keep=lambda _: fit)
    dates = spine.period_spine(panel_rows.sparkSession, origin=first_day).select("period", "week_start")
    observed = panel_rows.select("series", "period", "rate")
    columns = ["period", "t", "level", "trend", "denominator", "numerator", "rate"]
    return {
        "coefficients": done.coefficients,
        "ratios": done.ratios,
        "robust": done.robust,
        "statistics": done.statistics,
        "explained": done.explained,
        "residuals": done.residuals,
        "residual_summary": summary.summary6(done.residuals, ["residual"], ["series", "model"], bounded=True),
        "acf": done.acf,
        "pacf": done.pacf,
        "trends": done.trends,
        "bands": done.bands.join(observed, ["series", "period"], "left").join(dates, "period"),
        "effects": absolute_effects(done.trends),
        "summaries": summary.summary_by_level(panel_rows),
        "panel_summary": summary.summary6(panel_rows, columns, ["series"], bounded=True),
    }


def run_study(
    spark: SparkSession,
    paths: Mapping[str, str],
    out: str,
    week_column: str = "WEEKS_BEFORE_AFTER",
    first_day: str = "2015-08-10",
    trim: str | None = "after",
    trim_to: int = 6,
    spread: int = 0,
    line_breaks: bool = True,
) -> dict[str, DataFrame]:
    """Run all steps into the folder ``out`` and return its tables.

    The large stages and the results are parquet and are returned as read back; reports and results are one
    CSV file each as well. ``trim`` and ``trim_to`` say when ids are cut and to how many characters; None leaves
    them whole, in the sources too. ``spread`` splits ids that many records share once they are cut.

    Started again with the same inputs and parameters, after an error or a kill, it goes on from the steps that
    are finished. Stages that no result is read from are removed in the end.
    """
    others = [name for name in INPUTS if name != "births"]

    def linked_records() -> DataFrame:
        inputs = read_inputs(spark, {name: paths[name] for name in others}, week_column, line_breaks)
        sources = linkage.default_sources(*[inputs[name] for name in others], week_column)
        return linkage.link_cohort(run.table("cohort"), sources, status=True, trim=trim is not None, trim_to=trim_to, spread=spread)

    def linked_tables() -> dict[str, DataFrame]:
        linked = run.table("linked")
        names = [c.removeprefix("link_") for c in linked.columns if c.startswith("link_")]
        return linked_reports(linked, run.table("categories"), names)

    def categories() -> DataFrame:
        return quality.reduced(outcomes.with_parity(run.table("linked")), [*outcomes.STRATA, *ANSWERS])

    with stage.Run(spark, out) as run:
        passing = {"keep": False}
        run.add("births", lambda: read_inputs(spark, {"births": paths["births"]}, week_column, line_breaks)["births"], inputs=[paths["births"]], params=(week_column, line_breaks), **passing)
        run.add("axis", lambda: cohort.on_study_axis(run.table("births"), week_column), after=["births"], params=week_column, **passing)
        run.add("clean", lambda: cohort.clean_axis(run.table("axis"), trim, trim_to), after=["axis"], params=(trim, trim_to))
        run.add("cohort", lambda: cohort.complete_cohort(run.table("clean")), after=["clean"])
        run.add("linked", linked_records, inputs=[paths[name] for name in others], after=["cohort"], params=(week_column, trim, trim_to, spread, line_breaks))
        run.add("panel", lambda: outcomes.outcome_panel(run.table("linked")), after=["linked"])
        run.add("categories", categories, after=["linked"], **passing)
        run.add("fit", lambda: outcomes.fit_ladder(run.table("panel")), after=["panel"], **passing)
        run.add_tables("cohort_reports", lambda: cohort_reports(run.table("births"), run.table("axis"), run.table("clean"), week_column), after=["clean"], params=week_column)
        run.add_tables("linked_reports", linked_tables, after=["categories"])
        run.add_tables("analysis", lambda: analysis_tables(run.table("panel"), run.table("fit"), first_day), after=["fit"], params=first_day)

        results = {}
        for group in ("cohort_reports", "linked_reports", "analysis"):
            results.update(run.tables(group))
        for name, table in results.items():
            delimited.write_result(table, f"{out}/results/{name}", mode="overwrite")
        return {name: run.table(name) for name in ("clean", "cohort", "linked", "panel")} | results
