"""Registered queries: every operator over whole driver tables.

Counts come out as BIGINT, measures as DOUBLE rounded to 6 places, dates as text, so that another engine
can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.standin import Study
from itspark.functions import axis, harmonic, recode
from itspark.functions.recode import sentinel_to_null
from itspark.operators import dedup, effects, link, model, panel, quality, serial, summary
from itspark.operators.model import MODELS
from itspark.operators.panel import PERSON_TIME, OutcomeSpec
from itspark.plans import cohort, outcomes
from itspark.sources import delimited, spine, stage
from itspark.sources.schemas import KEYS

ORIGIN = "1995-01-08"
SPREAD = 16

SERIES = (
    OutcomeSpec("filled", "int(o_orderstatus = 'F')", complete=("priority",)),
    OutcomeSpec("urgent", "int(priority = '1-URGENT')"),
    OutcomeSpec("open_truncated", "int(o_orderstatus = 'O')", start=25),
    OutcomeSpec("units_26w", "int(o_totalprice / 100000)", PERSON_TIME, horizon=26),
)


def _plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as BIGINT, fractions rounded with no negative zero, dates and flags as text and number."""

    def plain(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.abs(c) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(c, digits))
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        return c.alias(f.name)

    return df.select(*[plain(f) for f in df.schema.fields])


# sources


def scan_roundtrip(s: Study) -> DataFrame:
    """Orders with awkward text, line breaks in it, written as CSV and as a stage, read back in both dialects, compared in totals."""
    rows = s.table("orders").select(
        "o_orderkey",
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("customer"),
        "o_totalprice",
        recode.sentinel_to_null(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"),
        F.col("o_orderdate").cast("date").alias("ordered"),
        F.concat(F.lit(' say "'), "o_orderstatus", F.lit('", or so,\n\\')).alias("note"),
    )
    text = stage.new_stage_path(s.spark, "orders-csv")
    delimited.write_delimited(rows, text)
    schema = "o_orderkey bigint, customer string, o_totalprice double, priority string, ordered date, note string"
    from_text = delimited.read_delimited(s.spark, text, schema, multi_line=True)
    from_base = delimited.read_delimited(s.spark, text, schema, blank_is_null=False, multi_line=True)
    from_stage = stage.write_stage(rows, stage.new_stage_path(s.spark, "orders"))

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("copy"),
            F.count(F.lit(1)).alias("n"),
            F.count("priority").alias("n_priority"),
            F.round(F.sum("o_totalprice"), 2).alias("price"),
            F.sum(F.length("customer")).alias("customer_chars"),
            F.min("customer").alias("first_customer"),
            F.min("ordered").alias("first_day"),
            F.max("ordered").alias("last_day"),
            F.sum(F.length("note")).alias("note_chars"),
            F.max("note").alias("last_note"),
        )

    copies = totals(from_text, "csv").unionByName(totals(from_base, "csv base")).unionByName(totals(from_stage, "stage"))
    return _plain(copies, 2)


def result_roundtrip(s: Study) -> DataFrame:
    """A result table written as one CSV file and read back in the base dialect; a null is NA and null again."""
    priority = recode.sentinel_to_null(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority")
    counts = s.table("orders").groupBy(priority).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("price"))
    counts = counts.withColumn("quoted", F.concat(F.lit('"'), F.coalesce("priority", F.lit("")), F.lit('", x')))
    path = stage.new_stage_path(s.spark, "result")
    delimited.write_result(counts, path)
    return _plain(delimited.read_delimited(s.spark, path, "priority string, n bigint, price double, quoted string", blank_is_null=False), 2)


def period_spine(s: Study) -> DataFrame:
    """Spine of the study with the orders of each week, none where there are none."""
    periods = spine.period_spine(s.spark, origin=ORIGIN, start=25)
    orders = panel.count_by(s.records(), "time_weeks").withColumnRenamed("time_weeks", "period")
    joined = periods.join(orders, "period", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    written = F.date_format("week_start", "yyyy/M/d")
    return _plain(joined.withColumn("read_back", recode.slash_date(written)))


# axis and recodes


def study_time(s: Study) -> DataFrame:
    return _plain(s.records().select("o_orderkey", "time_weeks"))


def its_terms(s: Study) -> DataFrame:
    return _plain(axis.its_terms(s.records()).select("o_orderkey", "level", "trend_weeks"))


def binary_outcome(s: Study) -> DataFrame:
    priority, price = F.col("priority"), F.col("o_totalprice")
    return _plain(
        s.all_records().select(
            "o_orderkey",
            recode.binary(priority == "1-URGENT").alias("urgent"),
            recode.binary(price > 250000).alias("large"),
            recode.either(priority == "5-LOW", F.lit("low"), F.lit("other")).alias("kind"),
            recode.observed_flag(priority).alias("observed"),
        )
    )


def recode_sentinel(s: Study) -> DataFrame:
    return _plain(
        s.table("orders").select(
            "o_orderkey",
            recode.sentinel_to_null(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"),
            recode.sentinel_to_null(F.col("o_orderstatus"), "P", "O").alias("status"),
        )
    )


def recode_predicate(s: Study) -> DataFrame:
    price = F.col("o_totalprice")
    return _plain(s.table("orders").select("o_orderkey", recode.null_where(price, price > 400000).alias("price")), 2)


def key_suffix(s: Study) -> DataFrame:
    return s.table("customer").select(
        "c_custkey",
        recode.key_suffix(F.col("c_name")).alias("suffix"),
        recode.key_suffix(F.col("c_mktsegment"), 12).alias("short_kept"),
    )


def exclusive_flag(s: Study) -> DataFrame:
    """Tick boxes of every line, and whether the target box alone is ticked."""
    flag, discount = F.col("l_returnflag"), F.col("l_discount")
    boxes = s.table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(flag == "R", "Y").when(flag == "A", "N").alias("a"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("b"),
        F.when(discount > 0.05, "Y").when(discount > 0.0, "N").otherwise("7x").alias("c"),
    )
    ticks = {c: recode.yes_no_to_int(F.col(c)) for c in "abc"}
    return _plain(
        boxes.select(
            "l_orderkey", "l_linenumber", *[t.alias(f"tick_{c}") for c, t in ticks.items()],
            recode.exclusive_flag(ticks["b"], ticks["a"], ticks["c"]).alias("only_b"),
        )
    )


def harmonic_terms(s: Study) -> DataFrame:
    weeks = panel.count_by(s.records(), "time_weeks")
    return _plain(weeks.select("time_weeks", "n", *[c.alias(n) for n, c in harmonic.harmonic_terms(F.col("time_weeks")).items()]))


# cohort and quality


def cohort_build(s: Study) -> DataFrame:
    return _plain(cohort.build_cohort(s.births()))


def attrition(s: Study) -> DataFrame:
    return _plain(quality.attrition(cohort.on_study_axis(s.births()), cohort.criteria(), KEYS))


def complete_case(s: Study) -> DataFrame:
    return _plain(quality.complete_cases(s.all_records(), ["priority"]).select("o_orderkey", "priority"))


def missing_counts(s: Study) -> DataFrame:
    return quality.missing_counts(cohort.clean_records(s.births()), cohort.PROFILED)


def null_counts(s: Study) -> DataFrame:
    return quality.null_counts(cohort.clean_records(s.births()), cohort.COHORT_COLUMNS)


def freq_table(s: Study) -> DataFrame:
    columns = ["feed_on_discharge", "book_smoking_history", "smoking_during_pregnancy", "mother_age", "simd_quintile", "sex"]
    return quality.freq(cohort.clean_records(s.births()), columns)


def freq_table_known(s: Study) -> DataFrame:
    return quality.freq(s.all_records(), ["priority", "o_orderstatus"], use_na=False)


def histogram_round(s: Study) -> DataFrame:
    """Number and break points of the bins come from the data."""
    return _plain(quality.histogram(s.table("orders"), "o_totalprice"))


def histogram(s: Study) -> DataFrame:
    return _plain(quality.histogram(s.table("orders"), "o_totalprice", 25))


def crosstab(s: Study) -> DataFrame:
    """Language against whether a document has a quality label."""
    flagged = s.labelled_documents().withColumn("labelled", recode.observed_flag(F.col("quality")).cast("bigint"))
    return _plain(quality.crosstab(flagged, "lang", "labelled"))


def crosstab_na(s: Study) -> DataFrame:
    documents = s.labelled_documents().withColumn("quality", F.col("quality").cast("bigint"))
    return _plain(quality.crosstab(documents, "source", "quality", use_na=True))


def miss_by_factor(s: Study) -> DataFrame:
    return _plain(quality.miss_by(s.labelled_documents(), "lang", ["quality", "toxic"]))


def miss_by_period(s: Study) -> DataFrame:
    return _plain(quality.miss_by(cohort.clean_records(s.births()), "time_weeks", cohort.PROFILED))


def miss_patterns(s: Study) -> DataFrame:
    return _plain(quality.miss_patterns(cohort.clean_records(s.births()), cohort.PROFILED))


# duplicates


def dedup_exact(s: Study) -> DataFrame:
    return dedup.distinct_rows(s.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"))


def dedup_conflict(s: Study) -> DataFrame:
    """Lines cut down to columns in which they repeat and disagree; copies fold, keys in conflict go."""
    columns = ("l_orderkey", "l_returnflag", "l_linestatus", "l_tax")
    return _plain(dedup.drop_conflicts(s.table("lineitem").select(*columns), ["l_orderkey", "l_returnflag"]))


def dedup_repeated(s: Study) -> DataFrame:
    lines = s.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return dedup.drop_repeated_keys(lines, ["l_orderkey", "l_returnflag"])


def conflict_report(s: Study) -> DataFrame:
    lines = s.table("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    return dedup.conflict_report(lines, ["l_orderkey", "l_returnflag"])


def window_count_keys(s: Study) -> DataFrame:
    """Orders of the same customer; their number is open, so heavy customers are spread."""
    orders = s.table("orders").select("o_orderkey", "o_custkey")
    return panel.with_group_count(orders, "o_custkey", spread=SPREAD).select("o_orderkey", "n")


def window_count(s: Study) -> DataFrame:
    return panel.with_period_count(s.records()).select("o_orderkey", "n")


# linkage


def link_left(s: Study) -> DataFrame:
    """Orders linked to a table of priorities by the one column they share, unknown to unknown."""
    orders = s.all_records().select("o_orderkey", "priority")
    priorities = s.all_records().groupBy("priority").agg(F.max("o_totalprice").alias("top_price"))
    known = priorities.filter(F.col("priority").isNull() | (F.col("priority") != "5-LOW"))
    return _plain(link.link_left(orders, known, marker="matched", spread=SPREAD), 2)


def link_star(s: Study) -> DataFrame:
    return _plain(s.linked())


def link_fill_zero(s: Study) -> DataFrame:
    """Cohort linked to episodes alone; orders without any line have none."""
    linked = link.link_sources(cohort.build_cohort(s.births()), s.sources()[:2], KEYS)
    return _plain(linked.select(*KEYS, *[f"episodes_{w}w_{who}" for w in (26, 52) for who in ("child", "mother")]))


def link_report(s: Study) -> DataFrame:
    names = [source.name for source in s.sources()]
    return link.link_report(s.linked(status=True), names)


def bind_on_period(s: Study) -> DataFrame:
    """Panel, spine and weekly counts side by side."""
    rows = panel.panel(s.records(), SERIES[:2]).select("series", "period", "rate")
    weeks = panel.count_by(s.records(), "time_weeks").withColumnRenamed("time_weeks", "period")
    dates = spine.period_spine(s.spark, origin=ORIGIN).select("period", "week_start")
    return _plain(link.bind_on_period(rows, weeks, dates, on=["period"]))


# panels and summaries


def count_by_period(s: Study) -> DataFrame:
    before = s.keyed_orders(whole=True).withColumn(
        "time_raw", axis.raw_study_time(F.col("WEEKS_BEFORE_AFTER"), F.col("COHORT_IDENTIFIER"))
    )
    return _plain(panel.count_by(before, "time_raw"))


def panel_prevalence(s: Study) -> DataFrame:
    return _plain(panel.panel(s.records(), SERIES[:2]))


def panel_truncated(s: Study) -> DataFrame:
    whole = panel.panel(s.records(), SERIES[:2])
    return _plain(axis.window_from(whole, 25))


def panel_incidence(s: Study) -> DataFrame:
    """The four episode series on the linked cohort."""
    linked = link.link_sources(cohort.build_cohort(s.births()), s.sources()[:2], KEYS)
    return _plain(panel.panel(linked, outcomes.OUTCOMES[:4]))


def panel_multi(s: Study) -> DataFrame:
    """All fourteen outcome series from one pass over the linked records."""
    return _plain(outcomes.outcome_panel(s.linked()))


def segmented(s: Study, segment: Column) -> DataFrame:
    """Records with a segment of their customer."""
    customers = s.table("customer").select(F.col("c_custkey").alias("o_custkey"), segment.alias("c_mktsegment"))
    return link.link_left(s.records(), customers, ["o_custkey"], na_matches=False, spread=SPREAD)


def panel_filled(s: Study) -> DataFrame:
    """A panel by market segment, one of which is unknown, weeks without orders included."""
    orders = segmented(s, sentinel_to_null(F.col("c_mktsegment"), "MACHINERY"))
    by = ["c_mktsegment", "series"]
    rows = panel.fill_periods(panel.panel(orders, SERIES[1:3], by=by[:1]), by)
    return _plain(rows.drop("scale"))


def summary_by_level(s: Study) -> DataFrame:
    return _plain(summary.summary_by_level(study_panel(s)))


def summary_frame(s: Study) -> DataFrame:
    columns = ["period", "trend", "level", "denominator", "numerator", "rate"]
    return _plain(summary.summary6(study_panel(s), columns, ["series"], bounded=True))


def summary_records(s: Study) -> DataFrame:
    """Summaries straight from the records, with the ranked quantiles."""
    return _plain(summary.summary6(s.table("orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus"]), 4)


def summary_recoded(s: Study) -> DataFrame:
    return _plain(summary.summary6(cohort.clean_records(s.births()), ["total_previous_pregnancies", "birthweight"]), 4)


# models


def study_panel(s: Study) -> DataFrame:
    return panel.panel(s.records(), SERIES)


def staged(s: Study, rows: DataFrame) -> DataFrame:
    """The panel as a stage: the records are scanned once, and what follows reads a few hundred rows a series."""
    return stage.write_stage(rows, stage.new_stage_path(s.spark, "panel"))


def study_fit(s: Study, *names: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(s, study_panel(s))
    return rows, model.fit_its(rows, [MODELS[n] for n in names])


def design_grid(s: Study) -> DataFrame:
    rows = study_panel(s)
    both = panel.design_grid(rows, "factual").unionByName(panel.design_grid(rows, "counterfactual"))
    return _plain(both)


COEFFICIENT_COLUMNS = ("series", "model", "term", "estimate", "std_error", "statistic", "p_value")


def its_poisson(s: Study) -> DataFrame:
    return _plain(model.coefficients(study_fit(s, "poisson")[1]).select(*COEFFICIENT_COLUMNS))


def its_quasi(s: Study) -> DataFrame:
    return _plain(model.coefficients(study_fit(s, "quasi")[1]).select(*COEFFICIENT_COLUMNS))


def its_harmonic(s: Study) -> DataFrame:
    fit = study_fit(s, "poisson_harmonic", "quasi_harmonic")[1]
    return _plain(model.coefficients(fit).select(*COEFFICIENT_COLUMNS))


def its_dispersion(s: Study) -> DataFrame:
    fit = study_fit(s, "poisson", "quasi", "quasi_harmonic")[1]
    columns = ("series", "model", "df_residual", "pearson", "dispersion", "reported_dispersion")
    return _plain(model.fit_statistics(fit).select(*columns))


def its_irr(s: Study) -> DataFrame:
    fit = study_fit(s, "poisson", "quasi")[1]
    return _plain(model.irr(fit).select("series", "model", "term", "irr", "lower", "upper"))


def its_irr_rounded(s: Study) -> DataFrame:
    """Ratios as printed, to four places."""
    fit = study_fit(s, "quasi", "quasi_harmonic")[1]
    return model.irr(fit, digits=4).select("series", "model", "term", "irr", "lower", "upper")


def its_robust(s: Study) -> DataFrame:
    """Robust errors on both scales, with and without the small-sample factor."""
    rows = staged(s, study_panel(s))
    specs = [MODELS["poisson"], MODELS["poisson_harmonic"]]
    parts = [
        model.irr(model.fit_its(rows, specs, cadjust=adjusted), robust=True).withColumn("cadjust", F.lit(int(adjusted)))
        for adjusted in (True, False)
    ]
    columns = ("series", "model", "cadjust", "term", "irr", "lower", "upper", "std_error", "irr_std_error", "p_value")
    return _plain(parts[0].unionByName(parts[1]).select(*columns))


def its_summary(s: Study) -> DataFrame:
    return _plain(model.fit_statistics(study_fit(s, *MODELS)[1]).drop("status"))


def its_explained(s: Study) -> DataFrame:
    return _plain(model.explained(study_fit(s, *MODELS)[1]))


def its_residual_summary(s: Study) -> DataFrame:
    residuals = effects.residuals(*study_fit(s, "poisson", "poisson_harmonic"))
    return _plain(summary.summary6(residuals, ["residual"], ["series", "model"], bounded=True))


def its_residuals(s: Study) -> DataFrame:
    return _plain(effects.residuals(*study_fit(s, "poisson", "poisson_harmonic")))


def resid_acf(s: Study) -> DataFrame:
    return _plain(serial.acf(effects.residuals(*study_fit(s, "poisson"))))


def resid_pacf(s: Study) -> DataFrame:
    return _plain(serial.pacf(effects.residuals(*study_fit(s, "poisson"))))


def its_factual(s: Study) -> DataFrame:
    return _plain(effects.predict(*study_fit(s, "poisson", "poisson_harmonic"), "factual"))


def its_counterfactual(s: Study) -> DataFrame:
    return _plain(effects.predict(*study_fit(s, "poisson", "poisson_harmonic"), "counterfactual"))


def its_ci_band(s: Study) -> DataFrame:
    return _plain(effects.confidence_band(*study_fit(s, "quasi", "poisson_harmonic")))


def segment_bands(s: Study) -> DataFrame:
    """The chart table: observed rate, fit and limits in two segments, first day of the week."""
    rows, fit = study_fit(s, "poisson_harmonic")
    band = effects.segment_columns(effects.confidence_band(rows, fit)).drop("pred", "lcb", "ucb")
    observed = rows.select("series", "period", "rate")
    dated = spine.period_spine(s.spark, origin=ORIGIN).select("period", "week_start")
    return _plain(link.bind_on_period(band, observed).join(dated, "period"))


def its_effects(s: Study) -> DataFrame:
    """Absolute effects 5 and 25 weeks in, of the primary model of each of the fourteen outcomes."""
    rows = staged(s, outcomes.outcome_panel(s.linked()))
    fit = outcomes.fit_ladder(rows).filter("is_primary")
    return _plain(effects.absolute_effects(effects.trends(rows, fit)))


def its_effects_by(s: Study) -> DataFrame:
    """Effects in two strata, one market segment and the customers of which no such segment is known."""
    by = ["c_mktsegment", "series"]
    orders = segmented(s, F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")))
    rows = staged(s, panel.panel(orders, SERIES[2:], by=by[:1]))
    fit = model.fit_its(rows, [MODELS["poisson"]], by)
    return _plain(effects.absolute_effects(effects.trends(rows, fit, by)))


def its_ladder(s: Study) -> DataFrame:
    """All thirty-one fits of the fourteen outcomes, each outcome with its own list of models."""
    rows = staged(s, outcomes.outcome_panel(s.linked()))
    terms = model.coefficients(outcomes.fit_ladder(rows), keep=["is_primary"])
    return _plain(terms.select("series", "model", "is_primary", "term", "estimate", "std_error"))


QUERIES = (
    scan_roundtrip, result_roundtrip, period_spine, study_time, its_terms, binary_outcome, recode_sentinel, recode_predicate,
    key_suffix, exclusive_flag, harmonic_terms, cohort_build, attrition, complete_case, missing_counts,
    null_counts, freq_table, freq_table_known, histogram, histogram_round, crosstab, crosstab_na, miss_by_factor,
    miss_by_period, miss_patterns, dedup_exact, dedup_conflict, dedup_repeated, conflict_report, window_count, window_count_keys,
    link_left, link_star, link_fill_zero, link_report, bind_on_period, count_by_period, panel_prevalence,
    panel_truncated, panel_incidence, panel_multi, panel_filled, summary_by_level, summary_frame,
    summary_records, summary_recoded, design_grid, its_poisson, its_quasi, its_harmonic, its_dispersion,
    its_irr, its_irr_rounded, its_robust, its_summary, its_explained, its_residuals, its_residual_summary,
    resid_acf, resid_pacf, its_factual, its_counterfactual,
    its_ci_band, segment_bands, its_effects, its_effects_by, its_ladder,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(query: Callable[[Study], DataFrame]):
        return lambda spark, sf_dir: query(Study(spark, sf_dir))

    return {q.__name__: on(q) for q in QUERIES}
