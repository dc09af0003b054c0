import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from itspark.functions.harmonic import harmonic_terms
from itspark.operators import effects, model, panel, serial
from itspark.operators.model import MODELS, ModelSpec
from itspark.operators.panel import PERSON_TIME, OutcomeSpec
from itspark.operators.tails import normal_p, t_p, t_quantile
from tests.conftest import rows

OUTCOMES = [
    OutcomeSpec("yes", "int(answer = 'Y')"),
    OutcomeSpec("events", "n", PERSON_TIME, horizon=26),
    OutcomeSpec("yes_late", "int(answer = 'Y')", start=2),
    OutcomeSpec("yes_known", "int(answer = 'Y')", complete=("stratum",)),
]


def test_panel_against_brute_force(spark):
    rng = random.Random(2)
    data = [
        (rng.choice([1, 2, 3, 3, 3, 105, 207, 208, None]), rng.choice(["Y", "N", None]), rng.choice([0, 0, 1, 4]), rng.choice(["a", None]))
        for _ in range(300)
    ] + [(50, None, 0, "a")]
    df = spark.createDataFrame(data, "time_weeks int, answer string, n int, stratum string")
    got = {(r.series, r.period): r for r in panel.panel(df, OUTCOMES).collect()}
    expected = {}
    for t in {d[0] for d in data if d[0] is not None and d[0] <= 207}:
        week = [d for d in data if d[0] == t]
        known = [d for d in week if d[1]]
        for name, subset, value, horizon, start in (
            ("yes", known, lambda d: d[1] == "Y", 1, 0),
            ("events", week, lambda d: d[2], 26, 0),
            ("yes_late", known, lambda d: d[1] == "Y", 1, 2),
            ("yes_known", [d for d in known if d[3]], lambda d: d[1] == "Y", 1, 0),
        ):
            if subset and t > start:
                expected[name, t] = (len(subset) * horizon, sum(value(d) for d in subset), t - start)
    assert got.keys() == expected.keys()
    for key, (den, num, t) in expected.items():
        r = got[key]
        assert (r.denominator, r.numerator, r.t) == (den, num, t)
        assert r.rate == pytest.approx(num / den * (1000 if key[0] == "events" else 100))
        assert (r.level, r.trend) == ((1, key[1] - 104) if key[1] > 104 else (0, 0))
    # The week in which nobody answered is there for the events and absent for the answers.
    assert ("events", 50) in got and ("yes", 50) not in got


def test_panel_by_stratum_and_filled_periods(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 3, 0), ("b", 207, 1)], "g string, time_weeks int, v int")
    filled = panel.fill_periods(panel.panel(df, [OutcomeSpec("s", "v", start=1)], by=["g"]), ["g", "series"])
    assert filled.count() == 2 * 206
    got = filled.filter("g = 'a' and denominator > 0").collect()
    assert [(r.period, r.t, r.numerator, r.rate) for r in got] == [(3, 2, 0.0, 0.0)]
    assert filled.filter("denominator = 0 and rate is null").count() == 2 * 206 - 2


def make_panel(spark, series: dict[str, dict], n=207, start=0, seed=0):
    """Panels with known coefficients; ``size`` is the denominator."""
    rng = np.random.default_rng(seed)
    out = []
    for name, spec in series.items():
        for period in range(start + 1, n + 1):
            t, level, trend = period - start, int(period > 104), max(0, period - 104)
            b = spec.get("b", (-2.0, 0.002, 0.3, -0.004))
            eta = b[0] + b[1] * t + b[2] * level + b[3] * trend
            size = spec.get("size", 900)
            mean = size * math.exp(eta)
            y = spec["y"](period) if "y" in spec else float(rng.poisson(mean * rng.gamma(spec["shape"], 1 / spec["shape"]) if "shape" in spec else mean))
            out.append((name, period, t, level, trend, size, y, y / size * 100, 100))
    schema = "series string, period int, t int, level int, trend int, denominator long, numerator double, rate double, scale int"
    return spark.createDataFrame(out, schema)


@pytest.fixture(scope="module")
def fitted(spark):
    rows_ = make_panel(spark, {"plain": {}, "over": {"shape": 20.0}, "few": {"size": 12}}).cache()
    return rows_, model.fit_its(rows_, list(MODELS.values())).cache()


def test_exact_data_give_back_the_coefficients(spark):
    b = (-1.5, 0.003, -0.25, 0.002)
    exact = make_panel(
        spark, {"e": {"y": lambda p: 1000 * math.exp(b[0] + b[1] * p + b[2] * (p > 104) + b[3] * max(0, p - 104)), "size": 1000}}
    )
    fit = model.fit_its(exact, [MODELS["poisson"], MODELS["poisson_harmonic"]]).collect()
    for r in fit:
        assert r.coef[:4] == pytest.approx(b, abs=1e-9)
        assert r.coef[4:] == pytest.approx([0.0] * len(r.coef[4:]), abs=1e-9)
        assert r.deviance == pytest.approx(0.0, abs=1e-6)


@pytest.mark.parametrize("harmonic", [False, True])
def test_fit_agrees_with_the_ml_library(spark, fitted, harmonic):
    rows_, fit = fitted
    columns = {"x1": F.col("t"), "x2": F.col("level"), "x3": F.col("trend")}
    if harmonic:
        columns.update(harmonic_terms(F.col("t")))
    name = "poisson_harmonic" if harmonic else "poisson"
    ours = fit.filter(f"series = 'over' and model = '{name}'").first()
    data = rows_.filter("series = 'over'").withColumns({k: c.cast("double") for k, c in columns.items()})
    data = data.withColumn("off", F.log("denominator"))
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(data)
    theirs = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="numerator", offsetCol="off", maxIter=50, tol=1e-12
    ).fit(data)
    assert ours.coef == pytest.approx([theirs.intercept, *theirs.coefficients], rel=1e-7, abs=1e-10)
    errors = theirs.summary.coefficientStandardErrors
    assert ours.se == pytest.approx([errors[-1], *errors[:-1]], rel=1e-6)
    assert ours.deviance == pytest.approx(theirs.summary.deviance, rel=1e-9)
    assert ours.null_deviance == pytest.approx(theirs.summary.nullDeviance, rel=1e-9)
    assert ours.aic == pytest.approx(theirs.summary.aic, rel=1e-9)


def test_score_is_zero_and_quasi_scales_the_errors(fitted):
    rows_, fit = fitted
    by = {(r.series, r.model): r for r in fit.collect()}
    assert len(by) == 12 and all(r.fit_ok for r in by.values())
    for series in ("plain", "over", "few"):
        p, q = by[series, "poisson"], by[series, "quasi"]
        assert q.coef == p.coef and q.aic is None
        assert q.se == pytest.approx([s * math.sqrt(p.dispersion) for s in p.se])
        assert q.se_robust == p.se_robust
        assert q.crit == pytest.approx(t_quantile(0.975, 203)) and p.crit == pytest.approx(1.959963985)
    assert by["over", "poisson"].dispersion > 2
    terms = rows_.select("series", "period", "level", "trend")
    res = effects.residuals(rows_, fit).filter("model = 'poisson_harmonic'").join(terms, ["series", "period"])
    score = res.groupBy("series").agg(
        *[F.sum(F.expr(f"(numerator - fitted) * {x}")).alias(f"s_{x}") for x in ("1", "t", "level", "trend")]
    )
    for r in score.collect():
        assert list(r)[1:] == pytest.approx([0.0] * 4, abs=1e-4)


def test_robust_errors_by_hand(fitted):
    rows_, fit = fitted
    got = fit.filter("series = 'over' and model = 'quasi'").first()
    data = sorted(tuple(r) for r in rows_.filter("series = 'over'").select("t", "level", "trend", "numerator", "denominator").collect())
    x = np.array([[1.0, t, lev, tr] for t, lev, tr, _, _ in data])
    y, n = np.array([d[3] for d in data]), np.array([float(d[4]) for d in data])
    mu = n * np.exp(x @ np.array(got.coef))
    bread = np.linalg.inv((x.T * mu) @ x)
    v = bread @ ((x.T * (y - mu) ** 2) @ x) @ bread
    assert got.se_robust == pytest.approx(np.sqrt(np.diag(v) * 207 / 206))
    plain = model.fit_its(rows_, [MODELS["quasi"]], cadjust=False).filter("series = 'over'").first()
    assert plain.se_robust == pytest.approx(np.sqrt(np.diag(v)))


def test_series_that_cannot_be_fitted_say_why(spark):
    rows_ = make_panel(spark, {"none": {"y": lambda p: 0.0}, "ok": {}})
    early = make_panel(spark, {"early": {}}).filter("period <= 104")
    short = make_panel(spark, {"short": {}}).filter("period in (1, 2, 110)")
    empty = make_panel(spark, {"gaps": {}}).withColumn("denominator", F.expr("if(period % 9 = 0, 0, denominator)"))
    fit = model.fit_its(rows_.union(early).union(short).union(empty), [MODELS["poisson"]])
    got = {r.series: r for r in fit.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "none": "no events", "ok": "ok", "early": "terms not separable", "short": "too few periods", "gaps": "ok",
    }
    assert got["early"].coef is None and not got["early"].fit_ok and got["gaps"].n_obs == 184
    assert model.coefficients(fit).select("series").distinct().count() == 2
    assert model.fit_statistics(fit).filter("not fit_ok and dispersion is null and reported_dispersion is null").count() == 3


def test_chosen_models_per_series_and_limits(spark, fitted):
    rows_, _ = fitted
    chosen = F.when(F.col("series") == "over", F.array(F.lit("quasi"), F.lit("poisson"))).otherwise(F.array(F.lit("poisson")))
    fit = model.fit_its(rows_, list(MODELS.values()), chosen=chosen)
    assert rows(fit, "series", "model") == [("few", "poisson"), ("over", "poisson"), ("over", "quasi"), ("plain", "poisson")]
    with pytest.raises(ValueError):
        ModelSpec("x", harmonics=-1)
    one = model.fit_its(rows_, [ModelSpec("one", "poisson", 1)])
    assert one.first().terms == ["intercept", "time", "level", "trend", "sin1", "cos1"]
    # A model with one pair is predicted with its own terms, whatever their place.
    res = effects.residuals(rows_, one).groupBy("series").agg(F.sum(F.col("numerator") - F.col("fitted")).alias("s"))
    assert [r.s for r in res.collect()] == pytest.approx([0.0] * 3, abs=1e-5)


def test_any_number_of_seasonal_pairs(spark, fitted):
    rows_, _ = fitted
    fit = model.fit_its(rows_, [ModelSpec("four", "poisson", 4), MODELS["poisson_harmonic"]])
    four = fit.filter("series = 'over' and model = 'four'").first()
    assert four.terms[4:] == [f"{f}{k}" for f in ("sin", "cos") for k in (1, 2, 3, 4)]
    columns = {"x1": F.col("t"), "x2": F.col("level"), "x3": F.col("trend"), **harmonic_terms(F.col("t"), 4)}
    data = rows_.filter("series = 'over'").withColumns({k: c.cast("double") for k, c in columns.items()}).withColumn("off", F.log("denominator"))
    data = VectorAssembler(inputCols=list(columns), outputCol="features").transform(data)
    glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="numerator", offsetCol="off", maxIter=50, tol=1e-12)
    theirs = glm.fit(data)
    assert four.coef == pytest.approx([theirs.intercept, *theirs.coefficients], rel=1e-7, abs=1e-10)
    # Every model is predicted with its own terms.
    left = effects.residuals(rows_, fit).groupBy("series", "model").agg(F.sum(F.col("numerator") - F.col("fitted")).alias("s"))
    assert [r.s for r in left.collect()] == pytest.approx([0.0] * 6, abs=1e-5)


def test_many_series_are_one_stack(spark):
    """Series of several lengths, good and bad, in stacks: the same fits as one series at a time."""
    rng = np.random.default_rng(3)
    data, plain = [], {}
    for series in range(3000):
        periods = [p for p in range(1, 208) if series % 3 or p % 7][: 40 if series % 100 == 5 else None]
        y = rng.poisson(30.0 + 20 * (series % 4), len(periods)) * (series % 100 != 7)
        plain[series] = (periods, y)
        data += [(series, p, p, int(p > 104), max(0, p - 104), 500, float(v)) for p, v in zip(periods, y)]
    schema = "series int, period int, t int, level int, trend int, denominator int, numerator double"
    rows_ = spark.createDataFrame(pd.DataFrame(data, columns=[c.split()[0] for c in schema.split(", ")]), schema)
    fit = {r.series: r for r in model.fit_its(rows_, [MODELS["quasi"]]).collect()}
    assert len(fit) == 3000
    for series in (0, 1, 5, 7, 104, 105, 107, 2998, 2999):
        periods, y = plain[series]
        x = np.array([[1.0, p, p > 104, max(0, p - 104)] for p in periods], float)
        (alone,) = model.fit_stack(x[None], y[None].astype(float), np.full((1, len(periods)), 500.0), MODELS["quasi"], True, 0.05)
        got = fit[series].asDict()
        assert {k: got[k] for k in alone} == alone
    assert fit[5].status == "terms not separable" and fit[7].status == "no events"
    assert sum(r.fit_ok for r in fit.values()) == 3000 - 60


def test_one_bad_series_leaves_the_stack_alone():
    x = np.stack([np.column_stack([np.ones(60), np.arange(60.0)])] * 3)
    y = np.stack([np.full(60, 5.0), np.where(np.arange(60) == 59, 1e300, 0.0), np.arange(60.0)])
    coef, mu, rounds, converged = model.solve_poisson(x, y, np.zeros((3, 60)))
    alone = [model.solve_poisson(x[i : i + 1], y[i : i + 1], np.zeros((1, 60))) for i in (0, 2)]
    for i, (c, m, r, ok) in zip((0, 2), alone):
        assert converged[i] and ok[0] and (coef[i] == c[0]).all() and (mu[i] == m[0]).all() and rounds[i] == r[0]


def test_explained(fitted):
    _, fit = fitted
    by = {(r.series, r.model): r for r in fit.collect()}
    for r in model.explained(fit).collect():
        f = by[r.series, r.model]
        cox_snell = 1 - math.exp((f.deviance - f.null_deviance) / 207)
        assert r.n_obs == 207 and r.r2_cox_snell == pytest.approx(cox_snell)
        assert r.r2_nagelkerke == pytest.approx(cox_snell / (1 - math.exp(-f.null_deviance / 207))) and 0 < r.r2_nagelkerke <= 1


def test_order_of_rows_does_not_matter(spark, fitted):
    rows_, fit = fitted
    shuffled = model.fit_its(rows_.orderBy(F.rand(3)).repartition(5), list(MODELS.values()))
    a = {(r.series, r.model): r.coef for r in fit.collect()}
    b = {(r.series, r.model): r.coef for r in shuffled.collect()}
    assert a == b


def test_irr(fitted):
    _, fit = fitted
    coef = {(r.series, r.term): r for r in model.coefficients(fit).filter("model = 'quasi'").collect()}
    for r in model.irr(fit).filter("model = 'quasi'").collect():
        c = coef[r.series, r.term]
        assert r.irr == pytest.approx(math.exp(c.estimate))
        assert r.lower == pytest.approx(math.exp(c.estimate - 1.959963985 * c.std_error))
        assert r.irr_std_error == pytest.approx(r.irr * c.std_error)
        assert c.p_value == pytest.approx(t_p(c.statistic, 203))


def test_trends_effects_and_bands(fitted):
    rows_, fit = fitted
    trend = effects.trends(rows_, fit)
    assert trend.filter("period <= 104 and abs(factual - counterfactual) > 1e-9").count() == 0
    for scenario in ("factual", "counterfactual"):
        both = effects.predict(rows_, fit, scenario).join(trend, ["series", "model", "period"])
        assert both.count() == 12 * 207
        assert both.filter(f"abs(rate_fit - {scenario}) > 1e-9").count() == 0
    effect = effects.absolute_effects(trend)
    assert {(r.period, r.post_week) for r in effect.collect()} == {(109, 5), (129, 25)} and effect.count() == 24
    band = effects.segment_columns(effects.confidence_band(rows_, fit))
    assert band.filter("not (lcb < pred and pred < ucb)").count() == 0
    assert band.filter("(first_seg is null) = (second_seg is null)").count() == 0
    assert band.filter("trend = 0 and first_ucb is null or trend > 0 and second_lcb is null").count() == 0
    r = band.filter("series = 'over' and model = 'quasi' and period = 129").first()
    f = fit.filter("series = 'over' and model = 'quasi'").first()
    x = np.array([1.0, 129.0, 1.0, 25.0])
    eta, se = x @ np.array(f.coef), math.sqrt(x @ np.array(f.vcov) @ x)
    assert (r.pred, r.lcb, r.ucb) == pytest.approx(tuple(100 * math.exp(eta + k * t_quantile(0.975, 203) * se) for k in (0, -1, 1)))


def test_truncated_series_keep_their_own_axis(spark):
    rows_ = make_panel(spark, {"late": {}}, start=25)
    fit = model.fit_its(rows_, [MODELS["quasi"]])
    grid = panel.design_grid(rows_).orderBy("period").collect()
    assert [grid[0].period, grid[0].t, grid[-1].period, grid[-1].t, len(grid)] == [26, 1, 207, 182, 182]
    assert sum(g.level == 0 for g in grid) == 79
    assert {r.period for r in effects.absolute_effects(effects.trends(rows_, fit)).collect()} == {109, 129}
    with pytest.raises(ValueError):
        panel.design_grid(rows_, "other")


def acf_by_hand(v, lags):
    d = np.array(v) - np.mean(v)
    return [float((d[: len(d) - k] * d[k:]).sum() / (d * d).sum()) for k in range(lags + 1)]


def pacf_by_hand(r):
    """Last coefficient of each Yule-Walker system, solved whole."""
    out = []
    for k in range(1, len(r)):
        system = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(float(np.linalg.solve(system, np.array(r[1 : k + 1]))[-1]))
    return out


def test_acf_and_pacf(spark):
    rng = np.random.default_rng(4)
    series = {"long": 207, "cut": 182, "tiny": 5, "longer": 400}
    values = {k: list(np.cumsum(rng.normal(size=n)) * 0.1 + rng.normal(size=n)) for k, n in series.items()}
    data = [(k, "m", 3 * i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    rng.shuffle(data)
    df = spark.createDataFrame([(k, m, int(i), float(v)) for k, m, i, v in data], "series string, model string, period int, residual double")
    lags = {"long": 23, "cut": 22, "tiny": 4, "longer": 26}
    got, part = serial.acf(df), serial.pacf(df)
    for k, n in series.items():
        r = acf_by_hand(values[k], lags[k])
        ours = got.filter(f"series = '{k}'").orderBy("lag").collect()
        assert [x.acf for x in ours] == pytest.approx(r)
        assert ours[0].band == pytest.approx(1.96 / math.sqrt(n))
        theirs = part.filter(f"series = '{k}'").orderBy("lag").collect()
        assert [x.lag for x in theirs] == list(range(1, lags[k] + 1))
        assert [x.pacf for x in theirs] == pytest.approx(pacf_by_hand(r))
    assert serial.acf(df, max_lag=3).filter("series = 'long'").count() == 4


def test_a_null_stratum_is_a_stratum(spark):
    rng = np.random.default_rng(7)
    data = [(g, w, int(rng.random() < 0.3)) for g in ("a", None) for w in range(1, 208) for _ in range(20)]
    df = spark.createDataFrame(data, "g string, time_weeks int, v int")
    by = ["g", "series"]
    gap = df.filter("not (g is null and time_weeks = 50)")
    filled = panel.fill_periods(panel.panel(gap, [OutcomeSpec("s", "v")], by=["g"]), by)
    empty = rows(filled.filter("denominator = 0"), "g", "period")
    assert filled.count() == 414 and empty == [(None, 50)]
    assert filled.filter("g is null").agg(F.sum("denominator")).first()[0] == 206 * 20
    made = panel.panel(df, [OutcomeSpec("s", "v")], by=["g"])
    fit = model.fit_its(made, [MODELS["poisson"]], by)
    for table in (effects.residuals(made, fit, by), effects.trends(made, fit, by), effects.predict(made, fit, by=by), effects.confidence_band(made, fit, by)):
        assert dict(rows(table.groupBy("g").count())) == {"a": 207, None: 207}


def test_tails():
    assert normal_p(1.959963984540054) == pytest.approx(0.05)
    table = {1: 12.706205, 10: 2.228139, 30: 2.042272, 120: 1.979930, 199: 1.971957}
    for df, q in table.items():
        assert t_quantile(0.975, df) == pytest.approx(q, abs=5e-7)
        assert t_p(q, df) == pytest.approx(0.05, abs=1e-6)
    assert t_p(0.0, 7) == pytest.approx(1.0)
