"""Segmented Poisson and quasi-Poisson regression, every series of a panel fitted in parallel.

Spark builds the design columns and gathers each series into one row of arrays, as long as the study is, not
the data. Tasks then solve many series at a time: the least squares of all series with equally many periods are
one stack of matrices, and series leave the stack as they converge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from itspark.functions.harmonic import harmonic_terms
from itspark.operators.tails import normal_p, t_p, t_quantile

BASE_TERMS = ("intercept", "time", "level", "trend")
MAX_ITERATIONS = 25
TOLERANCE = 1e-8
#: Series that are solved as one stack of matrices.
STACK = 512


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str = "poisson"
    harmonics: int = 0

    def __post_init__(self):
        if self.harmonics < 0:
            raise ValueError(f"seasonal pairs are 0 or more, not {self.harmonics}")


MODELS = {
    m.name: m
    for m in (
        ModelSpec("poisson", "poisson"),
        ModelSpec("quasi", "quasipoisson"),
        ModelSpec("poisson_harmonic", "poisson", 2),
        ModelSpec("quasi_harmonic", "quasipoisson", 2),
    )
}

_DOUBLES = T.ArrayType(T.DoubleType())
_FIT_FIELDS = [
    T.StructField("model", T.StringType()),
    T.StructField("family", T.StringType()),
    T.StructField("fit_ok", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("terms", T.ArrayType(T.StringType())),
    T.StructField("coef", _DOUBLES),
    T.StructField("se", _DOUBLES),
    T.StructField("p", _DOUBLES),
    T.StructField("se_robust", _DOUBLES),
    T.StructField("p_robust", _DOUBLES),
    T.StructField("vcov", T.ArrayType(_DOUBLES)),
    T.StructField("n_obs", T.LongType()),
    T.StructField("df_residual", T.LongType()),
    T.StructField("df_null", T.LongType()),
    T.StructField("deviance", T.DoubleType()),
    T.StructField("null_deviance", T.DoubleType()),
    T.StructField("pearson", T.DoubleType()),
    T.StructField("dispersion", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("crit", T.DoubleType()),
    T.StructField("iterations", T.LongType()),
]


def design_terms(t: Column, level: Column, trend: Column, harmonics: int = 0) -> dict[str, Column]:
    """Model terms in coefficient order."""
    terms = dict(zip(BASE_TERMS, (F.lit(1.0), t.cast("double"), level.cast("double"), trend.cast("double"))))
    if harmonics:
        terms.update(harmonic_terms(t, harmonics))
    return terms


def _deviance(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    log_ratio = np.log(np.where(y > 0, y, 1.0) / np.where(y > 0, mu, 1.0))
    return 2.0 * np.sum(y * log_ratio - (y - mu), axis=-1)


def solve_poisson(x: np.ndarray, y: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Reweighted least squares for a log link, of a stack of series: ``x`` is series by periods by terms.

    Returns coefficients, fitted means, rounds, converged. One round is added after the stop rule, so that the
    covariances belong to the maximum itself. A series stays as it is once it is done, whatever the others do.
    """
    mu = y + 0.1
    eta = np.log(mu)
    before = _deviance(y, mu)
    coef = np.full((len(x), x.shape[2]), np.nan)
    stopped, rounds = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    left = np.arange(len(x))
    with np.errstate(all="ignore"):
        for turn in range(1, MAX_ITERATIONS + 2):
            rounds[left] = turn
            root = np.sqrt(mu[left])
            working = eta[left] - offset[left] + (y[left] - mu[left]) / mu[left]
            q, r = np.linalg.qr(x[left] * root[..., None])
            diagonal = np.abs(np.diagonal(r, axis1=1, axis2=2))
            regular = np.isfinite(diagonal).all(axis=1) & (diagonal > 0).all(axis=1)
            stopped[left[~regular]] = 0
            left, q, r, working = left[regular], q[regular], r[regular], (working * root)[regular]
            if not len(left):
                break
            coef[left] = np.linalg.solve(r, q.swapaxes(1, 2) @ working[..., None])[..., 0]
            eta[left] = (x[left] @ coef[left][..., None])[..., 0] + offset[left]
            mu[left] = np.exp(eta[left])
            now = _deviance(y[left], mu[left])
            ended = (stopped[left] > 0) | ~np.isfinite(now)
            close = ~ended & (np.abs(now - before[left]) / (np.abs(now) + 0.1) < TOLERANCE)
            stopped[left[close]] = turn
            before[left] = now
            left = left[~ended]
            if not len(left):
                break
    return coef, mu, np.where(stopped > 0, stopped, rounds), stopped > 0


def _log_factorials(y: np.ndarray) -> np.ndarray:
    values, at = np.unique(y, return_inverse=True)
    return np.array([math.lgamma(v + 1.0) for v in values])[at].reshape(y.shape)


def fit_stack(x: np.ndarray, y: np.ndarray, n: np.ndarray, spec: ModelSpec, cadjust: bool, alpha: float) -> list[dict]:
    """Coefficients, covariances and fit statistics of one model on each of a stack of series of equal length."""
    # The same memory layout for every stack, so that a series' figures do not depend on the others to the last bit.
    x, y, n = (np.ascontiguousarray(a) for a in (x, y, n))
    series, rows, p = x.shape
    empty = dict.fromkeys(f.name for f in _FIT_FIELDS)
    empty.update(model=spec.name, family=spec.family, terms=list(_term_names(spec)), n_obs=rows, fit_ok=False)
    out = [dict(empty) for _ in range(series)]
    status = np.full(series, "ok", object)
    if rows <= p:
        status[:] = "too few periods"
    else:
        scaled = x / np.abs(x).max(axis=1, keepdims=True).clip(min=1.0)
        status[np.linalg.matrix_rank(scaled) < p] = "terms not separable"
        status[y.sum(axis=1) <= 0] = "no events"
    fitted = np.flatnonzero(status == "ok")
    x, y, n = x[fitted], y[fitted], n[fitted]
    if len(fitted):
        coef, mu, rounds, converged = solve_poisson(x, y, np.log(n))
        status[fitted[~converged]] = "no convergence"
        for i, r in zip(fitted, rounds):
            out[i]["iterations"] = int(r)
        fitted, x, y, n, coef, mu = (a[converged] for a in (fitted, x, y, n, coef, mu))
    for fields, reason in zip(out, status):
        fields["status"] = str(reason)
    if not len(fitted):
        return out

    quasi = spec.family == "quasipoisson"
    df = rows - p
    pearson = np.sum((y - mu) ** 2 / mu, axis=1)
    dispersion = pearson / df
    bread = np.linalg.inv((x * mu[..., None]).swapaxes(1, 2) @ x)
    meat = (x * ((y - mu) ** 2)[..., None]).swapaxes(1, 2) @ x
    vcov = bread * (dispersion if quasi else np.ones(len(x)))[:, None, None]
    robust = bread @ meat @ bread * (rows / (rows - 1) if cadjust else 1.0)
    se, se_robust = (np.sqrt(np.diagonal(v, axis1=1, axis2=2)) for v in (vcov, robust))
    tail = (lambda z: t_p(z, df)) if quasi else normal_p
    crit = t_quantile(1 - alpha / 2, df) if quasi else NormalDist().inv_cdf(1 - alpha / 2)
    log_density = np.sum(y * np.log(mu) - mu - _log_factorials(y), axis=1)
    constant = (y.sum(axis=1) / n.sum(axis=1))[:, None]
    deviance, null_deviance = _deviance(y, mu), _deviance(y, n * constant)
    for k, i in enumerate(fitted):
        out[i].update(
            fit_ok=True,
            coef=coef[k].tolist(),
            se=se[k].tolist(),
            p=[tail(z) for z in (coef[k] / se[k]).tolist()],
            se_robust=se_robust[k].tolist(),
            p_robust=[tail(z) for z in (coef[k] / se_robust[k]).tolist()],
            vcov=vcov[k].tolist(),
            df_residual=df,
            df_null=rows - 1,
            deviance=float(deviance[k]),
            null_deviance=float(null_deviance[k]),
            pearson=float(pearson[k]),
            dispersion=float(dispersion[k]),
            aic=None if quasi else float(-2.0 * log_density[k] + 2 * p),
            crit=crit,
        )
    return out


def fit_its(
    panel: DataFrame,
    models: Sequence[ModelSpec],
    by: Sequence[str] = ("series",),
    chosen: Column | None = None,
    cadjust: bool = True,
    alpha: float = 0.05,
) -> DataFrame:
    """Fit ``numerator ~ offset(log denominator) + time + level + trend (+ seasonal pairs)`` per group.

    One row per group and model. ``chosen`` is an array of model names per row of the panel, for series
    that take different models; without it all are fitted. A series that cannot be fitted gives a row with
    ``fit_ok`` false and a reason. Robust errors are the HC0 sandwich, times n/(n-1) with ``cadjust``.
    """
    models = tuple(models)
    most = max(m.harmonics for m in models)
    terms = design_terms(F.col("t"), F.col("level"), F.col("trend"), most)
    # Only the most seasonal design is sent; the smaller ones are its leading columns, pair by pair.
    names = list(terms)
    columns = {m.name: [names.index(c) for c in _term_names(m)] for m in models}
    by = list(by)
    wanted = chosen if chosen is not None else F.array(*[F.lit(m.name) for m in models])
    used = panel.filter((F.col("denominator") > 0) & F.col("numerator").isNotNull())
    period = F.struct(
        F.col("period").alias("period"),
        F.col("numerator").cast("double").alias("y"),
        F.col("denominator").cast("double").alias("n"),
        F.array(*terms.values()).alias("x"),
        F.array_join(wanted, ",").alias("wanted"),
    )
    gathered = used.groupBy(*by).agg(F.array_sort(F.collect_list(period)).alias("_rows"))
    rows = gathered.select(
        *by,
        F.col("_rows.y").alias("_y"),
        F.col("_rows.n").alias("_n"),
        F.flatten("_rows.x").alias("_x"),
        F.col("_rows")[0]["wanted"].alias("_wanted"),
    )
    fields = [f for f in panel.schema.fields if f.name in by]
    schema = T.StructType([*sorted(fields, key=lambda f: by.index(f.name)), *_FIT_FIELDS])
    types = {f.name: to_arrow_type(f.dataType) for f in _FIT_FIELDS}

    def fit_stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, STACK):
                batch = whole.slice(start, STACK)
                lengths = pc.list_value_length(batch.column("_y")).to_numpy(zero_copy_only=False)
                asked = [w.split(",") for w in batch.column("_wanted").to_pylist()]
                at, results = [], []
                for m in models:
                    takes = np.array([m.name in a for a in asked], bool)
                    for size in np.unique(lengths[takes]):
                        own = np.flatnonzero(takes & (lengths == size))
                        y, n, x = (
                            batch.column(c).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), size, -1)
                            for c in ("_y", "_n", "_x")
                        )
                        results.extend(fit_stack(x[:, :, columns[m.name]], y[..., 0], n[..., 0], m, cadjust, alpha))
                        at.extend(own.tolist())
                keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in by]
                made = [pa.array([r[name] for r in results], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays([*keys, *made], names=[*by, *types])

    return rows.mapInArrow(fit_stacks, schema)


def _term_names(spec: ModelSpec) -> tuple[str, ...]:
    pairs = range(1, spec.harmonics + 1)
    return (*BASE_TERMS, *[f"sin{k}" for k in pairs], *[f"cos{k}" for k in pairs])


def coefficients(
    fit: DataFrame, by: Sequence[str] = ("series",), robust: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """A row per term: estimate, standard error, statistic (z, or t for quasi), p value.

    ``keep`` names further columns of the fit to carry along.
    """
    se, p = ("se_robust", "p_robust") if robust else ("se", "p")
    rows = fit.filter("fit_ok").select(
        *by,
        *keep,
        "model",
        "family",
        "crit",
        F.posexplode(
            F.arrays_zip(
                F.col("terms"),
                F.col("coef").alias("estimate"),
                F.col(se).alias("std_error"),
                F.col(p).alias("p_value"),
            )
        ).alias("term_no", "v"),
    )
    return rows.select(
        *by,
        *keep,
        "model",
        "family",
        "term_no",
        F.col("v.terms").alias("term"),
        F.col("v.estimate").alias("estimate"),
        F.col("v.std_error").alias("std_error"),
        (F.col("v.estimate") / F.col("v.std_error")).alias("statistic"),
        F.col("v.p_value").alias("p_value"),
        "crit",
    )


def irr(
    fit: DataFrame,
    by: Sequence[str] = ("series",),
    robust: bool = False,
    alpha: float = 0.05,
    digits: int | None = None,
) -> DataFrame:
    """Rate ratios exp(b) with the Wald interval exp(b -/+ z se), and the error on the ratio scale.

    ``digits`` rounds the ratios and limits half to even, as they are printed.
    """
    z = F.lit(NormalDist().inv_cdf(1 - alpha / 2))
    b, se = F.col("estimate"), F.col("std_error")
    ratios = {"irr": F.exp(b), "lower": F.exp(b - z * se), "upper": F.exp(b + z * se)}
    if digits is not None:
        ratios = {name: F.bround(c, digits) for name, c in ratios.items()}
    return coefficients(fit, by, robust).select(
        *by,
        "model",
        "term_no",
        "term",
        *[c.alias(name) for name, c in ratios.items()],
        se.alias("std_error"),
        (F.exp(b) * se).alias("irr_std_error"),
        "p_value",
    )


def fit_statistics(fit: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Deviances, degrees of freedom, dispersion and AIC, a row per fit.

    ``reported_dispersion`` is what a Poisson summary states: 1 by definition.
    """
    reported = F.when(F.col("family") == "poisson", F.lit(1.0)).otherwise(F.col("dispersion"))
    return fit.select(
        *by, "model", "family", "fit_ok", "status", "n_obs", "df_residual", "df_null",
        "deviance", "null_deviance", "pearson", "dispersion",
        F.when(F.col("fit_ok"), reported).alias("reported_dispersion"), "aic",
    )


def explained(fit: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """Observations and the pseudo R squared of each fit, from its deviances.

    Cox and Snell: ``1 - exp((deviance - null) / n)``; Nagelkerke divides it by its largest value, ``1 - exp(-null / n)``.
    Null for a fit that failed, and Nagelkerke's where the constant alone fits exactly.
    """
    cox_snell = 1 - F.exp((F.col("deviance") - F.col("null_deviance")) / F.col("n_obs"))
    most = 1 - F.exp(-F.col("null_deviance") / F.col("n_obs"))
    return fit.select(
        *by, "model", "n_obs", cox_snell.alias("r2_cox_snell"), (cox_snell / F.nullif(most, F.lit(0.0))).alias("r2_nagelkerke")
    )
