"""The same results as ``checks.queries`` in plain SQL for DuckDB, written without the library.

The model fits are unrolled: one aggregate for the weighted sums of a round, one step per column of
Gauss-Jordan elimination, one step for the new fitted means.
"""

from __future__ import annotations

from itertools import product

ROUNDS = 9
# 0.975 quantiles of the normal and, by degrees of freedom, of the t distribution.
Z975 = 1.959963984540054


def num(expr: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({expr}) < {0.5 * 10.0**-digits:.10f} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE, {digits}) END"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def level(t: str) -> str:
    return f"CASE WHEN {t} BETWEEN 1 AND 104 THEN 0 WHEN {t} BETWEEN 105 AND 207 THEN 1 END"


def trend(t: str) -> str:
    return f"CASE WHEN {t} BETWEEN 1 AND 104 THEN 0 WHEN {t} BETWEEN 105 AND 207 THEN {t} - 104 END"


def select(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items()) + "\n" + body


# ---------------------------------------------------------------- shared tables

KEYED = """
SELECT *, CASE WHEN r <= 105 THEN 106 - r ELSE r - 105 END AS weeks_rel,
       CASE WHEN r <= 105 THEN 'UNEXPOSED' ELSE 'EXPOSED' END AS cohort_id,
       'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS full_id
FROM (SELECT *, CAST(floor(date_diff('day', DATE '1995-01-01', o_orderdate::DATE) / 7.0) AS INTEGER) + 1 AS r FROM orders)
WHERE r <= 209
"""

RECORDS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, r - 1 AS t
FROM keyed WHERE weeks_rel > 0 AND r > 1 AND r < 209
"""

BIRTHS = """
SELECT full_id, weeks_rel, cohort_id, r - 1 AS time_weeks,
  CASE WHEN o_totalprice < 10000 THEN 2 ELSE 1 END AS number_births,
  CASE WHEN o_totalprice >= 10000 AND o_totalprice < 15000 THEN 2 ELSE 1 END AS pregnancy_outcome,
  CASE WHEN o_totalprice >= 485000 AND o_totalprice < 490000 THEN 0
       WHEN o_totalprice >= 490000 AND o_totalprice < 495000 THEN 9 ELSE o_orderkey % 2 + 1 END AS sex,
  CASE WHEN o_totalprice >= 495000 THEN 4 ELSE 3 END AS discharge_condition,
  CAST(floor(o_totalprice) AS INTEGER) AS birthweight,
  CASE WHEN o_totalprice >= 15000 AND o_totalprice < 20000 THEN 9 WHEN o_totalprice >= 20000 AND o_totalprice < 25000 THEN 3
       WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 4 END AS feed_on_discharge,
  CASE WHEN o_totalprice >= 25000 AND o_totalprice < 30000 THEN 99 WHEN o_totalprice >= 30000 AND o_totalprice < 35000 THEN 16
       WHEN o_totalprice >= 35000 AND o_totalprice < 36000 THEN 15 ELSE o_custkey % 4 END AS total_previous_pregnancies,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 9 WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 2 ELSE 0 END AS book_smoking_history,
  CASE WHEN o_totalprice >= 36000 AND o_totalprice < 40000 THEN 9 WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS smoking_during_pregnancy,
  'band ' || CAST(floor(o_totalprice / 100000) AS INTEGER) AS mother_age,
  o_custkey % 5 + 1 AS simd_quintile
FROM keyed WHERE weeks_rel > 0 AND r > 1 AND r < 209
"""

CLEAN = """
SELECT right(full_id, 6) AS mother_id, weeks_rel, cohort_id, time_weeks, mother_age, simd_quintile, birthweight,
  CASE WHEN sex NOT IN (9, 0) THEN sex END AS sex,
  CASE WHEN feed_on_discharge NOT IN (9, 3) THEN feed_on_discharge END AS feed_on_discharge,
  CASE WHEN total_previous_pregnancies <= 15 THEN total_previous_pregnancies END AS total_previous_pregnancies,
  nullif(book_smoking_history, 9) AS book_smoking_history,
  nullif(smoking_during_pregnancy, 9) AS smoking_during_pregnancy
FROM (SELECT DISTINCT * FROM births WHERE number_births = 1 AND pregnancy_outcome = 1 AND discharge_condition = 3)
QUALIFY count(*) OVER (PARTITION BY full_id, weeks_rel, cohort_id) = 1
"""

COHORT = f"""
SELECT *, {level('time_weeks')} AS level, {trend('time_weeks')} AS trend_weeks FROM clean
WHERE feed_on_discharge IS NOT NULL AND total_previous_pregnancies IS NOT NULL AND book_smoking_history IS NOT NULL
  AND smoking_during_pregnancy IS NOT NULL AND sex IS NOT NULL AND mother_age IS NOT NULL AND simd_quintile IS NOT NULL
"""

ALL = {"records": "SELECT o_orderkey, o_orderstatus, o_totalprice, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders"}
STUDY = {"keyed": KEYED, "records": RECORDS}
CLEANED = {"keyed": KEYED, "births": BIRTHS, "clean": CLEAN}
COHORTED = {**CLEANED, "cohort": COHORT}

UNIQUE = "QUALIFY count(*) OVER (PARTITION BY mother_id, weeks_rel, cohort_id) = 1"


def _episodes(status: str) -> str:
    lag = "date_diff('day', o_orderdate::DATE, l_shipdate::DATE)"
    return f"""
SELECT right(full_id, 6) AS mother_id, weeks_rel, cohort_id,
  count(*) FILTER (WHERE {lag} >= 0 AND {lag} < 182) AS w26, count(*) FILTER (WHERE {lag} >= 0 AND {lag} < 364) AS w52
FROM lineitem JOIN keyed ON l_orderkey = o_orderkey WHERE l_linestatus = '{status}'
GROUP BY o_orderkey, full_id, weeks_rel, cohort_id"""


def _visit(number: int) -> str:
    return f"""
SELECT right(full_id, 6) AS mother_id, weeks_rel, cohort_id,
  CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'A' THEN 'N' ELSE 'Unknown/Invalid' END AS pc,
  CASE WHEN l_discount > 0 THEN CASE l_linestatus WHEN 'F' THEN 'Y' ELSE 'N' END END AS sh,
  CASE WHEN l_quantity <= 15 THEN 'Breast' WHEN l_quantity <= 35 THEN 'Formula' WHEN l_quantity <= 45 THEN 'Mixed'
       ELSE 'Unknown/Invalid' END AS feed,
  CASE l_returnflag WHEN 'R' THEN 'Y' WHEN 'A' THEN 'N' END AS pr,
  CASE l_linestatus WHEN 'F' THEN 'Y' ELSE 'N' END AS su,
  CASE WHEN l_discount > 0.05::DOUBLE THEN 'Y' WHEN l_discount > 0 THEN 'N' END AS si
FROM lineitem JOIN keyed ON l_orderkey = o_orderkey WHERE l_linenumber % 2 = {number % 2}"""


SOURCES = {
    "child_raw": _episodes("F"),
    "mother_raw": _episodes("O"),
    "fv_raw": "SELECT mother_id, weeks_rel, cohort_id, pc, sh, feed FROM (" + _visit(1) + ")",
    "six_raw": _visit(2),
    **{n: f"SELECT * FROM (SELECT DISTINCT * FROM {n}_raw) {UNIQUE}" for n in ("child", "mother", "fv", "six")},
}

LINKED = """
SELECT c.*,
  coalesce(a.w26, 0) AS episodes_26w_child, coalesce(a.w52, 0) AS episodes_52w_child,
  coalesce(b.w26, 0) AS episodes_26w_mother, coalesce(b.w52, 0) AS episodes_52w_mother,
  nullif(f.pc, 'Unknown/Invalid') AS smoke_pc_fv, nullif(f.sh, 'Unknown/Invalid') AS smoke_sh_fv, nullif(f.feed, 'Unknown/Invalid') AS feed_fv,
  nullif(s.pc, 'Unknown/Invalid') AS smoke_pc_68, nullif(s.sh, 'Unknown/Invalid') AS smoke_sh_68, nullif(s.feed, 'Unknown/Invalid') AS feed_68,
  CASE WHEN s.mother_id IS NULL OR (coalesce(s.pr, 'N') = 'N' AND s.su = 'N' AND coalesce(s.si, 'N') = 'N') THEN NULL
       WHEN s.su = 'Y' AND coalesce(s.pr, 'N') = 'N' AND coalesce(s.si, 'N') = 'N' THEN 1 ELSE 0 END AS sleep_bin_su,
  a.mother_id IS NOT NULL AS has_child, b.mother_id IS NOT NULL AS has_mother, f.mother_id IS NOT NULL AS has_fv, s.mother_id IS NOT NULL AS has_six
FROM cohort c
LEFT JOIN child a USING (mother_id, weeks_rel, cohort_id)
LEFT JOIN mother b USING (mother_id, weeks_rel, cohort_id)
LEFT JOIN fv f USING (mother_id, weeks_rel, cohort_id)
LEFT JOIN six s USING (mother_id, weeks_rel, cohort_id)
"""

FULL = {**COHORTED, **SOURCES, "linked": LINKED}

# ---------------------------------------------------------------- panels

# series, 0/1 or count expression (null when unknown), further condition, person-time factor, scale, first period left out
STUDY_SERIES = (
    ("filled", "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END", "priority IS NOT NULL", 1, 100, 0),
    ("urgent", "CASE WHEN priority = '1-URGENT' THEN 1 WHEN priority IS NOT NULL THEN 0 END", "true", 1, 100, 0),
    ("open_truncated", "CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END", "true", 1, 100, 25),
    ("units_26w", "trunc(o_totalprice / 100000)", "true", 26, 1000, 0),
)


def _yes(column: str, yes: str = "Y") -> str:
    return f"CASE WHEN {column} = '{yes}' THEN 1 WHEN {column} IS NOT NULL THEN 0 END"


LINKED_SERIES = (
    ("child_admissions_26w", "episodes_26w_child", "true", 26, 1000, 0),
    ("child_admissions_52w", "episodes_52w_child", "true", 52, 1000, 0),
    ("mother_admissions_26w", "episodes_26w_mother", "true", 26, 1000, 0),
    ("mother_admissions_52w", "episodes_52w_mother", "true", 52, 1000, 0),
    ("carer_smokes_fv", _yes("smoke_pc_fv"), "true", 1, 100, 0),
    ("carer_smokes_68", _yes("smoke_pc_68"), "true", 1, 100, 25),
    ("second_hand_smoke_fv", _yes("smoke_sh_fv"), "true", 1, 100, 0),
    ("second_hand_smoke_68", _yes("smoke_sh_68"), "true", 1, 100, 0),
    ("second_hand_smoke_68_truncated", _yes("smoke_sh_68"), "true", 1, 100, 25),
    ("smoker_at_booking", "CASE WHEN book_smoking_history = 1 THEN 1 ELSE 0 END", "true", 1, 100, 0),
    ("smoked_in_pregnancy", "smoking_during_pregnancy", "true", 1, 100, 0),
    ("breastfed_fv", _yes("feed_fv", "Breast"), "true", 1, 100, 0),
    ("breastfed_68", _yes("feed_68", "Breast"), "true", 1, 100, 0),
    ("supine_sleep_68", "sleep_bin_su", "true", 1, 100, 0),
)

LADDER = {
    "child_admissions_26w": ("poisson quasi quasi_harmonic", "quasi_harmonic"),
    "child_admissions_52w": ("poisson quasi", "quasi"),
    "mother_admissions_26w": ("poisson quasi", "quasi"),
    "mother_admissions_52w": ("poisson quasi", "quasi"),
    "carer_smokes_fv": ("poisson quasi quasi_harmonic", "quasi_harmonic"),
    "carer_smokes_68": ("poisson quasi", "quasi"),
    "second_hand_smoke_fv": ("poisson poisson_harmonic", "poisson_harmonic"),
    "second_hand_smoke_68": ("poisson quasi quasi_harmonic", "quasi_harmonic"),
    "second_hand_smoke_68_truncated": ("quasi", "quasi"),
    "smoker_at_booking": ("poisson quasi quasi_harmonic", "quasi_harmonic"),
    "smoked_in_pregnancy": ("poisson quasi quasi_harmonic", "quasi_harmonic"),
    "breastfed_fv": ("poisson poisson_harmonic", "poisson_harmonic"),
    "breastfed_68": ("poisson poisson_harmonic", "poisson_harmonic"),
    "supine_sleep_68": ("poisson", "poisson"),
}


def panel_sql(source: str, period: str, series, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    parts = [
        f"SELECT {keys}'{name}' AS series, {period} AS period, {period} - {start} AS t, {level(period)} AS level,"
        f" {trend(period)} AS trend, count(*) * {horizon} AS denominator, CAST(sum({value}) AS DOUBLE) AS numerator,"
        f" {scale} AS scale FROM {source} WHERE ({value}) IS NOT NULL AND {condition} AND {period} > {start}"
        f" GROUP BY {keys}{period}"
        for name, value, condition, horizon, scale, start in series
    ]
    return "SELECT *, numerator / denominator * scale AS rate FROM (" + "\nUNION ALL\n".join(parts) + ")"


STUDY_PANEL = {**STUDY, "panel": panel_sql("records", "t", STUDY_SERIES)}
LINKED_PANEL = {**FULL, "panel": panel_sql("linked", "time_weeks", LINKED_SERIES)}


def panel_out(where: str = "true", extra: str = "") -> str:
    return (
        f"SELECT series, {big('period')} AS period, {big('t')} AS t, {big('level')} AS level, {big('trend')} AS trend,"
        f" {big('denominator')} AS denominator, {num('numerator')} AS numerator, {num('rate')} AS rate,"
        f" {big('scale')} AS scale{extra} FROM panel WHERE {where}"
    )


# ---------------------------------------------------------------- fits

BASE = ("intercept", "time", "level", "trend")
SEASON = ("sin1", "sin2", "cos1", "cos2")


def _season(t: str) -> dict[str, str]:
    return {f"{f}{k}": f"{f}(2.0 * pi() * {k} * {t} / 52.0)" for f in ("sin", "cos") for k in (1, 2)}


def terms_of(harmonic: bool) -> tuple[str, ...]:
    return BASE + SEASON if harmonic else BASE


def design(t: str = "t", lev: str = "level", tr: str = "trend", harmonic: bool = False) -> list[str]:
    season = _season(t)
    return ["1.0::DOUBLE", f"{t}::DOUBLE", f"{lev}::DOUBLE", f"{tr}::DOUBLE"] + ([season[s] for s in SEASON] if harmonic else [])


def _eliminate(ctes: dict[str, str], name: str, source: str, p: int, width: int) -> str:
    """Gauss-Jordan on columns m{i}_{j}; every step clears one column in all rows and leaves it out."""
    for k in range(p):
        cols = [
            f"m{i}_{j} / m{k}_{k} AS m{i}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}"
            for i, j in product(range(p), range(k + 1, width))
        ]
        ctes[f"{name}_e{k}"] = f"SELECT series, {', '.join(cols)} FROM {source}"
        source = f"{name}_e{k}"
    return source


def fit_ctes(tag: str, harmonic: bool) -> dict[str, str]:
    """CTEs ending in <tag>_mu (fitted rows) and <tag>_fit (a row per series: b, bread v, robust h, statistics)."""
    x = design(harmonic=harmonic)
    p = len(x)
    ctes = {
        f"{tag}_x": "SELECT series, period, numerator AS y, denominator::DOUBLE AS n, ln(denominator) AS o, "
        + ", ".join(f"{e} AS x{i}" for i, e in enumerate(x))
        + " FROM panel WHERE denominator > 0"
    }
    ctes[f"{tag}_mu0"] = f"SELECT *, y + 0.1 AS mu, ln(y + 0.1) AS eta FROM {tag}_x"
    for step in range(ROUNDS):
        working = "(eta - o + (y - mu) / mu)"
        cells = [
            f"sum(mu * x{i} * " + (f"x{j}" if j < p else working) + f") AS m{i}_{j}"
            for i, j in product(range(p), range(p + 1))
        ]
        ctes[f"{tag}_s{step}"] = f"SELECT series, {', '.join(cells)} FROM {tag}_mu{step} GROUP BY series"
        solved = _eliminate(ctes, f"{tag}_s{step}", f"{tag}_s{step}", p, p + 1)
        eta = " + ".join(f"x{i} * m{i}_{p}" for i in range(p)) + " + o"
        ctes[f"{tag}_mu{step + 1}"] = (
            f"SELECT d.*, exp({eta}) AS mu, {eta} AS eta FROM {tag}_x d JOIN {solved} USING (series)"
        )
    rows = f"{tag}_mu{ROUNDS}"
    cells = [f"sum(mu * x{i} * x{j}) AS m{i}_{j}" for i, j in product(range(p), range(p))]
    identity = [f"{1.0 if i == j else 0.0}::DOUBLE AS m{i}_{p + j}" for i, j in product(range(p), range(p))]
    ctes[f"{tag}_i"] = f"SELECT series, {', '.join(cells + identity)} FROM {rows} GROUP BY series"
    inverse = _eliminate(ctes, f"{tag}_i", f"{tag}_i", p, 2 * p)
    meat = [f"sum((y - mu) * (y - mu) * x{i} * x{j}) AS w{i}_{j}" for i, j in product(range(p), range(p))]
    dev = "CASE WHEN y > 0 THEN y * ln(y / {m}) ELSE 0 END - (y - {m})"
    ctes[f"{tag}_null"] = f"SELECT series, sum(y) / sum(n) AS rate0 FROM {tag}_x GROUP BY series"
    ctes[f"{tag}_stat"] = (
        f"SELECT series, count(*) AS n_obs, count(*) - {p} AS df, sum((y - mu) * (y - mu) / mu) AS pearson,"
        f" 2 * sum({dev.format(m='mu')}) AS deviance, 2 * sum({dev.format(m='(n * rate0)')}) AS null_deviance,"
        f" -2 * sum(y * ln(mu) - mu - lgamma(y + 1)) + 2 * {p} AS aic, {', '.join(meat)}"
        f" FROM {rows} JOIN {tag}_null USING (series) GROUP BY series"
    )
    v = [f"m{i}_{p + j} AS v{i}_{j}" for i, j in product(range(p), range(p))]
    h = []
    for i in range(p):
        inner = " + ".join(f"m{i}_{p + a} * w{a}_{b} * m{b}_{p + i}" for a, b in product(range(p), range(p)))
        h.append(f"{inner} AS h{i}")
    b = [f"m{i}_{p} AS b{i}" for i in range(p)]
    ctes[f"{tag}_inv"] = f"SELECT series, {', '.join(v)}, {', '.join(h)}, t.* EXCLUDE (series) FROM {inverse} JOIN {tag}_stat t USING (series)"
    ctes[f"{tag}_fit"] = (
        f"SELECT q.*, c.* EXCLUDE (series), pearson / df AS dispersion FROM {tag}_inv q JOIN"
        f" (SELECT series, {', '.join(b)} FROM {tag}_s{ROUNDS - 1}_e{p - 1}) c USING (series)"
    )
    return ctes


# Two-sided p values by Simpson's rule on the density, in 4000 steps from 0 to the statistic.
SIMPSON = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def with_p(rows: str, quasi: bool) -> str:
    """Add p_value to rows with ``statistic`` and ``df``."""
    u = "(least(abs(statistic), 40.0) * i / 4000.0)"
    density = (
        f"exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * pow(1 + {u} * {u} / df, -(df + 1) / 2.0)"
        if quasi
        else f"exp(-{u} * {u} / 2) / sqrt(2 * pi())"
    )
    return (
        f"SELECT *, greatest(0, 1 - 2 * (SELECT sum({SIMPSON} * {density}) * least(abs(statistic), 40.0) / 12000.0"
        f" FROM range(0, 4001) g(i))) AS p_value FROM ({rows})"
    )


def coefficient_rows(tag: str, model: str, harmonic: bool, robust: str = "") -> str:
    """A row per series and term; ``robust`` is a factor on the robust variance."""
    quasi = model.startswith("quasi")
    parts = []
    for i, term in enumerate(terms_of(harmonic)):
        se = f"sqrt(h{i} * {robust})" if robust else f"sqrt(v{i}_{i}{' * dispersion' if quasi else ''})"
        parts.append(
            f"SELECT series, '{model}' AS model, '{term}' AS term, b{i} AS estimate, {se} AS std_error,"
            f" b{i} / {se} AS statistic, df FROM {tag}_fit"
        )
    return " UNION ALL ".join(parts)


def coefficients(panel: dict, *models: str) -> str:
    ctes = dict(panel)
    parts = []
    for m in models:
        harmonic = m.endswith("harmonic")
        tag = "h" if harmonic else "l"
        if f"{tag}_fit" not in ctes:
            ctes.update(fit_ctes(tag, harmonic))
        parts.append(with_p(coefficient_rows(tag, m, harmonic), m.startswith("quasi")))
    columns = ", ".join(f"{num(c)} AS {c}" for c in ("estimate", "std_error", "statistic", "p_value"))
    return select(ctes, f"SELECT series, model, term, {columns} FROM (" + " UNION ALL ".join(f"({q})" for q in parts) + ")")


def fitted_ctes(*harmonics: bool) -> dict[str, str]:
    ctes = dict(STUDY_PANEL)
    for h in harmonics:
        ctes.update(fit_ctes("h" if h else "l", h))
    return ctes


def its_irr() -> str:
    parts = [coefficient_rows("l", m, False) for m in ("poisson", "quasi")]
    return select(
        fitted_ctes(False),
        f"SELECT series, model, term, {num('exp(estimate)')} AS irr, {num(f'exp(estimate - {Z975} * std_error)')} AS lower,"
        f" {num(f'exp(estimate + {Z975} * std_error)')} AS upper FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_irr_rounded() -> str:
    parts = [coefficient_rows("h" if m.endswith("harmonic") else "l", m, m.endswith("harmonic")) for m in ("quasi", "quasi_harmonic")]
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, term, round_even(exp(estimate), 4) AS irr, round_even(exp(estimate - {Z975} * std_error), 4) AS lower,"
        f" round_even(exp(estimate + {Z975} * std_error), 4) AS upper FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_robust() -> str:
    parts = []
    for (m, harmonic), adjusted in product((("poisson", False), ("poisson_harmonic", True)), (1, 0)):
        factor = "n_obs / (n_obs - 1.0)" if adjusted else "1.0"
        rows = coefficient_rows("h" if harmonic else "l", m, harmonic, factor)
        parts.append(f"SELECT *, {adjusted} AS cadjust FROM ({with_p(rows, False)})")
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, {big('cadjust')} AS cadjust, term, {num('exp(estimate)')} AS irr,"
        f" {num(f'exp(estimate - {Z975} * std_error)')} AS lower, {num(f'exp(estimate + {Z975} * std_error)')} AS upper,"
        f" {num('std_error')} AS std_error, {num('exp(estimate) * std_error')} AS irr_std_error, {num('p_value')} AS p_value"
        " FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_dispersion() -> str:
    parts = [
        f"SELECT series, '{m}' AS model, df, pearson, dispersion, {reported} AS reported FROM {tag}_fit"
        for m, tag, reported in (("poisson", "l", "1.0"), ("quasi", "l", "dispersion"), ("quasi_harmonic", "h", "dispersion"))
    ]
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, {big('df')} AS df_residual, {num('pearson')} AS pearson, {num('dispersion')} AS dispersion,"
        f" {num('reported')} AS reported_dispersion FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_summary() -> str:
    parts = []
    for m, tag in (("poisson", "l"), ("quasi", "l"), ("poisson_harmonic", "h"), ("quasi_harmonic", "h")):
        quasi = m.startswith("quasi")
        parts.append(
            f"SELECT series, '{m}' AS model, '{'quasipoisson' if quasi else 'poisson'}' AS family, 1 AS fit_ok, n_obs, df,"
            f" deviance, null_deviance, pearson, dispersion, {'dispersion' if quasi else '1.0'} AS reported,"
            f" {'NULL::DOUBLE' if quasi else 'aic'} AS aic FROM {tag}_fit"
        )
    stats = ", ".join(f"{num(c)} AS {c}" for c in ("deviance", "null_deviance", "pearson", "dispersion", "aic"))
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, family, {big('fit_ok')} AS fit_ok, {big('n_obs')} AS n_obs, {big('df')} AS df_residual,"
        f" {big('n_obs - 1')} AS df_null, {stats}, {num('reported')} AS reported_dispersion FROM ("
        + " UNION ALL ".join(parts) + ")",
    )


def its_explained() -> str:
    parts = [
        f"SELECT series, '{m}' AS model, n_obs, 1 - exp((deviance - null_deviance) / n_obs) AS cs, 1 - exp(-null_deviance / n_obs) AS most FROM {tag}_fit"
        for m, tag in (("poisson", "l"), ("quasi", "l"), ("poisson_harmonic", "h"), ("quasi_harmonic", "h"))
    ]
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, {big('n_obs')} AS n_obs, {num('cs')} AS r2_cox_snell, {num('cs / nullif(most, 0)')} AS r2_nagelkerke"
        " FROM (" + " UNION ALL ".join(parts) + ")",
    )


def residual_rows(tag: str, model: str) -> str:
    gap = "greatest(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu), 0)"
    return (
        f"SELECT r.series, '{model}' AS model, r.period, p.t, y, mu, sign(y - mu) * sqrt(2 * {gap}) AS residual"
        f" FROM {tag}_mu{ROUNDS} r JOIN panel p USING (series, period)"
    )


def its_residuals() -> str:
    parts = [residual_rows("l", "poisson"), residual_rows("h", "poisson_harmonic")]
    return select(
        fitted_ctes(False, True),
        f"SELECT series, model, {big('period')} AS period, {big('t')} AS t, {num('y')} AS numerator, {num('mu')} AS fitted,"
        f" {num('residual')} AS residual FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_residual_summary() -> str:
    ctes = fitted_ctes(False, True)
    ctes["res"] = residual_rows("l", "poisson") + " UNION ALL " + residual_rows("h", "poisson_harmonic")
    return select(ctes, f"SELECT series, model, 'residual' AS variable, {six('residual')} FROM res GROUP BY series, model")


def _acf_ctes() -> dict[str, str]:
    ctes = fitted_ctes(False)
    ctes["res"] = residual_rows("l", "poisson")
    ctes["centred"] = (
        "SELECT series, row_number() OVER (PARTITION BY series ORDER BY period) AS i, count(*) OVER (PARTITION BY series) AS n,"
        " residual - avg(residual) OVER (PARTITION BY series) AS d FROM res"
    )
    ctes["lagsum"] = (
        "SELECT a.series, a.n, k.lag, sum(a.d * b.d) AS s FROM centred a CROSS JOIN range(0, 30) k(lag)"
        " JOIN centred b ON b.series = a.series AND b.i = a.i + k.lag"
        " WHERE k.lag <= floor(10 * log10(a.n)) GROUP BY a.series, a.n, k.lag"
    )
    ctes["cor"] = "SELECT s.series, s.n, s.lag, s.s / z.s AS r FROM lagsum s JOIN lagsum z ON z.series = s.series AND z.lag = 0"
    return ctes


def resid_acf() -> str:
    return select(
        _acf_ctes(),
        f"SELECT series, 'poisson' AS model, {big('n')} AS n, {big('lag')} AS lag, {num('r')} AS acf,"
        f" {num('1.96 / sqrt(n)')} AS band FROM cor",
    )


def resid_pacf() -> str:
    """Order by order: each step solves the next order from the one before, as lists."""
    ctes = _acf_ctes()
    ctes["lists"] = "SELECT series, n, list(r ORDER BY lag) AS r FROM cor GROUP BY series, n"
    sql = select(ctes, "")
    last = (
        "((r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) / (1 - list_dot_product(phi, r[2:k + 1])))"
    )
    steps = f""", steps AS (
  WITH RECURSIVE walk AS (
    SELECT series, n, r, 1 AS k, [r[2]] AS phi, r[2] AS pacf FROM lists
    UNION ALL
    SELECT series, n, r, k + 1,
      list_append(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), last), last
    FROM (SELECT *, {last} AS last FROM walk WHERE k + 2 <= len(r))
  ) SELECT * FROM walk)
SELECT series, 'poisson' AS model, {big('n')} AS n, {big('k')} AS lag, {num('pacf')} AS pacf, {num('1.96 / sqrt(n)')} AS band FROM steps"""
    return sql.rstrip() + steps


GRID = (
    "SELECT series, scale, mean_denominator, p AS period, p - start AS t, {lev} AS level, {tr} AS trend"
    " FROM (SELECT series, any_value(scale) AS scale, avg(denominator) AS mean_denominator, min(period - t) AS start"
    " FROM panel GROUP BY series) CROSS JOIN range(1, 208) g(p) WHERE p > start"
)
FACTUAL_GRID = GRID.format(lev=level("p"), tr=trend("p"))
COUNTER_GRID = GRID.format(lev="0", tr="0")


def design_grid() -> str:
    ctes = {**STUDY_PANEL, "f": FACTUAL_GRID, "c": COUNTER_GRID}
    parts = [
        f"SELECT series, '{name}' AS scenario, {big('period')} AS period, {big('t')} AS t, {big('level')} AS level,"
        f" {big('trend')} AS trend, {num('mean_denominator')} AS mean_denominator, {big('scale')} AS scale FROM {cte}"
        for name, cte in (("factual", "f"), ("counterfactual", "c"))
    ]
    return select(ctes, " UNION ALL ".join(parts))


def _eta(harmonic: bool, lev: str = "level", tr: str = "trend") -> str:
    return "(" + " + ".join(f"b{i} * {e}" for i, e in enumerate(design("t", lev, tr, harmonic))) + ")"


def _variance(harmonic: bool) -> str:
    x = design(harmonic=harmonic)
    return "(" + " + ".join(f"v{i}_{j} * {x[i]} * {x[j]}" for i, j in product(range(len(x)), range(len(x)))) + ")"


def predictions(scenario: str) -> str:
    ctes = fitted_ctes(False, True)
    ctes["grid"] = FACTUAL_GRID if scenario == "factual" else COUNTER_GRID
    parts = [
        f"SELECT series, '{m}' AS model, '{scenario}' AS scenario, {big('period')} AS period, {big('t')} AS t, {big('level')} AS level,"
        f" {big('trend')} AS trend, {num(f'exp({_eta(h)}) * scale')} AS rate_fit FROM grid JOIN {tag}_fit USING (series)"
        for m, tag, h in (("poisson", "l", False), ("poisson_harmonic", "h", True))
    ]
    return select(ctes, " UNION ALL ".join(parts))


# Quantile of t by Newton steps on the Simpson integral, starting from the normal quantile.
def _t_quantiles(fit: str) -> str:
    sql = f"SELECT DISTINCT df, {Z975}::DOUBLE AS q FROM {fit}"
    for _ in range(6):
        u = "(q * i / 4000.0)"
        const = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi())"
        area = f"(SELECT sum({SIMPSON} * {const} * pow(1 + {u} * {u} / df, -(df + 1) / 2.0)) * q / 12000.0 FROM range(0, 4001) g(i))"
        sql = f"SELECT df, q - ({area} - 0.475) / ({const} * pow(1 + q * q / df, -(df + 1) / 2.0)) AS q FROM ({sql})"
    return sql


def band_ctes(*models: str) -> dict[str, str]:
    ctes = fitted_ctes(*[m.endswith("harmonic") for m in models])
    ctes["grid"] = FACTUAL_GRID
    if "quasi" in models:
        ctes["tq"] = _t_quantiles("l_fit")
    ctes["band"] = " UNION ALL ".join(
        f"SELECT series, '{m}' AS model, period, t, level, trend, scale, {_eta(h)} AS eta,"
        f" {q} * sqrt({_variance(h)}{' * dispersion' if m == 'quasi' else ''}) AS half FROM grid JOIN {tag}_fit USING (series){j}"
        for m, tag, h, q, j in (
            ("quasi", "l", False, "q", " JOIN tq USING (df)"),
            ("poisson_harmonic", "h", True, str(Z975), ""),
        )
        if m in models
    )
    return ctes


def its_ci_band() -> str:
    return select(
        band_ctes("quasi", "poisson_harmonic"),
        f"SELECT series, model, {big('period')} AS period, {big('t')} AS t, {big('level')} AS level, {big('trend')} AS trend,"
        f" {num('exp(eta) * scale')} AS pred, {num('exp(eta - half) * scale')} AS lcb, {num('exp(eta + half) * scale')} AS ucb FROM band",
    )


def segment_bands() -> str:
    parts = []
    for prefix, condition in (("first", "trend = 0"), ("second", "trend > 0")):
        for name, e in (("seg", "eta"), ("lcb", "eta - half"), ("ucb", "eta + half")):
            parts.append(f"CASE WHEN {condition} THEN {num(f'exp({e}) * b.scale')} END AS {prefix}_{name}")
    return select(
        band_ctes("poisson_harmonic"),
        f"SELECT series, b.model, {big('b.period')} AS period, {big('b.t')} AS t, {big('b.level')} AS level, {big('b.trend')} AS trend,"
        f" {', '.join(parts).replace('trend =', 'b.trend =').replace('trend >', 'b.trend >')}, {num('p.rate')} AS rate,"
        f" {day('DATE ' + repr('1995-01-08') + ' + CAST(7 * (b.period - 1) AS INTEGER)')} AS week_start"
        " FROM band b LEFT JOIN panel p USING (series, period) WHERE b.model = 'poisson_harmonic'",
    )


def its_effects() -> str:
    ctes = dict(LINKED_PANEL)
    ctes.update(fit_ctes("l", False))
    ctes.update(fit_ctes("h", True))
    ctes["grid"] = FACTUAL_GRID
    parts = []
    for series, (_, m) in LADDER.items():
        h = m.endswith("harmonic")
        parts.append(
            f"SELECT series, '{m}' AS model, period, exp({_eta(h)}) * scale AS factual, exp({_eta(h, '0.0', '0.0')}) * scale AS counterfactual"
            f" FROM grid JOIN {'h' if h else 'l'}_fit USING (series) WHERE series = '{series}' AND period IN (109, 129)"
        )
    return select(
        ctes,
        f"SELECT series, model, {big('period')} AS period, {num('factual')} AS factual, {num('counterfactual')} AS counterfactual,"
        f" {big('period - 104')} AS post_week, {num('factual - counterfactual')} AS effect FROM (" + " UNION ALL ".join(parts) + ")",
    )


def its_effects_by() -> str:
    """The stratum is made part of the series' name for the fit, and taken off again, so that null is one too."""
    series = [(f"{n}", *rest) for n, *rest in STUDY_SERIES[2:]]
    ctes = {
        **STUDY,
        "seg": "SELECT records.*, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE '' END AS s FROM records LEFT JOIN customer ON c_custkey = o_custkey",
        "parts": panel_sql("seg", "t", series, "s"),
        "panel": "SELECT * EXCLUDE (s, series), s || '|' || series AS series FROM parts",
    }
    ctes.update(fit_ctes("l", False))
    ctes["grid"] = FACTUAL_GRID
    body = (
        f"SELECT series, period, exp({_eta(False)}) * scale AS factual, exp({_eta(False, '0.0', '0.0')}) * scale AS counterfactual"
        " FROM grid JOIN l_fit USING (series) WHERE period IN (109, 129)"
    )
    return select(
        ctes,
        "SELECT nullif(split_part(series, '|', 1), '') AS c_mktsegment, split_part(series, '|', 2) AS series, 'poisson' AS model,"
        f" {big('period')} AS period, {num('factual')} AS factual, {num('counterfactual')} AS counterfactual,"
        f" {big('period - 104')} AS post_week, {num('factual - counterfactual')} AS effect FROM ({body})",
    )


def its_ladder() -> str:
    ctes = dict(LINKED_PANEL)
    ctes.update(fit_ctes("l", False))
    ctes.update(fit_ctes("h", True))
    parts = []
    for m in ("poisson", "quasi", "poisson_harmonic", "quasi_harmonic"):
        h = m.endswith("harmonic")
        takes = ", ".join(f"'{s}'" for s, (models, _) in LADDER.items() if m in models.split())
        first = ", ".join(f"'{s}'" for s, (_, primary) in LADDER.items() if m == primary)
        parts.append(
            f"SELECT *, CASE WHEN series IN ({first}) THEN 1 ELSE 0 END AS is_primary FROM"
            f" ({coefficient_rows('h' if h else 'l', m, h)}) WHERE series IN ({takes})"
        )
    return select(
        ctes,
        f"SELECT series, model, term, {num('estimate')} AS estimate, {num('std_error')} AS std_error, {big('is_primary')} AS is_primary"
        " FROM (" + " UNION ALL ".join(parts) + ")",
    )


# ---------------------------------------------------------------- records

COHORT_COLUMNS = (
    "mother_id", "weeks_rel", "cohort_id", "feed_on_discharge", "total_previous_pregnancies", "book_smoking_history",
    "smoking_during_pregnancy", "mother_age", "simd_quintile", "time_weeks", "sex",
)
TEXT = {"mother_id", "cohort_id", "mother_age", "smoke_pc_fv", "smoke_sh_fv", "feed_fv", "smoke_pc_68", "smoke_sh_68", "feed_68"}
PROFILED = (
    "feed_on_discharge", "total_previous_pregnancies", "smoking_during_pregnancy", "book_smoking_history", "simd_quintile",
)


def listed(columns) -> str:
    return ", ".join(c if c in TEXT else f"{big(c)} AS {c}" for c in columns)


def null_counts() -> str:
    parts = [f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM clean" for c in COHORT_COLUMNS]
    return select(CLEANED, " UNION ALL ".join(parts))


def attrition() -> str:
    ok = ("number_births = 1", "pregnancy_outcome = 1", "discharge_condition = 3")
    names = ("all records", "single birth", "live birth", "alive at discharge")
    parts = []
    for i, name in enumerate(names):
        left = " AND ".join(ok[:i]) or "true"
        failing = f"count(*) FILTER (WHERE NOT ({ok[i - 1]}))" if i else "0"
        unknown = f"count(*) FILTER (WHERE ({ok[i - 1]}) IS NULL)" if i else "0"
        parts.append(
            f"SELECT {big(i)} AS step_no, '{name}' AS step, {big(failing)} AS n_failing, {big(unknown)} AS n_unknown, {big(f'count(*) FILTER (WHERE {left})')} AS n_rows,"
            f" {big(f'count(DISTINCT (full_id, weeks_rel, cohort_id)) FILTER (WHERE {left})')} AS n_keys FROM births"
        )
    return select({"keyed": KEYED, "births": BIRTHS}, " UNION ALL ".join(parts))


def freq_table() -> str:
    parts = []
    for c in ("feed_on_discharge", "book_smoking_history", "smoking_during_pregnancy", "mother_age", "simd_quintile", "sex"):
        parts.append(
            f"SELECT '{c}' AS variable, {c}::VARCHAR AS value, count(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY {c}"
            f" UNION ALL SELECT '{c}', NULL, count(*) FILTER (WHERE {c} IS NULL) FROM clean"
        )
    return select(CLEANED, " UNION ALL ".join(parts))


def histogram() -> str:
    return f"""
WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 25 AS w FROM orders),
v AS (SELECT least(25, greatest(1, CAST(ceil((o_totalprice - lo) / w) AS INTEGER))) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT {big('g.bin')} AS bin, {num('lo + (g.bin - 1) * w')} AS lower, {num('lo + g.bin * w')} AS upper, coalesce(v.n, 0) AS n
FROM range(1, 26) g(bin) CROSS JOIN b LEFT JOIN v ON v.bin = g.bin"""


def histogram_round() -> str:
    return f"""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / ceil(log2(count(o_totalprice)) + 1) AS c FROM orders),
p AS (SELECT *, pow(10.0, floor(log10(c))) AS base FROM e),
s AS (SELECT *, base * CASE WHEN c / base <= 1.4 THEN 1.0 WHEN c / base <= 2.8 THEN 2.0 WHEN c / base <= 7 THEN 5.0 ELSE 10.0 END AS w FROM p),
b AS (SELECT w::DOUBLE AS w, floor(lo / w + 1e-7) AS f, (ceil(hi / w - 1e-7) - floor(lo / w + 1e-7))::INT AS k FROM s),
v AS (SELECT least(k, greatest(1, ceil(o_totalprice / w - f - 1e-7)::INT)) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT {big('g.bin')} AS bin, {num('(f + g.bin - 1) * w')} AS lower, {num('(f + g.bin) * w')} AS upper, coalesce(v.n, 0) AS n
FROM b, LATERAL (SELECT unnest(range(1, b.k + 1)) AS bin) g LEFT JOIN v ON v.bin = g.bin"""


def crosstab(x: str, y: str, known: str) -> str:
    n, e = "n::DOUBLE", "(rn::DOUBLE * cn / tn)"
    return f"""
WITH d AS (SELECT {x} AS x, {y} AS y FROM documents LEFT JOIN labels USING (doc_id) WHERE {known}),
xs AS (SELECT x, count(*) AS rn FROM d GROUP BY x), ys AS (SELECT y, count(*) AS cn FROM d GROUP BY y),
c AS (SELECT xs.x, ys.y, rn, cn, (SELECT count(*) FROM d) AS tn,
  (SELECT count(*) FROM d WHERE d.x IS NOT DISTINCT FROM xs.x AND d.y IS NOT DISTINCT FROM ys.y) AS n FROM xs CROSS JOIN ys)
SELECT x, y, n, {num(f'100 * {n} / rn')} AS row_pct, {num(f'100 * {n} / cn')} AS col_pct, {num(f'100 * {n} / tn')} AS total_pct,
  {num(f'({n} - {e}) * ({n} - {e}) / {e}')} AS chisq FROM c"""


def miss_rows(source: str, factor: str, columns, factor_out: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {factor_out} AS {factor}, '{c}' AS variable,"
        f" {num(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)')} AS pct_missing FROM {source} GROUP BY {factor}"
        for c in columns
    )


def miss_patterns() -> str:
    flags = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in PROFILED)
    size = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in PROFILED)
    return select(
        CLEANED,
        f"SELECT concat_ws('&', {flags}) AS pattern, {big(size)} AS n_variables, count(*) AS n FROM clean WHERE {size} > 0"
        " GROUP BY 1, 2 ORDER BY n DESC, pattern LIMIT 50",
    )


def six(value: str, digits: int = 6) -> str:
    q = {"min": f"min({value})", "q1": f"quantile_cont({value}, 0.25)", "median": f"quantile_cont({value}, 0.5)",
         "q3": f"quantile_cont({value}, 0.75)", "mean": f"avg({value})", "max": f"max({value})"}
    return ", ".join(f"{num(e, digits)} AS {k}" for k, e in q.items()) + f", count(*) FILTER (WHERE {value} IS NULL) AS n_missing"


def summary_by_level() -> str:
    parts = []
    for c in ("numerator", "rate"):
        for phase, where in (("all", "true"), ("pre", "level = 0"), ("post", "level = 1")):
            parts.append(
                f"SELECT series, '{c}' AS variable, '{phase}' AS phase, {six(f'{c}::DOUBLE')} FROM panel WHERE {where} GROUP BY series"
            )
    return select(STUDY_PANEL, " UNION ALL ".join(parts))


def summary_of(ctes: dict, source: str, columns, by: str = "", digits: int = 6) -> str:
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    body = " UNION ALL ".join(f"SELECT {keys}'{c}' AS variable, {six(f'{c}::DOUBLE', digits)} FROM {source}{group}" for c in columns)
    return select(ctes, body) if ctes else body


def exclusive_flag() -> str:
    a = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
    b = "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"
    c = "CASE WHEN l_discount > 0.05::DOUBLE THEN 1 WHEN l_discount > 0 THEN 0 END"
    only = "CASE WHEN a + b + c = 0 THEN NULL WHEN b = 0 THEN 0 WHEN c IS NULL THEN NULL WHEN a + b + c = 1 THEN 1 ELSE 0 END"
    ticks = ", ".join(f"{t}::DOUBLE AS tick_{t}" for t in "abc")
    return (
        f"SELECT l_orderkey, {big('l_linenumber')} AS l_linenumber, {ticks}, {big(only)} AS only_b"
        f" FROM (SELECT l_orderkey, l_linenumber, {a} AS a, {b} AS b, {c} AS c FROM lineitem)"
    )


def scan_roundtrip() -> str:
    parts = [
        f"SELECT '{copy}' AS copy, count(*) AS n, count(nullif(o_orderpriority, '4-NOT SPECIFIED')) AS n_priority,"
        f" {num('sum(o_totalprice)', 2)} AS price, {big('9 * count(*)')} AS customer_chars,"
        " lpad(min(o_custkey)::VARCHAR, 9, '0') AS first_customer,"
        f" {day('min(o_orderdate)')} AS first_day, {day('max(o_orderdate)')} AS last_day,"
        f" {big(f'sum(length(o_orderstatus) + {chars})')} AS note_chars,"
        f" max('{blank}say \"' || o_orderstatus || '\", or so,' || chr(10) || '\\') AS last_note FROM orders"
        for copy, blank, chars in (("csv", "", 16), ("csv base", " ", 17), ("stage", " ", 17))
    ]
    return " UNION ALL ".join(parts)


def period_spine() -> str:
    start = day("DATE '1995-01-08' + CAST(7 * (p - 1) AS INTEGER)")
    return select(
        STUDY,
        f"SELECT {big('p')} AS period, {big(level('p'))} AS level, {big(trend('p'))} AS trend_weeks,"
        f" {big('CASE WHEN p > 25 THEN p - 25 END')} AS time_truncated, {start} AS week_start, {start} AS read_back, coalesce(c.n, 0) AS n"
        " FROM range(1, 208) g(p) LEFT JOIN (SELECT t, count(*) AS n FROM records GROUP BY t) c ON c.t = p",
    )


def link_report() -> str:
    parts = []
    for name, table in (("admissions_child", "child"), ("admissions_mother", "mother"), ("first_visit", "fv"), ("six_week_visit", "six")):
        known = f"(mother_id, weeks_rel, cohort_id) IN (SELECT (mother_id, weeks_rel, cohort_id) FROM {table}_raw)"
        for status, where in (
            ("matched", f"has_{table}"), ("conflict", f"NOT has_{table} AND {known}"), ("absent", f"NOT has_{table} AND NOT {known}")
        ):
            parts.append(f"SELECT '{name}' AS source, '{status}' AS status, count(*) FILTER (WHERE {where}) AS n FROM linked")
    return select(FULL, " UNION ALL ".join(parts))


def link_star() -> str:
    columns = (
        *COHORT_COLUMNS, "level", "trend_weeks", "episodes_26w_child", "episodes_52w_child", "episodes_26w_mother",
        "episodes_52w_mother", "smoke_pc_fv", "smoke_sh_fv", "feed_fv", "smoke_sh_68", "smoke_pc_68", "feed_68", "sleep_bin_su",
    )
    return select(FULL, f"SELECT {listed(columns)} FROM linked")


def panel_filled() -> str:
    by_segment = (
        "SELECT records.*, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM records LEFT JOIN customer ON c_custkey = o_custkey"
    )
    ctes = {**STUDY, "seg": by_segment, "panel": panel_sql("seg", "t", STUDY_SERIES[1:3], "c_mktsegment")}
    values = "(SELECT c_mktsegment, series, period, denominator, numerator, rate FROM panel) v"
    return select(
        ctes,
        f"SELECT s.c_mktsegment, s.series, {big('g.p')} AS period, {big('g.p - start')} AS t, {big(level('g.p'))} AS level,"
        f" {big(trend('g.p'))} AS trend, {big('coalesce(denominator, 0)')} AS denominator, {num('coalesce(numerator, 0)')} AS numerator,"
        f" {num('rate')} AS rate FROM (SELECT c_mktsegment, series, min(period - t) AS start FROM panel GROUP BY ALL) s"
        f" CROSS JOIN range(1, 208) g(p) LEFT JOIN {values}"
        " ON v.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment AND v.series = s.series AND v.period = g.p WHERE g.p > start",
    )


def statements() -> dict[str, str]:
    rows = lambda columns: select(STUDY, f"SELECT {columns} FROM records")
    lines = "(SELECT l_orderkey, l_returnflag, l_linestatus FROM lineitem)"
    season = ", ".join(f"{num(e)} AS {n}" for n, e in _season("t").items())
    conflict = f"""
WITH v AS (SELECT *, count(*) AS copies FROM {lines} GROUP BY ALL),
k AS (SELECT l_orderkey, l_returnflag, sum(copies) AS n, count(*) AS versions FROM v GROUP BY 1, 2)
SELECT {big('sum(n)')} AS rows_in, {big('sum(versions)')} AS rows_distinct, {big('sum(n) - sum(versions)')} AS copies_dropped,
  count(*) AS keys, count(*) FILTER (WHERE versions > 1) AS keys_conflicted,
  {big('coalesce(sum(versions) FILTER (WHERE versions > 1), 0)')} AS rows_conflicted,
  {big('sum(versions) - coalesce(sum(versions) FILTER (WHERE versions > 1), 0)')} AS rows_kept FROM k"""
    episodes = ", ".join(f"{big(f'episodes_{w}w_{who}')} AS episodes_{w}w_{who}" for w in (26, 52) for who in ("child", "mother"))
    return {
        "scan_roundtrip": scan_roundtrip(),
        "result_roundtrip": f"SELECT priority, count(*) AS n, {num('avg(o_totalprice)', 2)} AS price,"
        " '\"' || coalesce(priority, '') || '\", x' AS quoted"
        " FROM (SELECT nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority, o_totalprice FROM orders) GROUP BY priority",
        "period_spine": period_spine(),
        "study_time": rows(f"o_orderkey, {big('t')} AS time_weeks"),
        "its_terms": rows(f"o_orderkey, {big(level('t'))} AS level, {big(trend('t'))} AS trend_weeks"),
        "binary_outcome": select(
            ALL,
            "SELECT o_orderkey, CAST(priority = '1-URGENT' AS BIGINT) AS urgent, CAST(o_totalprice > 250000 AS BIGINT) AS large,"
            " CASE WHEN priority = '5-LOW' THEN 'low' WHEN priority <> '5-LOW' THEN 'other' END AS kind,"
            " CAST(priority IS NOT NULL AS BIGINT) AS observed FROM records",
        ),
        "recode_sentinel": "SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,"
        " nullif(nullif(o_orderstatus, 'P'), 'O') AS status FROM orders",
        "recode_predicate": f"SELECT o_orderkey, {num('CASE WHEN o_totalprice <= 400000 THEN o_totalprice END', 2)} AS price FROM orders",
        "key_suffix": "SELECT c_custkey, right(c_name, 6) AS suffix, c_mktsegment AS short_kept FROM customer",
        "exclusive_flag": exclusive_flag(),
        "harmonic_terms": select(STUDY, f"SELECT {big('t')} AS time_weeks, count(*) AS n, {season} FROM records GROUP BY t"),
        "cohort_build": select(COHORTED, f"SELECT {listed((*COHORT_COLUMNS, 'level', 'trend_weeks'))} FROM cohort"),
        "attrition": attrition(),
        "complete_case": select(ALL, "SELECT o_orderkey, priority FROM records WHERE priority IS NOT NULL"),
        "missing_counts": select(
            CLEANED,
            "SELECT count(*) AS n_rows, count(*) FILTER (WHERE " + " OR ".join(f"{c} IS NULL" for c in PROFILED) + ") AS n_incomplete FROM clean",
        ),
        "null_counts": null_counts(),
        "freq_table": freq_table(),
        "freq_table_known": select(
            ALL,
            " UNION ALL ".join(
                f"SELECT '{c}' AS variable, {c} AS value, count(*) AS n FROM records WHERE {c} IS NOT NULL GROUP BY {c}"
                for c in ("priority", "o_orderstatus")
            ),
        ),
        "histogram": histogram(),
        "histogram_round": histogram_round(),
        "crosstab": crosstab("lang", "CAST(quality IS NOT NULL AS BIGINT)", "lang IS NOT NULL"),
        "crosstab_na": crosstab("source", "CAST(quality AS BIGINT)", "true"),
        "miss_by_factor": miss_rows("(SELECT * FROM documents LEFT JOIN labels USING (doc_id))", "lang", ("quality", "toxic"), "lang"),
        "miss_by_period": select(CLEANED, miss_rows("clean", "time_weeks", PROFILED, big("time_weeks"))),
        "miss_patterns": miss_patterns(),
        "dedup_exact": f"SELECT DISTINCT * FROM {lines}",
        "dedup_conflict": f"SELECT l_orderkey, l_returnflag, l_linestatus, {num('l_tax')} AS l_tax"
        " FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus, l_tax FROM lineitem)"
        " QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_returnflag) = 1",
        "dedup_repeated": f"SELECT * FROM {lines} QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_returnflag) = 1",
        "conflict_report": conflict,
        "window_count": rows("o_orderkey, count(*) OVER (PARTITION BY t) AS n"),
        "window_count_keys": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
        "link_left": select(
            {**ALL, "known": "SELECT priority, max(o_totalprice) AS top_price FROM records WHERE priority IS DISTINCT FROM '5-LOW' GROUP BY priority"},
            f"SELECT o_orderkey, r.priority, {num('top_price', 2)} AS top_price, CAST(top_price IS NOT NULL AS BIGINT) AS matched"
            " FROM records r LEFT JOIN known k ON r.priority IS NOT DISTINCT FROM k.priority",
        ),
        "link_star": link_star(),
        "link_fill_zero": select(FULL, f"SELECT {listed(COHORT_COLUMNS[:3])}, {episodes} FROM linked"),
        "link_report": link_report(),
        "bind_on_period": select(
            {**STUDY, "panel": panel_sql("records", "t", STUDY_SERIES[:2])},
            f"SELECT {big('g.p')} AS period, series, {num('rate')} AS rate, c.n,"
            f" {day('DATE ' + repr('1995-01-08') + ' + CAST(7 * (g.p - 1) AS INTEGER)')} AS week_start FROM range(1, 208) g(p)"
            " LEFT JOIN (SELECT t AS period, count(*) AS n FROM records GROUP BY t) c ON c.period = g.p LEFT JOIN panel ON panel.period = g.p",
        ),
        "count_by_period": select({"keyed": KEYED.replace("WHERE r <= 209", "")}, f"SELECT {big('r')} AS time_raw, count(*) AS n FROM keyed GROUP BY r"),
        "panel_prevalence": select(STUDY_PANEL, panel_out("series IN ('filled', 'urgent')")),
        "panel_truncated": select(
            STUDY_PANEL, panel_out("series IN ('filled', 'urgent') AND period > 25", f", {big('period - 25')} AS time_truncated")
        ),
        "panel_incidence": select(LINKED_PANEL, panel_out("series LIKE '%admissions%'")),
        "panel_multi": select(LINKED_PANEL, panel_out()),
        "panel_filled": panel_filled(),
        "summary_by_level": summary_by_level(),
        "summary_frame": summary_of(STUDY_PANEL, "panel", ("period", "trend", "level", "denominator", "numerator", "rate"), "series"),
        "summary_records": summary_of({}, "orders", ("o_totalprice", "o_custkey"), "o_orderstatus", 4),
        "summary_recoded": summary_of(CLEANED, "clean", ("total_previous_pregnancies", "birthweight"), "", 4),
        "design_grid": design_grid(),
        "its_poisson": coefficients(STUDY_PANEL, "poisson"),
        "its_quasi": coefficients(STUDY_PANEL, "quasi"),
        "its_harmonic": coefficients(STUDY_PANEL, "poisson_harmonic", "quasi_harmonic"),
        "its_dispersion": its_dispersion(),
        "its_irr": its_irr(),
        "its_irr_rounded": its_irr_rounded(),
        "its_robust": its_robust(),
        "its_summary": its_summary(),
        "its_explained": its_explained(),
        "its_residuals": its_residuals(),
        "its_residual_summary": its_residual_summary(),
        "resid_acf": resid_acf(),
        "resid_pacf": resid_pacf(),
        "its_factual": predictions("factual"),
        "its_counterfactual": predictions("counterfactual"),
        "its_ci_band": its_ci_band(),
        "segment_bands": segment_bands(),
        "its_effects": its_effects(),
        "its_effects_by": its_effects_by(),
        "its_ladder": its_ladder(),
    }
