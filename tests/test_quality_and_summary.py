import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itspark.operators import quality, summary
from tests.conftest import rows


def test_attrition(spark):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", 1, 2), ("b", 2, 1), ("c", None, 1), (None, 1, 1), (None, 1, 1)], "k string, births int, alive int"
    )
    steps = quality.attrition(df, {"single": F.col("births") == 1, "alive": F.col("alive") == 1}, ["k"])
    # A row whose criterion is unknown is counted apart; like one that fails it is not left.
    assert [tuple(r) for r in steps.orderBy("step_no").collect()] == [
        (0, "all records", 0, 0, 6, 4), (1, "single", 1, 1, 4, 2), (2, "alive", 1, 0, 3, 2),
    ]


def test_include_and_complete_cases(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 2)], "a int, b int")
    assert rows(quality.include(df, F.col("a") == 1, F.col("b") == 1)) == [(1, 1)]
    assert quality.complete_cases(df).count() == 2
    assert quality.complete_cases(df, ["a"]).count() == 3
    assert tuple(quality.missing_counts(df, ["a", "b"]).first()) == (4, 2)
    assert rows(quality.null_counts(df)) == [("a", 1), ("b", 1)]


def test_freq_shows_a_null_row_even_at_zero(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 1)], "a string, b int")
    assert rows(quality.freq(df, ["a", "b"])) == [
        ("a", "x", 2), ("a", "y", 1), ("a", None, 0), ("b", "1", 2), ("b", None, 1),
    ]
    assert rows(quality.freq(df, "b", use_na=False)) == [("b", "1", 2)]


def test_histogram_lists_empty_bins_and_closes_on_the_right(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 2, 10)] + [(None,)], "x double")
    got = [tuple(r) for r in quality.histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [(1, 0.0, 2.0, 4), (2, 2.0, 4.0, 0), (3, 4.0, 6.0, 0), (4, 6.0, 8.0, 0), (5, 8.0, 10.0, 1)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [r.n for r in quality.histogram(same, "x", 2).orderBy("bin").collect()] == [2, 0]


@pytest.mark.parametrize(
    "values,breaks",
    [
        ([0.3, 1, 2, 2, 9.7], [0, 2, 4, 6, 8, 10]),  # five values: four bins of 2.35, so steps of 2
        ([1.0] * 40, [0.5, 1.5]),
        ([12, 20, 30, 40, 50, 60, 70, 80], [0, 20, 40, 60, 80]),  # 17 a bin: steps of 20
        ([-0.03, 0.0, 0.01, 0.0199], [-0.04, -0.02, 0.0, 0.02]),  # 0.0166 a bin: steps of 0.02
        ([], None),
    ],
)
def test_histogram_chooses_round_breaks(spark, values, breaks):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = quality.histogram(df, "x").orderBy("bin").collect()
    if breaks is None:
        assert got == []
        return
    assert [r.lower for r in got] == pytest.approx(breaks[:-1]) and [r.upper for r in got] == pytest.approx(breaks[1:])
    inside = lambda v, k: (breaks[k] < v + 1e-9 if k == 0 else breaks[k] + 1e-9 < v) and v <= breaks[k + 1] + 1e-9
    assert [r.n for r in got] == [sum(inside(v, k) for v in values) for k in range(len(breaks) - 1)]


def test_crosstab_makes_no_list_of_levels(spark):
    df = spark.range(400).select((F.col("id") % 37).alias("a"), (F.col("id") % 23).alias("b"))
    table = quality.crosstab(df, "a", "b")
    assert "collect_" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert table.count() == 37 * 23 and table.agg(F.sum("n")).first()[0] == 400


@pytest.mark.parametrize("use_na", [False, True])
def test_crosstab(spark, use_na):
    data = [("p", 1)] * 3 + [("p", 0)] * 2 + [("q", 1)] * 4 + [(None, 1), ("q", None)]
    got = quality.crosstab(spark.createDataFrame(data, "x string, y int"), "x", "y", use_na).collect()
    counted = Counter(d for d in data if use_na or None not in d)
    xs, ys = {d[0] for d in counted}, {d[1] for d in counted}
    assert {(r.x, r.y) for r in got} == {(x, y) for x in xs for y in ys}
    total = sum(counted.values())
    for r in got:
        n = counted[r.x, r.y]
        row, col = sum(counted[r.x, y] for y in ys), sum(counted[x, r.y] for x in xs)
        e = row * col / total
        assert (r.n, r.row_pct, r.col_pct, r.total_pct) == pytest.approx((n, 100 * n / row, 100 * n / col, 100 * n / total))
        assert r.chisq == pytest.approx((n - e) ** 2 / e)
    assert any(r.n == 0 for r in got)


def test_miss_by(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 2, None), (2, 1, 1), (None, None, 1)], "w int, a int, b int")
    assert rows(quality.miss_by(df, "w", ["a", "b"])) == [
        (1, "a", 50.0), (1, "b", 50.0), (2, "a", 0.0), (2, "b", 0.0), (None, "a", 100.0), (None, "b", 0.0),
    ]


def test_miss_patterns_with_fewer_sets_than_columns(spark):
    rng = random.Random(5)
    columns = [f"c{i}" for i in range(5)]
    data = [tuple(None if rng.random() < 0.1 * (i + 1) else 1 for i in range(5)) for _ in range(400)]
    df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in columns))
    for max_sets in (10, 3):
        sizes = Counter(columns[i] for d in data for i in range(5) if d[i] is None)
        top = {c for c, _ in sorted(sizes.items(), key=lambda i: (-i[1], i[0]))[:max_sets]}
        expected = Counter(
            "&".join(c for c, v in zip(columns, d) if v is None and c in top) for d in data
        )
        expected.pop("", None)
        got = quality.miss_patterns(df, columns, max_sets=max_sets)
        assert {r.pattern: r.n for r in got.collect()} == dict(expected)
    first = quality.miss_patterns(df, columns, top=2).collect()
    assert len(first) == 2 and first[0].n >= first[1].n


def test_miss_patterns_of_many_columns(spark):
    columns = [f"c{i}" for i in range(70)]
    data = [tuple(None if i in gone else 1 for i in range(70)) for gone in ({0, 69}, {0, 69}, {61, 65}, set(), set(range(70)))]
    df = spark.createDataFrame(data, ", ".join(f"{c} int" for c in columns))
    got = quality.miss_patterns(df, columns, max_sets=None, top=None).collect()
    assert [(r.pattern, r.n_variables, r.n) for r in got] == [("c0&c69", 2, 2), ("&".join(columns), 70, 1), ("c61&c65", 2, 1)]


def test_tables_from_reduced_records(spark):
    data = [(random.Random(i).choice("xyz"), random.Random(i + 99).choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(data, "a string, b int")
    small = quality.reduced(df, ["a", "b"])
    assert small.count() <= 9
    for use_na in (True, False):
        assert rows(quality.crosstab(small, "a", "b", use_na, weight="n")) == rows(quality.crosstab(df, "a", "b", use_na))
        assert rows(quality.freq(small, ["a", "b"], use_na, weight="n")) == rows(quality.freq(df, ["a", "b"], use_na))
    sparse = spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int")
    assert quality.crosstab(sparse, "a", "b", zero_cells=False).count() == 2 and quality.crosstab(sparse, "a", "b").count() == 4
    assert "collect_list" not in quality.crosstab(df, "a", "b")._jdf.queryExecution().optimizedPlan().toString()


def six(values):
    known = [v for v in values if v is not None]
    q = [float(v) for v in np.quantile(known, [0, 0.25, 0.5, 0.75, 1])] if known else [None] * 5
    return (q[0], q[1], q[2], q[3], float(np.mean(known)) if known else None, q[4], len(values) - len(known))


@pytest.mark.parametrize("bounded", [True, False])
def test_summary6(spark, bounded):
    rng = random.Random(1)
    data = {
        "small": [1, 2, 3, 10, None],
        "hot": [5.0] * 3000 + [rng.gauss(0, 9) for _ in range(1000)],
        "wide": [rng.uniform(-1e6, 1e6) for _ in range(5000)],
        "one": [4.0],
        None: [1.0, 2.0],
        "unknown": [None, None],
    }
    pairs = [(g, None if v is None else float(v)) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(pairs, "g string, x double")
    got = {r.g: tuple(r)[2:] for r in summary.summary6(df, ["x"], ["g"], bounded=bounded).collect()}
    assert got.keys() == data.keys()
    for g, values in data.items():
        expected = six(values)
        for a, b in zip(got[g], expected):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)), (g, got[g], expected)
    whole = summary.summary6(df, ["x"], bounded=bounded).first()
    assert tuple(whole)[1:] == pytest.approx(six([v for _, v in pairs]))


def test_quartiles_do_not_depend_on_the_order_of_partitions(spark):
    df = spark.range(0, 5000, numPartitions=5).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 100000 / 7.0).alias("x"))
    first = summary.summary6(df, ["x"], ["g"])
    assert "percentile" not in first._jdf.queryExecution().optimizedPlan().toString()
    for other in (df.repartition(7, "x"), df.orderBy(F.desc("x")), df.coalesce(1)):
        assert rows(summary.summary6(other, ["x"], ["g"]).drop("mean")) == rows(first.drop("mean"))


@pytest.mark.parametrize("cells,few", [(4, 3), (64, 0), (4096, 50_000)])
def test_quartiles_by_refined_histograms(spark, monkeypatch, cells, few):
    """Skewed, tied, tiny, huge and infinite values, a null group, and a group of nulls: as numpy has them."""
    monkeypatch.setattr(summary, "CELLS", cells)
    monkeypatch.setattr(summary, "FEW", few)
    rng = random.Random(9)
    of = {
        "skew": [rng.lognormvariate(0, 4) for _ in range(701)],
        "tied": [rng.choice([1.0, 1.0, 1.0, 2.0, -3.5]) for _ in range(400)],
        "wide": [rng.choice([1e-300, 5e-324, 1e300, -1.7e308, 1.7e308, 0.0, 1.0]) for _ in range(90)],
        "ends": [float("inf")] * 30 + [float("-inf")] * 30 + [1.0, 2.0, 3.0] * 3,
        None: [7.0],
        "none": [],
    }
    data = [(g, v) for g, own in of.items() for v in [*own, None, None]]
    rng.shuffle(data)
    got = summary.summary6(spark.createDataFrame(data, "g string, x double"), ["x"], ["g"]).collect()
    assert len(got) == len(of)
    for r in got:
        own = sorted(of[r.g])
        assert r.n_missing == 2
        for q, p in summary.QUARTILES:
            if not own:
                assert r[q] is None
                continue
            at = (len(own) - 1) * p
            lo, hi = own[int(at)], own[-int(-at // 1)]
            expected = lo + (hi - lo) * (at - int(at))
            assert r[q] == pytest.approx(expected, rel=1e-12, nan_ok=True), (r.g, q)


def test_summary_quartiles_are_type_7(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 10, None)], "x int")
    got = summary.summary6(df, ["x"]).first()
    assert (got.q1, got["median"], got.q3, got.n_missing) == (1.75, 2.5, 4.75, 1)


def test_summary_by_level(spark):
    panel = spark.createDataFrame(
        [("s", 0, 1.0, 10.0), ("s", 0, 3.0, None), ("s", 1, 5.0, 30.0)], "series string, level int, numerator double, rate double"
    )
    got = {(r.variable, r.phase): r for r in summary.summary_by_level(panel).collect()}
    assert len(got) == 6
    assert (got["numerator", "pre"]["median"], got["numerator", "post"]["median"], got["numerator", "all"]["median"]) == (2, 5, 3)
    assert (got["rate", "pre"].n_missing, got["rate", "all"]["mean"]) == (1, 20.0)
