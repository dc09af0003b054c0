import math

from pyspark.sql import functions as F

from itspark.functions import axis, harmonic, recode
from tests.conftest import rows


def test_study_window_keeps_whole_weeks_of_both_arms(spark):
    arms, weeks = ("UNEXPOSED", "EXPOSED", None), (0, 1, 2, 103, 104, 105, None)
    df = spark.createDataFrame([(a, w) for a in arms for w in weeks], "cohort_id string, weeks_rel int")
    got = {(r.cohort_id, r.weeks_rel): r.time_weeks for r in axis.study_window(df).collect()}
    # Brute force of the rule on the raw axis.
    expected = {}
    for a in arms:
        for w in weeks:
            if a is None or w is None:
                continue
            t = (w - 106) * -1 if a == "UNEXPOSED" else w + 105
            if w > 0 and 1 < t < 209:
                expected[a, w] = t - 1
    assert got == expected
    assert got["UNEXPOSED", 104] == 1 and got["UNEXPOSED", 1] == 104
    assert got["EXPOSED", 1] == 105 and got["EXPOSED", 103] == 207


def test_every_study_week_is_reached_once(spark):
    df = spark.range(0, 120).selectExpr("int(id) as weeks_rel", "explode(array('UNEXPOSED', 'x')) as cohort_id")
    assert sorted(r.time_weeks for r in axis.study_window(df).collect()) == list(range(1, 208))


def test_raw_axis_is_null_for_a_null_arm(spark):
    df = spark.createDataFrame([(None, 3)], "arm string, w int")
    assert df.select(axis.raw_study_time(F.col("w"), F.col("arm"))).first()[0] is None


def test_its_terms(spark):
    df = spark.createDataFrame([(t,) for t in (0, 1, 104, 105, 207, 208, None)], "time_weeks int")
    got = [(r.time_weeks, r.level, r.trend_weeks) for r in axis.its_terms(df).collect()]
    assert got == [
        (0, None, None), (1, 0, 0), (104, 0, 0), (105, 1, 1), (207, 1, 103), (208, None, None), (None, None, None),
    ]


def test_window_from(spark):
    df = spark.createDataFrame([(t,) for t in (25, 26, 207)], "period int")
    assert rows(axis.window_from(df, 25)) == [(207, 182), (26, 1)]


def test_recodes_keep_unknown(spark):
    df = spark.createDataFrame(
        [(9, 15, "Y"), (3, 16, "N"), (1, None, None), (None, 99, "Unknown/Invalid")], "code int, n int, answer string"
    )
    got = df.select(
        recode.sentinel_to_null(F.col("code"), 9, 3).alias("code"),
        recode.null_where(F.col("n"), F.col("n") > 15).alias("n"),
        recode.sentinel_to_null(F.col("answer"), "Unknown/Invalid").alias("answer"),
        recode.binary(F.col("answer") == "Y").alias("yes"),
        recode.either(F.col("answer") == "Y", F.lit("a"), F.lit("b")).alias("choice"),
        recode.observed_flag(F.col("n")).alias("seen"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (None, 15, "Y", 1, "a", 1),
        (None, None, "N", 0, "b", 1),
        (1, None, None, None, None, 0),
        (None, None, None, 0, "b", 1),
    ]


def test_key_suffix(spark):
    df = spark.createDataFrame([("AB123456",), ("123",), (None,)], "id string")
    assert [r[0] for r in df.select(recode.key_suffix(F.col("id"))).collect()] == ["123456", "123", None]


def test_blank_and_date(spark):
    df = spark.createDataFrame([("", "2015/8/3"), ("x", "2017/08/14"), (None, "3 Aug")], "t string, d string")
    got = df.select(recode.blank_to_null(F.col("t")), recode.slash_date(F.col("d")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(None, "2015-08-03"), ("x", "2017-08-14"), (None, None)]


def test_exclusive_flag_over_all_patterns(spark):
    answers = ("Y", "N", None, "bad")
    df = spark.createDataFrame([(a, b, c) for a in answers for b in answers for c in answers], "pr string, su string, si string")
    ticks = {c: recode.yes_no_to_int(F.col(c)) for c in ("pr", "su", "si")}
    flagged = df.withColumn("flag", recode.exclusive_flag(ticks["su"], ticks["pr"], ticks["si"]))

    def expected(pr, su, si):
        value = {"Y": 1, "N": 0, None: 0, "bad": None}
        pr, su, si = value[pr], value[su], value[si]
        total = None if None in (pr, su, si) else pr + su + si
        if total == 0:
            return None
        if total is not None:
            return int(total == 1 and su == 1)
        # Unknown total: false as soon as the target is known not to be ticked, otherwise unknown.
        return 0 if su == 0 else None

    for r in flagged.collect():
        assert r.flag == expected(r.pr, r.su, r.si), r


def test_harmonic_terms(spark):
    df = spark.createDataFrame([(7,)], "t int")
    got = df.select(*[c.alias(n) for n, c in harmonic.harmonic_terms(F.col("t")).items()]).first().asDict()
    assert list(got) == ["sin1", "sin2", "cos1", "cos2"]
    for k in (1, 2):
        assert math.isclose(got[f"sin{k}"], math.sin(2 * math.pi * k * 7 / 52), abs_tol=1e-12)
        assert math.isclose(got[f"cos{k}"], math.cos(2 * math.pi * k * 7 / 52), abs_tol=1e-12)
