import random

import pytest
from pyspark.sql import functions as F

from itspark.operators import dedup, link, panel
from itspark.operators.link import SourceSpec
from tests.conftest import rows

TEXT_ROWS = [
    ("a", 1, "x"), ("a", 1, "x"),  # exact copy: one stays
    ("b", 1, "x"), ("b", 1, "y"),  # conflict: both go
    ("c", 1, "x"), ("c", 1, "x"), ("c", 1, None),  # copy and conflict: all go
    (None, 1, "x"), (None, 1, "y"),  # null keys are one group
    (None, 2, None), (None, 2, None),
    ("d", 1, None),
]


@pytest.mark.parametrize("as_number", [False, True])
def test_drop_conflicts(spark, as_number):
    number = {"x": 1, "y": 2, None: None}
    data = [(k, w, number[v] if as_number else v) for k, w, v in TEXT_ROWS]
    df = spark.createDataFrame(data, f"k string, w int, v {'int' if as_number else 'string'}")
    one, none = (1, None) if as_number else ("x", None)
    assert rows(dedup.drop_conflicts(df, ["k", "w"])) == rows_of([("a", 1, one), (None, 2, none), ("d", 1, none)])


def rows_of(data):
    return sorted(data, key=repr)


def test_drop_conflicts_forms_agree_with_brute_force(spark):
    rng = random.Random(3)
    data = [
        (rng.choice(["p", "q", "r", "s", None]), rng.randrange(8), rng.choice([1.0, 2.0, None, float("nan")]), rng.choice([0, 0, 0, 1]))
        for _ in range(120)
    ]
    df = spark.createDataFrame(data, "k string, w int, x double, y int")
    as_text = df.withColumn("x", F.col("x").cast("string"))
    same = [(k, w, repr(x), y) for k, w, x, y in data]
    kept = [r for r in set(same) if len({s for s in same if s[:2] == r[:2]}) == 1]
    assert len(kept) > 0
    by_column = rows_of((r.k, r.w, repr(r.x), r.y) for r in dedup.drop_conflicts(df, ["k", "w"]).collect())
    by_row = dedup.drop_conflicts(as_text, ["k", "w"])
    assert by_column == rows_of(kept)
    assert by_row.count() == len(kept)
    assert dedup.drop_conflicts(df.union(df), ["k", "w"]).count() == len(kept)


def test_hash_aggregate_for_numbers_only(spark):
    df = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    plan = dedup.drop_conflicts(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_drop_repeated_keys_and_key_only_tables(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (None, 2)], "k string, v int")
    assert rows(dedup.drop_repeated_keys(df, ["k"])) == rows_of([("b", 1), (None, 2)])
    assert rows(dedup.drop_repeated_keys(df, ["k", "v"])) == rows_of([("b", 1), (None, 2)])
    assert rows(dedup.drop_conflicts(df, ["k", "v"])) == rows_of([("a", 1), ("b", 1), (None, 2)])
    assert dedup.distinct_rows(df).count() == 3


def test_conflict_report(spark):
    df = spark.createDataFrame(TEXT_ROWS, "k string, w int, v string")
    got = dedup.conflict_report(df, ["k", "w"]).first().asDict()
    assert got == {
        "rows_in": 12, "rows_distinct": 9, "copies_dropped": 3, "keys": 6, "keys_conflicted": 3,
        "rows_conflicted": 6, "rows_kept": 3,
    }
    assert got["rows_kept"] == dedup.drop_conflicts(df, ["k", "w"]).count()
    empty = dedup.conflict_report(df.limit(0), ["k", "w"]).first()
    assert set(empty) == {0}


LEFT = [("a", 1, "l1"), ("b", 1, "l2"), (None, 1, "l3"), ("z", 9, "l4"), ("a", 1, "l5")]
RIGHT = [("a", 1, 10), ("b", 1, None), (None, 1, 30), ("y", 1, 40)]


@pytest.mark.parametrize("spread", [0, 4])
def test_link_left(spark, spread):
    left = spark.createDataFrame(LEFT, "k string, w int, name string")
    right = spark.createDataFrame(RIGHT, "k string, w int, v int")
    natural = link.link_left(left, right, marker="hit", spread=spread)
    assert natural.columns == ["k", "w", "name", "v", "hit"]
    assert rows(natural, "name", "v", "hit") == [
        ("l1", 10, 1), ("l2", None, 1), ("l3", 30, 1), ("l4", None, 0), ("l5", 10, 1),
    ]
    strict = link.link_left(left, right, na_matches=False, fill={"v": 0}, spread=spread)
    assert rows(strict, "name", "v") == [("l1", 10), ("l2", 0), ("l3", 0), ("l4", 0), ("l5", 10)]


def test_link_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        link.link_left(spark.range(1), spark.range(1).withColumnRenamed("id", "x"))
    both = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        link.link_left(both, both, ["k"])


def test_spread_splits_a_key_that_holds_most_rows(spark):
    """Every row of the hot key comes through exactly once, and its rows get many salts."""
    left = spark.range(0, 30000, numPartitions=4).select(
        F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"), F.lit("same").alias("s")
    )
    right = spark.range(0, 30000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    linked = link.link_left(left, right, spread=8)
    assert linked.count() == 30000 and linked.select("row").distinct().count() == 30000
    assert linked.filter("v != k * 2 or v is null").count() == 0
    salted, copies = link._spread(left, right, ["k"], 8)
    assert salted.filter("k = 7").select("_salt").distinct().count() == 8
    assert salted.filter("k != 7 and _salt != 0").count() == 0
    assert copies.filter("k = 7").count() == 8 and copies.filter("k = 8").count() == 1
    # Copies of one row lie in one salt per map task, not in one salt overall.
    copied = left.select("k", "s")
    spread, _ = link._spread(copied, right, ["k"], 4)
    assert spread.filter("k = 7").select("_salt").distinct().count() == 4


def heavy(df, keys, parts):
    return sorted(r[0] for r in link.heavy_key_hashes(df, keys, parts).collect())


@pytest.mark.parametrize("parts", [1, 3, 200, 200_000])
def test_heavy_keys_are_exactly_those_above_a_share(spark, parts):
    """However many partitions there are, and with a null key among the heavy ones."""
    some = F.when(F.col("id") < 40000, None).when(F.col("id") < 70000, F.col("id") % 90).otherwise(F.col("id") / 2)
    df = spark.range(0, 100000, numPartitions=4).select(F.floor(some).alias("k"), (F.col("id") % 2).alias("j"))
    for keys in (["k"], ["k", "j"]):
        counts = df.groupBy(F.xxhash64(*keys).alias("h")).count().filter(F.col("count") * parts > 100000)
        assert heavy(df, keys, parts) == sorted(r.h for r in counts.collect())
    assert heavy(df.limit(0), ["k"], parts) == []


def test_spread_at_any_number_of_partitions(spark):
    left = spark.range(0, 20000, numPartitions=4).select((F.col("id") % 5000).alias("k"), F.col("id").alias("row"))
    right = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    salted, copies = link._spread(left, right, ["k"], 4, parts=200_000)
    assert salted.count() == 20000 and copies.count() == 20000
    joined = salted.join(copies, ["k", "_salt"])
    assert joined.count() == 20000 and joined.filter("v != 2 * k").count() == 0
    top = spark.createDataFrame([(2**62 + i,) for i in range(9)], "k long")
    assert link.link_left(top, top.withColumn("v", F.lit(1)), spread=7).filter("v = 1").count() == 9


def test_heavy_keys_are_few_and_heavy(spark):
    df = spark.range(10000).select(F.when(F.col("id") < 4000, -1).otherwise(F.col("id")).alias("k"))
    assert heavy(df, ["k"], None) == [df.filter("k = -1").select(F.xxhash64("k")).first()[0]]


def test_link_sources_and_report(spark):
    cohort = spark.createDataFrame([("000001", 1, "E"), ("000002", 1, "E"), ("000003", 1, "E")], "mother_id string, weeks_rel int, cohort_id string")
    source = spark.createDataFrame(
        [("AA000001", 1, "E", 4), ("AA000001", 1, "E", 4), ("AA000002", 1, "E", 1), ("BB000002", 1, "E", 2), ("AA000009", 1, "E", 2)],
        "ID string, W int, C string, N int",
    )
    spec = SourceSpec("adm", source, {"ID": "mother_id", "W": "weeks_rel", "C": "cohort_id", "N": "n"}, fill={"n": 0})
    keys = ["mother_id", "weeks_rel", "cohort_id"]
    linked = link.link_sources(cohort, [spec], keys, status=True)
    # Two ids are the same key once trimmed: a conflict, shown as such, counted as no episodes.
    assert rows(linked, "mother_id", "n", "link_adm") == [
        ("000001", 4, "matched"), ("000002", 0, "conflict"), ("000003", 0, "absent"),
    ]
    assert rows(link.link_report(linked, ["adm"])) == [("adm", "absent", 1), ("adm", "conflict", 1), ("adm", "matched", 1)]
    plain = link.link_sources(cohort, [spec], keys)
    assert rows(plain, "mother_id", "n") == [("000001", 4), ("000002", 0), ("000003", 0)]


def test_linkage_reuses_the_partitioning_of_the_deduplication(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        keys = ["mother_id", "weeks_rel", "cohort_id"]
        columns = ("string(id) as mother_id", "int(id) as weeks_rel", "if(id % 2 = 0, 'E', 'U') as cohort_id")
        cohort = spark.range(9).selectExpr(*columns)
        names = {k: k for k in keys}
        specs = [
            SourceSpec(f"s{i}", spark.range(9 + i).selectExpr(*columns, f"int(id) as n{i}"), {**names, f"n{i}": f"n{i}"})
            for i in range(3)
        ]
        plan = link.link_sources(cohort, specs, keys)._jdf.queryExecution().executedPlan().toString()
        shuffles = plan.count("Exchange hashpartitioning") + plan.count("ReusedExchange")
        assert shuffles == 4, plan
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_bind_on_period_and_group_counts(spark):
    a = spark.createDataFrame([("s", 2, 20), ("s", 1, 10)], "series string, period int, a int")
    b = spark.createDataFrame([("s", 1, 1), ("s", 2, 2)], "series string, period int, b int")
    assert rows(link.bind_on_period(a, b)) == [("s", 1, 10, 1), ("s", 2, 20, 2)]
    c = spark.createDataFrame([("s", 3, 5), (None, 1, 6)], "series string, period int, c int")
    d = spark.createDataFrame([(None, 1, 7)], "series string, period int, d int")
    assert rows(link.bind_on_period(a, c, d)) == [("s", 1, 10, None, None), ("s", 2, 20, None, None), ("s", 3, None, 5, None), (None, 1, None, 6, 7)]
    df = spark.createDataFrame([("x", 1), ("x", 2), (None, 3), (None, 4), (None, 5)], "g string, id int")
    for spread in (0, 3):
        assert rows(panel.with_group_count(df, "g", spread=spread), "id", "n") == [(1, 2), (2, 2), (3, 3), (4, 3), (5, 3)]
    weeks = spark.createDataFrame([(1, 1), (2, 1), (3, 207), (4, 208), (5, None)], "id int, time_weeks int")
    assert rows(panel.with_period_count(weeks), "id", "n") == [(1, 2), (2, 2), (3, 1)]
    assert rows(panel.count_by(df, "g")) == [("x", 2), (None, 3)]
