"""Every registered query against DuckDB on the smallest driver tables, and the shape of its plan."""

import os
import re

import pytest

import __spark_entry__ as driver
from checks import oracle, queries as registered
from checks.compare import compare, open_duck
from checks.plans import plan_counts, with_stages

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")

QUERIES, SQL = registered.registry(), oracle.statements()


@pytest.fixture(scope="module")
def duck():
    return open_duck(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
    assert QUERIES.keys() <= driver.queries().keys()
    assert driver.oracle_sql().keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], SQL[name], SF_DIR) == ""


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["link_star", "panel_multi", "panel_filled", "summary_records", "crosstab", "its_residuals", "miss_patterns"])
def test_plans_scale(spark, name):
    """No nested-loop join, no unpartitioned window, models in grouped tasks only."""
    df = QUERIES[name](spark, SF_DIR)
    counts = plan_counts(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert counts["nested"] == 0
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\((?:specifiedwindowframe|[^,()]* ASC)", plan)
    assert counts["python"] == (1 if name == "its_residuals" else 0)


def test_stages_are_counted_too(spark):
    counts = plan_counts(*with_stages(QUERIES["its_poisson"], spark, SF_DIR))
    assert counts["scans"] >= 2 and counts["nested"] == 0


def test_one_scan_of_the_records_for_all_series(spark):
    assert plan_counts(QUERIES["panel_prevalence"](spark, SF_DIR))["scans"] == 1


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["panel_prevalence"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderdate," in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>" in plan
