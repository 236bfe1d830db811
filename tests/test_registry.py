"""Every registered query against DuckDB, and the plans they run."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as driver
from kartoteka.registry import registered
from oracle import TESTDATA, compare, connect

FOLDER = TESTDATA / "sf0.001"
QUERIES = {name: query.run for name, query in registered().items()}
SQL = {name: query.sql for name, query in registered().items() if query.sql is not None}

@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert driver.entry(spark).count() == 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, str(FOLDER))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, bad
    if name in SQL:
        assert compare(df, connection, SQL[name]) == ([], [])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name, columns", [
    ("stored_columns", ["o_orderkey", "o_totalprice"]),
    ("name_contains", ["p_partkey", "p_name"]),
    ("coverage", ["user_id", "event_type"]),
    ("group_count", ["o_orderpriority"]),
])
def test_scans_read_only_what_is_needed(spark, name, columns):
    plan = QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", plan)[1])) == set(columns)


def test_point_lookup_is_pushed_into_the_scan(spark):
    plan = QUERIES["detail_by_key"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan


def test_recent_rows_are_found_by_the_scan(spark):
    plan = QUERIES["modified_since_typed"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_pages_keep_only_their_rows(spark):
    plan = QUERIES["list_page"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("BroadcastHashJoin") == 2


def test_best_rows_are_limited_before_the_shuffle(spark):
    plan = QUERIES["best_per_key"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
