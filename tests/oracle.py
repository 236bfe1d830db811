"""Comparing a Spark result with DuckDB's, row by row in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(folder.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9) + 0.0
    return value


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in records], key=repr)


def compare(spark_df, connection, sql: str) -> tuple[list, list]:
    """(rows only Spark has, rows only DuckDB has); column names must agree."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows(names, result.fetchall())
    assert sorted(spark_df.columns) == sorted(names), (sorted(spark_df.columns), sorted(names))
    actual = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if actual == expected:
        return [], []
    from collections import Counter
    a, e = Counter(map(repr, actual)), Counter(map(repr, expected))
    return list((a - e).elements()), list((e - a).elements())
