"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.text import contains_ci, eq_ci, parse_day


def detail_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def where_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(eq_ci(column, value))


def mentions(columns: Sequence[str], term: str, pattern: bool = False) -> Column:
    """Any of the columns contains the term, in any case."""
    return reduce(lambda a, b: a | b, [contains_ci(c, term, pattern) for c in columns])


def keyword_search(
    df: DataFrame, term: str, search_in: Sequence[str], show: Sequence[str], pattern: bool = False
) -> DataFrame:
    """Distinct shown columns of the rows that mention the term."""
    return df.where(mentions(search_in, term, pattern)).select(*show).distinct()


def modified_since(df: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Rows changed in the last days, the boundary day included; unreadable dates are dropped.

    A typed date or timestamp is compared as it is, so that files can be skipped by it.
    """
    typed = isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return df.where((F.col(column) if typed else parse_day(column)) >= F.lit(as_of - timedelta(days=days)))


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())
