"""Ordered pages, first matches and the best rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _asc(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o).asc_nulls_last() if isinstance(o, str) else o for o in order]


def page(df: DataFrame, order: Sequence[str | Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page. `order` must end in a key, so that equal names have one order too."""
    return df.orderBy(*_asc(order)).offset(offset).limit(limit)


def page_after(df: DataFrame, order: Sequence[str], last: Sequence[object], limit: int = 50) -> DataFrame:
    """The page after the row with these order values; the cost does not grow with depth.

    As in `page`, NULL comes last; a page may also continue from a NULL.
    """
    later = F.lit(False)
    for name, value in reversed(list(zip(order, last, strict=True))):
        if value is None:
            later = F.col(name).isNull() & later
        else:
            later = F.col(name).isNull() | (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & later)
    return df.where(later).orderBy(*_asc(order)).limit(limit)


def first_match(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return page(df, order, limit=1)


def full_sort(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Range-partitioned sort; a key at the end of `order` also splits a value that repeats."""
    return df.orderBy(*_asc(order))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
                rank_as: str | None = None) -> DataFrame:
    """The first k rows of each key.

    Spark limits each group before the shuffle as well, so a key with a third of
    the rows still sends at most k rows per task.
    """
    rank = rank_as or "__rank"
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*_asc(order))))
    top = ranked.where(F.col(rank) <= k)
    return top if rank_as else top.drop(rank)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def merge_top(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, salt_on: Sequence[str],
              rank_as: str | None = None, first_of: Sequence[str | Column] | None = None, salts: int = 64) -> DataFrame:
    """`top_per_key` for few keys with very many rows: once per key and salt, then per key.

    With `first_of`, rows that agree in `salt_on` count once: the first in that order.
    They share a salt, so this takes no shuffle of its own.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
    if first_of is not None:
        salted = best_per_key(salted.repartition(*keys, "__salt"), [*keys, "__salt", *salt_on], first_of)
    partial = top_per_key(salted, [*keys, "__salt"], order, k).drop("__salt")
    return top_per_key(partial, keys, order, k, rank_as)
