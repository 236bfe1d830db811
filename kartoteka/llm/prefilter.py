"""Rows that may have an id of another table, told by a filter of fixed size, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20  # so many numbers are broadcast at most, whatever the tables' sizes


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def split_by_ids(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may have an id of `ids`, rows that surely have none); `ids` has one column.

    Ids are reduced to the numbers of their hash buckets, of which there are `BUCKETS` at most.
    With so many ids that all buckets are used the first part is everything, and still right.
    """
    used = F.broadcast(ids.select(_bucket(ids.columns[0]).alias("__bucket")).distinct())
    keyed = rows.withColumn("__bucket", _bucket(column))
    return keyed.join(used, "__bucket", "left_semi").drop("__bucket"), keyed.join(used, "__bucket", "left_anti").drop("__bucket")
