"""Stored tables, read with a column list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def read_table(
    spark: SparkSession, location: str, columns: Sequence[str] | None = None, fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A catalog table (`fmt="table"`), files, or a database table (`fmt="jdbc"`)."""
    if fmt == "table":
        df = spark.read.table(location)
    elif fmt == "jdbc":
        df = spark.read.format("jdbc").options(dbtable=location, **(options or {})).load()
    else:
        df = spark.read.format(fmt).options(**(options or {})).load(location)
    return df.select(*columns) if columns else df
