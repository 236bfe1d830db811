"""What a registered query is, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from kartoteka.session import scratch


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def land(df: DataFrame, name: str, *partition: str) -> str:
    """Write rows as JSON, one document per line and compressed, the way responses are landed."""
    path = scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.json(path, compression="gzip")
    return path


def key_sql(*parts: str) -> str:
    """DuckDB text of the surrogate key over SQL parts (the first is the source)."""
    digest = f"md5(concat_ws(chr(31), {', '.join(parts)}))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"
