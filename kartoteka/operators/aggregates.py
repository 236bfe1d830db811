"""Counts and distinct values. All of them combine map-side before they shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def group_count(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def facet_counts(facets: DataFrame, items: DataFrame, facet_key: str, item_facet: str, label: str) -> DataFrame:
    """Items per facet; a facet nobody uses counts 0.

    Items are counted before the join, so a popular facet moves one row per task.
    """
    counted = items.groupBy(F.col(item_facet).alias("__facet")).agg(F.count("*").alias("n"))
    return (
        facets.join(counted, F.col(facet_key) == F.col("__facet"), "left")
        .groupBy(F.col(label).alias("facet")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    )


def coverage_stats(df: DataFrame, group: str, key: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(key) if approximate else F.count_distinct(F.col(key))
    return df.groupBy(group).agg(F.count("*").alias("total"), distinct.alias("unique_keys"))


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    return df.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(limit)


def union_all_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack frames whose columns may differ; missing ones become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows on the way to whatever action comes next, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


SKETCH_BITS = 14  # of the logarithm of a sketch's registers: 16 kB at most, an error of about 0.8 %


def store_counts(df: DataFrame, root: str, load: str, group: str, key: str) -> None:
    """Write rows and a mergeable sketch of the distinct keys of each group, for one load.

    A load that is stored again takes the place of what it stored before.
    """
    counts = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(key), F.lit(SKETCH_BITS)).alias("keys"))
    (counts.withColumn("load", F.lit(load)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("load").parquet(root))


def stored_counts(spark: SparkSession, root: str, schema: str = "group string, n bigint, keys binary, load string") -> DataFrame:
    """group, total and unique_keys (estimated) over all stored loads; their rows are not read again."""
    stored = spark.read.schema(schema).parquet(root)
    return stored.groupBy("group").agg(F.sum("n").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("unique_keys"))
