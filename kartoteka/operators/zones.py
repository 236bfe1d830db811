"""Deep pages from storage: a table sorted into files, and a map of the keys in each.

`store_sorted` writes rows by range of their order, a file for each range, and notes the first and last
keys and the number of rows of every file. A page at any depth then opens the few files it lies in:
`page_at` by number, `page_after` by the last row seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.operators.topk import page, page_after

_PART = "__part"


def _order(names: Sequence[str]) -> list:
    return [F.col(n).asc_nulls_last() for n in names]


@dataclass(frozen=True)
class SortedTable:
    """Where the table is, and what it is ordered by: NULL last, a key at the end."""

    root: str
    order: tuple[str, ...]
    schema: T.StructType

    def store(self, df: DataFrame, files: int = 200) -> SortedTable:
        """Write the rows in about so many files, and the map of their keys."""
        dealt = df.repartitionByRange(files, *_order(self.order)).withColumn(_PART, F.spark_partition_id())
        # the folder tells which range a file belongs to
        dealt.sortWithinPartitions(*_order(self.order)).write.mode("overwrite").partitionBy(_PART).parquet(f"{self.root}/rows")
        rows = self._rows(df.sparkSession)
        keys = F.struct(*[part for n in self.order for part in (F.col(n).isNull().alias(f"{n}_missing"), F.col(n))])
        zones = rows.groupBy(_PART).agg(F.count("*").alias("n"), F.min(keys).alias("low"), F.max(keys).alias("high"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        zones.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/zones")  # a row for each file
        return self

    def zones(self, spark: SparkSession) -> list:
        """One row for each file: its number, rows, rows before it, lowest and highest key."""
        return sorted(spark.read.parquet(f"{self.root}/zones").collect(), key=lambda z: z[_PART])

    def _rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(_PART, T.IntegerType())])).parquet(f"{self.root}/rows")

    def _read(self, spark: SparkSession, parts: Sequence[int]) -> DataFrame:
        return self._rows(spark).where(F.col(_PART).isin(list(parts))).drop(_PART)

    def page_at(self, spark: SparkSession, limit: int = 50, offset: int = 0) -> DataFrame:
        """The rows from `offset` on; files before them are not opened."""
        zones = [z for z in self.zones(spark) if z.before < offset + limit and z.before + z.n > offset]
        return page(self._read(spark, [z[_PART] for z in zones]), list(self.order), limit, max(0, offset - zones[0].before) if zones else 0)

    def page_after(self, spark: SparkSession, last: Sequence[object], limit: int = 50) -> DataFrame:
        """The rows after the one with these order values: the file they fall in, and the next ones until the page is full."""
        key = [part for v in last for part in (v is None, v)]

        def beyond(high) -> bool:
            for own, sought in zip([x for n in self.order for x in (high[f"{n}_missing"], high[n])], key, strict=True):
                if own != sought:
                    if own is None or sought is None:
                        return own is None
                    return own > sought
            return False

        opened, full = [], 0
        for zone in self.zones(spark):
            if not beyond(zone.high):
                continue
            opened.append(zone[_PART])
            if len(opened) > 1:
                full += zone.n  # of the first one only some rows may come after
            if full >= limit:
                break
        return page_after(self._read(spark, opened), list(self.order), last, limit)
