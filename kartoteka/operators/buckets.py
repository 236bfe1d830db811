"""A stored table in key buckets, of which a merge rewrites only those that the batch touches.

Rows lie in Parquet folders by a hash of their key. A merge reads and writes the buckets of the staged
keys, by dynamic partition overwrite; files of all other buckets stay as they are, and a look-up of
some keys reads their buckets only. Rows without a key match nothing: each batch keeps its own in a
folder of its own.

A batch is written beside the table first and then moved in. If it fails, running it again either
starts over or moves in what was written, so that the table is the same as after one run; batches
have names and come one after another, and only the last one may run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.operators.joins import join_spread, measured
from kartoteka.operators.tables import staged_table, upsert

_BUCKET, _BATCH = "__bucket", "__batch"


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


@dataclass(frozen=True)
class KeyBuckets:
    """Where the table is and how it is divided; `buckets` stays the same for the life of the table.

    Choose it so that a bucket is some hundred megabytes: a merge rewrites buckets as wholes.
    """

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    buckets: int = 256

    @property
    def _keyed(self) -> str:
        return f"{self.root}/keyed"

    @property
    def _keyless(self) -> str:
        return f"{self.root}/keyless"

    def _pending(self, batch: str) -> str:
        return f"{self.root}/pending/{batch}"

    def number(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _has_key(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])

    def _stored(self, spark: SparkSession, path: str, extra: str, kind: T.DataType) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(extra, kind)])
        if not _exists(spark, path):
            # known to be empty before anything runs, so that what meets it is not shuffled
            return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).limit(0)
        return spark.read.schema(schema).parquet(path)

    def create(self, rows: DataFrame) -> None:
        """Write the starting table; what was there goes."""
        rows = rows.select(self.schema.names)
        _remove(rows.sparkSession, self.root)
        self._write(rows.where(self._has_key()), self._keyed)
        self._write_keyless(rows.where(~self._has_key()), self._keyless, "start")

    def _write(self, rows: DataFrame, path: str) -> None:
        # one file for each bucket
        self._put(rows.withColumn(_BUCKET, self.number()).repartition(_BUCKET), path)

    def _put(self, numbered: DataFrame, path: str) -> None:
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(path)

    def _write_keyless(self, rows: DataFrame, path: str, batch: str) -> None:
        (rows.withColumn(_BATCH, F.lit(batch)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(_BATCH).parquet(path))

    def read(self, spark: SparkSession) -> DataFrame:
        keyed = self._stored(spark, self._keyed, _BUCKET, T.IntegerType()).drop(_BUCKET)
        return keyed.unionByName(self._stored(spark, self._keyless, _BATCH, T.StringType()).drop(_BATCH))

    def touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that the keys of some rows fall in: `buckets` at most."""
        return sorted(r[0] for r in rows.where(self._has_key()).select(self.number().alias(_BUCKET)).distinct().collect())

    def read_buckets(self, spark: SparkSession, numbers: Sequence[int]) -> DataFrame:
        """The stored rows of some buckets; files of others are not opened."""
        return self._stored(spark, self._keyed, _BUCKET, T.IntegerType()).where(F.col(_BUCKET).isin(list(numbers)))

    def find(self, wanted: DataFrame) -> DataFrame:
        """The stored rows with one of the wanted keys."""
        wanted = wanted.select(*self.keys).where(self._has_key()).distinct()
        near = self.read_buckets(wanted.sparkSession, self.touched(wanted)).drop(_BUCKET)
        return near.join(measured(wanted), list(self.keys), "left_semi").select(self.schema.names)

    def _not_older(self, staged: DataFrame, there: DataFrame, version: str) -> DataFrame:
        """Staged rows but for those that are not newer than the stored row of their key."""
        known = there.select(*self.keys, version).join(measured(staged.select(*self.keys).distinct()), list(self.keys), "left_semi")
        known = known.select(*[F.col(k).alias(f"__of_{k}") for k in self.keys], F.col(version).alias("__stored"))
        met = join_spread(staged, known, {k: f"__of_{k}" for k in self.keys})
        return met.where(F.coalesce(F.col(version) > F.col("__stored"), F.col("__stored").isNull())).select(self.schema.names)

    def merge(self, staged: DataFrame, update_cols: Sequence[str], newest_by: Sequence[Column] | None = None, batch: str = "0",
              version: str | None = None, once: bool = False) -> list[int]:
        """Upsert the staged rows and return the numbers of the buckets that were written.

        With a `version` column, staged rows no newer than what is stored are late and change nothing.
        Staged rows that are read from files and have no key twice, as those of `load_changes`, may say `once`:
        they are then neither written nor shuffled to find that out.
        """
        spark, pending = staged.sparkSession, self._pending(batch)
        if not _exists(spark, f"{pending}/done/_SUCCESS"):
            _remove(spark, f"{self.root}/pending")  # earlier batches are in the table
            staged = staged.select(self.schema.names)
            staged = staged if once else staged_table(staged, "staged")
            numbers = self.touched(staged)
            there = self.read_buckets(spark, numbers).drop(_BUCKET)
            if version is not None:
                staged = staged_table(self._not_older(staged, there, version), "in_time")
            self._write(upsert(there, staged.where(self._has_key()), self.keys, update_cols, newest_by, once), f"{pending}/keyed")
            self._write_keyless(staged.where(~self._has_key()), f"{pending}/keyless", batch)
            spark.createDataFrame([(n,) for n in numbers], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{pending}/done")
        self._put(self._stored(spark, f"{pending}/keyed", _BUCKET, T.IntegerType()), self._keyed)  # files of one bucket each, which need no shuffle
        self._write_keyless(self._stored(spark, f"{pending}/keyless", _BATCH, T.StringType()).drop(_BATCH), self._keyless, batch)
        return sorted(r.bucket for r in spark.read.parquet(f"{pending}/done").collect())
