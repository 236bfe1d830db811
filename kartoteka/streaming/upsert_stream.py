"""The incremental upsert fed by a folder that new files land in, and the newest row of each key as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kartoteka.operators.buckets import KeyBuckets
from kartoteka.operators.topk import best_per_key

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _landed(spark: SparkSession, landing: str, schema: T.StructType, fmt: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(landing)


def upsert_stream(
    spark: SparkSession, landing: str, store: KeyBuckets, checkpoint: str, update_cols: Sequence[str],
    newest_by: Sequence[Column], version: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: T.StructType | None = None, fmt: str = "parquet", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Merge every file that has landed into a bucketed table, then stop.

    A batch rewrites the buckets of its keys. It is named after the query and its number, so that one
    that is run again after a failure gives the same table. With `version`, late rows change nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        store.merge(prepare(batch) if prepare else batch, update_cols, newest_by, f"{query}-{number}", version)

    landed = _landed(spark, landing, schema or store.schema, fmt, files_per_batch)
    return (
        landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


class NewestRow(StatefulProcessor):
    """Keeps the newest row of a key; gives it out when it has changed. Rows as old as it or older are ignored."""

    def __init__(self, schema: T.StructType, key: str, version: str):
        self.schema, self.key, self.version = schema, key, version
        self.names = [f.name for f in schema.fields if f.name != key]

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = T.StructType([f for f in self.schema.fields if f.name != self.key])
        self.newest = handle.getValueState("newest", kept)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            found = frame.loc[frame[self.version].idxmax()]
            if best is None or found[self.version] > best[self.version]:
                best = found
        stored = self.newest.get() if self.newest.exists() else None
        if stored is None or best[self.version] > stored[self.names.index(self.version)]:
            plain = [None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in (best[n] for n in self.names)]
            self.newest.update(tuple(plain))
            yield pd.DataFrame([[key[0], *plain]], columns=[self.key, *self.names])[self.schema.names].astype(
                {f.name: "object" for f in self.schema.fields if isinstance(f.dataType, T.StringType)})

    def close(self) -> None:
        pass


def newest_stream(
    spark: SparkSession, landing: str, schema: T.StructType, key: str, version: str, changes: str, checkpoint: str,
    fmt: str = "parquet", files_per_batch: int = 1000,
) -> StreamingQuery:
    """Keep the newest row of each key in a state store and append what changes to a log, then stop.

    No table is rewritten. Rows without key or version are left out. A batch replaces its own folder of the log when it is run again.
    """
    spark.conf.set(_STATE_STORE, _ROCKS_DB)
    landed = _landed(spark, landing, schema, fmt, files_per_batch).where(F.col(key).isNotNull() & F.col(version).isNotNull())
    changed = landed.groupBy(key).transformWithStateInPandas(
        NewestRow(schema, key, version), outputStructType=schema, outputMode="Update", timeMode="None")

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return (
        changed.writeStream.foreachBatch(log).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def newest_rows(spark: SparkSession, schema: T.StructType, key: str, version: str, changes: str) -> DataFrame:
    """The newest row of every key, from the log of changes."""
    logged = spark.read.schema(schema).option("basePath", changes).parquet(changes)
    return best_per_key(logged.select(schema.names), [key], [F.col(version).desc()])
