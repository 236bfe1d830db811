"""Comparing every row of a large table with a set of probes, without a cross join.

Each task reads its own rows and keeps only the best few per probe, so pairs never
become rows. Probes travel to the tasks in blocks that were measured to be small: one
scan for each block. The rows are neither copied nor shuffled, however many blocks there
are, and the driver holds one block at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.operators.tables import staged_table
from kartoteka.session import scratch

MAX_PROBES = 4096
MAX_PROBE_BYTES = 16 * 1024 * 1024


class Kernel(Protocol):
    """What one task keeps while it reads rows."""

    def add(self, batch: pa.RecordBatch) -> None: ...

    def result(self) -> pa.RecordBatch: ...


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    """Arrow types of the flat result columns that kernels return."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema.fields])


def blocks_needed(probes: DataFrame, width: Column, max_probes: int = MAX_PROBES,
                  max_bytes: int = MAX_PROBE_BYTES) -> int:
    """How many pieces the probes make when each must stay under both limits."""
    rows, size = probes.agg(F.count("*"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0))).first()
    return max(1, math.ceil(rows / max_probes), math.ceil(size / max_bytes))


def scan_probes(
    data: DataFrame, probes: DataFrame, build: Callable[[pa.Table], Kernel], schema: T.StructType,
    *, probe_key: Sequence[str], width: Column, max_probes: int = MAX_PROBES, max_bytes: int = MAX_PROBE_BYTES,
) -> DataFrame:
    """The kernels' results, one set per task and block of probes; the caller merges them."""
    blocks = blocks_needed(probes, width, max_probes, max_bytes)

    def scanned(held: pa.Table) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            kernel = build(held)
            for batch in batches:
                kernel.add(batch)
            yield kernel.result()

        return data.mapInArrow(scan, schema)

    if blocks == 1:
        return scanned(probes.toArrow())
    spark, found = data.sparkSession, scratch(data.sparkSession, "scanned")
    dealt = staged_table(probes.withColumn("__block", F.pmod(F.xxhash64(*probe_key), F.lit(blocks)).cast("int")), "probes")
    for block in range(blocks):
        scanned(dealt.where(F.col("__block") == block).drop("__block").toArrow()).write.mode("append").parquet(found)
    return spark.read.schema(schema).parquet(found)
