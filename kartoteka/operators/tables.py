"""Writing tables: append, insert-if-absent and upsert.

Plain files have no row-level changes. `insert_if_absent` returns only the rows to
append; `upsert` returns the whole new table, to be written next to the old one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.operators.aggregates import counted
from kartoteka.operators.joins import join_spread, measured
from kartoteka.operators.project import with_audit
from kartoteka.operators.topk import best_per_key
from kartoteka.session import scratch

_MATCHED = "__matched"

# Columns an update leaves as they are (fixed values).
KEPT_ON_UPDATE = ("id_guid_sk", "__ingested_at")


def append_audited(df: DataFrame, target: str, source: str, as_of: datetime | None = None,
                   fmt: str = "parquet") -> int:
    """Append rows with audit columns to a folder and return how many were written.

    Executors write their own partitions; the count is taken while writing.
    """
    rows, seen = counted(with_audit(df, source, as_of), "appended")
    rows.write.mode("append").format(fmt).save(target)
    return seen.get["rows"]


def register(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def insert_if_absent(target: DataFrame, staged: DataFrame, keys: Sequence[str],
                     prefer: Sequence[str | Column]) -> DataFrame:
    """Staged rows whose key the target lacks, one per key: the first by `prefer`.

    A key with a NULL in it is equal to no other: such rows are all returned, and pass by
    the join. The target is only asked which of the staged keys it has. That reads its key
    columns alone and shuffles nothing while the staged keys are few.
    """
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = best_per_key(staged.where(has_key), keys, prefer)
    known = target.select(*keys).join(measured(first.select(*keys)), list(keys), "left_semi")
    fresh = first.join(known, list(keys), "left_anti").select(*staged.columns)
    return fresh.unionByName(staged.where(~has_key))


def latest_staged(staged: DataFrame, keys: Sequence[str], newest_by: Sequence[Column] | None) -> DataFrame:
    """One staged row per key. Without an order a repeated key is an error, as in MERGE."""
    if newest_by:
        return best_per_key(staged, keys, list(newest_by))
    names = [c for c in staged.columns if c not in keys]
    once = staged.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.any_value(F.struct(*names)).alias("__row"))
    checked = F.when(F.col("__n") > 1, F.raise_error(F.lit("staged rows repeat a key"))).otherwise(F.col("__row"))
    return once.select(*keys, checked.alias("__row")).select(*keys, "__row.*").select(*staged.columns)


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str], update_cols: Sequence[str],
           newest_by: Sequence[Column] | None = None, once: bool = False) -> DataFrame:
    """The target after a merge: matched rows take the staged `update_cols`, new keys are added.

    A staged NULL overwrites. Staged rows without a key match nothing, so they are all
    added; target rows without a key stay. A small staged side is broadcast, and the
    target then passes through without a shuffle. With `once` no staged key repeats.
    """
    keyed = staged.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    keyless = staged.where(F.expr(" OR ".join(f"`{k}` IS NULL" for k in keys)))
    latest = keyed if once else latest_staged(keyed, keys, newest_by)

    new_names = {c: f"__new_{c}" for c in [*keys, *update_cols]}
    changes = latest.select(*[F.col(c).alias(n) for c, n in new_names.items()], F.lit(True).alias(_MATCHED))
    merged = join_spread(target, measured(changes), {k: new_names[k] for k in keys})
    updated = merged.select(*[
        F.when(F.col(_MATCHED), F.col(new_names[c])).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c)
        for c in target.columns
    ])

    known = target.select(*keys).join(measured(latest.select(*keys)), list(keys), "left_semi")
    added = latest.join(known, list(keys), "left_anti").unionByName(keyless)
    return updated.unionByName(added.select(*target.columns))


def merge_into(table: str, staged: DataFrame, keys: Sequence[str], update_cols: Sequence[str]) -> None:
    """The same merge as a row-level change, for catalogs that support it."""
    on = [F.col(f"{table}.{k}") == F.col(f"staged.{k}") for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    (
        staged.alias("staged").mergeInto(table, condition)
        .whenMatched().update({c: F.col(f"staged.{c}") for c in update_cols})
        .whenNotMatched().insertAll()
        .merge()
    )


def staged_table(df: DataFrame, name: str) -> DataFrame:
    """Write rows that several steps read to the shared folder, and read them back.

    The steps then neither compute them again nor lose them with an executor.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
