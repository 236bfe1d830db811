from __future__ import annotations

from pyspark.sql import functions as F

from kartoteka.operators.buckets import KeyBuckets
from kartoteka.streaming.upsert_stream import newest_rows, newest_stream, upsert_stream

SCHEMA = "k int, v string, at int"


def stored(spark, tmp_path, rows):
    store = KeyBuckets(str(tmp_path / "root"), spark.createDataFrame([], SCHEMA).schema, ("k",), 4)
    store.create(spark.createDataFrame(rows, SCHEMA))
    return store


def run(spark, tmp_path, store, checkpoint="check", version=None):
    query = upsert_stream(spark, str(tmp_path / "landing"), store, str(tmp_path / checkpoint), ["v", "at"], [F.col("at").desc()], version, files_per_batch=1)
    query.awaitTermination()
    return query


def land(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))


def rows(df):
    return sorted(tuple(r) for r in df.fillna("-").collect())


def test_each_batch_is_merged(spark, tmp_path):
    store = stored(spark, tmp_path, [(1, "a", 0), (9, "z", 0)])
    land(spark, tmp_path, [(1, "b", 1), (1, "c", 2), (2, "x", 1)])
    run(spark, tmp_path, store)
    land(spark, tmp_path, [(2, "y", 3)])
    land(spark, tmp_path, [(3, "n", 3), (1, None, 4)])
    assert run(spark, tmp_path, store).lastProgress["batchId"] == 2
    assert rows(store.read(spark)) == [(1, "-", 4), (2, "y", 3), (3, "n", 3), (9, "z", 0)]


def test_files_read_again_give_the_same_table(spark, tmp_path):
    store = stored(spark, tmp_path, [(1, "a", 0)])
    land(spark, tmp_path, [(1, "b", 1), (2, "x", 1)])
    run(spark, tmp_path, store)
    once = rows(store.read(spark))
    run(spark, tmp_path, store, checkpoint="lost")  # the checkpoint is gone, so all files come again
    assert rows(store.read(spark)) == once == [(1, "b", 1), (2, "x", 1)]


def test_late_rows_change_nothing(spark, tmp_path):
    store = stored(spark, tmp_path, [(1, "a", 5)])
    land(spark, tmp_path, [(1, "late", 4), (2, "x", 1)])
    run(spark, tmp_path, store, version="at")
    land(spark, tmp_path, [(2, "late", 0), (1, "b", 6)])
    run(spark, tmp_path, store, version="at")
    assert rows(store.read(spark)) == [(1, "b", 6), (2, "x", 1)]


def test_newest_rows_are_kept_as_state(spark, tmp_path):
    schema, changes = spark.createDataFrame([], SCHEMA).schema, str(tmp_path / "changes")
    for batch in ([(1, "a", 1), (1, "b", 3), (2, None, 1), (None, "x", 9)], [(1, "late", 2), (1, "same", 3), (3, "n", 1)], [(2, "y", 2), (4, "v", None)]):
        land(spark, tmp_path, batch)
        newest_stream(spark, str(tmp_path / "landing"), schema, "k", "at", changes, str(tmp_path / "check")).awaitTermination()
    assert rows(newest_rows(spark, schema, "k", "at", changes)) == [(1, "b", 3), (2, "y", 2), (3, "n", 1)]
    logged = spark.read.parquet(changes)
    assert sorted((r.batch, r.k) for r in logged.collect()) == [(0, 1), (0, 2), (1, 3), (2, 2)]  # late rows make no change
