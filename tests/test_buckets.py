from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kartoteka.operators.buckets import KeyBuckets
from kartoteka.plans.load import load_changes, load_into, loaded_table

SCHEMA = "k string, part int, v string, note string"


def store(spark, tmp_path, buckets=16, keys=("k",)):
    return KeyBuckets(str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, keys, buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = store(spark, tmp_path)
    table.create(spark.createDataFrame([(f"k{i}", i, "old", None) for i in range(500)] + [(None, 1, "no key", None)] * 3, SCHEMA))
    before = files(tmp_path / "t" / "keyed")
    staged = spark.createDataFrame([("k3", 0, "new", "n"), ("fresh", 0, "new", None), (None, 2, "no key", None)], SCHEMA)
    written = table.merge(staged, ["v"], batch="a")
    assert written == table.touched(staged) and 1 <= len(written) <= 2
    after = files(tmp_path / "t" / "keyed")
    kept = {f for f in before if int(f.split("__bucket=")[1].split("/")[0]) not in written}
    assert len(kept) >= 14 and all(before[f] == after.get(f) for f in kept)
    assert not any(f in after for f in before if f not in kept)
    got = rows(table.read(spark))
    assert len(got) == 505 and ("k3", 3, "new", None) in got and ("fresh", 0, "new", None) in got and got.count((None, 1, "no key", None)) == 3


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = store(spark, tmp_path)
    table.create(spark.createDataFrame([("a", 1, "old", None)], SCHEMA))
    staged = spark.createDataFrame([("a", 1, "new", None), (None, 1, "x", None), ("b", 2, None, None)], SCHEMA)
    table.merge(staged, ["v"], batch="7")
    once = rows(table.read(spark))
    table.merge(staged, ["v"], batch="7")
    assert rows(table.read(spark)) == once == rows(spark.createDataFrame([("a", 1, "new", None), (None, 1, "x", None), ("b", 2, None, None)], SCHEMA))


def test_a_batch_that_failed_while_it_was_moved_in(spark, tmp_path, monkeypatch):
    table = store(spark, tmp_path)
    table.create(spark.createDataFrame([(f"k{i}", i, "old", None) for i in range(50)], SCHEMA))
    staged = spark.createDataFrame([(f"k{i}", 0, "new", None) for i in range(0, 50, 5)] + [(None, 0, "x", None)], SCHEMA)
    whole = KeyBuckets._write_keyless

    def fails(self, df, path, batch):
        if "pending" not in path:
            raise OSError("lost")
        whole(self, df, path, batch)

    monkeypatch.setattr(KeyBuckets, "_write_keyless", fails)
    with pytest.raises(OSError, match="lost"):
        table.merge(staged, ["v"], batch="1")
    monkeypatch.undo()
    table.merge(staged, ["v"], batch="1")
    got = rows(table.read(spark))
    assert len(got) == 51 and sum(r[2] == "new" for r in got) == 10


def test_nothing_staged_and_nothing_stored(spark, tmp_path):
    table, none = store(spark, tmp_path), spark.createDataFrame([], SCHEMA)
    assert rows(table.read(spark)) == []
    assert table.merge(none, ["v"]) == [] and rows(table.read(spark)) == []
    assert table.merge(spark.createDataFrame([("a", 1, "x", None)], SCHEMA), ["v"], batch="1") != []
    assert rows(table.read(spark)) == [("a", 1, "x", None)]


def test_keys_of_two_columns_and_look_up(spark, tmp_path):
    table = store(spark, tmp_path, keys=("k", "part"))
    table.create(spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("a", None, "z", None), ("b", 1, "w", None)], SCHEMA))
    table.merge(spark.createDataFrame([("a", 2, "Y", "n"), ("a", None, "Z", None)], SCHEMA), ["v", "note"])
    assert rows(table.read(spark)) == rows(spark.createDataFrame(
        [("a", 1, "x", None), ("a", 2, "Y", "n"), ("a", None, "z", None), ("a", None, "Z", None), ("b", 1, "w", None)], SCHEMA))
    wanted = spark.createDataFrame([("a", 2), ("c", 1), ("a", None)], "k string, part int")
    assert rows(table.find(wanted)) == [("a", 2, "Y", "n")]
    plan = table.find(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [__bucket" in plan


def test_late_rows(spark, tmp_path):
    table = store(spark, tmp_path)
    table.create(spark.createDataFrame([("a", 5, "old", None), ("b", None, "old", None)], SCHEMA))
    table.merge(spark.createDataFrame([("a", 4, "late", None), ("b", 1, "new", None), ("c", 0, "new", None)], SCHEMA), ["v", "part"], version="part")
    assert rows(table.read(spark)) == [("a", 5, "old", None), ("b", 1, "new", None), ("c", 0, "new", None)]


LOADED = "id_guid_sk string, name string, image string, __source string, __ingested_at int, __updated_at int"


def test_a_load_that_runs_twice_leaves_what_one_run_leaves(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("1", "a", None, "s", 1, 1), ("2", "b", "x", "s", 1, 1), ("2", "b", "x", "s", 1, 1)], LOADED)
    load_into(spark, {"category": first}, root, "1")
    once = rows(loaded_table(spark, "category", first.schema, root))
    again = load_into(spark, {"category": first.withColumn("__updated_at", F.lit(2))}, root, "2")
    assert [r.change for r in again["category"].collect()] == ["same", "same"]
    assert rows(loaded_table(spark, "category", first.schema, root)) == once and len(once) == 2
    later = spark.createDataFrame([("1", "a", "y", "s", 3, 3), ("3", "c", None, "s", 3, 3)], LOADED)
    assert sorted((r.id_guid_sk, r.change) for r in load_into(spark, {"category": later}, root, "3")["category"].collect()) == [("1", "changed"), ("3", "new")]
    assert rows(loaded_table(spark, "category", first.schema, root)) == [
        ("1", "a", "y", "s", 1, 3), ("2", "b", "x", "s", 1, 1), ("3", "c", None, "s", 3, 3)]


def test_null_and_empty_are_not_the_same(spark):
    stored = spark.createDataFrame([("1", None, "", "s", 1, 1)], LOADED)
    loaded = spark.createDataFrame([("1", "", None, "s", 1, 1)], LOADED)
    assert [r.change for r in load_changes(stored, loaded, ["id_guid_sk"]).collect()] == ["changed"]


def test_a_load_is_shuffled_once_for_each_look_at_it(spark, tmp_path, monkeypatch):
    plans = []
    put = KeyBuckets._put
    monkeypatch.setattr(KeyBuckets, "_put", lambda self, df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), put(self, df, path))[1])
    loaded = spark.createDataFrame([(f"{i}", "a", None, "s", 1, 1) for i in range(50)] + [(None, "n", None, "s", 1, 1)] * 2, LOADED)
    listed = load_into(spark, {"category": loaded}, str(tmp_path), "1")["category"]
    assert listed.count() == 51 and loaded_table(spark, "category", loaded.schema, str(tmp_path)).count() == 51
    # into the buckets of the batch, and from there into the table
    assert [p.count("Exchange ") for p in plans] == [1, 0]
    known = loaded.limit(9).localCheckpoint()
    met = load_changes(known, loaded.repartition(3), ["id_guid_sk"])._jdf.queryExecution().executedPlan().toString()
    assert met.count("Exchange hashpartitioning(id_guid_sk") == 1 and "__spread" not in met
