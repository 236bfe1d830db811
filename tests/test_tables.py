from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.operators import contracts as ct
from kartoteka.operators import tables as tb
from kartoteka.operators.validate import USER_SOURCE
from kartoteka.plans.load import ITEM_UPDATES, incremental_upsert, staged_items

SCHEMA = "k int, id_guid_sk string, v string, __ingested_at int, __updated_at int"
UPDATES = ["v", "__updated_at"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def target(spark):
    return spark.createDataFrame([(1, "g1", "a", 1, 1), (2, "g2", "b", 1, 1), (None, "u", "user", 1, 1)], SCHEMA)


def test_upsert(spark):
    staged = spark.createDataFrame([(2, "new", None, 2, 2), (3, "g3", "c", 2, 2), (None, "v", "user", 2, 2)], SCHEMA)
    assert rows(tb.upsert(target(spark), staged, ["k"], UPDATES)) == sorted([
        (1, "g1", "a", 1, 1), (2, "g2", None, 1, 2), (None, "u", "user", 1, 1), (3, "g3", "c", 2, 2), (None, "v", "user", 2, 2)], key=str)


def test_upsert_twice_is_upsert_once(spark):
    staged = spark.createDataFrame([(2, "new", "z", 2, 2), (3, "g3", "c", 2, 2)], SCHEMA)
    once = tb.upsert(target(spark), staged, ["k"], UPDATES)
    assert rows(tb.upsert(once, staged, ["k"], UPDATES)) == rows(once)


def test_upsert_of_nothing_changes_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rows(tb.upsert(target(spark), none, ["k"], UPDATES)) == rows(target(spark))
    assert rows(incremental_upsert(target(spark), none, ["k"], UPDATES)) == rows(target(spark))


def test_upsert_repeated_key(spark):
    staged = spark.createDataFrame([(2, "x", "old", 2, 2), (2, "y", "new", 2, 3)], SCHEMA)
    latest = tb.upsert(target(spark), staged, ["k"], UPDATES, newest_by=[F.col("__updated_at").desc()])
    assert (2, "g2", "new", 1, 3) in rows(latest) and latest.count() == 3
    with pytest.raises(Exception, match="repeat a key"):
        tb.upsert(target(spark), staged, ["k"], UPDATES).collect()


def test_insert_if_absent(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    staged = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    added = tb.insert_if_absent(have, staged, ["k"], ["v"])
    assert rows(added) == [(2, "c")]
    assert rows(tb.insert_if_absent(have.unionByName(added), staged, ["k"], ["v"])) == []


def test_append_audited(spark, tmp_path):
    path, at = str(tmp_path / "t"), datetime(2024, 1, 1)
    assert tb.append_audited(spark.range(5), path, "a", at) == 5
    assert tb.append_audited(spark.range(7), path, USER_SOURCE, at) == 7
    assert tb.append_audited(spark.range(0), path, "a", at) == 0
    stored = spark.read.parquet(path)
    assert rows(stored.groupBy("__source").count()) == [("a", 5), (USER_SOURCE, 7)]
    assert dict(stored.dtypes)["__ingested_at"] == "timestamp"


def test_register(spark):
    tb.register({"v_one": spark.range(1), "v_two": spark.range(2)})
    assert spark.sql("SELECT count(*) FROM v_one, v_two").first()[0] == 2


def test_merge_into_needs_a_row_level_catalog(spark, tmp_path):
    spark.sql(f"CREATE TABLE plain_items (k INT, v STRING) USING parquet LOCATION '{tmp_path}/plain'")
    try:
        with pytest.raises(Exception, match="UNSUPPORTED_FEATURE|MERGE"):
            tb.merge_into("plain_items", spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], ["v"])
    finally:
        spark.sql("DROP TABLE plain_items")


def test_staged_items_filters_before_joining(spark):
    listings = spark.createDataFrame([("g", "1", "Beef", "Peru", "Dish"), ("h", "2", "Beef", "Peru", "Old")],
                                     "id_guid_sk string, external_id_meal string, category_name string, country string, meal string")
    categories = spark.createDataFrame([("c1", "Beef")], "id_guid_sk string, name string")
    places = spark.createDataFrame([("Peru", "South")], "country string, region string")
    entry = "map<string,struct<ingredient:string,measure:string>>"
    details = spark.createDataFrame(
        [("1", "Cook", {"1": ("a", "b")}, "i", "v", "s", "2024-03-01"), ("2", "Cook", {}, "i", "v", "s", "2023-01-01")],
        f"external_id string, instructions string, ingredient_measure {entry}, image string, video string, source_url string, date_modified string")
    staged = staged_items(listings, categories, places, details, "api", datetime(2024, 3, 31), 30)
    assert [r.external_id_meal for r in staged.collect()] == [1]
    stored = staged.withColumns({"id_guid_sk": F.lit("kept"), "name_meal": F.lit("before"), "__ingested_at": F.lit(datetime(2020, 1, 1)).cast("timestamp")})
    merged = incremental_upsert(stored, staged).first()
    assert (merged.id_guid_sk, merged.name_meal, merged["__ingested_at"].year, merged["__updated_at"].year) == ("kept", "Dish", 2020, 2024)
    assert set(ITEM_UPDATES) | {"id_guid_sk", "__ingested_at", "external_id_meal"} == set(staged.columns)


CONTRACT = ct.Contract(
    T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), False),
                  T.StructField("note", T.StringType())]), unique=(("id",), ("id", "name")), defaults={"note": "none"})


def test_contract_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (3, None)], "id int, name string")
    assert rows(ct.contract_report(df, CONTRACT)) == [
        ("not null id", 2), ("not null name", 1), ("unique id", 2), ("unique id, name", 1)]
    assert ("not null name", 1) not in rows(ct.contract_report(df, ct.relax(CONTRACT, "name")))
    assert rows(ct.duplicate_keys(df.where("id is not null"), ["id"])) == [(1, 3)]


def test_apply_defaults(spark):
    df = spark.createDataFrame([("1", "a", None), ("2", None, "x")], "id string, name string, note string")
    filled = ct.apply_defaults(df, CONTRACT)
    assert rows(filled) == [(1, "a", "none"), (2, None, "x")] and filled.columns == ["id", "name", "note"]
    assert rows(ct.apply_defaults(df.select("id"), CONTRACT)) == [(1, None, "none"), (2, None, "none")]


def test_catalogue_contracts_hold_for_defaulted_rows(spark):
    for name, contract in ct.catalogue_contracts("api").items():
        row = spark.range(1).select(*[
            (F.array(F.lit(1.0)) if isinstance(f.dataType, T.ArrayType) else F.lit("1")).cast(f.dataType).alias(f.name)
            for f in contract.schema.fields if f.name not in contract.defaults])
        report = ct.contract_report(ct.apply_defaults(row, contract), contract)
        assert {r.violations for r in report.collect()} == {0}, name
    assert "external_id_meal" not in ct.catalogue_contracts("api")["recipe"].required
