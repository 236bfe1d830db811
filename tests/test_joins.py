from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartoteka.operators import joins


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=["broadcast", "shuffle"])
def either_way(spark, request, monkeypatch):
    """Run a test with small sides broadcast, and again with everything shuffled."""
    if request.param == "shuffle":
        monkeypatch.setattr(joins.measured, "__defaults__", (-1,))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unprocessed_keeps_items_without_a_key(spark, either_way):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "c")], "k int, v string")
    done = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert rows(joins.unprocessed(items, done, ["k"])) == [(2, "b"), (None, "c"), (None, "c")]


def test_join_spread_left_and_anti(spark, either_way):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "j int, w string")
    assert rows(joins.join_spread(left, right, {"k": "j"})) == [
        (1, "a", 1, "x"), (1, "a", 1, "y"), (2, "b", None, None), (None, "c", None, None)]
    assert rows(joins.join_spread(left, right, {"k": "j"}, "left_anti")) == [(2, "b"), (None, "c")]


def test_rows_without_a_key_spread_over_tasks(spark, either_way):
    if either_way == "broadcast":
        pytest.skip("nothing is shuffled")
    left = spark.range(20000).select(F.lit(None).cast("int").alias("k"), "id")
    right = spark.createDataFrame([(1,)], "j int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = joins.join_spread(left, right, {"k": "j"}).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 4 * 20000 / 8


def test_dim_lookup(spark, either_way):
    df = spark.createDataFrame([(1, "Turkey"), (2, "Peru"), (3, "?"), (4, None)], "id int, country string")
    dim = spark.createDataFrame([("Peru", "P1", 1), ("Peru", "P2", 2), ("Turkey", "T", 1), (None, "N", 1)],
                                "name string, code string, at int")
    last = joins.dim_lookup(df, dim, ("country", "name"), {"acronym": "code"}, last_by=[F.col("at").desc()])
    assert rows(last) == [(1, "Turkey", "T"), (2, "Peru", "P2"), (3, "?", None), (4, None, None)]


def test_resolve_names_in_any_case(spark, either_way):
    df = spark.createDataFrame([(1, " itALY "), (2, "nowhere"), (3, " "), (4, None)], "id int, country string")
    dim = spark.createDataFrame([("Italy", "Europe"), ("ITALY", "first")], "country string, region string")
    got = joins.resolve_names(df, "country", dim, "country", {"place": "country", "region": "region"})
    assert [(r.id, r.place, r.region) for r in got.orderBy("id").collect()] == [
        (1, "ITALY", "first"), (2, None, None), (3, None, None), (4, None, None)]


def test_denormalize_is_an_inner_join(spark, either_way):
    listings = spark.createDataFrame([("g", "1", "Beef", "Peru", "Dish"), ("h", "2", "Beef", "?", "Lost"), ("i", "x", None, "Peru", "Odd")],
                                     "id_guid_sk string, external_id_meal string, category_name string, country string, meal string")
    categories = spark.createDataFrame([("c1", "Beef")], "id_guid_sk string, name string")
    places = spark.createDataFrame([("Peru", "South", "a"), ("Peru", "South", "b")], "country string, region string, cuisine string")
    details = spark.createDataFrame([("1", "Cook", {"1": ("a", "b")}, "i", "v", "s", "2024-01-01")],
                                    "external_id string, instructions string, "
                                    "ingredient_measure map<string,struct<ingredient:string,measure:string>>, "
                                    "image string, video string, source_url string, date_modified string")
    got = joins.denormalize(listings, categories, places, details).collect()
    assert len(got) == 1  # a place listed for two cuisines does not repeat the item
    assert got[0].asDict() == {
        "id_guid_sk": "g", "external_id_meal": 1, "name_meal": "Dish", "guid_category": "c1", "country": "Peru", "region": "South",
        "instructions": "Cook", "ingredient_measure": '{"1":{"ingredient":"a","measure":"b"}}', "image_recipe": "i",
        "video_recipe": "v", "source_url": "s", "date_modified": "2024-01-01"}


def test_measured_marks_only_small_sides(spark):
    small = spark.createDataFrame([(1, "x" * 100)], "k int, v string")
    plan = lambda df: spark.range(10).join(df, F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.measured(small)) and "broadcast" not in plan(joins.measured(small, max_bytes=50))


def test_hot_keys_are_measured(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).when(F.col("id") % 50 == 4, None).otherwise(F.col("id") + 100).alias("k"))
    assert sorted(joins.hot_keys(df, "k")) == [7, 8]
    assert joins.hot_keys(df.where("k > 100"), "k") == [] == joins.hot_keys(df.limit(0), "k")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_leaves_no_large_task(spark, how):
    left = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 5000).alias("k")).repartition(8)
    right = spark.range(4000).select(F.col("id").alias("key"), F.concat(F.lit("v"), "id").alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = joins.join_hot(left, right, {"k": "key"}, how)
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        rows = sorted((r.id, r.v or "") for r in joined.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = sorted((r.id, r.v or "") for r in left.join(right, F.col("k") == F.col("key"), how).collect())
    assert rows == expected
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]
