from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from kartoteka.operators import aggregates as ag
from kartoteka.operators.filters import keyword_search, modified_since, null_rows
from kartoteka.operators.project import card_projection, item_view, rename_select, with_audit
from kartoteka.operators.topk import best_per_key, first_match, merge_top, page, page_after, top_per_key


def rows(df):
    return [tuple(r) for r in df.collect()]


def catalogue(spark):
    items = spark.createDataFrame(
        [(1, "b", "g1", "Peru"), (2, "a", None, "Peru"), (3, "c", "g1", "Nowhere"), (4, "a", "g9", "Peru")],
        "id int, name string, guid string, country string")
    categories = spark.createDataFrame([("g1", "Beef")], "guid string, label string")
    places = spark.createDataFrame([("Peru", "flag")], "country string, flag string")
    return items, categories, places


def test_item_view_keeps_missing_category_and_drops_missing_place(spark):
    items, categories, places = catalogue(spark)
    columns = {"id": "i.id", "category": "c.label"}
    keys = dict(category_key=("guid", "guid"), place_key=("country", "country"))
    assert sorted(rows(item_view(items, categories, **keys, columns=columns)), key=str) == [
        (1, "Beef"), (2, None), (3, "Beef"), (4, None)]
    both = item_view(items, categories, places, **keys, columns={**columns, "flag": "p.flag"})
    assert sorted(rows(both), key=str) == [(1, "Beef", "flag"), (2, None, "flag"), (4, None, "flag")]


def test_pages_follow_each_other(spark):
    items = spark.createDataFrame([(i, f"n{i % 3}") for i in range(20)], "id int, name string")
    order = ["name", "id"]
    pages = [rows(page(items, order, 6, offset)) for offset in (0, 6, 12, 18)]
    assert sum(pages, []) == rows(items.orderBy(*order))
    last = pages[0][-1]
    assert rows(page_after(items, order, [last[1], last[0]], 6)) == pages[1]
    assert rows(first_match(items, order)) == [(0, "n0")]


def test_keyword_search_is_literal_and_distinct(spark):
    df = spark.createDataFrame([(1, "50%_ off", "x"), (1, "y", "50%_"), (2, "50 off", None), (3, None, None)],
                               "id int, a string, b string")
    assert rows(keyword_search(df, "50%_", ["a", "b"], ["id"])) == [(1,)]
    assert sorted(rows(keyword_search(df, "50%", ["a", "b"], ["id"], pattern=True))) == [(1,), (2,)]


def test_modified_since_includes_the_boundary_day(spark):
    days = ["2024-03-01", "2024-02-29", "2024-13-05", None, "2024-03-05 10:00:00", "2024-04-09"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, d string")
    assert sorted(r.id for r in modified_since(df, "d", date(2024, 3, 31), 30).collect()) == [0, 4, 5]


def test_null_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert rows(null_rows(df, "v")) == [(1, None)]


def test_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, None)], "id int, g string")
    assert sorted(rows(ag.group_count(df, "g")), key=str) == [("a", 2), ("b", 1), (None, 1)]
    assert sorted(rows(ag.coverage_stats(df.where("g is not null"), "g", "id"))) == [("a", 2, 2), ("b", 1, 1)]
    assert sorted(rows(ag.table_counts({"x": df, "y": df.limit(1)}))) == [("x", 4), ("y", 1)]
    facets = spark.createDataFrame([("a", "A"), ("z", "Z")], "g string, label string")
    assert sorted(rows(ag.facet_counts(facets, df.withColumnRenamed("g", "f"), "g", "f", "label"))) == [("A", 2), ("Z", 0)]
    assert [r[0] for r in ag.distinct_values(df, "g", 2).collect()] == ["a", "b"]


def test_approximate_coverage_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"))
    for r in ag.coverage_stats(df, "g", "k", approximate=True).collect():
        assert r.total == 10000 and abs(r.unique_keys - 10000) < 1500


def test_counted_needs_no_second_job(spark):
    df, seen = ag.counted(spark.range(123), "rows")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 123


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2)], "b string, id int")
    assert sorted(rows(ag.union_all_by_name([a, b]))) == [(1, "x", None), (2, None, "y")]


def test_best_per_key_breaks_ties(spark):
    df = spark.createDataFrame([("k", 0.5, 1), ("k", 0.5, 0), ("k", 0.1, 2), ("l", 0.2, 3)], "key string, s double, chunk int")
    best = best_per_key(df, ["key"], [F.col("s").desc(), F.col("chunk")])
    assert sorted(rows(best)) == [("k", 0.5, 0), ("l", 0.2, 3)]


def test_merge_top_equals_top_per_key_with_a_hot_key(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"),
                                  F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id")
    order = [F.col("v").desc(), F.col("id")]
    assert sorted(rows(merge_top(df, ["key"], order, 5, ["id"], "rank"))) == sorted(rows(top_per_key(df, ["key"], order, 5, "rank")))


def test_rename_select_and_audit(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = with_audit(rename_select(df, {"y": "b", "x": F.col("a") + 1}), "src")
    assert out.columns == ["y", "x", "__source", "__ingested_at", "__updated_at"]
    assert out.first()[:3] == ("x", 2, "src")


def test_cards(spark):
    def text(n):
        return "{" + ",".join(f'"{i}":{{"ingredient":"c{i}","measure":"{i if i % 2 else ""}"}}' for i in range(1, n + 1)) + "}"

    df = spark.createDataFrame([(1, "", "N", text(10), "x" * 201, 0.824), (2, "M", "N", text(2), "x" * 200, 0.0)],
                               "id int, a string, b string, c string, t string, s double")
    one, two = sorted(rows(card_projection(df, key="id", names=["a", "b"], components="c", text="t", similarity="s")))
    lines = one[2].split("\n")
    assert one[:2] == (1, "N") and len(lines) == 9 and lines[:2] == ["- c1 : 1", "- c2"] and lines[-1] == "+2 more..."
    assert one[3] == "x" * 200 + "..." and one[4] == "82% match"
    assert two == (2, "M", "- c1 : 1\n- c2", "x" * 200, None)


def test_counts_are_merged_from_loads(spark, tmp_path):
    from kartoteka.operators.aggregates import store_counts, stored_counts
    rows = spark.range(9000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 10 > 0, F.col("id") % 4000).alias("k"))
    for load in range(3):
        for _ in range(1 + load % 2):  # one of them twice
            store_counts(rows.where(F.col("k") % 3 == load), str(tmp_path), str(load), "g", "k")
    exact = {r.g: (r.n, r.k) for r in rows.where("k is not null").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("k").alias("k")).collect()}
    got = {r.group: (r.total, r.unique_keys) for r in stored_counts(spark, str(tmp_path)).collect()}
    assert {g: n for g, (n, _) in got.items()} == {g: n for g, (n, _) in exact.items()}
    assert all(abs(got[g][1] - k) <= 0.05 * k for g, (_, k) in exact.items())
