"""User submissions: checks, hints and accepted items."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.operators.aggregates import union_all_by_name
from kartoteka.operators.tables import append_audited
from kartoteka.operators.validate import USER_SOURCE, place_hints, to_items, validate_submissions
from kartoteka.registry.base import Query, key_sql, table
from kartoteka.registry.landed import SUBMITTED, submitted_orders
from kartoteka.session import scratch
from kartoteka.sources.landing import read_submissions
from kartoteka.sources.stored import read_table

AS_OF = datetime(2024, 3, 31)


def dims(spark, folder) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    categories = orders.select(F.col("o_orderpriority").alias("name")).distinct().withColumn(
        "id_guid_sk", F.concat(F.lit("cat "), "name"))
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return categories, places


def checked(spark, folder):
    accepted, rejected = validate_submissions(submitted_orders(spark, folder), *dims(spark, folder))
    shown = union_all_by_name([accepted.drop("instructions", "ingredient_measure"), rejected])
    return shown.select("submission", "country", "guid_category", "region", "reason", "hint",
                        F.array_join("available_places", "|").alias("available_places"),
                        F.array_join("valid_categories", "|").alias("valid_categories"))


def unreadable(spark, folder):
    """Submissions of which every thirteenth broke off on its way: they are rejected, the others are judged as ever."""
    rows = submitted_orders(spark, folder)
    text = F.to_json(F.struct(*rows.columns))
    path = scratch(spark, "submissions")
    rows.select(F.when(F.col("submission") % 13 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value")).write.text(path)
    read = read_submissions(spark, path, T.StructType([T.StructField("submission", T.LongType())]), strict=False)
    accepted, rejected = validate_submissions(read, *dims(spark, folder))
    shown = union_all_by_name([accepted.select("submission"), rejected.select("submission", "reason", "unreadable")])
    return shown.groupBy("reason").agg(F.count("*").alias("n"), F.sum("submission").alias("ids"), F.max(F.length("unreadable")).alias("longest"))


def hints(spark, folder):
    hint = place_hints(dims(spark, folder)[1])
    return hint.select(F.array_join("available_places", "|").alias("available_places"), "hint")


def accepted_items(spark, folder):
    """Accepted submissions, appended to a table and read back."""
    accepted, _ = validate_submissions(submitted_orders(spark, folder), *dims(spark, folder))
    target = scratch(spark, "items")
    append_audited(to_items(accepted, "submission", AS_OF), target, USER_SOURCE, AS_OF)
    stored = read_table(spark, target)
    entry = F.from_json("ingredient_measure", "map<string,struct<ingredient:string,measure:string>>")
    return stored.select(
        "id_guid_sk", "external_id_meal", "name_meal", "guid_category", "country", "region", "instructions",
        "image_recipe", "video_recipe", "source_url", "date_modified", "__source",
        entry["1"]["measure"].alias("box"), entry["3"]["measure"].alias("tag"), F.size(entry).alias("n_entries"))


_CHECKED = f"""
    SELECT s.*, n_name, r_name, o_pri,
           CASE WHEN trim(coalesce(category, '')) = '' THEN 'category is required'
                WHEN o_pri IS NULL THEN 'category not found'
                WHEN trim(coalesce(country, '')) = '' THEN 'country is required'
                WHEN n_name IS NULL THEN 'country not found'
                WHEN trim(coalesce(name, '')) = '' THEN 'name is required' END AS reason
    FROM (SELECT o_orderkey, o_custkey, o_orderstatus, {SUBMITTED["name_meal"]} AS name,
                 {SUBMITTED["category"]} AS category, {SUBMITTED["country"]} AS country FROM orders) s
    LEFT JOIN (SELECT DISTINCT o_orderpriority AS o_pri FROM orders) ON lower(trim(category)) = lower(o_pri)
    LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
        ON lower(trim(country)) = lower(n_name)
"""
_FIRST = "(SELECT list(n_name ORDER BY n_name) FROM (SELECT n_name FROM nation ORDER BY n_name LIMIT {n}))"
_HINT = f"'Try one of: ' || array_to_string({_FIRST.format(n=10)}, ', ')"

QUERIES = {
    "unreadable_submissions": Query(unreadable, f"""
        SELECT 'not readable' AS reason, count(*) AS n, NULL::BIGINT AS ids, 40 AS longest FROM orders WHERE o_orderkey % 13 = 0
        UNION ALL SELECT reason, count(*), sum(o_orderkey)::BIGINT, NULL FROM ({_CHECKED}) WHERE o_orderkey % 13 <> 0 GROUP BY reason"""),
    "validate_submissions": Query(checked, f"""
        SELECT o_orderkey AS submission, CASE WHEN reason IS NULL THEN n_name ELSE coalesce(n_name, country) END AS country,
               CASE WHEN reason IS NULL THEN 'cat ' || o_pri END AS guid_category,
               CASE WHEN reason IS NULL THEN r_name END AS region, reason,
               CASE WHEN reason = 'country not found' THEN {_HINT} END AS hint,
               CASE WHEN reason = 'country not found' THEN array_to_string({_FIRST.format(n=20)}, '|') END AS available_places,
               CASE WHEN reason = 'category not found' THEN (
                   SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders) END AS valid_categories
        FROM ({_CHECKED})"""),
    "place_hints": Query(hints, f"""
        SELECT array_to_string({_FIRST.format(n=20)}, '|') AS available_places, {_HINT} AS hint"""),
    "accepted_items": Query(accepted_items, f"""
        SELECT {key_sql("'input_user'", "o_orderkey::VARCHAR")} AS id_guid_sk, NULL::INT AS external_id_meal,
               'Order ' || o_orderkey AS name_meal, 'cat ' || o_pri AS guid_category, n_name AS country, r_name AS region,
               'Pack ' || o_orderstatus AS instructions, '' AS image_recipe, 'http://video' AS video_recipe,
               'http://src/' || o_orderkey AS source_url, '2024-03-31 00:00:00' AS date_modified,
               'input_user' AS __source, o_custkey || 'g' AS box, o_orderstatus AS tag, 2 AS n_entries
        FROM ({_CHECKED}) WHERE reason IS NULL"""),
}
