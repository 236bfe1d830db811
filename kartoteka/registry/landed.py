"""Responses landed as JSON files: reading them, and the loads built on them.

Each query first lands rows of the given tables the way responses arrive.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.nested import explode_components
from kartoteka.plans import load
from kartoteka.registry.base import Query, key_sql, land, table
from kartoteka.registry.shaping import REACHED_SQL, SLOTS, slots
from kartoteka.session import scratch
from kartoteka.sources import landing as src

SOURCE = "landing"
AS_OF = datetime(2024, 3, 31)


def enveloped(list_field: str, rows: Column, skip: Column | None = None) -> Column:
    """An envelope per row; skipped ones have no list."""
    return (rows if skip is None else F.when(~skip, rows)).alias(list_field)


def as_text(name: str, value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string").alias(name)


def landed_categories(spark, folder) -> str:
    supplier = table(spark, folder, "supplier")
    entry = F.struct(
        as_text("idCategory", "s_suppkey"), as_text("strCategory", "s_name"),
        as_text("strCategoryDescription", F.concat(F.lit("Nation "), "s_nationkey")),
        as_text("strCategoryThumb", F.concat(F.lit("http://img/"), F.lower("s_name"))))
    return land(supplier.select(enveloped("categories", F.array(entry), F.col("s_acctbal") < 2000)), "categories")


def category_envelopes(spark, folder):
    path = landed_categories(spark, folder)
    return load.categories_from(src.read_envelope(spark, path, "categories", src.CATEGORY_FIELDS), SOURCE)


def component_envelopes(spark, folder):
    """Two components per envelope."""
    part = table(spark, folder, "part")
    entry = lambda key, name: F.struct(
        as_text("idIngredient", key), as_text("strIngredient", name), as_text("strDescription", "p_brand"),
        as_text("strType", "p_type"), as_text("strThumb", F.lit(None)))
    both = F.array(entry(F.col("p_partkey") * 2, F.col("p_name")),
                   entry(F.col("p_partkey") * 2 + 1, F.concat("p_name", F.lit(" spare"))))
    path = land(part.select(enveloped("meals", both)), "components")
    return load.components_from(src.read_envelope(spark, path, "meals", src.COMPONENT_FIELDS), SOURCE)


def landed_listings(spark, folder) -> str:
    """One folder per priority; the country is the customer's nation."""
    orders = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    entry = F.struct(
        as_text("idMeal", "o_orderkey"), as_text("strMeal", F.concat(F.lit("Order "), "o_orderkey")),
        as_text("strMealThumb", F.concat(F.lit("http://img/"), "o_orderkey")),
        as_text("strArea", "c_mktsegment"), as_text("strCountry", "n_name"))
    rows = orders.select(enveloped("meals", F.array(entry), F.col("o_orderstatus") == "P"),
                         F.col("o_orderpriority").alias("category"))
    return land(rows, "listings", "category")


def tagged_listings(spark, folder):
    listed = src.read_tagged_listings(spark, landed_listings(spark, folder), "meals", src.LISTING_FIELDS)
    return load.listings_from(listed, SOURCE)


LISTINGS_SQL = f"""
    SELECT {key_sql("'landing'", "'item'", "o_orderkey::VARCHAR")} AS id_guid_sk,
           o_orderkey::VARCHAR AS external_id_meal, o_orderpriority AS category_name, c_mktsegment AS area,
           n_name AS country, 'Order ' || o_orderkey AS meal, 'http://img/' || o_orderkey AS image
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus != 'P'
"""


def landed_details(spark, folder) -> str:
    """All text; fields that are NULL are absent from the file."""
    wide = slots(spark, folder)
    orders = table(spark, folder, "orders").join(wide, F.col("o_orderkey") == F.col("l_orderkey"))
    entry = F.struct(
        as_text("idMeal", "o_orderkey"), as_text("strMeal", F.concat(F.lit("Order "), "o_orderkey")),
        as_text("strCategory", "o_orderpriority"), as_text("strInstructions", F.concat(F.lit("Pack "), "o_totalprice")),
        as_text("strSource", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus"))),
        as_text("dateModified", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")),
        *[F.col(f"part{n}").alias(f"strIngredient{n}") for n in range(1, SLOTS + 1)],
        *[F.col(f"amount{n}").alias(f"strMeasure{n}") for n in range(1, SLOTS + 1)])
    return land(orders.select(enveloped("meals", F.array(entry))), "details")


def item_details(spark, folder):
    details = load.details_from(src.read_details(spark, landed_details(spark, folder)), SOURCE)
    return details.select("external_id", "meal", "category", "country", "instructions", "source_url", "date_modified",
                          F.explode_outer("ingredient_measure").alias("slot", "entry")).select(
        "external_id", "meal", "category", "country", "instructions", "source_url", "date_modified", "slot",
        "entry.ingredient", "entry.measure")


def any_details(spark, folder):
    """Parts as details of more slots than are foreseen, with a number and a field of no column."""
    slots = F.sequence(F.lit(1), 18 + F.col("p_partkey") % 9)
    numbered = lambda prefix, value: F.map_from_arrays(
        F.transform(slots, lambda i: F.concat(F.lit(prefix), i)), F.transform(slots, value))
    fields = F.map_concat(
        F.create_map(F.lit("idMeal"), F.col("p_partkey").cast("string"), F.lit("strMeal"), F.col("p_name"), F.lit("strOrigin"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")),
        numbered("strIngredient", lambda i: F.when(i != F.col("p_partkey") % 30, F.concat(F.lit("component "), i))),
        numbered("strMeasure", lambda i: F.concat(i, F.lit("g"))))
    path = land(table(spark, folder, "part").select(enveloped("meals", F.array(fields), F.col("p_size") % 10 == 0)), "any_details")
    found = load.any_details_from(src.read_any_details(spark, path), SOURCE)
    return found.select("external_id", "meal", "category", F.element_at("other_fields", "strOrigin").alias("origin"), F.element_at("other_fields", "size").alias("size"),
                        F.size("other_fields").alias("others"), F.explode_outer("ingredient_measure").alias("slot", "entry")).select(
        "external_id", "meal", "category", "origin", "size", "others", "slot", "entry.ingredient", "entry.measure")


def landed_places(spark, folder) -> tuple[str, str]:
    """The place list, and a country reference whose names start five nations later."""
    nation = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(as_text("strArea", F.concat(F.lit("Area "), "n_name")), as_text("strCountry", "n_name"))
    listed = land(nation.select(enveloped("meals", F.array(entry))), "places")
    common = F.concat(F.lit("NATION_"), F.col("n_nationkey") + 5)
    reference = nation.select(
        F.struct(as_text("common", common), as_text("official", F.lower(common))).alias("name"),
        as_text("cca2", F.concat(F.lit("N"), "n_nationkey")), as_text("subregion", "r_name"))
    return listed, land(reference, "reference")


def place_list(spark, folder):
    listed, reference = landed_places(spark, folder)
    return load.places_from(src.read_envelope(spark, listed, "meals", src.PLACE_FIELDS),
                            src.read_places(spark, reference, multiline=False), SOURCE)


PLACES_SQL = f"""
    SELECT {key_sql("'landing'", "'place'", "n.n_name", "'Area ' || n.n_name")} AS id_guid_sk, n.n_name AS country,
           'Area ' || n.n_name AS cuisine, 'N' || e.n_nationkey AS acronym, r_name AS region,
           '{load.FLAG_PREFIX}n' || e.n_nationkey || '{load.FLAG_SUFFIX}' AS image
    FROM nation n LEFT JOIN nation e ON n.n_name = 'NATION_' || (e.n_nationkey + 5)
    LEFT JOIN region ON e.n_regionkey = r_regionkey
"""


def submitted_orders(spark, folder) -> DataFrame:
    """Orders as user submissions; some break a rule, some spell names in another case."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("submission"),
        F.expr(SUBMITTED["name_meal"]).alias("name_meal"),
        F.expr(SUBMITTED["category"]).alias("category"),
        F.expr(SUBMITTED["country"]).alias("country"),
        F.expr("concat('Pack ', o_orderstatus, ' ')").alias("instructions"),
        F.expr("concat('Box - ', cast(o_custkey AS string), 'g; tape; Tag - ', o_orderstatus, ';')").alias("ingredient_measure"),
        F.lit("").alias("image_recipe"), F.lit(" http://video ").alias("video_recipe"),
        F.expr("concat('http://src/', cast(o_orderkey AS string))").alias("source_url"))


# Submitted values, written so that both engines read them.
SUBMITTED = {
    "name_meal": "CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat(' Order ', CAST(o_orderkey AS VARCHAR(20)), ' ') END",
    "category": "CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'nothing' WHEN 2 THEN NULL "
                "ELSE concat(lower(o_orderpriority), ' ') END",
    "country": "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nowhere' "
               "ELSE concat('nation_', CAST(o_orderkey % 28 AS VARCHAR(20))) END",
}


def landed_submissions(spark, folder):
    path = land(submitted_orders(spark, folder), "submissions")
    key = T.StructType([T.StructField("submission", T.LongType())])
    return src.read_submissions(spark, path, extra=key)


def landed_questions(spark, folder):
    turns = table(spark, folder, "conversations")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return src.read_questions(spark, land(rows, "questions"))


def full_load(spark, folder) -> dict[str, DataFrame]:
    listed, reference = landed_places(spark, folder)
    priorities = table(spark, folder, "orders").select("o_orderpriority").distinct()
    entry = F.struct(as_text("idCategory", F.substring("o_orderpriority", 1, 1)), as_text("strCategory", "o_orderpriority"))
    where = load.Landing(
        categories=land(priorities.select(enveloped("categories", F.array(entry))), "categories"),
        components=landed_categories(spark, folder),
        listings=landed_listings(spark, folder),
        details=landed_details(spark, folder),
        places=listed,
        reference=reference,
        reference_multiline=False,
    )
    return load.full_load(spark, where, SOURCE, AS_OF)


def loaded_items(spark, folder):
    items = full_load(spark, folder)["recipe"]
    audit = F.date_format("__ingested_at", "yyyy-MM-dd HH:mm:ss")
    wide = items.select(*[c for c in items.columns if not c.startswith("__")], "__source", audit.alias("ingested"))
    per_item = explode_components(wide, "ingredient_measure", *[c for c in wide.columns if c != "ingredient_measure"])
    return per_item


def loaded_twice(spark, folder):
    """A full load run twice into stored tables: the stored items afterwards, as after one run."""
    root = scratch(spark, "catalogue")
    tables = full_load(spark, folder)
    for run in ("first", "second"):
        load.load_into(spark, tables, root, run, buckets=8)
    items = load.loaded_table(spark, "recipe", tables["recipe"].schema, root, buckets=8)
    return items.select("id_guid_sk", "external_id_meal", "name_meal", "guid_category", "country", "region", "instructions", "date_modified", "__source")


def changed_rows(spark, folder):
    """What a second load changes: places whose code ends in 7 have another image then, and those without a code are new."""
    root = scratch(spark, "catalogue")
    places = full_load(spark, folder)["country"]
    load.load_into(spark, {"country": places.where(F.col("acronym").isNotNull())}, root, "first", buckets=8)
    later = places.withColumn("image", F.when(F.col("acronym").endswith("7"), F.lit("new")).otherwise(F.col("image")))
    return load.load_into(spark, {"country": later}, root, "second", buckets=8)["country"].select("country", "cuisine", "image", "change")


QUERIES = {
    "full_load_twice": Query(loaded_twice, f"""
        SELECT l.id_guid_sk, o_orderkey::INT AS external_id_meal, meal AS name_meal,
               {key_sql("'landing'", "'category'", "o_orderpriority")} AS guid_category, l.country, p.region,
               'Pack ' || o_totalprice AS instructions, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_modified, 'landing' AS __source
        FROM ({LISTINGS_SQL}) l JOIN ({PLACES_SQL}) p ON l.country = p.country
        JOIN orders ON external_id_meal = o_orderkey::VARCHAR
        JOIN (SELECT DISTINCT l_orderkey FROM lineitem) k ON o_orderkey = k.l_orderkey"""),
    "load_changes": Query(changed_rows, f"""
        SELECT country, cuisine, CASE WHEN acronym LIKE '%7' THEN 'new' ELSE image END AS image,
               CASE WHEN acronym IS NULL THEN 'new' WHEN acronym LIKE '%7' THEN 'changed' ELSE 'same' END AS change FROM ({PLACES_SQL})"""),
    "category_envelopes": Query(category_envelopes, f"""
        SELECT {key_sql("'landing'", "'category'", "s_name")} AS id_guid_sk, s_suppkey::INT AS external_id,
               s_name AS name, 'Nation ' || s_nationkey AS description, 'http://img/' || lower(s_name) AS imagem
        FROM supplier WHERE s_acctbal >= 2000"""),
    "component_envelopes": Query(component_envelopes, f"""
        SELECT {key_sql("'landing'", "'component'", "key::VARCHAR")} AS id_guid_sk, key::INT AS external_id,
               name AS ingredient_name, p_brand AS description, p_type AS type_ingredient, NULL::VARCHAR AS image
        FROM (SELECT *, p_partkey * 2 AS key, p_name AS name FROM part
              UNION ALL SELECT *, p_partkey * 2 + 1, p_name || ' spare' FROM part)"""),
    "tagged_listings": Query(tagged_listings, LISTINGS_SQL),
    "item_details": Query(item_details, f"""
        SELECT o_orderkey::VARCHAR AS external_id, 'Order ' || o_orderkey AS meal, o_orderpriority AS category,
               NULL::VARCHAR AS country, 'Pack ' || o_totalprice AS instructions,
               CASE WHEN o_orderstatus = 'F' THEN 'F' END AS source_url,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_modified,
               n::VARCHAR AS slot, ingredient, measure
        FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) k ON o_orderkey = k.l_orderkey
        LEFT JOIN ({REACHED_SQL}) r ON o_orderkey = r.l_orderkey"""),
    "item_details_any": Query(any_details, """
        WITH filled AS (
            SELECT *, CASE WHEN p_partkey % 30 BETWEEN 1 AND 18 + p_partkey % 9 THEN p_partkey % 30 - 1 ELSE 18 + p_partkey % 9 END AS n
            FROM part WHERE p_size % 10 <> 0),
        slots AS (SELECT p_partkey AS of, unnest(range(1, n + 1)) AS i FROM filled)
        SELECT p_partkey::VARCHAR AS external_id, p_name AS meal, NULL::VARCHAR AS category, p_brand AS origin, p_size::VARCHAR AS size, 2 AS others,
               i::VARCHAR AS slot, 'component ' || i AS ingredient, i || 'g' AS measure
        FROM filled LEFT JOIN slots ON p_partkey = of"""),
    "place_list": Query(place_list, PLACES_SQL),
    "landed_submissions": Query(landed_submissions, f"""
        SELECT o_orderkey AS submission, {SUBMITTED["name_meal"]} AS name_meal, {SUBMITTED["category"]} AS category,
               {SUBMITTED["country"]} AS country, 'Pack ' || o_orderstatus || ' ' AS instructions,
               'Box - ' || o_custkey || 'g; tape; Tag - ' || o_orderstatus || ';' AS ingredient_measure,
               '' AS image_recipe, ' http://video ' AS video_recipe, 'http://src/' || o_orderkey AS source_url
        FROM orders"""),
    "landed_questions": Query(landed_questions, """
        SELECT conv_id * 1000 + turn AS question_id, text FROM conversations"""),
    "full_load": Query(loaded_items, f"""
        SELECT l.id_guid_sk, o_orderkey::INT AS external_id_meal, meal AS name_meal,
               {key_sql("'landing'", "'category'", "o_orderpriority")} AS guid_category, l.country, p.region,
               'Pack ' || o_totalprice AS instructions, NULL::VARCHAR AS image_recipe, NULL::VARCHAR AS video_recipe,
               CASE WHEN o_orderstatus = 'F' THEN 'F' END AS source_url,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date_modified, 'landing' AS __source,
               '2024-03-31 00:00:00' AS ingested, n::INT AS position, ingredient, measure
        FROM ({LISTINGS_SQL}) l JOIN ({PLACES_SQL}) p ON l.country = p.country
        JOIN orders ON external_id_meal = o_orderkey::VARCHAR
        JOIN ({REACHED_SQL}) r ON o_orderkey = r.l_orderkey"""),
}
