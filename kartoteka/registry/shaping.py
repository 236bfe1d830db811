"""Renaming, keys, scalar expressions, component lists and the star join."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.functions import text as tx
from kartoteka.functions.nested import explode_components, map_to_list, pairs_to_map, to_json_text, wide_slots
from kartoteka.operators.joins import denormalize, dim_lookup, join_hot, unprocessed
from kartoteka.operators.project import card_projection, rename_select, with_audit
from kartoteka.registry.base import Query, key_sql, table

SLOTS = 7


def rename_key(spark, folder):
    return rename_select(table(spark, folder, "supplier"), {
        "id_guid_sk": tx.surrogate_key("landing", "s_suppkey", "s_name"),
        "external_id": "s_suppkey",
        "name": "s_name",
        "image": tx.template_url("http://img/", "s_name", ".png"),
    })


def audit_columns(spark, folder):
    stamped = with_audit(table(spark, folder, "customer").select("c_custkey"), "landing", datetime(2024, 3, 31, 12, 0))
    return stamped.select("c_custkey", "__source", tx.day_text("__ingested_at").alias("__ingested_at"),
                          tx.day_text("__updated_at").alias("__updated_at"))


def dim_override(spark, folder):
    """Nation to region key to region name, with exceptions; unknown keys give NULLs down to the URL."""
    customer = table(spark, folder, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("place"))
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("code"))
    region = table(spark, folder, "region").select(F.col("r_regionkey").cast("string").alias("code"), "r_name")
    named = dim_lookup(customer, nation, ("place", "n_nationkey"), {"country": "n_name", "acronym": "code"})
    coded = named.withColumn("acronym", tx.override("acronym", "country", {"NATION_7": "4", "NATION_9": "77"}))
    placed = dim_lookup(coded, region, ("acronym", "code"), {"region": "r_name"})
    return placed.withColumn("image", tx.template_url("http://flags/", "region", ".png"))


def hot_join(spark, folder):
    """Line items looked up among the parts; a third of them, those of every third order, are of one part."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 7 > 0, F.col("l_partkey")).alias("part"))
    joined = join_hot(lines, table(spark, folder, "part").select("p_partkey", "p_name"), {"part": "p_partkey"}, "left")
    return joined.groupBy("part", "p_name").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


def star_join(spark, folder):
    orders = table(spark, folder, "orders").withColumn("placed", F.date_format("o_orderdate", "yyyy-MM-dd"))
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    listings = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", "o_orderpriority", "c_nationkey", "c_name")
    return denormalize(
        listings, table(spark, folder, "region").withColumn("priority", F.expr(
            "element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'), r_regionkey + 1)")),
        nation, orders,
        category_on=("o_orderpriority", "priority"), place_on=("c_nationkey", "n_nationkey"),
        detail_on=("o_orderkey", "o_orderkey"),
        columns={"id": "r.o_orderkey", "name": "r.c_name", "category": "c.r_name", "country": "co.n_name",
                 "price": "rf.o_totalprice", "placed": "rf.placed"})


def scalar_text(spark, folder):
    part = table(spark, folder, "part")
    halves = tx.split_first(F.concat("p_name", F.lit(" - "), "p_brand", F.lit(" - "), "p_type"), " - ")
    asked = F.concat(F.lit("what is x? What is the "), F.upper("p_name"), F.lit(" leather ingredient"))
    return part.select(
        "p_partkey",
        F.lower("p_brand").alias("lowered"),
        tx.strip(F.concat(F.lit("\t \n"), "p_name", F.lit(" \r "))).alias("stripped"),
        F.concat_ws(", ", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("joined"),
        halves[0].alias("first_half"), halves[1].alias("second_half"),
        tx.drop_words(tx.after_last(F.lower(asked), "what is"), ["the", "ingredient"]).alias("term"),
        tx.preview("p_type", 5).alias("shortened"),
        tx.contains_ci("p_name", "RING").alias("has_ring"),
        tx.has_word("p_name", ["ring", "old"]).alias("has_word"),
    )


def scalar_dates(spark, folder):
    orders = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(F.col("o_orderkey") % 5 == 0, F.lit("2024-13-05")).otherwise(F.concat(day, F.lit(" 09:30:00")))
    return orders.select(
        "o_orderkey",
        F.date_format(tx.parse_day(written), "yyyy-MM-dd").alias("parsed"),
        F.date_format(F.date_sub(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd").alias("cutoff"),
        tx.day_text("o_orderdate").alias("written"),
        tx.to_int(F.when(F.col("o_orderkey") % 3 == 0, F.lit("x1")).otherwise(F.col("o_custkey").cast("string"))).alias("number"),
    )


def scalar_nulls(spark, folder):
    events = table(spark, folder, "events")
    empty = F.when(F.col("event_type") == "view", F.lit("")).when(F.col("event_type") != "click", F.col("event_type"))
    return events.select("event_id", empty.isNull().alias("missing"), tx.is_blank(empty).alias("blank"),
                         tx.first_of(empty, F.lit(None).cast("string"), F.col("user_id").cast("string")).alias("label"))


def json_field(spark, folder):
    events = table(spark, folder, "events")
    parsed = F.from_json("props", "struct<k:int>")
    return events.select("event_id", parsed["k"].alias("k"),
                         F.get_json_object(to_json_text(F.struct(parsed["k"].alias("key"))), "$.key").alias("written"))


def slots(spark, folder) -> DataFrame:
    """Orders with one pair of columns per line number; numbers an order lacks are NULL.

    A line number can repeat within an order, so each slot takes the highest part.
    """
    line = table(spark, folder, "lineitem")
    at = lambda n: F.col("l_linenumber") == n
    return line.groupBy("l_orderkey").agg(
        *[F.concat(F.lit(" part "), F.max(F.when(at(n), F.col("l_partkey"))).cast("string")).alias(f"part{n}")
          for n in range(1, SLOTS + 1)],
        *[F.concat(F.max(F.when(at(n) & (F.col("l_quantity") > 5), F.col("l_quantity"))).cast("int").cast("string"),
                   F.lit(" ")).alias(f"amount{n}") for n in range(1, SLOTS + 1)])


SLOTS_SQL = f"""
    SELECT l_orderkey, l_linenumber AS n, 'part ' || max(l_partkey) AS ingredient,
           coalesce(max(l_quantity) FILTER (l_quantity > 5)::INT::VARCHAR, '') AS measure
    FROM lineitem WHERE l_linenumber <= {SLOTS} GROUP BY l_orderkey, l_linenumber
"""
# a slot is reached when no earlier one is missing: the n-th present slot has number n
REACHED_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS nth FROM ({SLOTS_SQL}))
    WHERE nth = n
"""


def wide_map(spark, folder):
    wide = slots(spark, folder)
    mapped = wide.select("l_orderkey", wide_slots(wide, "part", "amount").alias("m"))
    return mapped.select("l_orderkey", F.explode("m").alias("slot", "entry")).select(
        "l_orderkey", "slot", "entry.ingredient", "entry.measure")


def gapped_json(spark, folder) -> DataFrame:
    """Orders with a component map as JSON, keyed by line number, gaps left open."""
    wide = slots(spark, folder)
    entries = F.filter(F.array(*[
        F.struct(F.lit(str(n)).alias("key"),
                 F.struct(F.col(f"part{n}").alias("ingredient"), F.col(f"amount{n}").alias("measure")).alias("value"))
        for n in range(SLOTS, 0, -1)]), lambda e: e["value"]["ingredient"].isNotNull())
    return wide.select("l_orderkey", to_json_text(F.map_from_entries(entries)).alias("components"))


def map_list(spark, folder):
    return explode_components(gapped_json(spark, folder), "components", "l_orderkey")


def odd_json(spark, folder):
    """Arrays pass through, broken text gives no components; every order keeps its row."""
    good = gapped_json(spark, folder)
    kind = F.col("l_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("not json "), "components"))
        .when(kind == 1, F.lit(None))
        .when(kind == 2, F.concat(F.lit('[{"ingredient":"q'), F.col("l_orderkey"), F.lit('","measure":"9"},{"ingredient":""},{"ingredient":"r"}]')))
        .otherwise(F.concat(F.lit('{"10":{"ingredient":" k"},"x":{"ingredient":"last"},"2":{"ingredient":"first","measure":" 1 "},"3":{"ingredient":" "}}')))
    )
    listed = map_to_list(text)
    return good.select("l_orderkey", F.size(listed).cast("bigint").alias("n"),
                       F.array_join(F.transform(listed, lambda e: e["ingredient"]), "|").alias("names"),
                       F.array_join(F.transform(listed, lambda e: e["measure"]), "|").alias("measures"))


def long_keys(spark, folder):
    """Maps keyed by order number, over 1000 too, with keys that are no numbers; these come last."""
    line = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey").distinct()
    key = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("k"), "l_orderkey")).otherwise(F.col("l_orderkey").cast("string"))
    chosen = line.groupBy("l_suppkey", key.alias("key")).agg(F.max("l_partkey").alias("part"))
    maps = chosen.groupBy("l_suppkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        "key", F.struct(F.concat(F.lit("part "), "part", F.lit(" of "), "key").alias("ingredient"), F.lit("1").alias("measure")).alias("value"))))).alias("m"))
    listed = map_to_list(to_json_text("m"))
    # keys that are no numbers keep the order they are written in, which is the order of their text here
    return maps.select("l_suppkey", F.posexplode(F.transform(listed, lambda e: e["ingredient"])).alias("at", "ingredient"))


def star_two_cuisines(spark, folder):
    """The star join with every nation stored under two cuisines and every order listed twice."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    listed = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = table(spark, folder, "nation").withColumn("cuisine", F.explode(F.array(F.lit("old"), F.lit("new"))))
    priorities = orders.select("o_orderpriority").distinct()
    return denormalize(listed.unionByName(listed), priorities, nations, orders, category_on=("o_orderpriority", "o_orderpriority"),
                       place_on=("c_nationkey", "n_nationkey"), detail_on=("o_orderkey", "o_orderkey"),
                       columns={"id": "r.o_orderkey", "country": "co.n_name", "price": "rf.o_totalprice"})


def typed_pairs(spark, folder):
    line = table(spark, folder, "lineitem")
    typed = F.concat(F.lit(" part "), "l_partkey", F.lit(" - "), "l_quantity", F.lit(" - g; salt "), "l_suppkey",
                     F.lit(" ;; flour - "), "l_linenumber", F.lit(" cups;"))
    mapped = line.select("l_orderkey", "l_partkey", F.explode(pairs_to_map(typed)).alias("slot", "entry"))
    return mapped.groupBy("slot", "entry.ingredient", "entry.measure").agg(F.count("*").alias("n"))


def cards(spark, folder):
    """Up to fourteen components per order, so that some are left over."""
    line = table(spark, folder, "lineitem").withColumn(
        "slot", F.col("l_linenumber") * 2 - F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    wide = line.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped"),
        *[F.max(F.when(F.col("slot") == n, F.col("l_partkey"))).alias(f"c{n}") for n in range(1, 15)],
        *[F.max(F.when(F.col("slot") == n, F.col("l_suppkey"))).alias(f"m{n}") for n in range(1, 15)])
    entries = F.filter(F.array(*[F.struct(
        F.lit(str(n)).alias("key"),
        F.struct(F.col(f"c{n}").cast("string").alias("ingredient"),
                 F.when(F.col(f"m{n}") % 3 > 0, F.col(f"m{n}").cast("string")).otherwise("").alias("measure")).alias("value"))
        for n in range(1, 15)]), lambda e: e["value"]["ingredient"].isNotNull())
    items = wide.select("l_orderkey", F.lit("").alias("no_name"),
                        F.concat(F.lit("Order "), "l_orderkey").alias("name"),
                        to_json_text(F.map_from_entries(entries)).alias("components"),
                        (F.col("l_orderkey") % 101 / 100).alias("similarity"))
    return card_projection(items, key="l_orderkey", names=["no_name", "name"], components="components",
                           similarity="similarity")


def text_cards(spark, folder):
    return card_projection(table(spark, folder, "documents"), key="doc_id", names=["source"], text="text")


def not_labelled(spark, folder):
    """Documents without a label. Half have no key: those are always returned."""
    documents = table(spark, folder, "documents").select(
        "doc_id", "lang", F.when(F.col("lang") != "en", F.col("doc_id")).alias("key"))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("key"))
    return unprocessed(documents, labels, ["key"])


QUERIES = {
    "rename_key": Query(rename_key, f"""
        SELECT {key_sql("'landing'", "s_suppkey::VARCHAR", "s_name")} AS id_guid_sk, s_suppkey AS external_id,
               s_name AS name, 'http://img/' || lower(s_name) || '.png' AS image FROM supplier"""),
    "audit_columns": Query(audit_columns, """
        SELECT c_custkey, 'landing' AS __source, '2024-03-31 12:00:00' AS __ingested_at,
               '2024-03-31 12:00:00' AS __updated_at FROM customer"""),
    "dim_override": Query(dim_override, """
        SELECT c_custkey, place, country, acronym, r_name AS region, 'http://flags/' || lower(r_name) || '.png' AS image
        FROM (SELECT c_custkey, c_nationkey + 3 AS place, n_name AS country,
                     CASE n_name WHEN 'NATION_7' THEN '4' WHEN 'NATION_9' THEN '77' ELSE n_regionkey::VARCHAR END AS acronym
              FROM customer LEFT JOIN nation ON c_nationkey + 3 = n_nationkey)
        LEFT JOIN region ON acronym = r_regionkey::VARCHAR"""),
    "hot_join": Query(hot_join, """
        SELECT part, p_name, count(*) AS n, sum(l_orderkey)::BIGINT AS orders FROM (
            SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 7 > 0 THEN l_partkey END AS part FROM lineitem)
        LEFT JOIN part ON part = p_partkey GROUP BY 1, 2"""),
    "star_join": Query(star_join, """
        SELECT o_orderkey AS id, c_name AS name, r_name AS category, n_name AS country, o_totalprice AS price,
               strftime(o_orderdate, '%Y-%m-%d') AS placed
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON o_orderpriority =
            (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[r_regionkey + 1]"""),
    "scalar_text": Query(scalar_text, """
        SELECT p_partkey, lower(p_brand) AS lowered, p_name AS stripped,
               concat_ws(', ', p_name, CASE WHEN p_size > 25 THEN p_brand END) AS joined,
               p_name AS first_half, p_brand || ' - ' || p_type AS second_half,
               lower(p_name) || ' leather' AS term,
               CASE WHEN length(p_type) > 5 THEN left(p_type, 5) || '...' ELSE p_type END AS shortened,
               contains(lower(p_name), 'ring') AS has_ring,
               list_has_any(string_split(p_name, ' '), ['ring', 'old']) AS has_word
        FROM part"""),
    "scalar_dates": Query(scalar_dates, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed,
               strftime(o_orderdate::DATE - 30, '%Y-%m-%d') AS cutoff,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS written,
               CASE WHEN o_orderkey % 3 > 0 THEN o_custkey::INT END AS number
        FROM orders"""),
    "scalar_nulls": Query(scalar_nulls, """
        SELECT event_id, event_type = 'click' AS missing, event_type IN ('click', 'view') AS blank,
               CASE WHEN event_type IN ('click', 'view') THEN user_id::VARCHAR ELSE event_type END AS label
        FROM events"""),
    "json_field": Query(json_field, """
        SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k') AS written
        FROM events"""),
    "wide_to_map": Query(wide_map, f"SELECT l_orderkey, n::VARCHAR AS slot, ingredient, measure FROM ({REACHED_SQL})"),
    "map_to_list": Query(map_list, f"""
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY n)::INT AS position, ingredient, measure
        FROM ({SLOTS_SQL})"""),
    "map_to_list_odd": Query(odd_json, """
        SELECT DISTINCT l_orderkey, CASE l_orderkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END::BIGINT AS n,
               CASE l_orderkey % 4 WHEN 2 THEN 'q' || l_orderkey || '|r' WHEN 3 THEN 'first|k|last' ELSE '' END AS names,
               CASE l_orderkey % 4 WHEN 2 THEN '9' WHEN 3 THEN '1||' ELSE '' END AS measures
        FROM lineitem"""),
    "map_to_list_long_keys": Query(long_keys, """
        WITH c AS (
            SELECT l_suppkey, CASE WHEN l_partkey % 7 = 0 THEN 'k' || l_orderkey ELSE l_orderkey::VARCHAR END AS key, max(l_partkey) AS part
            FROM lineitem GROUP BY ALL)
        SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY starts_with(key, 'k'), try_cast(key AS BIGINT), key) - 1)::INT AS at,
               'part ' || part || ' of ' || key AS ingredient FROM c"""),
    "star_join_two_cuisines": Query(star_two_cuisines, """
        SELECT o_orderkey AS id, n_name AS country, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "pairs_to_map": Query(typed_pairs, """
        SELECT slot, ingredient, measure, count(*) AS n FROM (
            SELECT '1' AS slot, 'part ' || l_partkey AS ingredient, l_quantity::VARCHAR || ' - g' AS measure FROM lineitem
            UNION ALL SELECT '3', 'flour', l_linenumber || ' cups' FROM lineitem)
        GROUP BY ALL"""),
    "cards": Query(cards, """
        WITH slot AS (
            SELECT l_orderkey, l_linenumber * 2 - (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n,
                   max(l_partkey) AS c, max(l_suppkey) AS m FROM lineitem GROUP BY ALL),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS nth FROM slot)
        SELECT l_orderkey, 'Order ' || l_orderkey AS title,
               string_agg('- ' || c || CASE WHEN m % 3 > 0 THEN ' : ' || m ELSE '' END, chr(10) ORDER BY nth)
                   FILTER (nth <= 8)
               || CASE WHEN count(*) > 8 THEN chr(10) || '+' || (count(*) - 8) || ' more...' ELSE '' END AS components,
               CASE WHEN l_orderkey % 101 > 0 THEN (l_orderkey % 101) || '% match' END AS match
        FROM numbered GROUP BY l_orderkey"""),
    "text_cards": Query(text_cards, """
        SELECT doc_id, source AS title,
               CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents"""),
    "unprocessed": Query(not_labelled, """
        SELECT doc_id, lang, CASE WHEN lang != 'en' THEN doc_id END AS key FROM documents d
        WHERE lang = 'en' OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
}
