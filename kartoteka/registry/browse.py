"""Listing, looking up, searching and counting."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions.text import is_blank, starts_with_any
from kartoteka.operators.aggregates import (
    counted,
    coverage_stats,
    store_counts,
    stored_counts,
    distinct_values,
    facet_counts,
    group_count,
    table_counts,
    union_all_by_name,
)
from kartoteka.operators.filters import detail_by_key, keyword_search, modified_since, null_rows, where_ci
from kartoteka.operators.project import item_view
from kartoteka.operators.topk import best_per_key, first_match, full_sort, page, page_after
from kartoteka.operators.zones import SortedTable
from kartoteka.registry.base import Query, table
from kartoteka.session import scratch

AS_OF = "2001-06-30"
DAYS = 400

# Item view of customers: nation is the category, region the place.
VIEW_SQL = """
    SELECT c_custkey AS id, c_name AS name, n_name AS category, r_name AS area, c_mktsegment AS segment
    FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey
    JOIN region ON c_nationkey % 6 = r_regionkey
"""


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of nations 20 and up lack their category, those of place 5 their place."""
    items = table(spark, folder, "customer").withColumns({
        "nation": F.col("c_nationkey") + 5, "place": F.col("c_nationkey") % 6})
    return item_view(
        items, table(spark, folder, "nation"), table(spark, folder, "region"),
        category_key=("nation", "n_nationkey"), place_key=("place", "r_regionkey"),
        columns={"id": "i.c_custkey", "name": "i.c_name", "category": "c.n_name", "area": "p.r_name",
                 "segment": "i.c_mktsegment"})


def list_page(spark, folder):
    return page(customers(spark, folder), ["name", "id"], limit=50, offset=10)


def list_page_after(spark, folder):
    return page_after(customers(spark, folder), ["segment", "id"], ["FURNITURE", 40], limit=50)


def list_page_after_nulls(spark, folder):
    """From within the customers whose segment is missing, which come last; and from before them."""
    view = customers(spark, folder).withColumn("segment", F.when(F.col("id") % 3 > 0, F.col("segment")))
    return (page_after(view, ["segment", "id"], [None, 30], limit=50).withColumn("from", F.lit("null"))
            .unionByName(page_after(view, ["segment", "id"], ["MACHINERY", 0], limit=10_000).withColumn("from", F.lit("last segment"))))


def list_page_two_cuisines(spark, folder):
    """Every place is stored twice, under two cuisines; no item repeats."""
    places = table(spark, folder, "region").withColumn("cuisine", F.explode(F.array(F.lit("old"), F.lit("new"))))
    items = table(spark, folder, "customer").withColumn("place", F.col("c_nationkey") % 6)
    view = item_view(items, table(spark, folder, "nation"), places, category_key=("c_nationkey", "n_nationkey"),
                     place_key=("place", "r_regionkey"), columns={"id": "i.c_custkey", "category": "c.n_name", "area": "p.r_name"})
    return page(view, ["id"], limit=500)


def detail(spark, folder):
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    view = item_view(orders, customer, category_key=("o_custkey", "c_custkey"),
                     columns={"id": "i.o_orderkey", "price": "i.o_totalprice", "category": "c.c_name"})
    return detail_by_key(view, "id", 7)


def filter_ci_top(spark, folder):
    return page(where_ci(customers(spark, folder), "segment", "Building"), ["name", "id"], limit=50)


def place_items(spark, folder):
    return page(customers(spark, folder).where(F.col("area") == "ASIA"), ["id"], limit=20)


def first_by_name(spark, folder):
    return first_match(where_ci(table(spark, folder, "part"), "p_type", "promo").select("p_partkey", "p_name"),
                       ["p_name", "p_partkey"])


def name_contains(spark, folder):
    found = keyword_search(table(spark, folder, "part"), "WIDGET", ["p_name"], ["p_partkey", "p_name"])
    return page(found, ["p_name", "p_partkey"], limit=20)


def keyword_distinct(spark, folder):
    return keyword_search(table(spark, folder, "documents"), "Ation", ["text", "lang", "source"],
                          ["doc_id", "lang", "source"])


def keyword_pattern(spark, folder):
    return keyword_search(table(spark, folder, "documents"), "th%tion_", ["text"], ["doc_id", "lang"], pattern=True)


def keyword_literal(spark, folder):
    return keyword_search(table(spark, folder, "pages"), "%%%", ["html", "url"], ["page_id", "url"])


def as_text_dates(spark, folder):
    """Orders with their date as text; some are not dates, some are missing."""
    orders = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.substring(day, 1, 5), F.lit("13-05")))
                         .when(F.col("o_orderkey") % 10 == 1, None)
                         .when(F.col("o_orderkey") % 10 == 2, F.concat(day, F.lit(" 10:00:00")))
                         .otherwise(day).alias("modified"))


def recent(spark, folder):
    return modified_since(as_text_dates(spark, folder), "modified", date.fromisoformat(AS_OF), DAYS)


def recent_short_dates(spark, folder):
    """Dates whose month and day may have one digit, with and without a time."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy-M-d"),
                               F.expr("CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 8:05:00' ELSE 'T08:05:00Z' END")).alias("modified"))
    return modified_since(orders, "modified", date.fromisoformat(AS_OF), DAYS).select("o_orderkey")


def recent_typed(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    found = modified_since(orders, "o_orderdate", date.fromisoformat(AS_OF), DAYS)
    return found.select("o_orderkey", "o_totalprice")


def missing_labels(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return null_rows(joined, "quality").select("doc_id", "lang")


def blank_names(spark, folder):
    texts = table(spark, folder, "events").select(
        "event_id", F.expr("CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', chr(9), chr(10)) "
                           "WHEN 2 THEN '' ELSE event_type END").alias("label"))
    return texts.where(is_blank("label")).select("event_id")


def prefix_filter(spark, folder):
    return table(spark, folder, "part").where(starts_with_any("p_name", ("r", "h", "sm"))).select("p_partkey", "p_name")


def counts(spark, folder):
    return table_counts({n: table(spark, folder, n) for n in ("part", "supplier", "customer", "lineitem", "documents")})


def by_priority(spark, folder):
    return group_count(table(spark, folder, "orders"), "o_orderpriority")


def facets(spark, folder):
    return facet_counts(table(spark, folder, "nation").withColumn("key", F.col("n_nationkey") + 5),
                        table(spark, folder, "customer"), "key", "c_nationkey", "n_name")


def coverage(spark, folder):
    return coverage_stats(table(spark, folder, "events"), "event_type", "user_id")


def counts_of_loads(spark, folder):
    """Three loads of events, the second one stored twice: counts from what was stored, and whether estimates are within 5 %."""
    events, root = table(spark, folder, "events"), scratch(spark, "counts")
    for load in ("0", "1", "2", "1"):
        store_counts(events.where(F.col("event_id") % 3 == int(load)), root, load, "event_type", "user_id")
    exact = coverage_stats(events, "event_type", "user_id").select("event_type", F.col("unique_keys").alias("exact"))
    near = stored_counts(spark, root).withColumnRenamed("group", "event_type")
    return near.join(exact, "event_type").select("event_type", "total", (F.abs(F.col("unique_keys") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def coverage_approximate(spark, folder):
    """Whether the sketch is within five in a hundred of the exact number of users."""
    events = table(spark, folder, "events")
    near = coverage_stats(events, "event_type", "user_id", approximate=True).withColumnRenamed("unique_keys", "near")
    exact = coverage_stats(events, "event_type", "user_id").select("event_type", "unique_keys")
    return near.join(exact, "event_type").select("event_type", "total", (F.abs(F.col("near") - F.col("unique_keys")) <= 0.05 * F.col("unique_keys")).alias("close"))


def distinct_top(spark, folder):
    return distinct_values(table(spark, folder, "part"), "p_brand", 20)


def dearest_order(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return best_per_key(orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def counted_rows(spark, folder):
    """Counts taken while the rows go to their sink, not by a second job."""
    seen = []
    for name in ("orders", "lineitem"):
        df, observed = counted(table(spark, folder, name), name)
        df.write.format("noop").mode("overwrite").save()
        seen.append((name, observed.get["rows"]))
    return spark.createDataFrame(seen, "table_name string, n bigint")


def sorted_parts(spark, folder):
    return full_sort(table(spark, folder, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"])


def union_unlike(spark, folder):
    customer = table(spark, folder, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    return union_all_by_name([customer, supplier])


def stored_page(spark, folder):
    """Line items in files by price: a page three quarters down, by number."""
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    stored = SortedTable(scratch(spark, "sorted"), ("l_extendedprice", "l_orderkey", "l_linenumber"), lines.schema).store(lines, files=32)
    return stored.page_at(spark, 50, lines.count() * 3 // 4)


def stored_page_after(spark, folder):
    """The page of line items after a price that half of them have not reached."""
    lines = table(spark, folder, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    stored = SortedTable(scratch(spark, "sorted"), ("l_extendedprice", "l_orderkey", "l_linenumber"), lines.schema).store(lines, files=32)
    middle = lines.agg(F.round(F.avg("l_extendedprice"), 0)).first()[0]
    return stored.page_after(spark, (middle, 0, 0), 50)


QUERIES = {
    "stored_page": Query(stored_page, """
        SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem ORDER BY ALL LIMIT 50 OFFSET (SELECT count(*) * 3 // 4 FROM lineitem)"""),
    "stored_page_after": Query(stored_page_after, """
        SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem
        WHERE l_extendedprice >= (SELECT round(avg(l_extendedprice), 0) FROM lineitem) ORDER BY ALL LIMIT 50"""),
    "list_page": Query(list_page, f"SELECT * FROM ({VIEW_SQL}) ORDER BY name, id LIMIT 50 OFFSET 10"),
    "list_page_after": Query(list_page_after, f"""
        SELECT * FROM ({VIEW_SQL}) WHERE segment > 'FURNITURE' OR (segment = 'FURNITURE' AND id > 40)
        ORDER BY segment, id LIMIT 50"""),
    "list_page_after_nulls": Query(list_page_after_nulls, f"""
        WITH v AS (SELECT id, name, category, area, CASE WHEN id % 3 > 0 THEN segment END AS segment FROM ({VIEW_SQL}))
        (SELECT *, 'null' AS "from" FROM v WHERE segment IS NULL AND id > 30 ORDER BY id LIMIT 50) UNION ALL
        (SELECT *, 'last segment' FROM v WHERE segment IS NULL OR segment >= 'MACHINERY' ORDER BY segment NULLS LAST, id LIMIT 10000)"""),
    "list_page_two_cuisines": Query(list_page_two_cuisines, """
        SELECT c_custkey AS id, n_name AS category, r_name AS area FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON c_nationkey % 6 = r_regionkey ORDER BY id LIMIT 500"""),
    "detail_by_key": Query(detail, """
        SELECT o_orderkey AS id, o_totalprice AS price, c_name AS category
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 7"""),
    "filter_ci_top": Query(filter_ci_top, f"""
        SELECT * FROM ({VIEW_SQL}) WHERE lower(segment) = lower('Building') ORDER BY name, id LIMIT 50"""),
    "place_items": Query(place_items, f"SELECT * FROM ({VIEW_SQL}) WHERE area = 'ASIA' ORDER BY id LIMIT 20"),
    "first_match": Query(first_by_name, """
        SELECT p_partkey, p_name FROM part WHERE lower(p_type) = 'promo' ORDER BY p_name, p_partkey LIMIT 1"""),
    "name_contains": Query(name_contains, """
        SELECT DISTINCT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')
        ORDER BY p_name, p_partkey LIMIT 20"""),
    "keyword_distinct": Query(keyword_distinct, """
        SELECT DISTINCT doc_id, lang, source FROM documents
        WHERE contains(lower(text), 'ation') OR contains(lower(lang), 'ation') OR contains(lower(source), 'ation')"""),
    "keyword_pattern": Query(keyword_pattern, """
        SELECT DISTINCT doc_id, lang FROM documents WHERE lower(text) LIKE '%th%tion_%'"""),
    "keyword_literal": Query(keyword_literal, """
        SELECT DISTINCT page_id, url FROM pages WHERE contains(lower(html), '%%%') OR contains(lower(url), '%%%')"""),
    "modified_since": Query(recent, f"""
        SELECT o_orderkey, modified FROM (
            SELECT o_orderkey, CASE o_orderkey % 10
                WHEN 0 THEN strftime(o_orderdate, '%Y-') || '13-05'
                WHEN 1 THEN NULL
                WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:00:00'
                ELSE strftime(o_orderdate, '%Y-%m-%d') END AS modified FROM orders)
        WHERE try_strptime(left(modified, 10), '%Y-%m-%d')::DATE >= DATE '{AS_OF}' - {DAYS}"""),
    "modified_since_short_dates": Query(recent_short_dates, f"""
        SELECT o_orderkey FROM orders WHERE o_orderdate::DATE >= DATE '{AS_OF}' - {DAYS}"""),
    "modified_since_typed": Query(recent_typed, f"""
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '{AS_OF}' - {DAYS}"""),
    "null_rows": Query(missing_labels, """
        SELECT d.doc_id, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL"""),
    "blank_rows": Query(blank_names, "SELECT event_id FROM events WHERE event_id % 4 < 3"),
    "prefix_filter": Query(prefix_filter, """
        SELECT p_partkey, p_name FROM part
        WHERE starts_with(p_name, 'r') OR starts_with(p_name, 'h') OR starts_with(p_name, 'sm')"""),
    "table_counts": Query(counts, " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}"
        for n in ("part", "supplier", "customer", "lineitem", "documents"))),
    "group_count": Query(by_priority, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    "facet_counts": Query(facets, """
        SELECT n_name AS facet, count(c_custkey) AS n
        FROM nation LEFT JOIN customer ON n_nationkey + 5 = c_nationkey GROUP BY n_name"""),
    "coverage": Query(coverage, """
        SELECT event_type, count(*) AS total, count(DISTINCT user_id) AS unique_keys FROM events GROUP BY 1"""),
    "stored_counts": Query(counts_of_loads, "SELECT event_type, count(*) AS total, true AS close FROM events GROUP BY 1"),
    "coverage_approximate": Query(coverage_approximate, "SELECT event_type, count(*) AS total, true AS close FROM events GROUP BY 1"),
    "distinct_top": Query(distinct_top, "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 20"),
    "best_per_key": Query(dearest_order, """
        SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders
        ORDER BY o_custkey, o_totalprice DESC, o_orderkey"""),
    "observed_counts": Query(counted_rows, """
        SELECT 'orders' AS table_name, count(*) AS n FROM orders
        UNION ALL SELECT 'lineitem', count(*) FROM lineitem"""),
    "full_sort": Query(sorted_parts, "SELECT p_name, p_partkey FROM part ORDER BY 1, 2"),
    "union_by_name": Query(union_unlike, """
        SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
        UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier"""),
}
