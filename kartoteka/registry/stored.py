"""Writing and merging tables, and their contracts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartoteka.functions.text import day_text, surrogate_key
from kartoteka.operators.buckets import KeyBuckets
from kartoteka.operators.contracts import Contract, apply_defaults, contract_report, duplicate_keys, relax
from kartoteka.operators.tables import append_audited, insert_if_absent, register
from kartoteka.operators.topk import best_per_key
from kartoteka.plans import load
from kartoteka.registry.base import Query, key_sql, table
from kartoteka.session import scratch
from kartoteka.sources.stored import read_table
from kartoteka.streaming.upsert_stream import newest_rows, newest_stream, upsert_stream

FIRST, LATER = datetime(2024, 1, 1), datetime(2024, 3, 31)


def stored_columns(spark, folder):
    return read_table(spark, f"{folder}/orders.parquet", ["o_orderkey", "o_totalprice"])


def appended(spark, folder):
    """Two appends to one folder, and what is in it afterwards."""
    target = scratch(spark, "appended")
    rows = [append_audited(table(spark, folder, name).select(F.col(key).alias("key")), target, name, FIRST)
            for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    stored = read_table(spark, target)
    return stored.select("key", "__source", day_text("__ingested_at").alias("__ingested_at"),
                         F.when(F.col("__source") == "customer", rows[0]).otherwise(rows[1]).cast("bigint").alias("written"))


def viewed(spark, folder):
    register({"catalogue_part": table(spark, folder, "part"), "catalogue_line": table(spark, folder, "lineitem")})
    return spark.sql("""
        SELECT p_type, count(*) AS n, sum(l_quantity) AS quantity
        FROM catalogue_line JOIN catalogue_part ON l_partkey = p_partkey GROUP BY p_type""")


def inserted(spark, folder):
    """Documents staged twice into the labels; of the two the lower version is wanted."""
    target = table(spark, folder, "labels").select("doc_id")
    documents = table(spark, folder, "documents").select("doc_id", "lang")
    staged = documents.withColumn("version", F.lit(2)).unionByName(documents.withColumn("version", F.lit(1)))
    return insert_if_absent(target, staged, ["doc_id"], ["version"])


def inserted_without_keys(spark, folder):
    """Every third document has no key; each of these is a row of its own."""
    target = table(spark, folder, "labels").select("doc_id")
    staged = table(spark, folder, "documents").select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id"), "lang", "n_chars")
    return insert_if_absent(target, staged, ["doc_id"], ["n_chars"])


ITEM_COLUMNS = ["id_guid_sk", "external_id_meal", "status", "price", "__ingested_at", "__updated_at"]


def stored_items(spark, folder, source: str, at: datetime, key: str, status: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        surrogate_key(source, "o_orderkey").alias("id_guid_sk"), F.expr(key).alias("external_id_meal"),
        F.expr(status).alias("status"), F.col("o_totalprice").alias("price"),
        F.lit(at).cast("timestamp").alias("__ingested_at"), F.lit(at).cast("timestamp").alias("__updated_at"))


def upserted(spark, folder):
    """Every order merged in under twice its key: half meet a stored order, half are new.

    A third of the stored orders have no key, every fourth staged status is NULL.
    """
    target = stored_items(spark, folder, "old", FIRST, "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END", "o_orderstatus")
    staged = stored_items(spark, folder, "new", LATER, "o_orderkey * 2", "CASE WHEN o_orderkey % 4 > 0 THEN 'merged' END")
    store = KeyBuckets(scratch(spark, "items"), target.schema, ("external_id_meal",), 16)
    store.create(target)
    store.merge(staged, ["status", "price", "__updated_at"])
    return store.read(spark).select(*[day_text(c).alias(c) if c.endswith("_at") else c for c in ITEM_COLUMNS])


def upserted_few(spark, folder):
    """Orders of a single day merged into all orders, which lie in many buckets: the table, and whether most buckets were left alone."""
    target = stored_items(spark, folder, "old", FIRST, "o_orderkey", "o_orderstatus")
    day = table(spark, folder, "orders").agg(F.max("o_orderdate")).first()[0]
    staged = stored_items(spark, folder, "old", LATER, "o_orderkey", "'late'").join(
        table(spark, folder, "orders").where(F.col("o_orderdate") == F.lit(day)).select(F.col("o_orderkey").alias("external_id_meal")), "external_id_meal", "left_semi")
    store = KeyBuckets(scratch(spark, "items"), target.schema, ("external_id_meal",), 256)
    store.create(target)
    written = store.merge(staged, ["status", "__updated_at"])
    return store.read(spark).select("external_id_meal", "status", day_text("__updated_at").alias("__updated_at"),
                                    F.lit(len(written) <= staged.count()).alias("only_touched"))


UPSERT_SQL = f"""
    WITH target AS (
        SELECT {key_sql("'old'", "o_orderkey::VARCHAR")} AS id_guid_sk,
               CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS external_id_meal,
               o_orderstatus AS status, o_totalprice AS price FROM orders),
    staged AS (
        SELECT {key_sql("'new'", "o_orderkey::VARCHAR")} AS id_guid_sk, o_orderkey * 2 AS external_id_meal,
               CASE WHEN o_orderkey % 4 > 0 THEN 'merged' END AS status, o_totalprice AS price FROM orders)
    SELECT t.id_guid_sk, t.external_id_meal,
           CASE WHEN s.id_guid_sk IS NULL THEN t.status ELSE s.status END AS status,
           CASE WHEN s.id_guid_sk IS NULL THEN t.price ELSE s.price END AS price,
           '2024-01-01 00:00:00' AS __ingested_at,
           CASE WHEN s.id_guid_sk IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-03-31 00:00:00' END AS __updated_at
    FROM target t LEFT JOIN staged s ON t.external_id_meal = s.external_id_meal
    UNION ALL
    SELECT id_guid_sk, external_id_meal, status, price, '2024-03-31 00:00:00', '2024-03-31 00:00:00'
    FROM staged s WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.external_id_meal = s.external_id_meal)
"""


def incremental(spark, folder):
    """Orders of the last year joined with their dimensions and merged over a stored load of all orders."""
    orders = table(spark, folder, "orders").withColumn("modified", F.date_format("o_orderdate", "yyyy-MM-dd"))
    listed = orders.join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    stored = orders.select(
        F.col("o_orderkey").alias("key"), F.lit("stored").alias("country"), F.lit(0.0).alias("price"),
        F.lit("first").alias("__source"), F.lit(FIRST).cast("timestamp").alias("__ingested_at"),
        F.lit(FIRST).cast("timestamp").alias("__updated_at"))
    priorities = orders.select("o_orderpriority").distinct()
    staged = load.staged_items(
        listed, priorities, table(spark, folder, "nation"), orders, "second", datetime(2001, 8, 1), 365, "modified",
        category_on=("o_orderpriority", "o_orderpriority"), place_on=("c_nationkey", "n_nationkey"),
        detail_on=("o_orderkey", "o_orderkey"), newest="modified",
        columns={"key": "r.o_orderkey", "country": "co.n_name", "price": "rf.o_totalprice"})
    staged = load.with_audit(staged.drop("__source", "__ingested_at", "__updated_at"), "second", LATER)
    merged = load.incremental_upsert(stored, staged, ["key"], ["country", "price", "__source", "__updated_at"])
    return merged.select(*[day_text(c).alias(c) if c.endswith("_at") else c for c in merged.columns])


CONTRACT = Contract(
    T.StructType([T.StructField("id", T.StringType(), False), T.StructField("line", T.IntegerType(), False),
                  T.StructField("label", T.StringType(), False), T.StructField("amount", T.DoubleType(), False),
                  T.StructField("note", T.StringType())]),
    unique=(("id", "line"), ("label",)),
    defaults={"label": "unknown", "note": "none"},
)


def contracted(spark, folder) -> DataFrame:
    """Line items under a contract they break: repeated line numbers, missing labels and amounts."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") > 10, F.concat("l_returnflag", "l_linestatus")).alias("label"),
        F.when(F.col("l_discount") < 0.1, F.col("l_extendedprice")).alias("amount"))


def report(spark, folder):
    return contract_report(contracted(spark, folder), CONTRACT)


def relaxed(spark, folder):
    return contract_report(contracted(spark, folder), relax(relax(CONTRACT, "amount"), "line"))


def defaulted(spark, folder):
    filled = apply_defaults(contracted(spark, folder), CONTRACT)
    return filled.groupBy("label", "note").agg(F.count("*").alias("n"), F.count("amount").alias("amounts"))


def repeated(spark, folder):
    return duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


CONTRACT_SQL = """
    WITH c AS (
        SELECT l_orderkey::VARCHAR AS id, l_linenumber AS line,
               CASE WHEN l_quantity > 10 THEN l_returnflag || l_linestatus END AS label,
               CASE WHEN l_discount < 0.1 THEN l_extendedprice END AS amount FROM lineitem)
    SELECT 'not null id' AS rule, count(*) FILTER (id IS NULL) AS violations FROM c
    UNION ALL SELECT 'not null label', count(*) FILTER (label IS NULL) FROM c
    UNION ALL SELECT 'unique id, line', count(*) - count(DISTINCT (id, line)) FROM c
    UNION ALL SELECT 'unique label', count(label) - count(DISTINCT label) FROM c
"""


def _landing(spark, folder) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Events, those stored before, and those that land in two batches; in the second a third of the first comes again, late."""
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    third = events.agg(F.max("event_id")).first()[0] // 3
    old = events.where((F.col("event_id") < third) & (F.col("user_id") % 2 == 0))
    first = events.where((F.col("event_id") < 2 * third) & ~((F.col("event_id") < third) & (F.col("user_id") % 2 == 0)))
    again = events.where((F.col("event_id") < third) & (F.col("user_id") % 3 == 0)).withColumn("event_type", F.lit("late"))
    return events, old, [first, events.where(F.col("event_id") >= 2 * third).unionByName(again)]


def streamed(spark, folder):
    """The latest event of each user, merged from two batches with late rows; half of the users are stored before."""
    events, old, batches = _landing(spark, folder)
    landing, checkpoint = scratch(spark, "landing"), scratch(spark, "stream")
    store = KeyBuckets(scratch(spark, "latest"), events.schema, ("user_id",), 8)
    store.create(best_per_key(old, ["user_id"], [F.col("event_id").desc()]))
    for landed in batches:
        landed.write.mode("append").parquet(landing)
        upsert_stream(spark, landing, store, checkpoint, ["event_id", "event_type", "value"],
                      newest_by=[F.col("event_id").desc(), F.col("event_type")], version="event_id").awaitTermination()
    return store.read(spark)


def newest(spark, folder):
    """The same kept as state of a stream, whose changes go to a log."""
    events, old, batches = _landing(spark, folder)
    landing, checkpoint, changes = scratch(spark, "landing"), scratch(spark, "stream"), scratch(spark, "changes")
    for landed in (batches[0].unionByName(old), batches[1]):
        landed.write.mode("append").parquet(landing)
        newest_stream(spark, landing, events.schema, "user_id", "event_id", changes, checkpoint).awaitTermination()
    return newest_rows(spark, events.schema, "user_id", "event_id", changes)


STREAMED_SQL = "SELECT DISTINCT ON (user_id) user_id, event_id, event_type, value FROM events ORDER BY user_id, event_id DESC"


QUERIES = {
    "stored_columns": Query(stored_columns, "SELECT o_orderkey, o_totalprice FROM orders"),
    "append_audited": Query(appended, """
        SELECT c_custkey AS key, 'customer' AS __source, '2024-01-01 00:00:00' AS __ingested_at,
               (SELECT count(*) FROM customer) AS written FROM customer
        UNION ALL SELECT s_suppkey, 'supplier', '2024-01-01 00:00:00', (SELECT count(*) FROM supplier) FROM supplier"""),
    "temp_views": Query(viewed, """
        SELECT p_type, count(*) AS n, sum(l_quantity) AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type"""),
    "insert_if_absent": Query(inserted, """
        SELECT doc_id, lang, 1 AS version FROM documents d
        WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "insert_if_absent_null_keys": Query(inserted_without_keys, """
        SELECT CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id, lang, n_chars FROM documents d
        WHERE doc_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""),
    "upsert": Query(upserted, UPSERT_SQL),
    "upsert_few": Query(upserted_few, """
        SELECT o_orderkey AS external_id_meal, CASE WHEN newest THEN 'late' ELSE o_orderstatus END AS status,
               CASE WHEN newest THEN '2024-03-31 00:00:00' ELSE '2024-01-01 00:00:00' END AS __updated_at, true AS only_touched
        FROM (SELECT *, o_orderdate = max(o_orderdate) OVER () AS newest FROM orders)"""),
    "incremental_upsert": Query(incremental, """
        WITH staged AS (
            SELECT o_orderkey, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate::DATE >= DATE '2001-08-01' - 365)
        SELECT o.o_orderkey AS key, coalesce(n_name, 'stored') AS country, coalesce(s.o_totalprice, 0.0) AS price,
               CASE WHEN n_name IS NULL THEN 'first' ELSE 'second' END AS __source,
               '2024-01-01 00:00:00' AS __ingested_at,
               CASE WHEN n_name IS NULL THEN '2024-01-01 00:00:00' ELSE '2024-03-31 00:00:00' END AS __updated_at
        FROM orders o LEFT JOIN staged s ON o.o_orderkey = s.o_orderkey"""),
    "contract_report": Query(report, f"""
        {CONTRACT_SQL} UNION ALL SELECT 'not null line', count(*) FILTER (line IS NULL) FROM c
        UNION ALL SELECT 'not null amount', count(*) FILTER (amount IS NULL) FROM c"""),
    "contract_relaxed": Query(relaxed, CONTRACT_SQL),
    "apply_defaults": Query(defaulted, """
        SELECT CASE WHEN l_quantity > 10 THEN l_returnflag || l_linestatus ELSE 'unknown' END AS label, 'none' AS note,
               count(*) AS n, count(*) FILTER (l_discount < 0.1) AS amounts FROM lineitem GROUP BY 1"""),
    "duplicate_keys": Query(repeated, """
        SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""),
    "stream_upsert": Query(streamed, STREAMED_SQL),
    "stream_newest": Query(newest, STREAMED_SQL),
}
