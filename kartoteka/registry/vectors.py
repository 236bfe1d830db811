"""Composed text, vectors and similarity."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.vectors import cosine, cosine_distance, norm
from kartoteka.operators.aggregates import coverage_stats
from kartoteka.operators.embedding import compose_text, embed
from kartoteka.operators.routing import ADD_WORDS, item_template
from kartoteka.operators.similarity import Cells, ann_topk, cosine_topk
from kartoteka.operators.tables import staged_table
from kartoteka.operators.vector_index import VectorIndex
from kartoteka.plans.catalogue import Catalogue
from kartoteka.plans.search import embed_new, nearest_chunks, semantic_search
from kartoteka.registry.base import Query, table
from kartoteka.session import scratch

K = 5


def items(spark, folder) -> DataFrame:
    """Documents as items: some have no category, some a place that is not on the list."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id_guid_sk"), F.col("doc_id").alias("external_id_meal"),
        F.col("source").alias("name_meal"),
        F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("NATION_"), F.col("doc_id") % 30)).alias("country"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("region"),
        F.col("text").alias("instructions"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit('{"1":{"ingredient":"'), "lang", F.lit('","measure":"'), "n_chars", F.lit('"}}')))
        .alias("ingredient_measure"),
        F.col("quality").alias("guid_category"))


def composed(spark, folder):
    text = compose_text("name_meal", "country", "region", "instructions", "ingredient_measure")
    return items(spark, folder).select("id_guid_sk", text.alias("chunk_text"))


# Fixed value: where component text may be cut.
COMPONENT_LIMIT = 1200


def composed_long(spark, folder):
    """Whole documents as components, most of them longer than the limit, with and without it."""
    documents = table(spark, folder, "documents").select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("place", "region", "how")])
    text = lambda limit: compose_text("text", "place", "region", "how", "text", component_limit=limit)
    return documents.select("doc_id", F.md5(text(None)).alias("whole"), F.md5(text(COMPONENT_LIMIT)).alias("cut"))


def mixed_lengths(spark, folder):
    """Vectors of two models in one table: those of odd ids keep their first 32 components only. Each label asks with both."""
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 2 == 1, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    whole = means(spark, folder)
    queries = whole.select((F.col("query_id") * 2).alias("query_id"), "asked").unionByName(
        whole.select((F.col("query_id") * 2 + 1).alias("query_id"), F.slice("asked", 1, 32).alias("asked")))
    return shown(cosine_topk(vectors, queries, K, item="vec_id", query_vector="asked"))


COMPOSED_SQL = """
    SELECT doc_id, concat_ws(' | ', 'Recipe: ' || source,
        CASE WHEN doc_id % 9 > 0 THEN 'Country: NATION_' || (doc_id % 30)
            || CASE WHEN doc_id % 2 = 0 THEN ' (' || lang || ')' ELSE '' END END,
        'Instructions: ' || text,
        CASE WHEN doc_id % 5 > 0 THEN
            'Ingredients: {"1":{"ingredient":"' || lang || '","measure":"' || n_chars || '"}}' END) AS chunk_text
    FROM documents
"""


def cells_of(source: str, key: str, text: str) -> str:
    """DuckDB text of the hashed word counts of a table's texts."""
    return f"""
        SELECT {key}, bucket, count(*) AS n FROM (
            SELECT {key}, ('0x' || left(md5(unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))), 8))::BIGINT % 64
                AS bucket FROM {source})
        GROUP BY ALL
    """


def hashed(spark, folder):
    vectors = embed(table(spark, folder, "documents"), "text").select("doc_id", F.posexplode_outer("embedding").alias("bucket", "n"))
    return vectors.where("n > 0").select("doc_id", F.col("bucket").cast("bigint").alias("bucket"),
                                         F.col("n").cast("bigint").alias("n"))


def means(spark, folder) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    vectors = table(spark, folder, "embeddings").select(
        "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    mean = vectors.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("mean"))
    return mean.select(F.col("label").alias("query_id"), vector_to_array("mean").alias("asked"))


MEANS_SQL = """
    SELECT label AS query_id, list(mean ORDER BY pos) AS asked FROM (
        SELECT label, pos, avg(x) AS mean FROM (
            SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
        GROUP BY label, pos)
    GROUP BY label
"""


def vector_math(spark, folder):
    """Each vector against the mean of its own label."""
    joined = table(spark, folder, "embeddings").join(means(spark, folder), F.col("label") == F.col("query_id"))
    return joined.select(
        "vec_id", F.round(cosine("embedding", "asked"), 6).alias("similarity"),
        F.round(cosine_distance("embedding", "asked"), 6).alias("distance"),
        F.round(norm("embedding"), 6).alias("length"), F.size("embedding").alias("dimension"))


def shown(top: DataFrame) -> DataFrame:
    return top.select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def exact(spark, folder):
    return shown(cosine_topk(table(spark, folder, "embeddings"), means(spark, folder), K, item="vec_id", query_vector="asked"))


def exact_in_blocks(spark, folder):
    """The same with limits so low that rows and queries meet block by block."""
    return shown(cosine_topk(table(spark, folder, "embeddings"), means(spark, folder), K, item="vec_id",
                             query_vector="asked", max_probes=4))


TOPK_SQL = f"""
    SELECT query_id, rank::INT AS rank, vec_id, round(similarity, 6) AS similarity FROM (
        SELECT query_id, vec_id, similarity,
               row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank
        FROM (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], asked) AS similarity
              FROM embeddings, ({MEANS_SQL})))
    WHERE rank <= {K}
"""


def by_item(spark, folder):
    """Vectors as chunks of label items: the best chunk of an item counts."""
    vectors = table(spark, folder, "embeddings").withColumn("item", F.col("vec_id") % 50)
    top = cosine_topk(vectors, means(spark, folder), K, item="item", chunk="vec_id", query_vector="asked")
    return top.select("query_id", "rank", "item", "chunk", F.round("similarity", 6).alias("similarity"))


def fitted(spark, folder) -> tuple[Cells, DataFrame]:
    vectors = table(spark, folder, "embeddings")
    cells = Cells.fit(vectors, lists=16)
    return cells, cells.assign(vectors)


def near_cells(spark, folder):
    """Whether three quarters of the cells, read from the folders they are stored in, hold at least 0.8 of each query's nearest vectors."""
    cells, celled = fitted(spark, folder)
    stored = scratch(spark, "cells")
    celled.write.partitionBy("cell").parquet(stored)
    near = ann_topk(spark.read.parquet(stored), means(spark, folder), cells, 20, probe=12, item="vec_id", query_vector="asked")
    exact = cosine_topk(table(spark, folder, "embeddings"), means(spark, folder), 20, item="vec_id", query_vector="asked")
    found = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") >= 0.8 * F.count("*")).alias("enough"))


def indexed(spark, folder) -> VectorIndex:
    """Fitted and stored once; searches open what is stored."""
    root = scratch(spark, "index")
    VectorIndex.build(table(spark, folder, "embeddings"), root, item="vec_id", keep=["label"], lists=16)
    return VectorIndex.open(spark, root)


def pruned(spark, folder):
    return shown(indexed(spark, folder).pruned_topk(means(spark, folder), K, query_vector="asked"))


def pruned_among(spark, folder):
    """Only vectors whose label has an odd number of suppliers, which is decided while vectors are read."""
    labels = table(spark, folder, "supplier").groupBy((F.col("s_suppkey") % 10).cast("int").alias("label")).agg(F.sum("s_nationkey").alias("n")).where("n % 2 = 1")
    return shown(indexed(spark, folder).pruned_topk(means(spark, folder), K, query_vector="asked", allowed=[(labels, "label")]))


def coded(spark, folder):
    """Whether codes, with the best of them reranked, find at least 0.9 of each query's nearest vectors."""
    near = indexed(spark, folder).coded_topk(means(spark, folder), 20, query_vector="asked")
    exact = cosine_topk(table(spark, folder, "embeddings"), means(spark, folder), 20, item="vec_id", query_vector="asked")
    found = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


def all_cells(spark, folder):
    """Looking into every cell gives the exact answer."""
    cells, celled = fitted(spark, folder)
    return shown(ann_topk(celled, means(spark, folder), cells, K, probe=16, item="vec_id", query_vector="asked"))


def stored_vectors(spark, folder, among: DataFrame, model: str = "words-64", keep: tuple[str, ...] = (), text: str = "instructions") -> DataFrame:
    none = spark.createDataFrame([], "external_id_meal bigint, guid_recipe bigint, chunk_index int, chunk_text string, "
                                     "embedding array<float>, model_name string, created_at timestamp")
    rows = embed_new(among, none, model, as_of=datetime(2024, 1, 1), text=F.col(text), keep=keep)
    return staged_table(rows, "vectors")


def newly_embedded(spark, folder):
    """Items without a label are embedded already; the others follow."""
    every = items(spark, folder)
    done = stored_vectors(spark, folder, every.where("guid_category IS NULL"))
    fresh = embed_new(every, done, "words-64-b", as_of=datetime(2024, 3, 31))
    return fresh.select("guid_recipe", "chunk_index", "model_name", F.md5("chunk_text").alias("text"),
                        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("words"))


def model_coverage(spark, folder):
    every = items(spark, folder)
    old = stored_vectors(spark, folder, every.where("guid_category IS NULL"))
    new = embed_new(every, old, "words-64-b", as_of=datetime(2024, 3, 31))
    return coverage_stats(old.unionByName(new), "model_name", "guid_recipe")


def chunked(spark, folder):
    """Benchmark passages as questions; every third document has no external id."""
    every = items(spark, folder).withColumn(
        "external_id_meal", F.when(F.col("id_guid_sk") % 3 > 0, F.col("id_guid_sk")))
    found = nearest_chunks(
        table(spark, folder, "benchmark").withColumnRenamed("item_id", "question_id"),
        stored_vectors(spark, folder, every), every, K)
    return found.select("question_id", "rank", "external_id_meal", "name_meal", "country", "region", "chunk_text", "similarity")


def searched(spark, folder):
    """Benchmark passages as questions to the documents that have a place and a category, which lie beside the vectors."""
    every = items(spark, folder)
    return _searched(spark, folder, every, stored_vectors(spark, folder, every, keep=("country", "guid_category")))


def searched_by_model(spark, folder):
    """The same in a table that also holds vectors of the items' names by another model; places and categories lie with the items."""
    every = items(spark, folder)
    both = stored_vectors(spark, folder, every).unionByName(stored_vectors(spark, folder, every, "names-64", text="name_meal"))
    return _searched(spark, folder, every, both, model_name="words-64")


def _searched(spark, folder, every, vectors, **how):
    categories = table(spark, folder, "labels").select(F.col("quality").alias("id_guid_sk")).distinct().select(
        "id_guid_sk", F.concat(F.lit("quality "), "id_guid_sk").alias("name"))
    found = semantic_search(
        table(spark, folder, "benchmark").withColumnRenamed("item_id", "question_id"),
        vectors, every, table(spark, folder, "nation").withColumnRenamed("n_name", "country"), categories, K, **how,
        columns={"name_meal": "i.name_meal", "country": "i.country", "category_name": "c.name",
                 "nation": "p.n_nationkey", "ingredient_measure": "i.ingredient_measure"})
    return found.select("question_id", "rank", "guid_recipe", F.round("similarity", 6).alias("similarity"), "name_meal", "chunk_text",
                        "country", "category_name", "nation", F.get("components", 0)["measure"].alias("first_measure"))


SEARCHED_SQL = f"""
        WITH d AS ({cells_of("documents", "doc_id", "text")}), q AS ({cells_of("benchmark", "item_id", "text")}),
        dn AS (SELECT doc_id, sum(n * n) AS s FROM d GROUP BY 1), qn AS (SELECT item_id, sum(n * n) AS s FROM q GROUP BY 1),
        whole AS (
            SELECT d.doc_id, source, text, lang, n_chars, n_nationkey, n_name, quality FROM documents d
            JOIN labels l ON d.doc_id = l.doc_id
            JOIN nation ON n_name = 'NATION_' || (d.doc_id % 30) WHERE d.doc_id % 9 > 0),
        sims AS (
            SELECT item_id, d.doc_id, sum(q.n * d.n) / (sqrt(any_value(qn.s)) * sqrt(any_value(dn.s))) AS similarity
            FROM q JOIN d ON q.bucket = d.bucket JOIN whole w ON w.doc_id = d.doc_id
            JOIN qn USING (item_id) JOIN dn ON dn.doc_id = d.doc_id GROUP BY item_id, d.doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM sims)
        SELECT item_id AS question_id, rank::INT AS rank, doc_id AS guid_recipe, round(similarity, 6) AS similarity,
               CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS chunk_text,
               source AS name_meal, n_name AS country, 'quality ' || quality AS category_name, n_nationkey AS nation,
               CASE WHEN doc_id % 5 > 0 THEN n_chars::VARCHAR END AS first_measure
        FROM ranked JOIN whole USING (doc_id) WHERE rank <= {K}"""

def chatted(spark, folder):
    """Benchmark passages as messages, of which every fourth asks to add an item and every seventh is blank."""
    every = items(spark, folder)
    messages = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), F.expr(MESSAGE).alias("text"))
    places = table(spark, folder, "nation").select(F.col("n_name").alias("country"), F.col("n_nationkey").cast("string").alias("image"))
    categories = table(spark, folder, "labels").select(F.col("quality").alias("id_guid_sk")).distinct().select(
        "id_guid_sk", F.concat(F.lit("quality "), "id_guid_sk").alias("name"), F.lit("picture").alias("imagem"))
    detailed = every.withColumns({c: F.lit(None).cast("string") for c in ("image_recipe", "video_recipe")})
    catalogue = Catalogue(detailed, categories, places, every, stored_vectors(spark, folder, every, keep=("country", "guid_category")))
    answers = catalogue.chat(messages, K)
    return answers.select("question_id", "type", "rank", "guid_recipe", "name_meal", "category_name", "country_flag", F.length("template").alias("form"))


MESSAGE = "CASE WHEN item_id % 7 = 0 THEN '  ' WHEN item_id % 4 = 0 THEN concat('Please ADD this: ', text) ELSE text END"

QUERIES = {
    "chat": Query(chatted, f"""
        WITH asked AS (SELECT item_id, {MESSAGE} AS text FROM benchmark),
        kind AS (SELECT item_id, CASE WHEN trim(text) = '' THEN 'empty_query'
                     WHEN regexp_matches(lower(text), '\\b({"|".join(ADD_WORDS)})\\b') THEN 'template' ELSE 'recipe_search' END AS type FROM asked),
        found AS ({SEARCHED_SQL})
        SELECT k.item_id AS question_id, k.type, f.rank, f.guid_recipe, f.name_meal, f.category_name, f.nation::VARCHAR AS country_flag,
               CASE WHEN k.type = 'template' THEN {len(json.dumps(item_template()))} END AS form
        FROM kind k LEFT JOIN found f ON k.type = 'recipe_search' AND f.question_id = k.item_id"""),
    "compose_text_long": Query(composed_long, f"""
        SELECT doc_id, md5('Recipe: ' || text || ' | Ingredients: ' || text) AS whole,
               md5('Recipe: ' || text || ' | Ingredients: ' || left(text, {COMPONENT_LIMIT})) AS cut FROM documents"""),
    "cosine_topk_mixed_lengths": Query(mixed_lengths, f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN embedding[1:32] ELSE embedding END::DOUBLE[] AS e FROM embeddings),
        q AS (SELECT query_id * 2 AS query_id, asked FROM ({MEANS_SQL}) UNION ALL SELECT query_id * 2 + 1, asked[1:32] FROM ({MEANS_SQL})),
        scored AS (SELECT query_id, vec_id, list_cosine_similarity(e, asked) AS similarity FROM q JOIN v ON len(asked) = len(e)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id)::INT AS rank FROM scored)
        SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM ranked WHERE rank <= {K}"""),
    "compose_text": Query(composed, f"SELECT doc_id AS id_guid_sk, chunk_text FROM ({COMPOSED_SQL})"),
    "hash_embed": Query(hashed, cells_of("documents", "doc_id", "text")),
    "vector_math": Query(vector_math, f"""
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], asked), 6) AS similarity,
               round(1 - list_cosine_similarity(embedding::DOUBLE[], asked), 6) AS distance,
               round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length,
               len(embedding)::INT AS dimension
        FROM embeddings JOIN ({MEANS_SQL}) ON label = query_id"""),
    "cosine_topk": Query(exact, TOPK_SQL),
    "cosine_topk_blocks": Query(exact_in_blocks, TOPK_SQL),
    "cosine_topk_chunks": Query(by_item, f"""
        SELECT query_id, rank::INT AS rank, item, vec_id::INT AS chunk, round(similarity, 6) AS similarity FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, item) AS rank FROM (
                SELECT DISTINCT ON (query_id, item) * FROM (
                    SELECT query_id, vec_id, vec_id % 50 AS item,
                           list_cosine_similarity(embedding::DOUBLE[], asked) AS similarity
                    FROM embeddings, ({MEANS_SQL}))
                ORDER BY query_id, item, round(similarity, 9) DESC, vec_id))
        WHERE rank <= {K}"""),
    "ann_topk": Query(near_cells, f"SELECT DISTINCT query_id, true AS enough FROM ({MEANS_SQL})"),
    "ann_topk_all_cells": Query(all_cells, TOPK_SQL),
    "pruned_topk": Query(pruned, TOPK_SQL),
    "pruned_topk_among": Query(pruned_among, TOPK_SQL.replace("FROM embeddings, (", """FROM (SELECT * FROM embeddings WHERE label IN (
        SELECT s_suppkey % 10 FROM supplier GROUP BY 1 HAVING sum(s_nationkey) % 2 = 1)) e, (""")),
    "coded_topk": Query(coded, f"SELECT DISTINCT query_id, true AS enough FROM ({MEANS_SQL})"),
    "embed_new": Query(newly_embedded, f"""
        SELECT c.doc_id AS guid_recipe, 0 AS chunk_index, 'words-64-b' AS model_name, md5(chunk_text) AS text,
               len(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}]+'))::BIGINT AS words
        FROM ({COMPOSED_SQL}) c JOIN labels l ON c.doc_id = l.doc_id"""),
    "model_coverage": Query(model_coverage, """
        SELECT CASE WHEN l.doc_id IS NULL THEN 'words-64' ELSE 'words-64-b' END AS model_name,
               count(*) AS total, count(DISTINCT d.doc_id) AS unique_keys
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""),
    "nearest_chunks": Query(chunked, f"""
        WITH d AS ({cells_of("documents", "doc_id", "text")}), q AS ({cells_of("benchmark", "item_id", "text")}),
        dn AS (SELECT doc_id, sum(n * n) AS s FROM d GROUP BY 1), qn AS (SELECT item_id, sum(n * n) AS s FROM q GROUP BY 1),
        sims AS (
            SELECT item_id, d.doc_id, sum(q.n * d.n) / (sqrt(any_value(qn.s)) * sqrt(any_value(dn.s))) AS similarity
            FROM q JOIN d ON q.bucket = d.bucket AND d.doc_id % 3 > 0
            JOIN qn USING (item_id) JOIN dn ON dn.doc_id = d.doc_id GROUP BY item_id, d.doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS rank FROM sims)
        SELECT item_id AS question_id, rank::INT AS rank, doc_id AS external_id_meal, source AS name_meal,
               CASE WHEN doc_id % 9 > 0 THEN 'NATION_' || (doc_id % 30) END AS country,
               CASE WHEN doc_id % 2 = 0 THEN lang END AS region,
               CASE WHEN length(c.chunk_text) > 150 THEN left(c.chunk_text, 150) || '...' ELSE c.chunk_text END AS chunk_text,
               round(similarity, 4) AS similarity
        FROM ranked JOIN documents USING (doc_id) JOIN (SELECT doc_id, text AS chunk_text FROM documents) c USING (doc_id)
        WHERE rank <= {K}"""),
    "semantic_search": Query(searched, SEARCHED_SQL),
    "semantic_search_by_model": Query(searched_by_model, SEARCHED_SQL),
}
