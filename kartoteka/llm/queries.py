"""The numbered operators over whole tables, and the pipeline, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from kartoteka.llm import (byte_bpe, curves, language, line_dedup, manifest, near_dup, packing, quality, quantised, repair, secrets, sql, toxicity,
                           urls)
from kartoteka.registry.base import Query, table

# The rules that pages are judged by, as host, path and action.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _fold(folds: int) -> Column:
    """Fold of a document; ids that are null are in none."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def _held_out(folds: int, fold: int) -> Column:
    return F.coalesce(_fold(folds) == fold, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), _fold(5) != 0)
    return out.select("doc_id", _held_out(5, 0), "score", "predicted", "evidence")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated(docs)


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.digest_documents(table(spark, folder, "documents"), vocabulary)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.learn(docs, _fold(4) != 2, language.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return language.predict(docs, model).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


def op6_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = byte_bpe.read_merges(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, folder, "documents"), vocabulary)


def op8_curves(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.judge_urls(table(spark, folder, "pages"), rules)


def op11_quantised(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.near_vectors(table(spark, folder, "embeddings"))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.audit(repair.damaged(table(spark, folder, "conversations")))


def op13_manifest(spark: SparkSession, folder: str) -> DataFrame:
    one_more = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.manifest(manifest.leaves(table(spark, folder, "documents"), {"n_chars": one_more}, tampered))


_URL_SQL = f"""
WITH rules(host, path, action) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
fits AS (
  SELECT s.page_id, r.host || r.path AS rule, r.action,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC) AS place
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.action, '{urls.DEFAULT}') AS verdict
FROM split s LEFT JOIN fits f ON s.page_id = f.page_id AND f.place = 1
"""

QUERIES: dict[str, Query] = {
    "op1_toxicity": Query(op1_toxicity),
    "op2_line_dedup": Query(op2_line_dedup),
    "op3_byte_bpe": Query(op3_byte_bpe),
    "op4_language": Query(op4_language),
    "op5_secrets": Query(op5_secrets),
    "op6_minhash": Query(op6_minhash),
    "op7_packing": Query(op7_packing),
    "op8_curves": Query(op8_curves),
    "op9_quality": Query(op9_quality),
    "op10_url_filters": Query(op10_url_filters, _URL_SQL),
    "op11_quantised": Query(op11_quantised, sql.NEAR_VECTORS),
    "op12_repair": Query(op12_repair, sql.CONVERSATION_REPAIR),
    "op13_manifest": Query(op13_manifest, sql.MANIFEST),
    "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
