"""Queries over the whole tables, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import additive_quantization, fingerprints, html_text, language_id, license_scan, line_dedup, mixing, near_dedup, sentencepiece_chunks, toxicity
from granary.llm._common import table


def _rest(column: str, by: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_additive_quantization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantization.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_rest("doc_id", 4) != 2))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(_rest("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_emptied=True, count=True)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_rest("doc_id", 3) != 1))
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(_rest("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_chunks.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), "html", "page_id", "url")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.probabilities(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"),
        F.round("__probability", 6).alias("probability"), (mixing.draw() < F.col("__probability")).alias("kept"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_additive_quantization, op2_toxicity, op3_license_scan, op4_fingerprints, op5_line_dedup, op6_language_id, op7_sentencepiece,
        op8_html_text, op9_minhash_near_dedup, op10_mixing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": mixing.oracle_sql()}
