"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreframe.llm import decontaminate, fim, hard_negatives, licenses, line_dedup, media_chunks, mixing, ngram_join, packing, quality_lm, token_files, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken is counted from the draws that the splitting tree gives to the shards."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.size("shards")).alias("taken"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_sentences")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("similarity", F.round("similarity", 9))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.outcomes_of(table(spark, sf_dir, "labels"))
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_chunks.stored_media(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.quality(table(spark, sf_dir, "documents"), quality_lm.trusted_ids(table(spark, sf_dir, "labels")))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = packing.with_ids(ids, pieces, F.crc32)
    return found.select("doc_id", "start", "length", F.col("told").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr(hard_negatives.SHIFTED).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("id") % hard_negatives.EVERY == 0)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_licenses, op4_token_files, op5_toxicity, op6_decontaminate, op7_url_filter, op8_media_chunks, op9_ngram_join, op10_quality_lm, op11_packing, op12_hard_negatives, op13_fill_in_middle)}
ORACLES = {"op3_licenses": licenses.oracle(), "op2_mixing": mixing.ORACLE, "op7_url_filter": url_filter.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_fill_in_middle": fim.ORACLE}
