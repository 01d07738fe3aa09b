"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, html, langid, minhash, neighbours, oracle, packing, pii, quality, secrets, wavelet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=32, rows=8)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.main_text(pages, out="text").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_file_round_trip(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.quality_signals(docs).select("doc_id", *(F.col("quality")[c].alias(c) for c in names))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digests(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_digests(docs).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_html_extraction, op3_best_fit_packing, op4_embedding_near_dedup, op5_language_id, op6_token_files, op7_quality_rules, op8_pii, op9_secret_scan, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL can express. The others are held against brute force, round trips or held-out rows in tests."""
    return oracle.SQL
