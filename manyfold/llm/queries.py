"""The operators' registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from manyfold.llm import op1_pii, op2_quality, op3_decontaminate, op4_simhash, op5_tokens, op6_html, op7_urls, op8_embeddings, op9_mixing, op10_licenses


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii.digest(op1_pii.find(_table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return op3_decontaminate.digest(found)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_tokens.count_tokens(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_html.extract(_table(spark, sf_dir, "pages"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = op7_urls.listing(spark, op7_urls.RULES, "rule").unionByName(op7_urls.listing(spark, op7_urls.LISTED, "listed"))
    return op7_urls.judge(_table(spark, sf_dir, "pages"), listed)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return op9_mixing.rates(docs, op9_mixing.labelled_by(_table(spark, sf_dir, "labels"), docs, "lang"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_licenses.scan(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f) and name != "oracle_sql"}


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": op3_decontaminate.SQL, "op4_simhash_near_dedup": op4_simhash.SQL, "op7_url_filters": op7_urls.SQL, "op8_embedding_near_dedup": op8_embeddings.SQL}
