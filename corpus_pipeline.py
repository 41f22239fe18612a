"""A training-data pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``documents``, the
last adds how often a sampler should read each document.  Every stage works on all rows that its predecessor kept.

Defined cases, in every stage: a null text counts as empty (it is kept as null unless a stage rejects it); rows that repeat,
or repeat an id, are judged one by one, and copies of a kept id's text stay with it; a row with a null id is never dropped
as a copy; an empty table gives an empty result; columns beyond those of ``documents``, whatever their names, are carried on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from manyfold.llm import op1_pii, op2_quality, op3_decontaminate, op9_mixing, shingle_dedup
from manyfold.operators.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that the ordinal regression rejects go."""
    return op2_quality.select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup by SimHash with multi-index hashing, verified as five-word shingles of Jaccard 0.8 or more; pairs beyond its reach come
    from hashed minima.  Of each group of near copies the document with the smallest id stays."""
    return shingle_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages of benchmark items are cut out; a document without any other word goes."""
    return op3_decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans are replaced by their kind in brackets."""
    return op1_pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: ``mix_rate`` and ``mix_copies`` say how often a document is read."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op9_mixing.mix(docs, op9_mixing.labelled_by(labels, docs, "lang"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("mixing", mix)]
#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
