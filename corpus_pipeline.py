"""Corpus pipeline: each stage reads the documents that the one before it kept.

The quality classifier drops what it rejects, one document of each near-duplicate group
stays, documents with a benchmark window go, secrets in the rest are replaced by a mark,
and the mix says how often each remaining document is taken. Rows without an id are never
duplicates; rows of one id are one document. No SQL counterpart: the classifier is fitted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwatch.llm import benchmark, credentials, mixing, neardup, quality
from flowwatch.llm.common import keep, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs, name="_quality").where("_quality.kept").drop("_quality")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = benchmark.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits.runs") == 0).drop("hits")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their secrets; n_chars, where there is one, follows the text."""
    clean = credentials.redacted(docs)
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return clean


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, writing and rereading Parquet between them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
