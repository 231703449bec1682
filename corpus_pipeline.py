"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality_classifier, secret_scan, simhash, source_mix
from tessera.llm.common import free_name, read_table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.score_quality(docs, labels).where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 (shingles of five words) the document of the smallest id stays."""
    return simhash.drop_similar(docs, similarity=0.8).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = free_name(docs, "leaks")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"), into=found).where(F.size(found) == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark, and ``n_chars`` follows; all documents stay."""
    found = free_name(docs, "secrets")
    clean = secret_scan.redact_secrets(docs, into=found)
    return clean.withColumn("n_chars", F.when(F.col(found), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated to their source's target rate and shuffled globally."""
    return source_mix.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secret_stage),
    ("source mixing", mixing_stage),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
