"""The corpus pipeline: from raw documents to packed training windows.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import credentials, decontam, neardup, packing, quality
from voxmill.llm.shared import bounded_batches, read_table
from voxmill.session import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    bounded_batches(spark)
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    bounded_batches(spark)
    return neardup.keep_one_each(docs, words=5, similarity=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to the name of their kind."""
    bounded_batches(spark)
    return credentials.redact_secrets(docs)


def tiered_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each in its window."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("tiered_packing", tiered_packing),
]

# SQL has no tokenizer; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next one reads it.

    What a stage leaves behind goes once its result is written, and that once
    the next one's is; the last result reads the rows of the stage before it.
    """
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as hand_over:
            docs = hand_over(stage(spark, before, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
