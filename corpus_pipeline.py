"""A corpus from raw documents to packed training windows, in stages that are written and read again.

Every stage takes what its predecessor kept.  All but the last return the columns of ``documents``; the last returns
the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import near_dedup, packing, quality_classifier, quality_rules, secrets
from trajlake.llm.common import discard, materialize, scratch, table
from trajlake.llm.queries import word_tokenizer


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a certified cutoff go.

    So do null and empty texts, which have no words; a null language is a stratum of its own; rows that repeat, or whose
    id is null, are judged like any others.  An empty table stays empty."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely bad than good go.

    Without usable labels none does.  Null texts count as empty and are scored; equal texts share their fate."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def apply_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest id.

    Null and empty texts are one class; of repeated rows one stays; a row with a null id stays only if its class has no id."""
    return near_dedup.keep_one(docs)


def apply_secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, and n_chars, where there is one, follows its text.

    Null texts stay null with their n_chars; empty ones stay empty."""
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return masked.select(docs.columns)


def apply_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of packed sequences.

    A null or empty text is a document of the end id alone; repeated rows and null ids are packed like any others."""
    return packing.pack(docs, word_tokenizer(), memo_runs=MEMO_RUNS).withColumnRenamed("id", "doc_id")


#: Runs that the packing stage's encoders remember: a quarter of the default, as workers of all stages share the executors.
MEMO_RUNS = 250_000

STAGES = [
    ("quality_rules", apply_quality_rules),
    ("quality_classifier", apply_quality_classifier),
    ("near_dedup", apply_near_dedup),
    ("secret_scan", apply_secret_scan),
    ("packing", apply_packing),
]

#: SQL can express neither the classifier nor the packing; tests/llm/test_pipeline_plain.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch() as kept:
            rows = materialize(stage(spark, docs, sf_dir))
            kept.append(rows)
        discard(docs)
        docs = rows
    return STAGES[-1][1](spark, docs, sf_dir)
