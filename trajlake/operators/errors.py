"""The error template database: built, updated and summed up as a long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.text import error_template

KEYS = ("domain", "tool", "error")


def _named(results: DataFrame) -> DataFrame:
    return results.withColumn("tool", F.coalesce("tool", F.lit("unknown")))


def error_examples(results: DataFrame) -> DataFrame:
    """(domain, tool, error, example, first_seq, n) from rows (domain, tool, message, seq): every distinct message of a
    template, the place where it was first seen, and how often.  No template's rows meet in one task."""
    distinct = _named(results).groupBy("domain", "tool", F.col("message").alias("example")).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    return distinct.select("domain", "tool", error_template(F.col("example")).alias("error"), "example", "first_seq", "n")


def merge_error_examples(old: DataFrame, new: DataFrame) -> DataFrame:
    """All examples of both; numbers added up, the first place kept."""
    return merged_examples(old.unionByName(new))


def merged_examples(examples: DataFrame) -> DataFrame:
    """One row for each example of rows that may hold it several times."""
    return examples.groupBy(*KEYS, "example").agg(F.min("first_seq").alias("first_seq"), F.sum("n").alias("n"))


def error_counts(results: DataFrame) -> DataFrame:
    """(domain, tool, error, count), by partial sums alone."""
    return _named(results).withColumn("error", error_template(F.col("message"))).groupBy(*KEYS).agg(F.count("*").alias("count"))


def preview_error_db(examples: DataFrame, most_examples: int = 5) -> DataFrame:
    """(domain, tool, error, count, examples) from the table of all examples: counts are whole, ``examples`` is a preview of
    those first seen.

    The preview is taken for each salt, then for each template, so a frequent template is spread over all tasks."""
    salts = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = examples.withColumn("_salt", F.pmod(F.xxhash64("example"), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy(*KEYS, "_salt").orderBy("first_seq", "example"))
    first = F.when(F.col("_place") <= most_examples, F.struct("first_seq", "example"))
    parts = salted.withColumn("_place", place).groupBy(*KEYS, "_salt").agg(F.sum("n").alias("n"), F.collect_list(first).alias("e"))
    chosen = F.slice(F.array_sort(F.flatten(F.collect_list("e"))), 1, most_examples)
    return parts.groupBy(*KEYS).agg(F.sum("n").alias("count"), F.transform(chosen, lambda e: e["example"]).alias("examples"))


def build_error_db(results: DataFrame, most_examples: int = 5) -> DataFrame:
    """``preview_error_db`` of rows (domain, tool, message, seq); ``error_examples`` has all the examples."""
    return preview_error_db(error_examples(results), most_examples)


def merge_error_db(old: DataFrame, new: DataFrame, most_examples: int = 5) -> DataFrame:
    """Two previews: counts added up; examples of the old side first.  ``merge_error_examples`` loses none."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    examples = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_age", "examples"))), lambda e: e["examples"]))), 1, most_examples)
    return both.groupBy("domain", "tool", "error").agg(F.sum("count").alias("count"), examples.alias("examples"))


def error_db_stats(db: DataFrame) -> DataFrame:
    """Per domain: tools, distinct errors and all errors."""
    return db.groupBy("domain").agg(F.countDistinct("tool").alias("n_tools"), F.count("*").alias("n_errors"), F.sum("count").alias("total"))


def error_db_stats_by_tool(db: DataFrame) -> DataFrame:
    return db.groupBy("domain", "tool").agg(F.count("*").alias("n_errors"), F.sum("count").alias("total"))
