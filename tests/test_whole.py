"""Queries over the whole of their input: no prefix of a text, no subset of a table."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trajlake.operators import errors
from trajlake.plans import catalog
from trajlake.streaming import error_log, jobs

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_think_tags_after_a_long_text_in_any_language(spark, tmp_path):
    long = "x" * 500
    spark.createDataFrame([(1, f"{long}<thinking>t\n</thinking>\n\n\n\nend", "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["strip_think_and_squeeze"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, hashlib.md5(f"a\n\n{long}\n\nend\n\nb".encode()).hexdigest())]


@needs_data
def test_context_keeps_calls_whole(spark):
    rows = catalog.QUERIES["context_last_k_whole"](spark, DATA).collect()
    calls = [m for r in rows for m in r["context"].split(";") if m.startswith("assistant=")]
    assert calls and all(m.endswith("</tool_call>") and '"arguments"' in m for m in calls)


@needs_data
def test_every_document_has_a_reply_verdict(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert catalog.QUERIES["user_reply_rules_all"](spark, DATA).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
    assert catalog.QUERIES["user_reply_rules_all"](spark, DATA).count() == docs.count()


@needs_data
def test_scores_hold_every_language(spark):
    langs = {r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("lang").distinct().collect()}
    rows = catalog.QUERIES["scores_pivot_all_domains"](spark, DATA).collect()
    assert langs < set(rows[0].asDict()) and all(any(r[k] for r in rows) for k in langs)


def test_projection_follows_the_validator_and_not_the_id(spark, tmp_path):
    good = [(5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "a")]
    bad = [(6, 0, "user", "u"), (6, 1, "assistant", "a"), (7, 0, "system", "s"), (7, 1, "user", " ")]
    spark.createDataFrame(good + bad, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(tuple(r) for r in catalog.QUERIES["sft_project_valid"](spark, str(tmp_path)).collect()) == good


def test_error_examples_are_all_kept(spark):
    rows = spark.range(100).select(F.lit("d").alias("domain"), F.lit("t").alias("tool"), F.concat(F.lit("Error: #W"), (F.col("id") % 50).cast("string")).alias("message"), F.col("id").alias("seq"))
    table = errors.error_examples(rows)
    assert sorted((r["example"], r["first_seq"], r["n"]) for r in table.collect()) == sorted((f"Error: #W{k}", k, 2) for k in range(50))
    assert {r["n"] for r in errors.merge_error_examples(table, table).collect()} == {4}
    db = errors.build_error_db(rows, 7).collect()
    assert [(r["count"], r["examples"]) for r in db] == [(100, [f"Error: #W{k}" for k in range(7)])]


def test_error_stream_keeps_all_examples(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_stream(spark, str(tmp_path / "in"), per_trigger=1).select(F.lit("d").alias("domain"), F.lit("t").alias("tool"), F.concat(F.lit("Error: "), F.col("event_id").cast("string")).alias("message"), F.col("event_id").alias("seq"))
    error_log.maintain_error_db(stream, str(tmp_path / "db"), str(tmp_path / "ck")).awaitTermination()
    assert error_log.examples(spark, str(tmp_path / "db")).count() == 40
    assert error_log.error_db(spark, str(tmp_path / "db")).first()["count"] == 40
