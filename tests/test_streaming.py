"""Streaming jobs driven to their end on small folders."""

import pytest
from pyspark.sql import functions as F

from trajlake.streaming import jobs


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.range(200).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 5 == 0, "error").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    return rows, str(tmp_path / "in"), tmp_path


def test_windows_and_history_match_batch(spark, events):
    rows, path, _ = events
    stream = jobs.event_stream(spark, path)
    got = jobs.run_to_end(jobs.tumbling_error_rate(stream), "w").collect()
    assert sorted(got) == sorted(jobs.tumbling_error_rate(rows).collect())
    results = stream.select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("reward"))
    batch = rows.select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("reward"))
    assert sorted(jobs.run_to_end(jobs.failure_history(results), "h").collect()) == sorted(jobs.failure_history(batch).collect())


def test_append_once_and_resume(spark, events):
    rows, path, tmp = events
    for _ in range(2):  # a restart adds nothing
        jobs.append_as_completed(jobs.event_stream(spark, path), str(tmp / "out"), str(tmp / "ck"), ["event_id"]).awaitTermination()
    assert spark.read.json(str(tmp / "out")).count() == 200
