"""Streaming forms of the operators: Structured Streaming with watermarks, checkpoints and bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, per_trigger: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def append_as_completed(stream: DataFrame, path: str, checkpoint: str, keys: list[str], delay: str = "1 day") -> StreamingQuery:
    """Every completed record once, as JSON lines; the checkpoint takes a restarted job on from where it stopped.

    Needs a column ``ts``; a key that comes again within ``delay`` is dropped, later its state is forgotten."""
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def failure_history(stream: DataFrame) -> DataFrame:
    """Attempts, failures and rate of each task, updated as attempts arrive (task_id, reward)."""
    failures = F.count_if(F.coalesce("reward", F.lit(0.0)) <= 0)
    return stream.groupBy("task_id").agg(F.count("*").alias("attempts"), failures.alias("failures"), (failures / F.count("*")).alias("fail_rate"))


def latest_success(stream: DataFrame) -> DataFrame:
    """The latest successful attempt of each task (task_id, attempt, reward, trajectory)."""
    return stream.where("reward > 0").groupBy("task_id").agg(F.max("attempt").alias("attempt"), F.max_by("trajectory", "attempt").alias("trajectory"))


def tumbling_error_rate(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and errors of each window; the same on a table and on a stream."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select(F.col("w.start").alias("window_start"), "n", "n_errors")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """A trajectory is a user's events without a gap longer than ``gap``."""
    timed = events.withWatermark("ts", delay) if events.isStreaming else events
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select("user_id", F.col("s.start").alias("session_start"), "n", "n_errors")


def run_to_end(frame: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Drive a stream over what is there now into an in-memory table (for tests and small results)."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)
