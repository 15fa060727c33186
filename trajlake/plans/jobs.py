"""Queries that run the streaming jobs and the writers over the given tables, in the application's folder of the shared store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.plans.adapters import conversation_messages, event_messages, labelled_runs, table
from trajlake.plans.registry import query
from trajlake.sources import readers, sinks
from trajlake.storage import application_dir
from trajlake.streaming import error_log, jobs, ordered, resume

#: Batches that a table is dealt over, by the hash of its key.
BATCHES = 4


def _place(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _to_end(frame: DataFrame, place: str) -> DataFrame:
    """Drive a stream over what is there into a table."""
    frame.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{place}/out")


def _event_flags(spark: SparkSession, d: str, key: str, flag: str, value) -> DataFrame:
    """Events as an unordered stream (key, ts, seq, flag) with a last row that lets the watermark pass all others."""
    ordered.use_ordered_state(spark)
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias(key), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), value.alias(flag))
    close = rows.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit("").alias(key), "ts", F.lit(-1).cast("long").alias("seq"), F.lit(False).alias(flag))
    place = _place(spark, "events")
    rows.repartition(BATCHES, "seq").write.parquet(f"{place}/in")
    close.write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{place}/in")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'click') AS bad, sum((event_type NOT IN ('error', 'click'))::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
 r AS (SELECT *, CASE WHEN bad THEN count(*) FILTER (bad) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS consecutive FROM e)
 SELECT user_id::VARCHAR AS source, event_id AS seq, consecutive, max(consecutive) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 3 AS open FROM r"""
)
def stream_breaker_states(spark, d):
    """The circuit breaker's state after every event, from a stream whose rows come in any order."""
    stream = _event_flags(spark, d, "source", "failed", F.col("event_type").isin("error", "click"))
    return _to_end(ordered.breaker_states(stream, 3, "300 days"), _place(spark, "breaker")).where("source <> ''")


@query("SELECT traj_id::VARCHAR AS task_id, n AS n_made FROM (SELECT user_id AS traj_id, least(2, count(*) FILTER (event_type = 'purchase')) AS n FROM events GROUP BY user_id)")
def stream_injected_calls(spark, d):
    """At most two errors a task, wherever its calls lie in the stream."""
    stream = _event_flags(spark, d, "task_id", "wish", F.col("event_type") == "purchase")
    made = _to_end(ordered.injected_calls(stream, 2, 9, "300 days", None), _place(spark, "injected"))
    return made.where("task_id <> ''").groupBy("task_id").agg(F.count_if("made").alias("n_made"))


@query("SELECT domain, count(*) AS n_results, count(DISTINCT task_id) AS n_tasks, sum(task_id)::BIGINT AS tasks FROM lab GROUP BY domain", "lab")
def resumed_work(spark, d):
    """Every task once: batches that overlap, and one that comes again, on a log of commits."""
    out = _place(spark, "work")
    tasks = labelled_runs(spark, d).select("domain", F.col("task_id").cast("string").alias("task_id"), F.lit(0).alias("trial"))
    part = F.pmod(F.xxhash64("task_id"), F.lit(BATCHES))
    for k in (0, 1, 1, 2, 3):
        resume.work_once(tasks.where((part == k) | (part == k - 1)), f"batch-{k}", lambda todo: todo.withColumn("answer", F.lit("done")), out)
    done = resume.results(spark, out, "domain string, task_id string, trial int, answer string")
    return done.groupBy("domain").agg(F.count("*").alias("n_results"), F.countDistinct("task_id").alias("n_tasks"), F.sum(F.col("task_id").cast("long")).alias("tasks"))


@query("SELECT name AS tool, count(*) AS n_examples, sum(event_id)::BIGINT AS first_places, count(*) AS n FROM evt WHERE is_error GROUP BY name", "evt")
def error_log_examples(spark, d):
    """The error database from batches that were appended as runs and merged by size; one batch comes twice."""
    place = _place(spark, "errors")
    rows = event_messages(spark, d).where("is_error").select(F.lit("d").alias("domain"), F.col("name").alias("tool"), F.col("content").alias("message"), F.col("event_id").alias("seq"))
    part = F.pmod(F.xxhash64("seq"), F.lit(BATCHES + 1))
    for number in (0, 1, 1, 2, 3, 4):
        error_log.append(rows.where(part == number), "events", number, place, fanout=2)
    found = error_log.examples(spark, place)
    return found.groupBy("tool").agg(F.count("*").alias("n_examples"), F.sum("first_seq").alias("first_places"), F.sum("n").alias("n"))


@query("SELECT conv_id::VARCHAR AS task_id, 1 + (conv_id % 2) AS attempt, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def runs_round_trip(spark, d):
    """Messages in a folder for each attempt, written whole or not at all, written again, and read back."""
    place = _place(spark, "runs")
    rows = conversation_messages(spark, d).select(F.col("traj_id").cast("string").alias("task_id"), (1 + F.col("traj_id") % 2).alias("attempt"), "content")
    for _ in range(2):
        sinks.write_runs(rows, place, "attempt")
    back = spark.read.schema("task_id string, content string, attempt long").json(place)
    return back.groupBy("task_id", "attempt").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    """SELECT 'good' AS side, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents UNION ALL SELECT 'tolerant', count(*), sum(doc_id)::BIGINT FROM documents
 UNION ALL SELECT 'bad', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 7 = 0"""
)
def jsonl_round_trip(spark, d):
    """Documents as JSON lines, a broken line after every seventh: good records and rejects, by either reader."""
    place = _place(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", "text")
    whole = F.to_json(F.struct("doc_id", "text"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("broken "), F.col("doc_id").cast("string"), F.lit(' {"doc_id": 1}')))
    docs.select(F.explode(F.array(whole, broken)).alias("value")).where("value is not null").write.text(place)
    good, bad = readers.jsonl_with_rejects(spark, place, "doc_id long, text string")
    sides = (("good", good.select("doc_id")), ("tolerant", readers.jsonl_tolerant(spark, place, "doc_id long, text string").select("doc_id")), ("bad", bad.select(F.split("text", " ")[1].cast("long").alias("doc_id"))))
    out = None
    for name, rows in sides:
        one = rows.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(name).alias("side"), "n", "ids")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT user_id AS task_id, count(*) AS attempts, count(*) FILTER (value <= 50) AS failures, max(event_id) FILTER (value > 50) AS last_good FROM events GROUP BY user_id")
def stream_histories(spark, d):
    """Attempts, failures and the latest success of each task, from streams."""
    place = _place(spark, "history")
    rows = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("reward"), "props")
    rows.repartition(BATCHES, "attempt").write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in").withColumnRenamed("props", "trajectory")
    name = f"trajlake_{uuid.uuid4().hex}"
    history = jobs.run_to_end(jobs.failure_history(stream), f"{name}_history").select("task_id", "attempts", "failures")
    latest = jobs.run_to_end(jobs.latest_success(stream), f"{name}_latest").select("task_id", F.col("attempt").alias("last_good"))
    return history.join(latest, "task_id", "left")


