"""Work on a stream of tasks whose every result is kept exactly once, wherever the job is killed.

A batch's results and the keys of its tasks are written to one folder; a commit names the folder.  A batch that runs
again after a crash finds its commit and does nothing, or does not and starts over: what the crash left behind belongs to
no commit and is not read.  Tasks that an earlier batch, or an earlier job on the same folder, has completed are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trajlake.sources import readers, schemas
from trajlake.storage import remove
from trajlake.streaming.commits import CommitLog, folders, query_id

TASK = ["domain", "task_id", "trial"]


def _committed(spark: SparkSession, out: str, part: str) -> list[str]:
    log = CommitLog(spark, out)
    return [f"{out}/data/{log.read(name)['folder']}/{part}" for name in log.names()]


def results(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Results of all committed batches."""
    paths = _committed(spark, out, "results")
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def completed(spark: SparkSession, out: str) -> DataFrame:
    """Keys of all committed tasks."""
    paths = _committed(spark, out, "keys")
    return spark.read.schema(schemas.CHECKPOINT).parquet(*paths) if paths else spark.createDataFrame([], schemas.CHECKPOINT)


def work_once(batch: DataFrame, name: str, work: Callable[[DataFrame], DataFrame], out: str, before: DataFrame | None = None) -> None:
    """Work on the tasks (domain, task_id, trial, ...) of a batch and commit it; nothing if it is committed.

    ``before``: keys of tasks that are completed elsewhere."""
    spark = batch.sparkSession
    log = CommitLog(spark, out)
    if log.has(name):
        return
    folder = f"{name}-{uuid.uuid4().hex}"
    done = completed(spark, out)
    todo = readers.pending(batch.dropDuplicates(TASK), done if before is None else done.unionByName(before.select(*TASK))).persist()
    try:
        work(todo).write.json(f"{out}/data/{folder}/results")
        todo.select("domain", "task_id", F.col("trial").cast("int").alias("trial")).write.parquet(f"{out}/data/{folder}/keys")
    finally:
        todo.unpersist()
    log.commit(name, {"folder": folder})


def run_and_checkpoint(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, before: DataFrame | None = None) -> StreamingQuery:
    """Works through a stream of tasks, batch by batch; ``results`` and ``completed`` read what it has done."""

    def one(batch: DataFrame, number: int) -> None:
        work_once(batch, f"{query_id(batch.sparkSession, checkpoint)}-{number:012d}", work, out, before)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sweep(spark: SparkSession, out: str) -> list[str]:
    """Delete what crashes have left behind, while no job works on the folder; its names."""
    log = CommitLog(spark, out)
    live = {log.read(name)["folder"] for name in log.names()}
    lost = [f for f in folders(spark, f"{out}/data") if f not in live]
    for folder in lost:
        remove(spark, f"{out}/data/{folder}")
    return lost
