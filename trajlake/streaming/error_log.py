"""The error database kept by a stream: new examples are appended as runs, runs are merged by size, readers merge the rest.

Every batch writes its own distinct examples as a run of level 0.  When a level has ``FANOUT`` runs they become one of
the next level, so an example is written as often as its run climbs: the logarithm of the number of batches, not each
batch.  A version of the log names the live runs; runs and versions that neither of the last two versions names are
deleted.
"""

from __future__ import annotations

import uuid
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trajlake.operators.errors import error_examples, merged_examples, preview_error_db
from trajlake.storage import remove
from trajlake.streaming.commits import CommitLog, folders, query_id, size

FANOUT = 4
EXAMPLES = "domain string, tool string, error string, example string, first_seq long, n long"


def _latest(log: CommitLog) -> tuple[int, dict[str, Any]]:
    names = log.names()
    return (int(names[-1]), log.read(names[-1])) if names else (-1, {"runs": [], "batches": {}, "bytes": 0})


def _read(spark: SparkSession, path: str, runs: list[dict[str, Any]]) -> DataFrame:
    return spark.read.schema(EXAMPLES).parquet(*[f"{path}/runs/{r['name']}" for r in runs]) if runs else spark.createDataFrame([], EXAMPLES)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Every example with its template, number and first place, as of the latest version."""
    return merged_examples(_read(spark, path, _latest(CommitLog(spark, path))[1]["runs"]))


def error_db(spark: SparkSession, path: str, most_examples: int = 5) -> DataFrame:
    """The template table with a preview of each template's examples."""
    return preview_error_db(examples(spark, path), most_examples)


def append(batch: DataFrame, source: str, number: int, path: str, fanout: int = FANOUT) -> None:
    """Add the results (domain, tool, message, seq) of batch ``number`` of the stream ``source``, once."""
    spark = batch.sparkSession
    log = CommitLog(spark, path)
    version, state = _latest(log)
    if state["batches"].get(source, -1) >= number:
        return
    runs, written = list(state["runs"]), state["bytes"]

    def write(rows: DataFrame, level: int) -> None:
        nonlocal written
        name = f"{level}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/runs/{name}")
        runs.append({"name": name, "level": level})
        written += size(spark, f"{path}/runs/{name}")

    write(error_examples(batch), 0)
    while full := [level for level, n in Counter(r["level"] for r in runs).items() if n >= fanout]:
        level = min(full)
        old = [r for r in runs if r["level"] == level]
        runs[:] = [r for r in runs if r["level"] != level]
        write(merged_examples(_read(spark, path, old)), level + 1)
    log.commit(f"{version + 1:012d}", {"runs": runs, "batches": state["batches"] | {source: number}, "bytes": written})
    live = {r["name"] for r in (*runs, *state["runs"])}
    for name in folders(spark, f"{path}/runs"):
        if name not in live:
            remove(spark, f"{path}/runs/{name}")
    log.forget(log.names()[:-2])


def maintain_error_db(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds every micro-batch of a stream of results to the database at ``path``; ``error_db`` reads it."""

    def one(batch: DataFrame, number: int) -> None:
        append(batch, query_id(batch.sparkSession, checkpoint), number, path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
