"""Folds over each key's rows in their order, on streams whose rows arrive in any order, chunk and batch.

Rows wait in keyed state until the watermark has passed them, so that none before them can come any more; an event-time
timer then releases them, sorted, to the fold.  What waits is as many rows as arrive within the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A fold's step: (state, flag) -> (state, values of the output columns).
Step = Callable[[tuple, bool], tuple[tuple, tuple]]

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_ordered_state(spark: SparkSession) -> None:
    """Let the session's streams keep their state where lists and timers can be kept (read when a stream starts)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class OrderedFold(StatefulProcessor):
    """Rows (key, at microseconds, seq, flag) of one key, folded by (at, seq); a key without rows for more than ``idle``
    microseconds of event time starts anew, and a timer forgets it (None: never)."""

    def __init__(self, step: Step, start: tuple, state: str, names: list[str], idle: int | None) -> None:
        self.step, self.start, self.state, self.names, self.idle = step, start, state, names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, flag boolean")
        self.reached = handle.getValueState("reached", f"last long, {self.state}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = None
        for part in rows:
            self.waiting.appendList([(int(a), int(s), bool(f)) for a, s, f in zip(part["at"], part["seq"], part["flag"], strict=True)])
            latest = max(int(part["at"].max()), latest if latest is not None else -(2**63))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1_000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        later = rows[len(ready) :]
        if ready:
            last, *state = self.reached.get() if self.reached.exists() else (None, *self.start)
            out = []
            for at, seq, flag in ready:
                if self.idle is not None and last is not None and at - last > self.idle:
                    state = self.start
                last = at
                state, values = self.step(tuple(state), flag)
                out.append((*key, seq, *values))
            self.reached.update((last, *state))
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if self.idle is not None:
                self.handle.registerTimer(-(-(last + self.idle) // 1_000))
            yield pd.DataFrame(out, columns=self.names)
        elif self.idle is not None and not later and self.reached.exists() and self.reached.get()[0] + self.idle <= passed:
            self.reached.clear()

    def close(self) -> None:
        pass


def ordered_fold(rows: DataFrame, key: str, step: Step, start: tuple, state: str, outputs: str, delay: str, idle: str | None = None) -> DataFrame:
    """(key, seq, outputs) for each row of a stream (key, ts, seq long, flag), once its place in the order is certain.

    ``state`` and ``outputs`` name and type the fold's state and results ("run long, ..."); rows later than ``delay`` are
    dropped, as in any stream with a watermark.  The session needs ``use_ordered_state`` before the stream starts."""
    fields = T.StructType([rows.schema[key], T.StructField("seq", T.LongType()), *T._parse_datatype_string(outputs).fields])
    quiet = None if idle is None else rows.sparkSession.sql(f"SELECT unix_micros(timestamp_seconds(0) + interval '{idle}')").first()[0]
    fed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(key, "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("flag"), F.lit(False)).alias("flag"))
    fold = OrderedFold(step, start, state, fields.names, quiet)
    return fed.groupBy(key).transformWithStateInPandas(fold, fields, "Append", "EventTime")


def breaker_states(results: DataFrame, threshold: int = 50, delay: str = "10 minutes") -> DataFrame:
    """(source, seq, consecutive, open) for each result of a stream (source, ts, seq, failed): failures in a row up to it,
    and whether ``threshold`` in a row have occurred by then, in the order of (ts, seq)."""

    def step(state: tuple, failed: bool) -> tuple[tuple, tuple]:
        run = state[0] + 1 if failed else 0
        now = (run, state[1] or run >= threshold)
        return now, now

    return ordered_fold(results.withColumnRenamed("failed", "flag"), "source", step, (0, False), "run long, opened boolean", "consecutive long, open boolean", delay)


def injected_calls(calls: DataFrame, most: int, most_in_a_row: int, delay: str = "10 minutes", idle: str | None = "1 day") -> DataFrame:
    """(task_id, seq, made) for each tool call of a stream (task_id, ts, seq, wish): which proposed errors are made, by
    the rule of ``inject.online_injection``.  A task's state (errors made, run) is dropped when it has been idle."""

    def step(state: tuple, wish: bool) -> tuple[tuple, tuple]:
        made = wish and state[0] < most and state[1] < most_in_a_row
        return (state[0] + made, state[1] + 1 if made else 0), (made,)

    return ordered_fold(calls.withColumnRenamed("wish", "flag"), "task_id", step, (0, 0), "n long, run long", "made boolean", delay, idle)
