"""Ranks and running xors inside groups of any size, without a window over a group in one task.

Rows are dealt by ranges of (group, order), so a large group lies in several partitions.  Each partition is one pass in
order; where a group goes on in the next partition, what it has reached is added there from a table of one row for each
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.llm.common import discard, materialize


def ranked(rows: DataFrame, group: str, order: list[str], lanes: list[str] | None = None) -> DataFrame:
    """``rows`` with ``rank`` (long, from 1 in each group, in the given order, nulls first) and each of the columns in
    ``lanes`` (long, not null) replaced by its xor up to and with the row.

    ``group`` is a long without nulls.  Equal rows are ranked one after the other.  The result is read from a written
    table."""
    lanes = lanes or []
    keys = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    plain = [f for f in dealt.schema.fields if f.name not in lanes]
    schema = T.StructType([*plain, *[T.StructField(n, T.LongType()) for n in (*lanes, "rank", "_part", "_first")], T.StructField("_tail", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])  # the last row of a partition has nulls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = now = None
        have, reached = 0, [0] * len(lanes)
        kinds = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kinds = {f.name: f.type for f in batch.schema}
            g = np.asarray(batch.column(group))
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            at = np.repeat(starts, np.diff(np.append(starts, n)))
            rank = np.arange(n) - at + 1
            goes_on = g[: starts[1] if len(starts) > 1 else n] if now is not None and g[0] == now else g[:0]
            rank[: len(goes_on)] += have
            done = []
            for k, lane in enumerate(lanes):
                total = np.bitwise_xor.accumulate(np.asarray(batch.column(lane)))
                own = total ^ np.where(at > 0, total[at - 1], 0)
                own[: len(goes_on)] ^= reached[k]
                done.append(own)
                reached[k] = int(own[-1])
            first = int(g[0]) if first is None else first
            now, have = int(g[-1]), int(rank[-1])
            fixed = [batch.column(f.name) for f in plain]
            yield pa.RecordBatch.from_arrays([*fixed, *map(pa.array, done), pa.array(rank.astype(np.int64)), pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))], names=schema.names)
        if now is not None:
            ends = [pa.array([now], pa.int64()) if f.name == group else pa.nulls(1, kinds[f.name]) for f in plain]
            yield pa.RecordBatch.from_arrays([*ends, *[pa.array([x], pa.int64()) for x in (*reached, have, part, first)], pa.array([True])], names=schema.names)

    passed = materialize(dealt.mapInArrow(run, schema))
    tails = passed.where("_tail")
    reached = ["rank", *lanes]
    gives = tails.select(group, "_part", F.lit(1).alias("_asks"), *reached)
    asks = tails.select(F.col("_first").alias(group), "_part", F.lit(0).alias("_asks"), *[F.lit(0).cast("long").alias(c) for c in reached])
    before = Window.partitionBy(group).orderBy("_part", "_asks").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum("rank").over(before).alias("_add_rank"), *[F.bit_xor(c).over(before).alias(f"_add_{c}") for c in lanes]]
    offsets = gives.unionByName(asks).select(group, "_part", "_asks", *sums).where("_asks = 0 AND _add_rank > 0").drop("_asks")
    offsets = materialize(offsets.withColumnsRenamed({group: "_group", "_part": "_at"}))  # at most a row for each partition
    out = passed.where("not _tail").join(F.broadcast(offsets), (F.col(group) == F.col("_group")) & (F.col("_part") == F.col("_at")), "left")
    whole = {"rank": F.col("rank") + F.coalesce("_add_rank", F.lit(0))} | {c: F.col(c).bitwiseXOR(F.coalesce(f"_add_{c}", F.lit(0))) for c in lanes}
    done = materialize(out.select(*[f.name for f in plain], *[whole[c].cast("long").alias(c) for c in (*lanes, "rank")]))
    discard(passed, offsets)
    return done
