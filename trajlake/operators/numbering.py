"""Running sums and row numbers over a whole table without a window over it in one task.

Spark deals the rows by ranges of the whole order, whose bounds it samples, and sorts each range; equal keys may lie in
two ranges.  The dealt rows are written once, so that a row's range and its place there stay what they are.  A number is
the place plus the rows of the ranges before: a table of one row for each range, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.storage import written


def _dealt(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with their range (``_part``, rising with the order) and place in it (``_at``, from 0), nulls first."""
    keys = [*order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*([ranges] if ranges else []), *keys).sortWithinPartitions(*keys).drop("_tie")
    return written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))


def _before(dealt: DataFrame, value: Column) -> DataFrame:
    """(_part, _offset): the sum of ``value`` over all earlier ranges; a row for each range."""
    ordered = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(value).alias("_s"))
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_s").over(ordered), F.lit(0)).alias("_offset")))


def running_sum(rows: DataFrame, order: list[str], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (a column of the rows) up to and with each row in the given order.

    Nulls come first; rows of equal order come in any.  ``ranges``: how many, else as many as a shuffle has partitions."""
    dealt = _dealt(rows.withColumn("_value", value), order, ranges)
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("_inside", F.sum("_value").over(inside)).join(_before(dealt, F.col("_value")), "_part")
    return summed.select(*rows.columns, (F.col("_inside") + F.col("_offset")).alias(name))


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``rows`` with their place in the given order, from ``first``; no window at all."""
    dealt = _dealt(rows, order)
    return dealt.join(_before(dealt, F.lit(1)), "_part").select(*rows.columns, (F.col("_at") + F.col("_offset") + first).cast("long").alias(name))
