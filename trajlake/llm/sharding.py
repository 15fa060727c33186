"""Uniform shuffle into exact shards by a hypergeometric communication matrix.

Rows are numbered in the order of the table's scan and cut into parts of equal size.  How many rows of a part go to
each cell is drawn from the multivariate hypergeometric distribution, so that the cell totals come out exactly as
asked.  Rows are permuted inside their part, exchanged, and permuted again inside their cell.  The composition is a
uniform random permutation of all rows: every assignment of rows to (shard, slot) is equally likely.

The matrix is drawn as a tree of splits in tasks: a node holds how many rows its parts send to each cell in sum and
splits that among its children, down to single parts.  A part's counts meet its rows once, as one row beside them.  A
shard is one or more cells of at most ``cell_rows`` rows, so no task holds a whole shard of a large corpus.  The driver
knows the number of rows of each scan task and of each cell, nothing else.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import materialize
from trajlake.llm.textops import as_strings

#: Shards of the registered query.
SHARDS = 24
#: Most rows of a cell and of a part, i.e. of one task of either permutation; and parts of a small table.
CELL_ROWS = PART_ROWS = 250_000
LEAST_PARTS = 64
#: Children of a node of the matrix' tree.
FAN_OUT = 32
#: Totals that numpy draws from itself; larger ones are split first.
NUMPY_MOST = 10**9


def _measure(batches):
    task = TaskContext.get().partitionId()
    at = 0
    for batch in batches:
        texts = as_strings(batch.column("text"))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = memoryview(texts.buffers()[2] or b"")
        crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(texts))
        n = len(texts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("no_id"), pa.array(np.diff(offsets) + 8), pa.array(crc), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(at, at + n))],
            names=["id", "no_id", "size", "text_crc32", "task", "row"],
        )
        at += n


def even_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that add up to ``total``."""
    return total // shards + (np.arange(shards) < total % shards).astype(np.int64)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One hypergeometric number for totals beyond numpy's range: the inverse of its distribution function, summed in
    double precision over twelve standard deviations on either side of the mode."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    mode = (draws + 1) * (good + 1) // (total + 2)
    spread = int(12 * math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))) + 20
    k = np.arange(max(low, mode - spread), min(high, mode + spread) + 1, dtype=np.float64)
    with np.errstate(divide="ignore"):
        steps = np.log(good - k[:-1]) + np.log(draws - k[:-1]) - np.log(k[:-1] + 1) - np.log(bad - draws + k[:-1] + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return int(k[min(int(np.searchsorted(share, rng.random() * share[-1], "right")), len(k) - 1)])


def split_counts(rng: np.random.Generator, counts: np.ndarray, draws: int, most: int = NUMPY_MOST) -> np.ndarray:
    """How many of ``draws`` rows, taken at random from ``counts`` rows of each cell, are of each cell."""
    total = int(counts.sum())
    if total < most:
        return rng.multivariate_hypergeometric(counts, draws, method="marginals")
    if len(counts) == 1:
        return np.array([draws], np.int64)
    half = len(counts) // 2
    good = int(counts[:half].sum())
    left = large_hypergeometric(rng, good, total - good, draws)
    return np.concatenate([split_counts(rng, counts[:half], left, most), split_counts(rng, counts[half:], draws - left, most)])


def split_node(low: int, high: int, counts: np.ndarray, rows: int, per_part: int, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """Children of a node that holds parts ``low`` to ``high`` (exclusive): their bounds and counts by cell."""
    rng = np.random.default_rng([seed, 1, low, high])
    bounds = np.unique(np.linspace(low, high, min(FAN_OUT, high - low) + 1).astype(np.int64))
    left, out = counts.copy(), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        drawn = split_counts(rng, left, min(b * per_part, rows) - a * per_part)
        left -= drawn
        out.append((a, b, drawn))
    return out


def scatter_cells(part: int, counts: np.ndarray, seed: int) -> np.ndarray:
    """The cell of each row of a part, in the order of its rows."""
    cells = np.empty(int(counts.sum()), np.int32)
    cells[np.random.default_rng([seed, 2, part]).permutation(len(cells))] = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    return cells


def settle_order(cell: int, rows: int, seed: int) -> np.ndarray:
    """The places of a cell's rows in it."""
    return np.random.default_rng([seed, 3, cell]).permutation(rows)


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 7, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards, uniformly at random, with row counts at most one apart.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot (gapless from 0 in its shard).
    Null text counts as empty; texts of any length are measured whole; repeated rows and null ids are placed like any
    other row; an empty table gives an empty result; other columns are ignored.  The result depends on the seed and on
    the order of the table's scan.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(id_col), F.lit(0)).cast("long").alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(base.mapInArrow(_measure, "id long, no_id boolean, size long, text_crc32 long, task int, row long"))
    counted = sorted((r["task"], r["n"]) for r in rows.groupBy("task").agg(F.count("*").alias("n")).collect())
    sizes = np.array([n for _, n in counted], np.int64)
    total = int(sizes.sum())
    parts = min(max(1, total), max(LEAST_PARTS, -(-total // part_rows)))
    per_part = max(1, -(-total // parts))
    parts = -(-total // per_part)
    per_shard = even_sizes(total, shards)
    split = max(1, -(-int(per_shard.max()) // cell_rows))
    cells = np.concatenate([even_sizes(int(n), split) for n in per_shard])
    starts = np.concatenate([np.cumsum(even_sizes(int(n), split)) - even_sizes(int(n), split) for n in per_shard])

    node = "low long, high long, counts array<long>"

    def split_nodes(batches):
        for batch in batches:
            for low, high, counts in batch.itertuples(index=False):
                done = [(low, high, counts)] if high - low == 1 else split_node(low, high, np.asarray(counts, np.int64), total, per_part, seed)
                for child in done:  # one by one: a row holds a number for each cell
                    yield pd.DataFrame([child], columns=["low", "high", "counts"])

    matrix = spark.createDataFrame([(0, parts, cells.tolist())] if total else [], node)
    width = parts
    while width > 1:
        matrix = matrix.repartition(F.col("low")).mapInPandas(split_nodes, node)
        width = -(-width // FAN_OUT)
    matrix = materialize(matrix)

    def scatter(group: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number", ignore_index=True)
        cell = scatter_cells(int(plan["low"].iloc[0]), np.asarray(plan["counts"].iloc[0], np.int64), seed) if len(group) else np.zeros(0, np.int32)
        return group[["id", "no_id", "size", "text_crc32", "number"]].assign(cell=cell)

    def settle(key, group: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        group = group.sort_values("number", ignore_index=True)
        slot = starts[cell] + settle_order(cell, len(group), seed)
        return group[["id", "no_id", "size", "text_crc32"]].assign(shard=np.full(len(group), cell // split, np.int32), slot=slot)

    first = spark.createDataFrame([(t, int(n)) for (t, _), n in zip(counted, np.cumsum(sizes) - sizes, strict=True)], "task int, first long")
    numbered = rows.join(first, "task").select("id", "no_id", "size", "text_crc32", (F.col("first") + F.col("row")).alias("number"))
    numbered = numbered.withColumn("part", F.floor(F.col("number") / per_part).cast("long"))
    scattered = numbered.groupBy("part").cogroup(matrix.groupBy("low")).applyInPandas(scatter, "id long, no_id boolean, size long, text_crc32 long, number long, cell int")
    placed = scattered.groupBy("cell").applyInPandas(settle, "id long, no_id boolean, size long, text_crc32 long, shard int, slot long")
    return placed.select(F.when(~F.col("no_id"), F.col("id")).alias("id"), "size", "text_crc32", "shard", "slot")
