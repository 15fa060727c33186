"""Vector code compression: a vector becomes one byte for each of four parts, by codebooks of integers.

Components become integers, ``floor(1024 * x)``, and vectors are cut into four equal parts.  A codebook has up to 256
entries for each part; it starts as the parts of the smallest ids and is refined in a fixed number of rounds.  In each,
the codebooks are broadcast (256 entries of the vector's length: their size does not depend on the number of rows),
Arrow batches compute the squared distances of all their parts by norm expansion, ``|x|^2 - 2 x.c + |c|^2``, in exact
integers, and take the first smallest.  Every task adds up its parts by entry; a grouped shuffle merges these sums, and
the driver divides them: as many rows as codebook entries.  All of it is exact, so a result does not depend on how
the rows lie in partitions, and a task that runs again gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajlake.llm.common import discard, materialize, union_all
from trajlake.llm.keyed import attach

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors that meet the codebooks at once: bounds a worker's memory.
STEP = 2_048
#: Positions of a part in one row of the shuffled sums.
CHUNK = 16
#: Integers are kept within this (a component of 2**60 and more counts as that); errors end at the largest long.
MOST = 2**70
LONG = 2**63 - 1


def part_width(length: int) -> int:
    return -(-length // PARTS)


def _plain(width: int) -> int:
    """Up to this size of the integers, 64 bits hold the distances of four parts of this width."""
    return isqrt(2**58 // max(1, width))


def _compact(values: np.ndarray, width: int) -> np.ndarray:
    """The same integers in 64 bits if distances between them fit there; else as Python's own."""
    if values.dtype != object:
        return values
    limit = _plain(width)
    return values.astype(np.int64) if all(-limit <= v <= limit for v in values.reshape(-1)) else values


def integers(x: np.ndarray) -> np.ndarray:
    """(rows, PARTS, width) integers of finite vectors; zeros fill up parts of a length that four does not divide."""
    rows, length = x.shape
    width = part_width(length)
    with np.errstate(over="ignore"):
        scaled = np.zeros((rows, PARTS * width))
        scaled[:, :length] = np.floor(x.astype(np.float64) * SCALE)  # exact: a power of two
    if not scaled.size or np.abs(scaled).max() <= _plain(width):
        return scaled.astype(np.int64).reshape(rows, PARTS, width)
    clipped = [int(max(-MOST, min(MOST, v))) if np.isfinite(v) else (MOST if v > 0 else -MOST) for v in scaled.reshape(-1).tolist()]
    return np.array(clipped, dtype=object).reshape(rows, PARTS, width)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the first of equals, and the squared distance to it."""
    distance = (parts * parts).sum(axis=1)[:, None] - 2 * (parts @ book.T) + (book * book).sum(axis=1)[None, :]
    best = np.argmin(distance, axis=1).astype(np.int64)
    return best, distance[np.arange(len(best)), best]


def _blocks(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    x = np.asarray(column.flatten()).reshape(len(column), length)
    for first in range(0, len(x), STEP):
        block = integers(x[first : first + STEP])
        if block.dtype == object:  # rows of moderate size keep to 64 bits
            for k in range(len(block)):
                yield first + k, first + k + 1, _compact(block[k : k + 1], block.shape[2])
        else:
            yield first, first + len(block), block


def _decimals(values: np.ndarray) -> pa.Array:
    kind = pa.decimal128(38, 0)
    return pa.array([Decimal(int(v)) for v in values], kind) if values.dtype == object else pa.array(values, pa.int64()).cast(kind)


def _sums(books, length: int):
    """Adds up a task's parts by their nearest entry: (part, entry, chunk, n, s0 .. s15)."""
    width = part_width(length)
    chunks = max(1, -(-width // CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        entries = len(book[0])
        counts = np.zeros((PARTS, entries), np.int64)
        totals = [np.zeros((entries, chunks * CHUNK), np.int64) for _ in range(PARTS)]
        for batch in batches:
            for _, _, block in _blocks(batch.column("v"), length):
                for p in range(PARTS):
                    best, _ = nearest(block[:, p], book[p])
                    order = np.argsort(best, kind="stable")
                    used, begins = np.unique(best[order], return_index=True)
                    counts[p] += np.bincount(best, minlength=entries)
                    if width:
                        added = np.add.reduceat(block[order, p], begins, axis=0)
                        if added.dtype == object and totals[p].dtype != object:
                            totals[p] = totals[p].astype(object)
                        totals[p][used, :width] += added
        for p in range(PARTS):
            on = np.flatnonzero(counts[p])
            if len(on):
                for c in range(chunks):
                    cells = [_decimals(totals[p][on, c * CHUNK + j]) for j in range(CHUNK)]
                    heads = [pa.array(np.full(len(on), p, np.int32)), pa.array(on.astype(np.int32)), pa.array(np.full(len(on), c, np.int32)), pa.array(counts[p][on])]
                    yield pa.RecordBatch.from_arrays([*heads, *cells], names=["part", "entry", "chunk", "n", *[f"s{j}" for j in range(CHUNK)]])

    return run


def _round(rows: DataFrame, book: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The codebooks after one round; an entry that no part is nearest to stays."""
    spark, width = rows.sparkSession, part_width(length)
    shared = spark.sparkContext.broadcast(book)
    cells = [f"s{j}" for j in range(CHUNK)]
    schema = "part int, entry int, chunk int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in cells)
    merged = rows.select("v").mapInArrow(_sums(shared, length), schema).groupBy("part", "entry", "chunk").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cells])
    fresh = [b.astype(object) for b in book]
    for r in merged.collect():  # a row for each entry and chunk
        first = r["chunk"] * CHUNK
        for j, c in enumerate(cells[: max(0, width - first)]):
            fresh[r["part"]][r["entry"], first + j] = int(r[c]) // r["n"]
    shared.unpersist()
    return [_compact(b, width) for b in fresh]


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for part in book for v in part.reshape(-1)).encode()).hexdigest()


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v as array<double>) of the rows whose vector is there and all of finite numbers."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))


def fit(rows: DataFrame, length: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one array (entries, width) for each part, of rows (id, v) of one length; from fewer rows, fewer entries."""
    first = rows.where(F.size("v") == length).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = integers(np.array([r["v"] for r in first], float).reshape(len(first), length))
    book = [_compact(start[:, p], part_width(length)) for p in range(PARTS)]
    for _ in range(rounds):
        book = _round(rows, book, length)
    return book


def encode(rows: DataFrame, book: list[np.ndarray], length: int) -> DataFrame:
    """(id, label, code, error) of rows (id, label, v) of one length."""
    shared = rows.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            errors = np.zeros(batch.num_rows, np.int64)
            for first, last, block in _blocks(batch.column("v"), length):
                total = 0
                for p in range(PARTS):
                    codes[first:last, p], distance = nearest(block[:, p], shared.value[p])
                    total = total + distance
                errors[first:last] = [min(LONG, v) for v in total] if total.dtype == object else total
            text = codes.tobytes().hex()
            code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(errors)], names=["id", "label", "code", "error"])

    kinds = rows.schema
    schema = T.StructType([T.StructField("id", kinds["id"].dataType), T.StructField("label", kinds["label"].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("id", "label", "v").mapInArrow(run, schema)


def decode(codes: DataFrame, book: list[np.ndarray], length: int, code_col: str = "code") -> DataFrame:
    """``codes`` with ``v``, the vector that a code stands for: its entries, scaled back (by half a step more, as
    components were rounded down)."""
    points = [((b.astype(float) + 0.5) / SCALE).tolist() for b in book]
    tables = F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in part]) for part in points])
    at = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("v", F.slice(F.concat(*[F.get(F.get(tables, p), at[p]) for p in range(PARTS)]), 1, length))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every row whose vector is not null and has only finite numbers.

    ``error`` is the squared distance to the code's entries over all parts, ``label_error`` its sum over equal labels
    (nulls are one label).  Ties go to the lower entry.  Repeated rows count and are returned each; rows of one id start
    the codebook in the order of their vectors, those without an id last.  Vectors of each length have codebooks of their
    own; if four does not divide it, zeros fill up the last part.  Finite components may be of any size: up to about
    2**17 for 64 numbers in 64-bit integers, beyond that in larger ones (slower), from 2**60 on as 2**60; errors end at the
    largest long.  Fewer rows than entries make a smaller codebook; an empty table gives an empty result.  Other columns
    are ignored, whatever their names.

    A hot label's sum is broadcast, the others' are joined by a shuffle; no task gets a label's rows together.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    lengths = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    parts = []
    for length in lengths:
        own = rows.where(F.size("v") == length)
        book = fit(own, length, entries, rounds)
        parts.append(encode(own, book, length).withColumn("codebooks_sha256", F.lit(digest(book))))
    if not parts:
        return rows.select("id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).where("false")
    coded = materialize(union_all(parts))
    sums = materialize(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).select("label", F.least("s", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), "n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return attach(coded, sums, ["label"], "n", total).select("id", "code", "error", "label_error", "codebooks_sha256")
