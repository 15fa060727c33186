"""Shared folder, materialised tables and small helpers for the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trajlake.storage import shared_dir

#: Rows of texts that a Python worker gets at once in passes over whole tables: bounds its memory.
TEXT_ROWS = 1_000

_folders: dict[str, str] = {}
_paths: dict[int, tuple[DataFrame, str]] = {}


def _folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the driver's process ends, or its JVM does if the
    session has been stopped before."""
    place = shared_dir(spark)
    if place not in _folders:
        _folders[place] = f"{place}/trajlake-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_folders[place])
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)
        atexit.register(_delete, spark, _folders[place])
    return _folders[place]


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended: its folder stays
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with other settings for a while (dots of their names as two underscores); unknown ones are left out."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            with suppress(PySparkException):  # a setting this Spark doesn't have
                spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            with suppress(PySparkException):
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialize(df: DataFrame, observation: Observation | None = None, *measures: Column, batch_rows: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it again: cuts lineage, survives lost executors.

    ``observation`` receives ``measures`` of the rows as they are written, so that no second job is needed for them.
    ``batch_rows``: rows that Python workers get at once, for rows that are large; ``compression`` of the files.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    more = {"spark__sql__execution__arrow__maxRecordsPerBatch": str(batch_rows)} if batch_rows else {}
    with settings(spark, **more):
        (df.observe(observation, *measures) if observation else df).write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what has been written: its cleaner waits for the driver's garbage collector,
    which a driver with little to do runs rarely, and the last query stays referenced until another has run.  For
    operators whose shuffles are as large as their input."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no result will read again."""
    for df in tables:
        found = _paths.pop(id(df), None)
        if found:
            _delete(df.sparkSession, found[1])


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables materialised inside are deleted at the end, but for those that the caller puts into the list."""
    before, kept = set(_paths), []
    yield kept
    discard(*[df for key, (df, _) in list(_paths.items()) if key not in before and not any(df is k for k in kept)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column), F.lit(modulus))


def hash_sample(df: DataFrame, key: str, size: int, seed: int = 1) -> DataFrame:
    """About ``size`` rows (never more than twice that), chosen by the hash of their key; all rows of a smaller table.

    A threshold on the hash keeps what each task returns small however many tasks there are."""
    total = df.count()
    if total <= size:
        return df
    span = 1 << 31
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(span)) < int(span * size / total)).limit(2 * size)


def tree_sums(parts: DataFrame, dtype: str, lots: int = 64) -> DataFrame:
    """Sum of the arrays in ``sums`` (binary, of ``dtype``) by ``key`` (int): first of the partitions in each of ``lots``
    lots, then of the lots, so that no task holds an array of every partition."""
    kind = np.dtype(dtype)

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(group["sums"].iloc[0], kind).copy()
        for part in group["sums"].iloc[1:]:
            total += np.frombuffer(part, kind)
        return pd.DataFrame({"key": [group["key"].iloc[0]], "lot": [group["lot"].iloc[0]], "sums": [total.tobytes()]})

    lotted = parts.select("key", F.pmod(F.spark_partition_id(), F.lit(lots)).cast("int").alias("lot"), "sums")
    first = lotted.groupBy("key", "lot").applyInPandas(add, "key int, lot int, sums binary")
    return first.groupBy("key").applyInPandas(add, "key int, lot int, sums binary").drop("lot")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """The rows of one or more tables of equal columns."""
    out = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame)
    return out
