"""The folder that the driver and all executors share, the cut of a plan there, and tables kept there for a while."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[tuple[str, str], str] = {}
_written: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder set on its context.

    Where neither is set, only a session that runs in this one process gets a folder of its own; on a cluster that is an
    error, since executors would write to disks that others cannot read."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="trajlake-")
        sc.setCheckpointDir(place)
    return place


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the shared folder: a provider is not asked again when they are read again, and a
    lost executor loses no answers."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(rows.sparkSession))
    return rows.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark writes; nothing happens where the session has ended or none is there."""
    if spark.sparkContext._jsc is None:
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def application_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one, which goes when the driver's process ends."""
    key = (shared_dir(spark), spark.sparkContext.applicationId)
    if key not in _folders:
        _folders[key] = f"{key[0]}/trajlake-tables-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_folders[key])
        store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)  # also where the session is stopped before the process ends
        atexit.register(remove, spark, _folders[key])
    return _folders[key]


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the application's folder as Parquet and read from there: computed once, safe from lost executors."""
    spark = rows.sparkSession
    path = f"{application_dir(spark)}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for rows in tables:
        found = _written.pop(id(rows), None)
        if found:
            remove(rows.sparkSession, found[1])


@contextmanager
def workspace() -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but for those that the caller puts into the list."""
    before, kept = set(_written), []
    yield kept
    dropped(*[rows for key, (rows, _) in list(_written.items()) if key not in before and not any(rows is k for k in kept)])
