"""A log of commits beside a job's data: what has a file there exists, anything else is rubbish.

A step writes its data to folders that nobody reads yet, then puts one small file with their names into the log, by a
rename.  One job writes to a log at a time; any number may read.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

from trajlake.storage import remove


class CommitLog:
    """Commits of a job at ``path``, named by text."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, f"{path}/_log"

    def _file(self, name: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names of all commits, sorted."""
        at, store = self._file("")
        return sorted(n for n in (f.getPath().getName() for f in store.listStatus(at)) if not n.startswith((".", "_"))) if store.exists(at) else []

    def read(self, name: str) -> dict[str, Any]:
        at, store = self._file(name)
        source = store.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def has(self, name: str) -> bool:
        at, store = self._file(name)
        return store.exists(at)

    def commit(self, name: str, content: dict[str, Any]) -> None:
        """Makes the commit visible, whole or not at all."""
        draft, store = self._file(f".{name}-{uuid.uuid4().hex}")
        target = store.create(draft, True)
        try:
            target.write(bytearray(json.dumps(content).encode()))
        finally:
            target.close()
        if not store.rename(draft, self._file(name)[0]):
            raise RuntimeError(f"commit {name} exists already")

    def forget(self, names: list[str]) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint, so that a new checkpoint's batch 0 is not taken for an old one's."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()["value"])["id"]
