"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once; not where workers inherit its place by PYTHONPATH."""
    root = Path(__file__).resolve().parent
    inherited = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    application = spark.sparkContext.applicationId
    if root.parent in inherited or application in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="trajlake-code-")) / "trajlake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(application)
