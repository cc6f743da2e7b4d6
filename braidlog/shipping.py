"""Makes this package importable in the Python workers of any session, whatever the driver's path and folder are."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = Path(__file__).resolve().parent
    made = tempfile.mkdtemp(prefix="braidlog-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # executors fetch the archive from the driver as long as it runs
    context.addPyFile(shutil.make_archive(f"{made}/braidlog", "zip", folder.parent, folder.name))
    _shipped.add(context.applicationId)
