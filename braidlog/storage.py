"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


#: Contexts whose end deletes what written() has left in the shared folder.
_watched: set[str] = set()
#: Shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local folder, if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="braidlog-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(context: SparkContext, at: str) -> None:
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def deleted(spark: SparkSession, at: str) -> None:
    """Deletes a folder, if it is there."""
    _delete(spark.sparkContext, at)


def application_dir(spark: SparkSession) -> str:
    """A folder of this application within the shared one. It goes when the context stops, or at the latest when its JVM ends."""
    context = spark.sparkContext
    at = f"{shared_dir(spark)}/braidlog-{context.applicationId}"
    if context.applicationId not in _watched:
        _watched.add(context.applicationId)
        path = context._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        stop = context.stop

        def stopped() -> None:
            if context._jsc is not None:
                with contextlib.suppress(Exception):  # the file system may be gone before the context
                    _delete(context, at)
            stop()

        context.stop = stopped
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage is cut and a lost executor costs nothing of it.

    Shuffle files of the query that writes it go when it ends. The table goes when it is discarded, or with
    the application.
    """
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def released() -> None:
    """Gives memory that Python, Arrow and the C library hold without need back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that no plan reads any more."""
    for df in tables:
        _delete(df.sparkSession.sparkContext, df.written_at)
