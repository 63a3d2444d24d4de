"""A folder for files that a query needs on the way."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: str | None = None


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the session's shared folder; in local mode without one, in a temporary folder."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local = _local or tempfile.mkdtemp(prefix="spark-geoloom-")
    return f"{root.rstrip('/')}/geoloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that all that follows sees the same rows."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def listing(spark: SparkSession, tasks: int = 64):
    """Folders of tables that are opened within are listed by so many tasks at most, not by one each."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(tasks))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _path(spark: SparkSession, path: str):
    """A path of any file system that Spark reads, and that file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    path, files = _path(spark, path)
    files.delete(path, True)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether there is a file or folder of that name or glob pattern."""
    path, files = _path(spark, pattern)
    return bool(files.globStatus(path))


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; raises where that can't be done."""
    path, files = _path(spark, old)
    if not files.rename(path, _path(spark, new)[0]):
        raise OSError(f"{old} can't be renamed to {new}")
