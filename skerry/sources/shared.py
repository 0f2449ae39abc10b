"""Folders that driver and executors share, and files as the cluster's own file systems see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows every store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = file_system(spark, path)
    files.delete(where, True)


@lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-skerry-")


@lru_cache(maxsize=64)
def _own(spark: SparkSession, root: str) -> str:
    """This application's folder below the root; it goes when the driver ends."""
    path = f"{root.rstrip('/')}/skerry-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    files, where = file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all machines share; it goes when the driver ends. Where that is unset, a folder of this machine, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = _local_root()
    return f"{_own(spark, root)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A shared folder for the length of a block."""
    path = shared_folder(spark, name)
    try:
        yield path
    finally:
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what several jobs read is computed once, and no executor's memory holds it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
