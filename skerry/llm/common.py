"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but these six characters; bytes.split() and this class agree on them.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\r\x0b\x0c"
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of text that one vectorised step handles at once; a longer text is a step of its own.
STEP_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of this machine, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = local_root()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


_SCRATCH: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends: results that are read lazily need it till then."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that shared_folder gives inside the block are deleted at its end: what is read later must be written to one that was taken before."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


@lru_cache(maxsize=1)
def local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-skerry-")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the text's bytes; whatever other columns there are stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to c0, c1, ..., so that no helper column can clash with one; and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before those that a column has already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again, in slices of about `most` bytes of a binary column (one row at least)."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def slots(spark: SparkSession) -> int:
    """Partitions for a shuffle of our own."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

