"""Line deduplication: levelled sorted runs of line hashes, compacted periodically, that each new batch is merge-anti-joined with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import LOWER, WHITE, numbered, shared_folder, slots, steps, table, until_exit, unused, written

MIN_CODE_POINTS = 40
MIN_DOCUMENTS = 5
BATCHES = 4
FANOUT = 3


def line_hash(line: bytes, least: int) -> bytes | None:
    """128-bit hash of a line's key; None where the key is too short to count."""
    key = line.strip(WHITE)
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key.translate(LOWER))


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            at, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = {h for line in (text or b"").split(b"\n") if len(line) >= least and (h := line_hash(line, least))}
                at += [i] * len(own)
                keys += own
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(keys, pa.binary())], ["doc_id", "row", "h"])

    return run


class Runs:
    """Sorted runs (h, documents, keeper) in levels. A level that holds `fanout` runs is merged into one run of the next.

    Runs are tables bucketed and sorted by h: joining one with a batch moves the batch alone. A key is moved by
    merging once for each level it rises.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self.spark, self.fanout, self.buckets, self.levels = spark, fanout, slots(spark), []
        self.paths: dict[str, str] = {}

    def _store(self, df: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        self.paths[name] = shared_folder(self.spark, "run")
        placed = df.repartition(self.buckets, "h")
        placed.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        until_exit(self.spark, self.paths[name])
        return name

    def _merge(self, names: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for one that is dealt by h, and then splits keys
        both = self.spark.read.schema("h binary, documents long, keeper long").parquet(*[self.paths[name] for name in names])
        return both.groupBy("h").agg(F.sum("documents").alias("documents"), F.max("keeper").alias("keeper"))

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (h, documents, keeper). A hash that a run has already keeps its earlier keeper; only its count goes on."""
        for k, name in enumerate(self.names()):
            batch = batch.join(self.spark.table(name).select("h", F.lit(True).alias(f"in{k}")), "h", "left")
        if seen := [c for c in batch.columns if c.startswith("in")]:
            batch = batch.select("h", "documents", F.when(F.coalesce(*seen).isNull(), F.col("keeper")).alias("keeper"))
        self._put(0, self._store(batch))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = self._store(self._merge(self.levels[level]))
            self.drop(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)

    def merged(self) -> DataFrame:
        return self._merge(self.names())

    def drop(self, names: list[str]) -> None:
        """From the catalog; the files stay in the shared folder until the driver ends, or the block of `scratch` around it."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _kept(least: int):
    """Takes the lines whose hash the row's list holds out of its text; adds the lines before, and the lines taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            text, drops = batch.column("text"), batch.column("drops")
            lines = pc.add(pc.fill_null(pc.count_substring(text, b"\n"), 0), 1).cast(pa.int64())
            gone, kept = np.zeros(batch.num_rows, np.int64), text.to_pylist()
            for i in np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False)).tolist():
                hs, old = set(drops[i].as_py()), kept[i].split(b"\n")
                new = [line for line in old if len(line) < least or line_hash(line, least) not in hs]
                gone[i], kept[i] = len(old) - len(new), b"\n".join(new)
            out = pa.array(kept, pa.binary()) if gone.any() else text
            rest = [batch.column(c) for c in batch.schema.names if c not in ("text", "drops")]
            yield pa.RecordBatch.from_arrays([*rest, out, lines, pa.array(gone)], [*[c for c in batch.schema.names if c not in ("text", "drops")], "text", "lines", "gone"])

    return run


def dedup_lines(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS, min_documents: int = MIN_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with a shorter text, and two columns more: __n_lines (before), __n_dropped, each with more underscores where docs has one of that name.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least `min_code_points` in at
    least `min_documents` documents lose their lines in all documents but the largest doc_id. A document is a doc_id:
    repeated rows count once and are treated alike; rows without one count as one document, below all others. A null text
    is one empty line and stays null. All columns of docs stay, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    plain, columns = numbered(docs)
    text = columns["text"]
    rows = plain.withColumn("doc_id", F.col(columns["doc_id"]).cast("long")).withColumn("row", F.xxhash64("doc_id", text))
    keys = rows.select("doc_id", "row", F.col(text).cast("binary").alias("text")).mapInArrow(_hashes(min_code_points), "doc_id long, row long, h binary")
    bounds = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    number = F.lit(0)
    for bound in bounds or []:
        number = number + F.when(F.col("doc_id") > bound, 1).otherwise(0)
    path = shared_folder(spark, "keys")
    keys.withColumn("batch", number).write.partitionBy("batch").parquet(path)
    until_exit(spark, path)
    keys = spark.read.schema("doc_id long, row long, h binary, batch int").parquet(path)

    runs = Runs(spark, fanout)
    for i in reversed(range(batches)):  # largest doc_id first, so that the first to bring a line is the one that keeps it
        own = keys.where(F.col("batch") == i).select("h", "doc_id").distinct()
        runs.add(own.groupBy("h").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper")))
    frequent = written(runs.merged().where(F.col("documents") >= min_documents).select("h", "keeper"), "frequent")
    runs.drop(runs.names())

    # by row and not by doc_id: a list is never longer than its own text's lines, whatever rows share an id or have none
    drops = keys.join(frequent, "h").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = written(drops.groupBy("row").agg(F.collect_set("h").alias("drops")), "drops")
    # dealt by row at every size: a choice by size would move no text on small inputs and all of it on large ones
    joined = rows.join(drops.hint("shuffle_hash"), "row", "left")
    rest = [c for c in columns.values() if c != text]
    kinds = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest] + ["text binary", "lines long", "gone long"]
    out = joined.select(*rest, F.col(text).cast("binary").alias("text"), "drops").mapInArrow(_kept(min_code_points), ", ".join(kinds))
    out = out.select(*[F.col("text").cast(plain.schema[text].dataType) if c == text else F.col(c) for c in columns.values()], "lines", "gone")
    return out.toDF(*docs.columns, *unused(docs.columns, "__n_lines", "__n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT a.*, b.k IS NOT NULL AND a.doc_id <> b.keeper AS dropped FROM keyed a LEFT JOIN often b ON a.k = b.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
