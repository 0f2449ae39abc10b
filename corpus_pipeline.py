"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skerry.llm import line_dedup, mixing, packing, quality, similar
from skerry.llm.common import delete, scratch, shared_folder, until_exit


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the shorter text."""
    out = line_dedup.dedup_lines(docs)
    col = lambda c: F.col(f"`{c}`")
    dropped = col(out.columns[-1])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*map(col, docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("quality rules", good_documents), ("line dedup", fresh_lines), ("near dedup", one_of_each), ("source mixing", mixed), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own intermediate folders, and what it has read, are deleted once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_folder(spark, f"stage{k}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    until_exit(spark, path)
    return docs
