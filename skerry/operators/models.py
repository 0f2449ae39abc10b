"""Fitted models as stored artefacts: one pyspark.ml model for each lead, with what it was fitted on.

A folder holds `lead=<n>` for each model and `about`, a row for each lead: its features in order, their hash, the cutoff that
training rows lie before, and error measures if given. Rows whose lead has no model are left out of what is scored; no rows in, none out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ABOUT = "lead long, features array<string>, feature_hash string, cutoff timestamp_ntz, measures map<string, double>"


def features_hash(features: Sequence[str]) -> str:
    """Of names and order: vectors are built by place."""
    return hashlib.sha256("\n".join(features).encode()).hexdigest()


def forecast_of(model) -> Column:
    """What a fitted model gives in its rows: the chance of label 1 of a classifier, else the predicted value."""
    return vector_to_array(model.getProbabilityCol())[1] if model.hasParam("probabilityCol") else F.col(model.getPredictionCol())


def store(spark: SparkSession, root: str, models: Mapping[int, MLWritable], features: Sequence[str], cutoff, measures: Mapping[int, Mapping[str, float]] | None = None) -> None:
    """Writes the models, and last what they are: a folder without `about` is not an artefact. An artefact is never overwritten."""
    for lead, model in models.items():
        model.write().save(f"{root}/lead={lead}")
    rows = [(lead, list(features), features_hash(features), cutoff, dict((measures or {}).get(lead, {}))) for lead in models]
    spark.createDataFrame(rows, ABOUT).coalesce(1).write.json(f"{root}/about")


def about(spark: SparkSession, *roots: str) -> DataFrame:
    """A row for each lead of each artefact, with its folder as `root`."""
    rows = spark.read.schema(ABOUT).json([f"{r}/about" for r in roots])
    return rows.withColumn("root", F.regexp_replace(F.col("_metadata.file_path"), "/about/[^/]*$", ""))


def replay(spark: SparkSession, root: str, table: DataFrame, features: Sequence[str], vectors: Callable[[DataFrame, Sequence[str]], DataFrame], leaking: Collection[str] = ()) -> DataFrame:
    """The stored models over a table with a column lead: its rows with `prediction` and `trained`, whether the row's valid time lies before the cutoff.

    Refused: features that hold the truth, and features other than those that the models were fitted on, in their order.
    """
    if leaks := set(leaking) & set(features):
        raise ValueError(f"features hold the truth: {sorted(leaks)}")
    stored = about(spark, root).collect()  # a row for each lead
    if wrong := [r.lead for r in stored if r.feature_hash != features_hash(features)]:
        raise ValueError(f"the models of leads {wrong} were fitted on other features than {list(features)}")
    rows, out = vectors(table, features), None
    for r in stored:
        model = DefaultParamsReader.loadParamsInstance(f"{root}/lead={r.lead}", spark.sparkContext)
        own = model.transform(rows.where(F.col("lead") == r.lead)).withColumn("trained", F.col("valid") < F.lit(r.cutoff).cast("timestamp_ntz"))
        out = own if out is None else out.unionByName(own)
    return out


def retrain_summary(artefacts: DataFrame, keys: Sequence[str], after, model: str = "test_mae", single: str = "best_mae") -> DataFrame:
    """(keys, lead, cutoff, root, model, single, percent): of each key and lead the newest artefact with a cutoff after the given one, and its error against the best single source stored with it, in percent."""
    newest = artefacts.where(F.col("cutoff") > F.lit(after).cast("timestamp_ntz")).groupBy(*keys, "lead").agg(F.max_by(F.struct("cutoff", "root", F.col("measures")[model].alias(model), F.col("measures")[single].alias(single)), F.struct("cutoff", "root")).alias("a"))
    return newest.select(*keys, "lead", "a.*").withColumn("percent", F.try_divide(100 * (F.col(model) - F.col(single)), F.col(single)))
