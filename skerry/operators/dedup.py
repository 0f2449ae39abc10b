"""Which of several rows with one key counts.

Null keys are one group. A null in a column that is ordered downwards comes last. Rows that tie in every order column are
any of them: callers end the order with an id. Repeated rows leave one. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The row with the largest `newest` columns of each key; Spark keeps one row a key and task before it shuffles."""
    return first_by(df, keys, [F.col(c).desc_nulls_last() for c in newest])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_per_valid(df: DataFrame, keys: Sequence[str], lead: str = "lead", made: str = "made", ties: Sequence[str] = ()) -> DataFrame:
    """Smallest lead, then newest made, for each key."""
    return first_by(df, keys, [F.col(lead).asc(), F.col(made).desc(), *[F.col(c).asc() for c in ties]])


def freshest_per_valid(df: DataFrame, keys: Sequence[str], made: str = "made", ties: Sequence[str] = ()) -> DataFrame:
    """Newest made for each key, whatever its lead."""
    return first_by(df, keys, [F.col(made).desc(), *[F.col(c).asc() for c in ties]])


def merge_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fresh: Sequence[str]) -> DataFrame:
    """Both together; of each key the row with the largest `fresh` columns. Columns that one side lacks are null."""
    return latest(existing.unionByName(incoming, allowMissingColumns=True), keys, fresh)


def best_by_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], within: Sequence[str], then: Sequence[Column]) -> DataFrame:
    """Two choices, one after the other: first within finer groups, then among their winners."""
    return first_by(first_by(df, [*keys, *within], order), keys, then)
