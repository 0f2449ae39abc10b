"""Grouped sums: pivots, complete hours, circular means, summaries.

A null key is a group of its own; null values are left out, and a measure without any value is null. Names that a pivot is
not given have no column: callers take them from a stated list. Repeated rows count each time. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pivot_max(df: DataFrame, keys: Sequence[str], column: str, names: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """One column for each name: the largest value; the names are given, so no extra pass looks for them."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == n, F.col(value))).alias(f"{prefix}{n}") for n in names])


def pivot_two(df: DataFrame, keys: Sequence[str], first: str, firsts: Sequence, second: str, seconds: Sequence, value: str) -> DataFrame:
    """One column for each pair of names."""
    cells = [F.max(F.when((F.col(first) == a) & (F.col(second) == b), F.col(value))).alias(f"{a}_{b}") for a in firsts for b in seconds]
    return df.groupBy(*keys).agg(*cells)


def complete_total(df: DataFrame, keys: Sequence[str], value: str, expected: int) -> DataFrame:
    """Totals of groups that have exactly the expected number of non-null readings."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n")).where(F.col("n") == expected)


def circular_mean(degrees: Column) -> Column:
    """Mean direction in degrees from 0 to 360."""
    rad = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))), F.lit(360.0))


def spread(value: str) -> list[Column]:
    """Mean, population deviation, range and largest of a group, nulls left out."""
    v = F.col(value)
    dev = F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v)))
    return [F.avg(v).alias("mean"), dev.alias("std"), (F.max(v) - F.min(v)).alias("range"), F.max(v).alias("largest")]


def null_shares(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *others: Column) -> DataFrame:
    """(keys, n, null_<column>, others): share of nulls of each column by key, and whatever else one pass can count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in columns], *others)


def null_shares_by_each(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *others: Column) -> DataFrame:
    """null_shares by each key alone, in one pass: the other keys of a row are null, and `by` names the key."""
    sets = df.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
    by = F.element_at(F.array(*map(F.lit, keys)), (F.log2((2 ** len(keys) - 1) - F.grouping_id()).cast("int") * -1 + len(keys)))
    return sets.agg(by.alias("by"), F.count("*").alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in columns], *others)


def correlation_table(df: DataFrame, day: str, slot: str, value: str, floor: float = 1e-12) -> DataFrame:
    """(a, b, corr) for each pair of slots over the days that have both: population covariance, variances no less than `floor`."""
    a = df.select(day, F.col(slot).alias("a"), F.col(value).alias("__x"))
    b = df.select(day, F.col(slot).alias("b"), F.col(value).alias("__y"))
    joined = a.join(b, day)
    cov = F.avg(F.col("__x") * F.col("__y")) - F.avg("__x") * F.avg("__y")
    var = [F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(floor)) for c in ("__x", "__y")]
    return joined.groupBy("a", "b").agg((cov / F.sqrt(var[0] * var[1])).alias("corr"))
