"""Data quality: summaries, guards, coverage.

Nulls are what is counted here; null keys are a group of their own in summaries and match nothing between two of them. No rows
in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .select import ranked_values


def feature_summary(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, n, missing, mean, std, p01, p99): missing share, sample deviation, exact quantiles between neighbours.

    Quantiles are read off four selected values, so no task holds the values of a group; a feature that is
    always null has no quantiles. NaN counts as a value.
    """
    long = df.unpivot(list(keys), list(features), "feature", "value")
    own = [*keys, "feature"]
    stats = long.groupBy(*own).agg(F.count("*").alias("n"), F.count("value").alias("__v"), F.avg(F.col("value").isNull().cast("double")).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    places = [(f"{side}_{name}", q, f) for name, q in (("p01", 0.01), ("p99", 0.99)) for side, f in (("low", F.floor), ("high", F.ceil))]
    r = ranked_values(long.where("value IS NOT NULL"), own, "value", lambda n: [f(q * (n - 1)) for _, q, f in places], [p[0] for p in places])

    def quantile(name: str, q: float) -> Column:
        place = q * (F.col("n") - 1)
        return (F.col(f"low_{name}") + (F.col(f"high_{name}") - F.col(f"low_{name}")) * (place - F.floor(place))).alias(name)

    quantiles = r.select(*[F.col(k).alias(f"__k_{k}") for k in own], quantile("p01", 0.01), quantile("p99", 0.99))
    joined = stats.join(quantiles, [stats[k].eqNullSafe(quantiles[f"__k_{k}"]) for k in own], "left")
    return joined.select(*own, "n", "missing", "mean", "std", "p01", "p99")


def retrain_guard(current: DataFrame, previous: DataFrame, keys: Sequence[str], rows: float = 0.3, missing: float = 0.2, label: float = 0.1) -> DataFrame:
    """(keys, check, old, new): each limit that the new summary breaks; keys without an old one pass. Summaries: n, n_features, missing, label_rate."""
    c, p = current.alias("c"), previous.alias("p")
    joined = c.join(p, list(keys))
    checks = [
        ("rows", "n", F.abs(F.try_divide(F.col("c.n"), F.col("p.n")) - 1) > rows),
        ("features", "n_features", F.col("c.n_features") != F.col("p.n_features")),
        ("missing", "missing", F.abs(F.col("c.missing") - F.col("p.missing")) > missing),
        ("label_rate", "label_rate", F.abs(F.col("c.label_rate") - F.col("p.label_rate")) > label),
    ]
    found = F.array(*[F.when(bad, F.struct(F.lit(name).alias("check"), F.col(f"p.{col}").cast("double").alias("old"), F.col(f"c.{col}").cast("double").alias("new"))) for name, col, bad in checks])
    return joined.select(*keys, F.explode(F.array_compact(found)).alias("b")).select(*keys, "b.*")


def coverage(expected: DataFrame, actual: DataFrame, keys: Sequence[str], fresh: str, after) -> DataFrame:
    """expected with state: ok (rows fresher than `after`), stale (older rows only) or missing."""
    newest = actual.groupBy(*keys).agg(F.max(fresh).alias("__newest"))
    state = F.when(F.col("__newest").isNull(), "missing").when(F.col("__newest") < after, "stale").otherwise("ok")
    return expected.join(newest, list(keys), "left").withColumn("state", state).drop("__newest")


def changed(current: DataFrame, previous: DataFrame, keys: Sequence[str], checks: dict[str, tuple[str, float | None]]) -> DataFrame:
    """(keys, check, old, new), values as text: each check that two summaries break. A check is a column and the share that it may change by; None: it must be the same. Keys without an old summary pass."""
    j = current.alias("c").join(previous.alias("p"), list(keys))
    rows = []
    for name, (column, share) in checks.items():
        old, new = F.col(f"p.{column}"), F.col(f"c.{column}")
        broken = ~old.eqNullSafe(new) if share is None else F.abs(F.try_divide(new, old) - 1) > share
        rows.append(F.when(broken, F.struct(F.lit(name).alias("check"), old.cast("string").alias("old"), new.cast("string").alias("new"))))
    return j.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("b")).select(*keys, "b.*")
