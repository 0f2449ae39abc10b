"""Jobs over ordered rows: rolling days, directions, quintiles and splits; running values are those of scans.py.

Null keys are one group. Rows come in order of one column of times; where two share a time, callers give more order columns, or
either may be first. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .scans import changes, dry_run, forward_fill, hourly_line, islands, trailing  # noqa: F401
from .select import cut_at


def quintile(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with `quintile`: min(4, floor(rank * 5 / n)), rank from 0: four rows of each key say where they begin."""
    return cut_at(df, keys, order, lambda n: [F.ceil(n * q / 5) for q in range(1, 5)], "quintile", ties=True)


def rolling_mean(df: DataFrame, keys: Sequence[str], time: str, value: Column, days: int) -> DataFrame:
    """(keys, day, mean, n): for each day from the first to the last of all rows, the mean over the `days` calendar days that end with it.

    Values are added up by day first, and a day is handed to the windows that hold it; windows without a row are left out.
    """
    daily = df.groupBy(*keys, F.to_date(time).alias("__d")).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    last = df.agg(F.max(F.to_date(time)).alias("__last"))  # one row
    spread = daily.join(F.broadcast(last)).withColumn("day", F.explode(F.sequence("__d", F.least(F.date_add("__d", days - 1), F.col("__last")))))
    return spread.groupBy(*keys, "day").agg((F.sum("__s") / F.sum("__n")).alias("mean"), F.sum("__n").alias("n")).where("n > 0")


def hourly_direction(df: DataFrame, keys: Sequence[str], time: str, degrees: str) -> DataFrame:
    """(keys, hour, degrees): directions between neighbours in time by straight lines of sine and cosine, so that 350 and 10 meet at north."""
    rad = F.radians(degrees)
    line = hourly_line(df.select(*keys, time, F.sin(rad).alias("__sin"), F.cos(rad).alias("__cos")), keys, time, "__sin", "__cos")
    return line.select(*keys, "hour", F.pmod(F.degrees(F.atan2("__sin", "__cos")), F.lit(360.0)).alias(degrees))


PARTS = ("train", "validation", "test")


def split_by_rank(df: DataFrame, keys: Sequence[str], time: str, ranks: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """df with part (train, validation, test) in order of time within a key; the later two begin at the two ranks. Rows of one time are in one part."""
    out = cut_at(df, keys, [time], ranks, "__part")
    return out.withColumn("part", F.element_at(F.array(*map(F.lit, PARTS)), F.col("__part") + 1)).drop("__part")


def split_checked(df: DataFrame, keys: Sequence[str], time: str, train: float = 0.7, validation: float = 0.15, least: int = 10) -> DataFrame:
    """df with part and ok: the key has `least` rows, no part is empty, and no two parts share a time."""
    out = split_by_rank(df, keys, time, lambda n: [F.floor(n * F.lit(train)), F.floor(n * F.lit(train)) + F.floor(n * F.lit(validation))])
    edge = lambda f, name: f(F.when(F.col("part") == name, F.col(time)))
    ok = (F.count("*") >= least) & (edge(F.max, "train") < edge(F.min, "validation")) & (edge(F.max, "validation") < edge(F.min, "test"))
    edges = out.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.coalesce(ok, F.lit(False)).alias("ok"))
    return out.join(edges, [out[k].eqNullSafe(edges[f"__k_{k}"]) for k in keys]).select(*df.columns, "part", "ok")
