"""Calibration of stored probabilities.

Rows are those of one stored record each. A key without a threshold or a
climate of its own takes the fallback, or is Ambiguous. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.shared import written
from .joins import asof_join
from .scans import KEY, PART, carried, in_part
from .select import ranked_values


def conformal_thresholds(df: DataFrame, keys: Sequence[str], p: str, wet: str, alpha: float) -> DataFrame:
    """(keys, n, threshold): the split-conformal order statistic of 1 - p (wet) or p (dry), the ceil(q n)-th with q = min(1, ceil((1 - alpha)(n + 1)) / n). Rows without a score do not count."""
    score = F.when(F.col(wet) == 1, 1 - F.col(p)).otherwise(F.col(p))
    at = lambda n: [F.least(n, F.ceil((1 - alpha) * (n + 1))) - 1]
    return ranked_values(df.select(*keys, score.alias("__score")), keys, "__score", at, ["threshold"])


def conformal_tag(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """df with tag Wet, Dry or Ambiguous: the labels whose score is within the threshold of the row's key."""
    wet, dry = 1 - F.col(p) <= F.col("threshold"), F.col(p) <= F.col("threshold")
    tag = F.when(wet & ~dry, "Wet").when(dry & ~wet, "Dry").otherwise("Ambiguous")
    return df.join(thresholds.select(*keys, "threshold"), list(keys), "left").withColumn("tag", tag)


def climatology(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, clim): mean of a measure by key."""
    return df.groupBy(*keys).agg(F.avg(value).alias("clim"))


def with_climatology(df: DataFrame, clim: DataFrame, keys: Sequence[str], fallback: DataFrame) -> DataFrame:
    """df with clim: its key's, or the one of the one-row fallback."""
    return df.join(clim, list(keys), "left").join(F.broadcast(fallback)).withColumn("clim", F.coalesce("clim", "clim_all")).drop("clim_all")


def _pooled(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks (part, low, high, y, n) in order of low, neighbours pooled until means rise: a stack, whose top takes in what does not exceed it."""
    blocks, stack = blocks.sort_values("low"), []
    for low, high, y, n in zip(*(blocks[c].tolist() for c in ("low", "high", "y", "n"))):
        while stack and stack[-1][2] * n >= y * stack[-1][3]:
            last = stack.pop()
            low, y, n = last[0], y + last[2], n + last[3]
        stack.append((low, high, y, n))
    out = pd.DataFrame(stack, columns=["low", "high", "y", "n"])
    out.insert(0, "part", blocks["part"].iloc[0])
    return out


def isotonic_blocks(df: DataFrame, p: str, y: str) -> DataFrame:
    """(low, high, y, n): the blocks of an exact isotonic fit of y to p: their range of p, the sum of y and the number of rows; means rise from block to block.

    Rows of one p are added up first. Each range of p is pooled by itself; where the last mean of a range is not below the first
    of the next, the two are pooled again, and so on until all rise: pooling is the same in any order. A task holds
    the blocks of two ranges, which are few where labels are noisy. Rows with a null in p or y are left out.
    """
    kind = "part long, low double, high double, y double, n double"
    cells = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(p).cast("double").alias("low")).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count("*").cast("double").alias("n"))
    cells = cells.sort("low").select(F.spark_partition_id().cast("long").alias("part"), "low", F.col("low").alias("high"), "y", "n")
    blocks = written(cells.groupBy("part").applyInPandas(_pooled, kind), "blocks")
    while True:
        mean = F.col("y") / F.col("n")
        ranges = blocks.groupBy("part").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last"))
        w = Window.orderBy("part")  # a row for each range
        ranges = ranges.withColumn("falls", F.coalesce(F.lag("last").over(w) >= F.col("first"), F.lit(False)).cast("int"))
        ranges = ranges.withColumn("turn", F.row_number().over(w) % 2).withColumn("chain", F.sum(1 - F.col("falls")).over(w))
        if not ranges.agg(F.sum("falls")).first()[0]:
            return blocks.drop("part")
        # of a chain of falling ranges, two and two
        place = F.row_number().over(Window.partitionBy("chain").orderBy("part")) - 1
        pairs = ranges.select(F.col("part").alias("old"), F.min("part").over(Window.partitionBy("chain", F.floor(place / 2))).alias("new"))
        joined = blocks.join(pairs, blocks["part"] == pairs["old"]).select(F.col("new").alias("part"), "low", "high", "y", "n")
        blocks = written(joined.groupBy("part").applyInPandas(_pooled, kind), "blocks")


def isotonic_knots(df: DataFrame, p: str, y: str) -> DataFrame:
    """(x, value) knots of an isotonic fit: the mid-point of each block; one block gives a flat line over 0..1."""
    blocks = written(isotonic_blocks(df, p, y), "fit")
    knots = blocks.select(((F.col("low") + F.col("high")) / 2).alias("x"), (F.col("y") / F.col("n")).alias("value"))
    if len(blocks.head(2)) == 1:
        knots = knots.select(F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("x"), "value")
    return knots


def apply_knots(df: DataFrame, knots: DataFrame, p: str, parts: int = 256) -> DataFrame:
    """df with `calibrated`: straight lines between knots (x, value), flat outside; null where p is null or there are no knots.

    Each row meets the knot at or before its p, which carries the next one, by an as-of join over parts of p: any number of knots.
    """
    part = lambda x: F.floor(x * parts)
    rows = knots.withColumns({KEY: F.struct(F.lit(0).alias("k")), PART: part(F.col("x")), "__knot": F.struct("x", "value")})
    rows = rows.withColumn("__next", F.lead("__knot").over(in_part("x")))
    rows = carried(rows, {"__begin": F.min_by("__knot", "x")}, lambda w: {"__after": F.lead("__begin").over(w)})
    lines = rows.select("x", "value", F.coalesce("__next", "__after").alias("next"))
    flat = knots.groupBy().agg(F.min_by("value", "x").alias("value")).where("value IS NOT NULL").select(F.lit(float("-inf")).alias("x"), "value", F.lit(None).cast(lines.schema["next"].dataType).alias("next"))
    lines = lines.unionByName(flat).select(F.lit(0).alias("__one"), F.col("x").alias("__x"), F.col("value").alias("__value"), F.col("next").alias("__line"))
    joined = asof_join(df.withColumns({"__one": F.lit(0), "__p": F.col(p).cast("double")}), lines, ["__one"], "__p", "__x", ["__value", "__line"], part)
    slope = (F.col("__line.value") - F.col("__value")) / (F.col("__line.x") - F.col("asof"))
    value = F.when(F.col("__line").isNull(), F.col("__value")).otherwise(F.col("__value") + slope * (F.col("__p") - F.col("asof")))
    return joined.select(*df.columns, F.when(F.col("__p").isNotNull(), value).alias("calibrated"))
