"""Scores of forecasts against truth.

Rows that lack one of the two are left out of a measure and of its n; a measure of no rows is null, and so is a ratio with
nothing below it. Null keys are a group of their own. Repeated rows count each time. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def errors(f: str, y: str) -> list[Column]:
    """Mean absolute error, root mean square error, bias and n of rows that have both."""
    d = F.col(f) - F.col(y)
    return [F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.count(d).alias("n")]


def brier(p: str, wet: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(wet), F.lit(2.0)))


def brier_scores(df: DataFrame, keys: Sequence[str], p: str, wet: str, reference: str) -> DataFrame:
    """Brier score of p and of a reference probability, and the skill of the one over the other (null if the reference is perfect)."""
    out = df.groupBy(*keys).agg(brier(p, wet).alias("brier"), brier(reference, wet).alias("reference"), F.count("*").alias("n"))
    return out.withColumn("skill", 1 - F.try_divide("brier", "reference"))


def reliability(df: DataFrame, keys: Sequence[str], p: str, wet: str, bins: int) -> DataFrame:
    """(keys, bin, n, mean_p, observed): every bin of every key, empty ones with n 0 and nulls; rows without p are left out."""
    binned = df.where(F.col(p).isNotNull()).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int"))
    found = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(wet).alias("observed"))
    spine = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return spine.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def contingency(f: str, y: str) -> list[Column]:
    """Hits, misses, false alarms, true negatives, and the ratios made of them; 0/1 columns."""
    a, b = F.col(f) == 1, F.col(y) == 1
    hits, miss, false, none = (F.count_if(c) for c in (a & b, ~a & b, a & ~b, ~a & ~b))
    return [
        hits.alias("hits"), miss.alias("misses"), false.alias("false_alarms"), none.alias("true_negatives"),
        F.try_divide(hits, hits + miss).alias("hit_rate"), F.try_divide(false, hits + false).alias("false_alarm_ratio"),
        F.try_divide(hits, hits + miss + false).alias("csi"), F.try_divide(hits + false, hits + miss).alias("frequency_bias"),
    ]


def crps_ensemble(members: Column, y: Column) -> Column:
    """CRPS of an ensemble by its sorted members: mean |x - y| less half the mean difference of two members."""
    n = F.size(members)
    ordered = F.array_sort(members)
    apart = F.aggregate(F.transform(ordered, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda a, x: a + x)
    near = F.aggregate(F.transform(members, lambda x: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    return near / n - apart / (n * n)


def crps_quantiles(quantiles: Column, levels: Sequence[float], y: Column) -> Column:
    """CRPS as twice the mean pinball loss over the levels."""
    losses = [F.greatest((y - quantiles[i]) * level, (quantiles[i] - y) * (1 - level)) for i, level in enumerate(levels)]
    return sum(losses[1:], losses[0]) * (2.0 / len(losses))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "source", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def best_single(df: DataFrame, keys: Sequence[str], source: str, f: str, y: str) -> DataFrame:
    """(keys, best, best_mae): the source with the least mean absolute error; ties to the first name."""
    by = df.groupBy(*keys, source).agg(F.avg(F.abs(F.col(f) - F.col(y))).alias("__mae"))
    return by.groupBy(*keys).agg(F.min(F.struct("__mae", F.col(source).alias("s"))).alias("__m")).select(*keys, F.col("__m.s").alias("best"), F.col("__m.__mae").alias("best_mae"))


def drift(mae: Column, n: Column, lead: Column, reference: Column, least: int, threshold: float, slope: float) -> Column:
    """True where there are enough rows and the error is over the reference times a limit that grows with lead."""
    return (n >= least) & (mae > (threshold + slope * (lead - 24) / 24) * reference)


def pool_rows(df: DataFrame, keys: Sequence[str], n: str, means: Sequence[str], flag: str, label: str) -> DataFrame:
    """Verification rows of one key as one: n-weighted means, summed n, any flag, the label of the largest n."""
    weighted = [F.try_divide(F.sum(F.col(m) * F.col(n)), F.sum(F.when(F.col(m).isNotNull(), F.col(n)))).alias(m) for m in means]
    return df.groupBy(*keys).agg(*weighted, F.sum(n).alias(n), F.max(flag).alias(flag), F.max_by(label, F.struct(F.col(n), F.col(label))).alias(label))


def mixed_crps(pi: Column, quantiles: Column, y: Column, draws: int) -> Column:
    """CRPS of an amount that is nil with probability 1 - pi and else one of equally likely quantiles, as an ensemble of `draws` members."""
    wet = F.round(pi * draws).cast("int")
    k = F.size(quantiles)
    members = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.when(i <= draws - wet, F.lit(0.0)).otherwise(F.element_at(quantiles, F.least(k, F.floor((i - (draws - wet) - 1) * k / F.greatest(wet, F.lit(1))) + 1).cast("int"))))
    return crps_ensemble(members, y)


def mixture_crps(pi: Column, quantiles: Column, y: Column) -> Column:
    """CRPS, in closed form, of an amount that is nil with probability 1 - pi and else one of equally likely quantiles; y is 0 or more."""
    k, dry = F.size(quantiles), 1 - pi
    wet = pi / k
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    ordered = F.array_sort(quantiles)
    apart = 2 * add(F.transform(ordered, lambda x, i: x * (2 * i + 1 - k)))
    near = dry * y + wet * add(F.transform(quantiles, lambda x: F.abs(x - y)))
    return near - dry * wet * add(quantiles) - wet * wet * apart / 2


def histogram(value: Column, bins: int) -> Column:
    """Counts of values from 0 to 1 in equal bins, as an array; 1 is in the last. Combined before any shuffle."""
    at = F.when(value.isNotNull(), F.least(F.lit(bins - 1), F.floor(value * bins)))  # least passes over a null
    return F.array(*[F.count_if(at == i) for i in range(bins)])


def pool_bins(column: str, bins: int) -> Column:
    """Element-wise sums of arrays of counts."""
    return F.array(*[F.sum(F.col(column)[i]) for i in range(bins)])


def with_origins(cells: DataFrame, keys: Sequence[str], member: str, members: Sequence[str], value: str, run: str) -> DataFrame:
    """(keys, <member>): a struct of value and run for each member, null where it has no value. cells: a row for each key and member."""
    top = lambda m, c: F.max(F.when((F.col(member) == m) & F.col(value).isNotNull(), F.col(c)))
    wide = cells.groupBy(*keys).agg(*[c for m in members for c in (top(m, value).alias(f"__v_{m}"), top(m, run).alias(f"__r_{m}"))])
    return wide.select(*keys, *[F.when(F.col(f"__v_{m}").isNotNull(), F.struct(F.col(f"__v_{m}").alias("value"), F.col(f"__r_{m}").alias("run"))).alias(m) for m in members])


def combined(wide: DataFrame, keys: Sequence[str], versions: dict[str, tuple[Sequence[str], bool]]) -> DataFrame:
    """(keys, version, f, made, parts): the mean of each version's members, the newest run that it is made of, and how many members it had.

    versions: for each its members, and whether all are needed; a version with none, or without one that it needs, has no row.
    """
    rows = []
    for name, (members, every) in versions.items():
        have = F.array_compact(F.array(*members))
        mean = F.aggregate(have, F.lit(0.0), lambda a, m: a + m["value"]) / F.size(have)
        enough = F.size(have) >= (len(members) if every else 1)
        rows.append(F.when(enough, F.struct(F.lit(name).alias("version"), mean.alias("f"), F.array_max(F.transform(have, lambda m: m["run"])).alias("made"), F.size(have).alias("parts"))))
    return wide.select(*keys, F.explode(F.array_compact(F.array(*rows))).alias("__c")).select(*keys, "__c.*")
