"""Dry and wet spells within days.

An hour that is missing or null ends a spell, wet or dry. Tables have one row for each key and hour; null keys are one group. No
rows in, none out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.weather import day_range_utc
from .scans import dry_by_and_wet_since, islands  # noqa: F401


def daily_spells(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float, start: int, hours: int) -> DataFrame:
    """(keys, day, dry_hours, longest): hours start .. start + hours - 1 of each day that has them all; the longest dry run never crosses midnight."""
    inside = hourly.where((F.hour(hour) >= start) & (F.hour(hour) < start + hours) & F.col(value).isNotNull())
    inside = inside.withColumn("day", F.to_date(hour)).withColumn("__dry", F.col(value) < wet)
    whole = inside.groupBy(*keys, "day").agg(F.countDistinct(hour).alias("__n"), F.count_if("__dry").alias("dry_hours")).where(F.col("__n") == hours).drop("__n")
    longest = islands(inside, [*keys, "day"], hour, "__dry", 3600, short=True).groupBy(*keys, "day").agg(F.max("n").alias("longest"))
    return whole.join(longest, [*keys, "day"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def local_day_spells(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float, zone: str, start: int, end: int) -> DataFrame:
    """(keys, day, state, dry_hours, longest) for each day of the zone that a key has an hour of: from `start` to `end` by its clocks.

    A table of days holds each one's first and last hour in UTC, which summer time moves. state: whole; other length, where the clocks
    change inside the range; hours missing, where an hour or its value is. Only whole days have dry hours and a longest
    dry run, which never crosses midnight. hourly: UTC, one row for each key and hour.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(hour))
    rows = hourly.withColumn("day", F.to_date(local))
    days = rows.select("day").where("day IS NOT NULL").distinct()  # a row for each date
    days = days.select("day", *day_range_utc(F.col("day"), zone, start, end))
    inside = rows.join(days, "day").withColumn("__in", (F.col(hour) >= F.col("utc_start")) & (F.col(hour) < F.col("utc_end")) & F.col(value).isNotNull())
    inside = inside.withColumn("__dry", F.col("__in") & (F.col(value) < wet))
    whole = inside.groupBy(*keys, "day").agg(F.count_if("__in").alias("__n"), F.count_if("__dry").alias("__d"), F.first("utc_hours").alias("__h"))
    runs = islands(inside, [*keys, "day"], hour, "__dry", 3600, short=True).groupBy(*[F.col(k).alias(f"__k_{k}") for k in (*keys, "day")]).agg(F.max("n").alias("__longest"))
    out = whole.join(runs, [whole[k].eqNullSafe(runs[f"__k_{k}"]) for k in (*keys, "day")], "left")
    state = F.when(F.col("__h") != end - start, "other length").when(F.col("__n") != F.col("__h"), "hours missing").otherwise("whole")
    only = lambda c: F.when(F.col("state") == "whole", c)
    return out.withColumn("state", state).select(*keys, "day", "state", only(F.col("__d")).alias("dry_hours"), only(F.coalesce("__longest", F.lit(0))).alias("longest"))


def windows_of(spells: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(.., window, has): whether a day has a dry run of each length."""
    return spells.withColumn("window", F.explode(F.array(*map(F.lit, lengths)))).withColumn("has", (F.col("longest") >= F.col("window")).cast("int"))


def valid_starts(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float, start: int, end: int, length: int) -> DataFrame:
    """(keys, day, start_hour): hours from which `length` hours in a row, all before `end`, are there and dry."""
    inside = hourly.where((F.hour(hour) >= start) & (F.hour(hour) < end)).withColumn("day", F.to_date(hour)).withColumn("__h", F.hour(hour))
    w = Window.partitionBy(*keys, "day").orderBy("__h").rangeBetween(0, length - 1)
    dry = F.sum(F.when(F.col(value) < wet, 1).otherwise(0)).over(w)
    return inside.withColumn("__d", dry).where(F.col("__d") == length).select(*keys, "day", F.col("__h").alias("start_hour"))


def wet_bands(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float) -> DataFrame:
    """(keys, start, end): runs of wet hours, to the end of their last hour, split at gaps."""
    flagged = hourly.withColumn("__wet", F.coalesce(F.col(value) >= wet, F.lit(False)))
    return islands(flagged, keys, hour, "__wet", 3600).withColumn("end", F.col("end") + F.make_dt_interval(F.lit(0), F.lit(1)))


def start_curve(starts: DataFrame, keys: Sequence[str], weight: str, total: str) -> DataFrame:
    """Start-hour weights scaled so that each key's add up to its `total`."""
    whole = F.sum(weight).over(Window.partitionBy(*keys))
    return starts.withColumn("share", F.try_divide(F.col(weight) * F.col(total), whole))


def exact_windows(days: DataFrame, keys: Sequence[str], hours: int, lengths: Sequence[int], start_of: int, rho: float | str, p: str = "p", quantiles: Sequence[float] = ()) -> DataFrame:
    """(keys, p_<w>, longest_mean, longest_q<percent>, start_<h>): chance of a dry run of each length, mean and quantiles of the longest dry run, and chance that the first run of `start_of` hours begins at each hour.

    days: one row a key with an array p of `hours` wet probabilities. Hours are a chain of two states in which neighbours
    correlate by rho (a number or a column), as far as their probabilities allow. Nothing is drawn and no outcome is listed: a
    fold over a day's hours carries the chances of (dry hours up to now, longest so far), some hours squared of them. Days with
    another number of hours, or a null among them, are left out; a null rho is 0.
    """
    sound = days.where((F.size(p) == hours) & F.forall(p, lambda x: x.isNotNull()))
    r = F.coalesce(F.col(rho), F.lit(0.0)) if isinstance(rho, str) else F.lit(float(rho))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))

    def given(a, b):
        """Chance that an hour is wet after a wet one and after a dry one."""
        spread = F.col("__r") * F.sqrt(a * (1 - a))
        return F.struct(clamp(a + spread * F.sqrt((1 - b) / b)).alias("wet"), clamp(a - spread * F.sqrt(b / (1 - b))).alias("dry"))

    bounded = sound.withColumns({"__q": F.transform(p, lambda x: F.least(F.lit(0.99), F.greatest(F.lit(0.01), x.cast("double")))), "__r": r.cast("double")})
    rows = bounded.withColumn("__steps", F.zip_with(F.slice("__q", 2, hours), F.slice("__q", 1, hours - 1), given) if hours > 1 else F.array().cast("array<struct<wet: double, dry: double>>"))
    side, first = hours + 1, F.col("__q")[0]
    total = lambda places, of: F.aggregate(places, F.lit(0.0), lambda acc, k: acc + of(k))
    after = lambda step, now: F.when(now == 0, step["wet"]).otherwise(step["dry"])

    def lengthened(chances, step):
        """chances[now * side + best], an hour on: a wet hour leaves best, a dry one may raise it."""

        def cell(k):
            now, best = F.floor(k / side).cast("int"), k % side
            dries = 1 - after(step, now - 1)
            wets = F.get(chances, best) * step["wet"] + total(F.sequence(F.lit(1), F.lit(hours)), lambda n: F.get(chances, n * side + best)) * step["dry"]
            raised = total(F.sequence(F.lit(0), now), lambda b: F.get(chances, (now - 1) * side + b)) * dries
            return F.when(now == 0, wets).when(best > now, F.get(chances, (now - 1) * side + best) * dries).when(best == now, raised).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), cell)

    def begun(state, step):
        """Chances of dry hours up to now, below start_of, with no such run so far; and for each hour that one is reached."""
        wets = F.get(state["now"], F.lit(0)) * step["wet"] + total(F.sequence(F.lit(1), F.lit(start_of)), lambda n: F.coalesce(F.get(state["now"], n), F.lit(0.0))) * step["dry"]
        dries = F.transform(state["now"], lambda x, n: x * (1 - after(step, n)))
        return F.struct(F.concat(F.array(wets), F.slice(dries, 1, start_of - 1)).alias("now"), F.concat(state["hit"], F.array(F.get(dries, F.lit(start_of - 1)))).alias("hit"))

    initial = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.when(k == 0, first).when(k == side + 1, 1 - first).otherwise(0.0))
    waiting = F.slice(F.concat(F.array(first, 1 - first), F.array_repeat(F.lit(0.0), start_of)), 1, start_of)
    hits = F.aggregate("__steps", F.struct(waiting.alias("now"), F.array(1 - first if start_of == 1 else F.lit(0.0)).alias("hit")), begun, lambda s: s["hit"])
    rows = rows.withColumns({"__end": F.aggregate("__steps", initial, lengthened), "__hits": hits})
    rows = rows.withColumn("__best", F.transform(F.sequence(F.lit(0), F.lit(hours)), lambda b: total(F.sequence(F.lit(0), F.lit(hours)), lambda n: F.get("__end", n * side + b))))
    below = lambda b: total(F.slice("__best", 1, b + 1), lambda x: x)
    return rows.select(
        *keys, *[total(F.slice("__best", w + 1, hours + 1), lambda x: x).alias(f"p_{w}") for w in lengths], total(F.transform("__best", lambda x, b: x * b), lambda x: x).alias("longest_mean"),
        *[F.coalesce(*[F.when(below(b) >= q, b) for b in range(hours)], F.lit(hours)).alias(f"longest_q{round(100 * q)}") for q in quantiles],
        *[F.get("__hits", F.lit(h + start_of - 1)).alias(f"start_{h}") for h in range(hours - start_of + 1)],
    )


def neighbour_correlation(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float) -> DataFrame:
    """(keys, rho): correlation of wet and dry between an hour and the one before it, within 0 to 0.95; 0.95 where either are all alike, as nothing ever turns, and 0 without a value. hourly: one row an hour, of the hours of interest."""
    w = Window.partitionBy(*keys, F.to_date(hour)).orderBy(hour)
    is_wet = (F.col(value) >= wet).cast("double")
    last = F.when(F.timestamp_diff("HOUR", F.lag(hour).over(w), F.col(hour)) == 1, F.lag(is_wet).over(w))
    both = hourly.select(*keys, is_wet.alias("__now"), last.alias("__last")).where("__last IS NOT NULL").withColumn("__last", F.when(F.col("__now").isNotNull(), F.col("__last")))
    # zeros and ones: whole numbers, so that what is all alike has a variance of exactly 0
    sums = both.groupBy(*keys).agg(F.count("__now").alias("n"), F.sum("__now").alias("x"), F.sum("__last").alias("y"), F.sum(F.col("__now") * F.col("__last")).alias("xy"))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = F.sqrt(x * (n - x)) * F.sqrt(y * (n - y))
    c = F.when(spread == 0, 0.95).otherwise(F.try_divide(n * F.col("xy") - x * y, spread))
    return sums.select(*keys, F.coalesce(F.least(F.lit(0.95), F.greatest(F.lit(0.0), c)), F.lit(0.0)).alias("rho"))
