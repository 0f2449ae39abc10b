"""Joins on time.

Null keys and null times match nothing; left rows stay with nulls, each as often as it came. No right rows: all nulls; no left
rows: none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], part: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the values of the latest right row at or before left_time, however old, and its time as `asof`.

    One union and one window: no row is paired with more than one other. right has one row for each key and time.
    part: a function of time that never falls, such as its month. With it a key is not one task: windows are by key and
    part, and each part takes over the last right row of the parts before it.
    """
    kind = right.select(F.struct(F.col(right_time).alias("asof"), *values)).schema[0].dataType
    a = left.withColumns({"__t": F.col(left_time), "__side": F.lit(1), "__r": F.lit(None).cast(kind)})
    b = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time).alias("asof"), *values).alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__part", part(F.col("__t")) if part else F.lit(0))
    past = Window.partitionBy(*keys, "__part").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__last", F.last("__r", ignorenulls=True).over(past)).where("__side = 1")
    if part:
        ends = both.groupBy(*keys, "__part").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        own = [*keys, "__part"]
        ends = ends.select(*[F.col(k).alias(f"__end_{k}") for k in own], F.last("__end", ignorenulls=True).over(before).alias("__earlier"))
        same = [out[k].eqNullSafe(ends[f"__end_{k}"]) for k in own]
        out = out.join(ends, same).withColumn("__last", F.coalesce("__last", "__earlier"))
    return out.select(*left.columns, F.col("__last.asof").alias("asof"), *[F.col(f"__last.{v}").alias(v) for v in values])


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str], seconds: int, ties: Sequence[str] = ()) -> DataFrame:
    """left with the values of the right row that is nearest in time within `seconds`, and its time as `near`; earlier wins a tie, then `ties`.

    No row is paired with another: of the right rows of one time the first stays, and two windows give each left row the
    last before and, in falling order of time, the last after it: both frames grow row by row, so a part costs no more than its
    rows. Time is cut into parts 24 times as wide as the tolerance; a right row is in each part that it can matter to, so no
    window holds more than a part. Rows without a time or key match nothing.
    """
    epoch = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    reach, width = seconds * 1_000_000, 24 * seconds * 1_000_000
    kind = right.select(F.struct(F.col(right_time).alias("near"), *values)).schema[0].dataType
    part = lambda t: F.floor(t / width)
    first = Window.partitionBy(*keys, right_time).orderBy(*[F.col(t) for t in ties or values])
    r = right.where(F.col(right_time).isNotNull()).withColumn("__first", F.row_number().over(first)).where("__first = 1")
    r = r.select(*keys, epoch(right_time).alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time).alias("near"), *values).alias("__r"))
    r = r.withColumn("__part", F.explode(F.sequence(part(F.col("__t") - reach), part(F.col("__t") + reach))))
    a = left.withColumns({"__t": epoch(left_time), "__side": F.lit(1), "__r": F.lit(None).cast(kind)}).withColumn("__part", part(F.col("__t")))
    both = a.unionByName(r, allowMissingColumns=True).withColumn("__x", F.when(F.col("__side") == 0, F.struct("__t", "__r")))
    known_last = lambda *order: F.last("__x", ignorenulls=True).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"__before": known_last("__t", "__side"), "__after": known_last(F.desc("__t"), "__side")})
    back, on = F.col("__t") - F.col("__before.__t"), F.col("__after.__t") - F.col("__t")
    known = F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x) & F.col("__t").isNotNull()
    pick = F.when(known & (back <= reach) & (on.isNull() | (back <= on)), F.col("__before.__r")).when(known & (on <= reach), F.col("__after.__r"))
    out = both.where("__side = 1").withColumn("__m", pick)
    return out.select(*left.columns, F.col("__m.near").alias("near"), *[F.col(f"__m.{v}").alias(v) for v in values])


def lagged(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, hours, name: str) -> DataFrame:
    """left with `value` of right at `time` minus a number of hours (a column); null where there is none."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(time).alias("__time"), F.col(value).alias(name))
    back = F.col(time) - F.make_dt_interval(F.lit(0), hours.cast("int"))
    on = [left[k] == r[f"__{k}"] for k in keys]
    return left.withColumn("__back", back).join(r, [*on, F.col("__back") == r["__time"]], "left").select(*left.columns, name)


#: Edges of bands that an expression holds; more are an as-of join.
EDGES = 4_096


def last_at_most(edges: Sequence[float], value: Column) -> Column:
    """Place (from 0) of the last of the sorted edges that is not above the value, by halving; null below the first and for a null value."""
    held = F.array(*map(F.lit, edges))
    start = F.struct(F.lit(0).alias("a"), F.lit(len(edges)).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        m = F.floor((s["a"] + s["b"]) / 2).cast("int")
        low = F.get(held, m) <= value
        return F.when(s["b"] - s["a"] <= 1, s).otherwise(F.struct(F.when(low, m).otherwise(s["a"]).alias("a"), F.when(low, s["b"]).otherwise(m).alias("b")))

    turns = F.sequence(F.lit(1), F.lit(max(1, len(edges).bit_length())))
    return F.when(value >= F.lit(edges[0]), F.aggregate(turns, start, halve, lambda s: s["a"]))


def range_join(points: DataFrame, bands: DataFrame, value: str, low: str, high: str, how: str = "inner") -> DataFrame:
    """points with the bands that low <= value < high, each of them; how="left" keeps points that are in none.

    The edges of all bands cut the numbers into pieces, and each piece knows its bands. A point finds its piece by
    halving over the sorted edges, or, where these are many, by an as-of join; then the join is one of equals. Bands
    with a null edge hold nothing.
    """
    own = bands.where(F.col(low) < F.col(high)).withColumns({"__low": F.col(low).cast("double"), "__high": F.col(high).cast("double")})
    ends = own.select(F.explode(F.array("__low", "__high")).alias("__edge")).distinct()
    known = sorted(r[0] for r in ends.limit(EDGES + 1).collect())
    v = F.col(value).cast("double")
    if not known:
        found, pieces = points.withColumn("__piece", F.lit(None).cast("double")), own.withColumn("__at", F.lit(0.0))
    elif len(known) <= EDGES:
        found = points.withColumn("__piece", last_at_most(known, v).cast("double"))
        numbers = [last_at_most(known, F.col(c)) for c in ("__low", "__high")]
        pieces = own.withColumn("__at", F.explode(F.transform(F.sequence(numbers[0], numbers[1] - 1), lambda i: i.cast("double"))))
    else:
        number = ends.withColumns({"__piece": F.row_number().over(Window.orderBy("__edge")).cast("double"), "__one": F.lit(0)})
        found = asof_join(points.withColumns({"__one": F.lit(0), "__v": v}), number, ["__one"], "__v", "__edge", ["__piece"], lambda x: F.floor(F.log2(1 + F.abs(x)) * F.signum(x) * 16)).drop("asof", "__one", "__v")
        at = lambda name: number.select(F.col("__edge").alias(name), F.col("__piece").alias(f"{name}_no"))
        pieces = own.join(at("__low"), "__low").join(at("__high"), "__high")
        pieces = pieces.withColumn("__at", F.explode(F.transform(F.sequence(F.col("__low_no").cast("long"), F.col("__high_no").cast("long") - 1), lambda i: i.cast("double")))).drop("__low_no", "__high_no")
    return found.join(pieces, F.col("__piece") == F.col("__at"), how).drop("__piece", "__at", "__low", "__high")


def common_to_all(df: DataFrame, by: Sequence[str], member: str, members: int) -> DataFrame:
    """Keys that all `members` have: an intersection as one aggregation."""
    return df.groupBy(*by).agg(F.countDistinct(member).alias("__n")).where(F.col("__n") == members).drop("__n")
