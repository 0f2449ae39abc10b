"""Running values over the rows of a key in order of time, with a key cut into parts of time so that it is not one task.

What a running value needs of the rows before a part is little: the last state, a count, a time. Each part is scanned by a
window of its own; one aggregate a part says how it begins and ends; a window over these (a row for each key and part) carries
what is known from part to part; and each row takes over what its part was handed. Keys and parts travel as one pair of
columns, so aggregate, window and join need one shuffle of the rows.

Null keys are one group, rows without a time are a part before all others. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Length of a part: four weeks, some 700 hourly rows of a series.
PART_SECONDS = 28 * 86_400
KEY, PART = "__key", "__part"


def seconds_of(time: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp_ntz."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time) if isinstance(time, str) else time)


def parted(df: DataFrame, keys: Sequence[str], at: Column, width: int) -> DataFrame:
    """df with the key as one column and the part that a whole number falls in."""
    part = F.coalesce(F.floor(at / width), F.lit(-(1 << 62)))
    return df.withColumns({KEY: F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k")), PART: part})


def in_part(*order: str | Column) -> WindowSpec:
    return Window.partitionBy(KEY, PART).orderBy(*order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried(rows: DataFrame, ends: dict[str, Column], *steps: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows with what their part is handed. ends: aggregates of a part; each step makes columns of these by a window over the parts of a key, in order; the last step's are handed on."""
    parts = rows.groupBy(F.col(KEY).alias("__k"), F.col(PART).alias("__p")).agg(*[c.alias(n) for n, c in ends.items()])
    w, last = Window.partitionBy("__k").orderBy("__p"), []
    for step in steps:
        columns = step(w)
        parts, last = parts.withColumns(columns), list(columns)
    return rows.join(parts.select("__k", "__p", *last), (F.col(KEY) == F.col("__k")) & (F.col(PART) == F.col("__p")))


def before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def after(key: Sequence[str], order: str) -> WindowSpec:
    """The rows after a row, as those before it in falling order: such a frame grows row by row, one that ends with the group is read anew for each row."""
    return before(Window.partitionBy(*key).orderBy(F.desc(order)))


def forward_fill(df: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str], width: int = PART_SECONDS) -> DataFrame:
    """df with the last known value of each column."""
    rows = parted(df, keys, seconds_of(time), width)
    known = upto(in_part(time))
    rows = rows.withColumns({f"__own_{i}": F.last(c, ignorenulls=True).over(known) for i, c in enumerate(columns)})
    ends = {f"__end_{i}": F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(time))) for i, c in enumerate(columns)}
    out = carried(rows, ends, lambda w: {f"__before_{i}": F.last(f"__end_{i}", ignorenulls=True).over(before(w)) for i in range(len(columns))})
    return out.withColumns({c: F.coalesce(f"__own_{i}", f"__before_{i}") for i, c in enumerate(columns)}).select(*df.columns)


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, width: int = PART_SECONDS) -> DataFrame:
    """df with `streak`: a number that grows with each change of state; 1 at first. The first column of the order is a time."""
    rows = parted(df, keys, seconds_of(order[0]), width).withColumn("__state", F.struct(state.alias("s")))
    w = in_part(*order)
    rows = rows.withColumn("__last", F.lag("__state").over(w))
    # a part's first row is compared with the part before
    rows = rows.withColumn("__new", F.when(F.col("__last").isNotNull(), (F.col("__last") != F.col("__state")).cast("int")))
    place = F.struct(*order)
    ends = {"__begin": F.min_by("__state", place), "__end": F.max_by("__state", place), "__inner": F.coalesce(F.sum("__new"), F.lit(0))}
    out = carried(
        rows, ends,
        lambda p: {"__turn": F.coalesce((F.lag("__end").over(p) != F.col("__begin")).cast("int"), F.lit(1))},
        lambda p: {"__before": F.sum(F.col("__turn") + F.col("__inner")).over(upto(p)) - F.col("__inner")},
    )
    return out.withColumn("streak", F.col("__before") + F.coalesce(F.sum("__new").over(upto(w)), F.lit(0))).select(*df.columns, "streak")


def islands(df: DataFrame, keys: Sequence[str], time: str, flag: str, step_seconds: int, width: int = PART_SECONDS, short: bool = False) -> DataFrame:
    """(keys, start, end, n) of each run of rows with a true flag and no gap in time; a row for each key and step at most.

    Runs that end inside a part are done there; of a part's others, two at most, those that touch are joined. short: keys
    hold a day or so each (one of them is the day), and are not cut.
    """
    wide = max(1, width // step_seconds)
    slot = F.floor(seconds_of(time) / step_seconds)
    rows = parted(df.where(flag), keys, F.lit(0) if short else slot, wide).withColumn("__slot", slot)
    w = in_part("__slot")
    rows = rows.withColumn("__new", F.when(F.col("__slot") - F.lag("__slot").over(w) <= 1, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(upto(w)))
    found = rows.groupBy(KEY, PART, "__run").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"), F.min("__slot").alias("__a"), F.max("__slot").alias("__b"))
    names = [F.col(f"{KEY}.k{i}").alias(k) for i, k in enumerate(keys)]
    if short:
        return found.select(*names, "start", "end", "n")
    left, right = F.col("__a") == F.col(PART) * wide, F.col("__b") == F.col(PART) * wide + wide - 1
    whole, edge = found.where(~(left | right)), found.where(left | right)
    chain = Window.partitionBy(KEY).orderBy("__a")
    edge = edge.withColumn("__run", F.sum(F.when(F.lag("__b").over(chain) == F.col("__a") - 1, 0).otherwise(1)).over(upto(chain)))
    edge = edge.groupBy(KEY, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return whole.select(KEY, "start", "end", "n").unionByName(edge.select(KEY, "start", "end", "n")).select(*names, "start", "end", "n")


def hourly_line(df: DataFrame, keys: Sequence[str], time: str, *values: str, width: int = PART_SECONDS) -> DataFrame:
    """(keys, hour, values): straight lines between neighbours in time, on every whole hour from the first to the last.

    A null value is where a line ends: between it and its neighbours the line is flat at the earlier value.
    """
    rows = parted(df, keys, seconds_of(time), width).withColumn("__row", F.struct(F.col(time).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]))
    rows = rows.withColumn("__next", F.lead("__row").over(in_part(time)))
    rows = carried(rows, {"__begin": F.min_by("__row", time)}, lambda w: {"__after": F.lead("__begin").over(w)})
    rows = rows.withColumn("__next", F.coalesce("__next", "__after"))
    seconds = seconds_of(F.col("__next.t")) - seconds_of(time)
    rows = rows.withColumn("__h", F.explode(F.sequence(F.lit(0), F.coalesce((seconds / 3600).cast("int") - 1, F.lit(0)))))
    share = F.when(seconds > 0, F.col("__h") * 3600 / seconds).otherwise(0.0)
    line = lambda i, v: F.when(F.col(f"__next.v{i}").isNull(), F.col(v)).otherwise(F.col(v) + (F.col(f"__next.v{i}") - F.col(v)) * share)
    return rows.select(*keys, (F.col(time) + F.make_dt_interval(F.lit(0), F.col("__h"))).alias("hour"), *[line(i, v).alias(v) for i, v in enumerate(values)])


def gaps(df: DataFrame, keys: Sequence[str], time: str, width: int = PART_SECONDS) -> DataFrame:
    """df with `last_seen`: the time of the row before, null at first."""
    rows = parted(df, keys, seconds_of(time), width).withColumn("__last", F.lag(time).over(in_part(time)))
    out = carried(rows, {"__end": F.max(time)}, lambda w: {"__before": F.lag("__end").over(w)})
    return out.withColumn("last_seen", F.coalesce("__last", "__before")).select(*df.columns, "last_seen")


def _hours(hour: str) -> Column:
    return F.floor(seconds_of(hour) / 3600)


def trailing(df: DataFrame, keys: Sequence[str], hour: str, value: str, hours: int, wet: float, width: int = PART_SECONDS) -> DataFrame:
    """df (a row for each hour it has) with sum_<h> and wet_<h> over the last h hours, null unless all are there.

    A window looks back so many hours and no further: the last hours of a part are copied to the next.
    """
    wide = max(width // 3600, hours)
    rows = parted(df, keys, _hours(hour), wide).withColumn("__slot", _hours(hour))
    late = F.col("__slot") - F.col(PART) * wide > wide - hours
    rows = rows.withColumn("__copy", F.explode(F.when(late, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).withColumn(PART, F.col(PART) + F.col("__copy"))
    w = in_part("__slot").rangeBetween(1 - hours, 0)
    full = F.count(value).over(w) == hours
    out = rows.withColumns({f"sum_{hours}": F.when(full, F.sum(value).over(w)), f"wet_{hours}": F.when(full, F.count(F.when(F.col(value) >= wet, 1)).over(w))})
    return out.where("__copy = 0").select(*df.columns, f"sum_{hours}", f"wet_{hours}")


def dry_run(df: DataFrame, keys: Sequence[str], hour: str, value: str, above: float, width: int = PART_SECONDS) -> DataFrame:
    """df with `dry_hours`: hours without a gap up to and with this one that are not above the limit."""
    rows = parted(df, keys, _hours(hour), max(1, width // 3600)).withColumn("__slot", _hours(hour))
    w = in_part("__slot")
    ends_dry = (F.col(value) > above) | F.col(value).isNull()
    stop = F.when(ends_dry, F.col("__slot")).when(F.lag("__slot").over(w) < F.col("__slot") - 1, F.col("__slot") - 1)
    rows = rows.withColumn("__stop", stop)
    ends = {"__first": F.min("__slot"), "__last": F.max("__slot"), "__end": F.max("__stop")}
    out = carried(
        rows, ends,
        lambda p: {"__gap": F.when(F.coalesce(F.lag("__last").over(p) < F.col("__first") - 1, F.lit(True)), F.col("__first") - 1)},
        lambda p: {"__stopped": F.coalesce("__end", "__gap")},
        lambda p: {"__before": F.coalesce("__gap", F.last("__stopped", ignorenulls=True).over(before(p)))},
    )
    return out.withColumn("dry_hours", F.col("__slot") - F.coalesce(F.last("__stop", ignorenulls=True).over(upto(w)), F.col("__before"))).select(*df.columns, "dry_hours")


def dry_by_and_wet_since(hourly: DataFrame, keys: Sequence[str], hour: str, value: str, wet: float, width: int = PART_SECONDS) -> DataFrame:
    """Wet hours with wet_since (the start of their run of wet rows) and dry_by (the next dry hour; null if none follows). A null value is neither."""
    rows = parted(hourly, keys, seconds_of(hour), width).withColumn("__wet", F.col(value) >= wet)
    w = in_part(hour)
    is_wet, previous = F.coalesce("__wet", F.lit(False)), F.lag(F.coalesce("__wet", F.lit(False))).over(w)
    rows = rows.withColumns({"__first_row": previous.isNull(), "__begins": F.when(is_wet & ~previous, F.col(hour)), "__dry": F.when(~F.col("__wet"), F.col(hour))})
    rows = rows.withColumn("__since", F.last("__begins", ignorenulls=True).over(upto(w)))  # null: wet since the part's first row, or dry
    last = F.max_by(F.struct(is_wet.alias("wet"), F.col("__since").alias("since")), F.struct(hour))
    ends = {"__last": last, "__opens": F.min_by(F.struct(is_wet.alias("wet"), F.col(hour).alias("at")), F.struct(hour)), "__first_dry": F.min("__dry")}

    def opened(p: WindowSpec) -> dict[str, Column]:
        """When a wet run that a part begins with has begun, where the part before does not say."""
        return {"__own": F.when(~F.coalesce(F.lag("__last").over(p)["wet"], F.lit(False)), F.col("__opens.at"))}

    def ended(p: WindowSpec) -> dict[str, Column]:
        """The start of the wet run that goes on past the part; null, where it goes on from the part before."""
        return {"__going": F.when(F.col("__last.wet"), F.coalesce("__last.since", "__own"))}

    out = carried(
        rows, ends, opened, ended,
        lambda p: {"__before": F.coalesce("__own", F.last("__going", ignorenulls=True).over(before(p))), "__later": F.min("__first_dry").over(after(["__k"], "__p"))},
    )
    dry_by = F.coalesce(F.last("__dry", ignorenulls=True).over(after([KEY, PART], hour)), F.col("__later"))
    return out.withColumns({"dry_by": dry_by, "wet_since": F.coalesce("__since", "__before")}).where("__wet").select(*hourly.columns, "dry_by", "wet_since")
