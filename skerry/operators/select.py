"""Order statistics by selection: the rows of a few ranks of each key, exactly, without sorting or writing the table.

An asked rank lies in an interval, at first that of all rows. Each pass counts an interval's rows in so many buckets of equal width and
keeps the one that holds the rank, down to its least and largest value; a few thousand rows that are left are sorted. So two
or three aggregations, combined before they move, find what a sort of all rows would. Equal values are told apart by the
next column of the order; where that ends they are the same row.

Order columns are numbers (whole ones below 2 ** 53) or times. Rows with a null among them are left out. Null keys are one
group. No rows in, none out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.shared import written

BUCKETS = 4_096
#: Rows of an interval that are sorted in one place.
FEW = 10_000


def as_number(df: DataFrame, column: str) -> Column:
    """A double in the order of the column."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column)).cast("double")
    if isinstance(df.schema[column].dataType, T.DateType):
        return F.unix_date(F.col(column)).cast("double")
    return F.col(column).cast("double")


def boundaries(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranks: Callable[[Column], Sequence[Column]], few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(key, n, i, at, skip): n rows of a key, and for the i-th rank that `ranks` makes of n (from 0; null: not asked) the row's order columns as doubles; `skip` rows that are equal to it come before it. key is a struct."""
    last = len(order) - 1
    x = F.array(*[as_number(df, c) for c in order])
    rows = df.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k")).alias("key"), x.alias("x")).where(F.forall("x", lambda v: v.isNotNull()))
    # a target: the i-th rank of a key is the r-th row of those that have the values `fixed` in the first columns and the next in [low, high]; c rows are there
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("x")[0]).alias("low"), F.max(F.col("x")[0]).alias("high"))
    asked = F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("i", "r")
    none = F.array().cast("array<double>")
    targets = written(sums.select("key", "n", asked, none.alias("fixed"), "low", "high", F.col("n").alias("c")).where("r BETWEEN 0 AND n - 1"), "targets")

    def held(own: DataFrame) -> DataFrame:
        """Rows of the intervals of targets, each interval once, as g."""
        once = own.groupBy("key", "fixed", "low", "high").agg(F.min("i").alias("g")).withColumnRenamed("key", "of")
        inside = (F.size("fixed") == 0) | (F.slice("x", 1, F.size("fixed")) == F.col("fixed"))
        v = F.get("x", F.size("fixed"))
        return rows.join(once, (rows["key"] == once["of"]) & inside & (F.col("low").isNull() | v.between(F.col("low"), F.col("high")))).drop("of").withColumn("v", v)

    while True:
        flat = (F.col("low") == F.col("high")) & (F.size("fixed") < last)
        deep, wide = flat & (F.col("c") > few), (F.col("low") < F.col("high")) & (F.col("c") > few)
        todo = targets.agg(F.max(deep.cast("int")).alias("deep"), F.max(wide.cast("int")).alias("wide")).first()
        if todo.deep:  # many rows with one value: on to the next column
            own = targets.where(deep).withColumns({"fixed": F.concat("fixed", F.array("low")), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
            found = held(own).groupBy(F.col("key").alias("of"), "fixed").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumnRenamed("fixed", "at")
            own = own.drop("low", "high").join(found, (F.col("key") == F.col("of")) & (F.col("fixed") == F.col("at"))).select(*targets.columns)
            targets = written(targets.where(~deep).unionByName(own), "targets")
        elif todo.wide:
            own = targets.where(wide)
            share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
            counted = held(own).groupBy(F.col("key").alias("of"), F.col("fixed").alias("at"), F.col("low").alias("from"), F.col("high").alias("to"), F.floor(share * (buckets - 1)).alias("bucket"))
            counted = counted.agg(F.count("*").alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
            w = Window.partitionBy("of", "at", "from", "to").orderBy("bucket")  # `buckets` rows
            counted = counted.withColumn("below", F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            same = (F.col("key") == F.col("of")) & (F.col("fixed") == F.col("at")) & (F.col("low") == F.col("from")) & (F.col("high") == F.col("to"))
            hit = own.join(counted, same & (F.col("r") >= F.col("below")) & (F.col("r") < F.col("below") + F.col("m")))
            own = hit.select("key", "n", "i", (F.col("r") - F.col("below")).alias("r"), "fixed", F.col("least").alias("low"), F.col("most").alias("high"), F.col("m").alias("c"))
            targets = written(targets.where(~wide).unionByName(own), "targets")
        else:
            break
    equal = (F.col("low") == F.col("high")) & (F.size("fixed") == last)
    done = targets.where(equal).select("key", "n", "i", F.concat("fixed", F.array("low")).alias("at"), F.col("r").alias("skip"))
    own = targets.where(~equal)
    listed = held(own).groupBy(F.col("key").alias("of"), F.col("fixed").alias("f"), F.col("low").alias("from"), F.col("high").alias("to")).agg(F.sort_array(F.collect_list("x")).alias("xs"))  # `few` rows
    same = (F.col("key") == F.col("of")) & (F.col("fixed") == F.col("f")) & (F.col("low") == F.col("from")) & (F.col("high") == F.col("to"))
    read = own.join(listed, same).withColumn("at", F.get("xs", F.col("r").cast("int")))
    return done.unionByName(read.select("key", "n", "i", "at", (F.col("r") - F.array_position("xs", F.col("at")) + 1).alias("skip")))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """(keys, n, names): the values at the ranks that are made of n, from 0; null where none is asked."""
    found = boundaries(df, keys, [value], ranks)
    wide = found.groupBy("key", "n").agg(*[F.max(F.when(F.col("i") == i, F.col("at")[0])).alias(name) for i, name in enumerate(names)])
    return wide.select(*[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], "n", *names)


def cut_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranks: Callable[[Column], Sequence[Column]], name: str, ties: bool = False) -> DataFrame:
    """df with `name`: how many of the rows at the given ranks of its key come at its place or before. A rank that is null or past the end is no cut; a row with a null in the order counts as before all.

    Rows that are equal in the order are on one side, behind the cut. ties: they are cut as well, by a hash of all columns;
    rows that are equal in all columns are then numbered together, where a cut falls among them.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k"))
    if ties:
        df_, order = df.withColumn("__hash", F.pmod(F.xxhash64(*df.columns), F.lit(1 << 52))), [*order, "__hash"]
    else:
        df_ = df
    found = boundaries(df_, keys, order, ranks)
    cuts = written(found.groupBy("key").agg(F.collect_list(F.struct("at", "skip")).alias("__cuts")), "cuts")  # as many as ranks
    rows = df_.withColumns({"__own": key, "__x": F.array(*[as_number(df_, c) for c in order])})
    rows = rows.join(cuts, F.col("__own") == F.col("key"), "left").withColumn("__number", F.lit(0))
    if ties and cuts.where(F.exists("__cuts", lambda c: c["skip"] > 0)).head(1):
        among = F.coalesce(F.exists("__cuts", lambda c: (c["at"] == F.col("__x")) & (c["skip"] > 0)), F.lit(False))
        numbered = rows.where(among).withColumn("__number", F.row_number().over(Window.partitionBy("__own", "__x").orderBy(F.lit(0))) - 1)
        rows = rows.where(~among).unionByName(numbered)
    known = F.forall("__x", lambda v: v.isNotNull())
    behind = lambda c: (c["at"] < F.col("__x")) | ((c["at"] == F.col("__x")) & (F.col("__number") >= c["skip"] if ties else F.lit(True)))
    passed = F.size(F.filter("__cuts", behind))
    return rows.withColumn(name, F.when(known & F.col("__cuts").isNotNull(), passed).otherwise(0)).select(*df.columns, name)
