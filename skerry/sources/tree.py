"""Parquet trees whose schema drifts: reads of whole trees and of ranges, and writes that lose nothing."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.dedup import latest
from . import snapshots
from .shared import file_system, scratch_folder


def read_tree(spark: SparkSession, *roots: str) -> DataFrame:
    """All files below the roots, columns by name. Directory names are not columns, so that no `model=` hides a column Model.

    A root with a log of snapshots is read as its last one. For other roots Spark merges the schemas of all files.
    """
    logged = [r for r in roots if snapshots.has_log(spark, r)]
    plain = [r for r in roots if r not in logged]
    parts = [snapshots.read(spark, r, snapshots.current(spark, r)) for r in logged]
    if plain:
        parts.append(spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*plain))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _subtrees(spark: SparkSession, root: str, wanted: Callable[[dict[str, str | None]], bool]) -> list[str]:
    """Folders below a plain root that hold files and whose names are wanted; of the others nothing is listed."""
    files, where = file_system(spark, root)
    level, out = [(where, "")] if files.exists(where) else [], []
    while level:
        below = []
        for path, partition in level:
            folders = [f.getPath() for f in files.listStatus(path) if f.isDirectory() and "=" in f.getPath().getName()]
            if not folders:
                out.append(partition)
            for f in folders:
                name = f"{partition}/{f.getName()}".lstrip("/")
                if wanted(snapshots.values_of(name)):
                    below.append((f, name))
        level = below
    return out


def read_range(spark: SparkSession, root: str, time: str, first: str, last: str, keys: Mapping[str, Collection] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a tree by days (p_date=) whose time is in [first, last] and whose keys are among the values given; None stands for a null key.

    The folders are chosen by their names before Spark sees any: a range of two days lists and opens the files of two days. A
    name that the tree does not have takes no part in the choice. A tree with a log has its schema there; of any other the
    caller's is used, or that of the chosen files. No such tree, or none of its days: no rows.
    """
    keys = keys or {}
    texts = {f"p_{k}": {None if v in (None, "") else str(v) for v in values} for k, values in keys.items()}
    day = lambda v: v is not None and first[:10] <= v <= last[:10]

    def wanted(values: dict[str, str | None]) -> bool:
        return all((v in texts[k] if k in texts else day(v) if k == "p_date" else True) for k, v in values.items())

    if snapshots.has_log(spark, root):
        rows = snapshots.read(spark, root, snapshots.current(spark, root), lambda p: wanted(snapshots.values_of(p)))
    else:
        chosen = [f"{root}/{p}".rstrip("/") for p in _subtrees(spark, root, wanted)]
        if not chosen:
            if schema is None:
                raise ValueError(f"nothing below {root} is in the range, and no schema is given")
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
        rows = reader.option("recursiveFileLookup", True).parquet(*chosen)
    inside = F.col(time).between(F.lit(first).cast(rows.schema[time].dataType), F.lit(last).cast(rows.schema[time].dataType))
    for k, values in keys.items():
        some = F.col(k).isin(*[v for v in values if v is not None])
        inside = inside & (some | F.col(k).isNull() if None in values else some)
    return rows.where(inside)


def read_or_empty(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """The tree, or no rows of the schema where there is none."""
    try:
        return read_tree(spark, root)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def column_or(df: DataFrame, name: str, default) -> Column:
    """A column with its nulls filled, or the default where no file has it."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default).alias(name)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns: both mean missing."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floating})


def _by_day(df: DataFrame, keys: Sequence[str], time: str) -> tuple[DataFrame, list[str]]:
    """df with its partition columns p_<key> and p_date, and their names."""
    return df.withColumns({**{f"p_{k}": F.col(k) for k in keys}, "p_date": F.to_date(time)}), [*[f"p_{k}" for k in keys], "p_date"]


def _before(spark: SparkSession, path: str, names: Sequence[str]) -> snapshots.Snapshot:
    """The last snapshot; of a plain tree without a log one that names its partitions."""
    last = snapshots.current(spark, path)
    if not last.version and (own := snapshots.partitions_below(spark, path, names)):
        schema = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*[f"{path}/{p}" for p in own]).schema
        return snapshots.Snapshot(0, schema, dict.fromkeys(own, ""))
    return last


def write_days(df: DataFrame, path: str, keys: Sequence[str], time: str) -> None:
    """Replaces the partitions (keys, day) that df has rows for, and no other. Null keys and times are partitions of their own; without rows nothing changes."""
    out, names = _by_day(df, keys, time)
    snapshots.replace(out, path, names, _before(df.sparkSession, path, names))


def merge_days(df: DataFrame, path: str, keys: Sequence[str], time: str, unique: Sequence[str], order: str) -> None:
    """Joins df to what its partitions hold: of rows with equal `unique` columns the one with the largest `order` stays.

    Only partitions that df has rows for are read, chosen by name, those of null keys and null times among them; each is written once, into
    a new folder. The table changes when the log does: a merge that dies before leaves it as it was, and can be run again.
    """
    spark = df.sparkSession
    out, names = _by_day(df, keys, time)
    with scratch_folder(spark, "incoming") as folder:
        out.write.parquet(folder)  # a source is read once
        arrived = spark.read.schema(out.schema).parquet(folder)
        touched = snapshots.partitions_of(arrived, names)
        if not touched:
            return
        incoming = arrived.drop(*names)
        before = _before(spark, path, names)
        snapshots.widened(before.schema, df.schema)  # an error, where the columns cannot be one table
        old = snapshots.read(spark, path, before, touched.__contains__)
        rows = old.unionByName(incoming, allowMissingColumns=True) if before.schema else incoming
        merged, _ = _by_day(latest(rows, unique, [order]), keys, time)
        snapshots.replace(merged, path, names, before)


def _groups(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """df with `__flag` of its group, by an aggregate that is joined back; a null key is equal to a null."""
    found = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(flag.alias("__flag"))
    return df.join(found, [df[k].eqNullSafe(found[f"__k_{k}"]) for k in keys]).select(*[df[c] for c in df.columns], "__flag")


def with_any(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """df without the groups whose measure is null throughout."""
    return _groups(df, keys, F.count(measure) > 0).where("__flag").drop("__flag")


def thousandths_repaired(df: DataFrame, by: Sequence[str], value: str, limit: float = 100.0) -> DataFrame:
    """value divided by 1000 in every group that holds a value over the limit."""
    small = F.when(F.col("__flag"), F.col(value) / 1000).otherwise(F.col(value))
    return _groups(df, by, F.coalesce(F.max(value) > limit, F.lit(False))).withColumn(value, small).drop("__flag")


def files_repaired(spark: SparkSession, root: str, value: str, limit: float = 100.0, units: Sequence[str] = ()) -> DataFrame:
    """A tree with the value divided by 1000 in every file that holds one over the limit, as a file is written in one unit. All rows of a file never meet: its maximum is one row.

    units: columns that name what is written in one unit, where files hold many of these.
    """
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(root)
    if units:
        return thousandths_repaired(rows, units, value, limit)
    return thousandths_repaired(rows.withColumn("__file", F.col("_metadata.file_path")), ["__file"], value, limit).drop("__file")


def scaled_once(df: DataFrame, value: str, factor: float, marker: str = "unit_version") -> DataFrame:
    """value times a factor where the marker is below 1, and the marker set, so that a second run changes nothing."""
    old = F.coalesce(F.col(marker), F.lit(0)) if marker in df.columns else F.lit(0)
    return df.withColumn(value, F.when(old < 1, F.col(value) * factor).otherwise(F.col(value))).withColumn(marker, F.greatest(old, F.lit(1)))


def write_history(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One JSON object for each key, its rows nested."""
    rest = [c for c in df.columns if c not in keys]
    df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)
