"""Feeds of other shapes as tables: parallel-array JSON, nested station JSON, sectioned and flagged text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TIME = "yyyy-MM-dd'T'HH:mm"


def _time(c) :
    return F.to_timestamp_ntz(c, F.lit(TIME))


def parallel_arrays(df: DataFrame, json: str, variables: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, valid, variables) of `{"hourly": {"time": [..], var: [..]}}`: one row a time, none where all variables are missing. A null or malformed text gives no rows, a missing or short array nulls."""
    schema = f"hourly struct<time: array<string>, {', '.join(f'`{v}`: array<double>' for v in variables)}>"
    own = df.select(*keep, F.from_json(json, schema)["hourly"].alias("__j"))
    # an array that a feed leaves out is empty, not the end of the others
    own = own.select(*keep, F.col("__j.time").alias("__time"), *[F.coalesce(F.col("__j")[v], F.array().cast("array<double>")).alias(f"__{v}") for v in variables])
    own = own.select(*keep, F.explode(F.arrays_zip("__time", *[f"__{v}" for v in variables])).alias("z"))
    rows = own.select(*keep, _time(F.col("z.__time")).alias("valid"), *[F.col("z")[f"__{v}"].alias(v) for v in variables])
    return rows.where(F.coalesce(*variables).isNotNull())


def previous_runs(df: DataFrame, json: str, variables: Sequence[str], days: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, valid, run, lead, variables) of arrays named `<var>_previous_day<N>`: lead is 24 N hours, run is valid less lead."""
    wide = [f"{v}_previous_day{n}" for v in variables for n in days]
    rows = parallel_arrays(df, json, wide, [*keep])
    legs = F.array(*[F.struct(F.lit(24 * n).alias("lead"), *[F.col(f"{v}_previous_day{n}").alias(v) for v in variables]) for n in days])
    out = rows.select(*keep, "valid", F.explode(legs).alias("leg")).select(*keep, "valid", "leg.*")
    out = out.where(F.coalesce(*variables).isNotNull())
    return out.withColumn("run", F.col("valid") - F.make_dt_interval(F.lit(0), F.col("lead")))


def station_records(df: DataFrame, json: str, kinds: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, kind, ts, temp_c, wind_ms, rain_mm) of `{"sensors": [{"sensor_type", "data": [..]}]}`, imperial units converted."""
    schema = "sensors array<struct<sensor_type: int, data: array<struct<ts: long, temp: double, wind_speed: double, rain_in: double>>>>"
    rows = df.select(*keep, F.from_json(json, schema).alias("j")).select(*keep, F.explode("j.sensors").alias("s")).where(F.col("s.sensor_type").isin(*kinds))
    rows = rows.select(*keep, F.col("s.sensor_type").alias("kind"), F.explode("s.data").alias("d"))
    at = F.to_timestamp_ntz(F.lit("1970-01-01T00:00"), F.lit(TIME)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("d.ts").cast("decimal(18,6)"))
    return rows.select(*keep, "kind", at.alias("ts"), ((F.col("d.temp") - 32) * 5 / 9).alias("temp_c"), (F.col("d.wind_speed") * 0.44704).alias("wind_ms"), (F.col("d.rain_in") * 25.4).alias("rain_mm"))


def gauge_readings(df: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, ts, value, quality) of `{"items": [{"dateTime", "value", "quality"}]}`; a value that is no number is null."""
    schema = "items array<struct<dateTime: string, value: string, quality: string>>"
    rows = df.select(*keep, F.explode(F.from_json(json, schema)["items"]).alias("i"))
    return rows.select(*keep, F.to_timestamp_ntz(F.substring("i.dateTime", 1, 16), F.lit(TIME)).alias("ts"), F.col("i.value").try_cast("double").alias("value"), F.col("i.quality").alias("quality"))


def buoy_results(df: DataFrame, keys: Sequence[str], time: str, name: str, names: Sequence[str], value: str, forecast: str, order: str) -> DataFrame:
    """Key/value rows as columns: forecast rows are left out, the last of each time wins."""
    own = df.where(~F.coalesce(F.col(forecast), F.lit(False)))
    return own.groupBy(*keys, time).agg(*[F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order))).alias(n) for n in names])


def flagged_csv(spark: SparkSession, path: str, variable: str, *partitions: str) -> DataFrame:
    """(ts, variable, partitions) of CSV files time, value, flag with header: flag 1 alone, NaN left out. partitions: columns in the directories' names, with types."""
    rows = spark.read.csv(path, header=True, schema=", ".join([f"ts timestamp_ntz, `{variable}` double, flag int", *partitions]))
    return rows.where((F.col("flag") == 1) & ~F.isnan(variable) & F.col(variable).isNotNull()).drop("flag")


def sectioned_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ob_time, wind_ms, direction) of files with rows between `data` and `end data`: SYNOP rows, no NA, knots converted, first file wins.

    A file is read as one value, so its sections need no order among rows; files are as large as a station's year.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("value"))
    body = F.regexp_extract("value", r"(?s)(?:^|\n)data\n(.*?)\nend data", 1)
    lines = files.withColumn("__l", F.split(body, "\n")).withColumn("__head", F.split(F.element_at("__l", 1), ","))
    rows = lines.select("file", "__head", F.explode(F.slice("__l", 2, 1 << 30)).alias("line")).withColumn("c", F.split("line", ","))

    def cell(name: str):
        return F.trim(F.try_element_at("c", F.array_position("__head", name).cast("int")))

    rows = rows.where(cell("met_domain_name") == "SYNOP").select("file", F.to_timestamp_ntz(cell("ob_time"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ob_time"), (F.nullif(cell("wind_speed"), F.lit("NA")).try_cast("double") * 0.514444).alias("wind_ms"), F.nullif(cell("wind_direction"), F.lit("NA")).try_cast("double").alias("direction"))
    rows = rows.where("wind_ms IS NOT NULL")
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("ob_time").orderBy("file"))).where("__n = 1").drop("__n", "file")


def report_lines(df: DataFrame, line: str, station: str) -> DataFrame:
    """(station, ts, report, wind_dir, wind_kt, temp_c, dew_c) of `station,year,month,day,hour,minute,report`; other stations and NIL are left out."""
    c = F.split(line, ",", 7)
    part = [F.try_element_at(c, F.lit(i)) for i in range(1, 8)]
    rows = df.select(part[0].alias("station"), F.to_timestamp_ntz(F.concat_ws(" ", F.concat_ws("-", *part[1:4]), F.concat_ws(":", *part[4:6])), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), part[6].alias("report"))
    rows = rows.where((F.col("station") == station) & ~F.col("report").rlike(r"\bNIL\b"))
    wind, temp = r"\b(\d{3})(\d{2,3})(?:G\d{2,3})?KT\b", r"\b(M?\d{2})/(M?\d{2})\b"

    def degrees(k: int):
        return F.regexp_replace(F.nullif(F.regexp_extract("report", temp, k), F.lit("")), "M", "-").try_cast("double")

    return rows.withColumns({"wind_dir": F.regexp_extract("report", wind, 1).try_cast("double"), "wind_kt": F.regexp_extract("report", wind, 2).try_cast("double"), "temp_c": degrees(1), "dew_c": degrees(2)})


def spot_series(df: DataFrame, json: str, run: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, valid, lead, temp) of `{"timeSeries": [..]}`: lead in rounded hours, temperature or the middle of its largest and least."""
    schema = "timeSeries array<struct<time: string, screenTemperature: double, maxScreenAirTemp: double, minScreenAirTemp: double>>"
    rows = df.select(*keep, F.col(run), F.explode(F.from_json(json, schema)["timeSeries"]).alias("s")).withColumn("valid", F.to_timestamp_ntz(F.substring("s.time", 1, 16), F.lit(TIME)))
    lead = F.round(F.timestamp_diff("MINUTE", F.col(run), F.col("valid")) / 60).cast("int")
    return rows.select(*keep, "valid", lead.alias("lead"), F.coalesce("s.screenTemperature", (F.col("s.maxScreenAirTemp") + F.col("s.minScreenAirTemp")) / 2).alias("temp"))
