"""Queries on feeds, sinks and streams: what they read is made by Spark from the driver's tables, at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import feeds as fd, tree
from ..sources.shared import shared_folder
from ..streaming import arrivals
from .basics import rounded
from .registry import query
from .views import obs, read, truth


ISO = "yyyy-MM-dd'T'HH:mm"


def series_json(df: DataFrame, names: list[str]) -> DataFrame:
    """(station, day, json): a day's rows as parallel arrays. df: station, valid and the names."""
    g = df.groupBy("station", F.to_date("valid").alias("day")).agg(F.array_sort(F.collect_list(F.struct(F.date_format("valid", ISO).alias("time"), *names))).alias("r"))
    def field(n: str):
        return F.transform("r", lambda x: x[n]).alias(n)

    return g.select("station", "day", F.to_json(F.struct(F.struct(*map(field, ("time", *names))).alias("hourly")), {"ignoreNullFields": "false"}).alias("json"))


@query("src5_previous_runs", "SELECT station, valid, lead, valid - to_hours(lead) AS run, round(y * lead / 24, 9) AS y FROM truth, (VALUES (24), (48)) t(lead) WHERE NOT (lead = 48 AND y < 50)")
def src5(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).select("station", "valid", F.col("y").alias("y_previous_day1"), F.when(F.col("y") >= 50, F.col("y") * 2).alias("y_previous_day2"))
    out = fd.previous_runs(series_json(t, ["y_previous_day1", "y_previous_day2"]), "json", ["y"], [1, 2], ["station"])
    return out.withColumn("y", F.round("y", 9))


@query("src6_live_runs", "SELECT station, valid, round(y, 9) AS y FROM truth WHERE y >= 40")
def src6(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).withColumn("y", F.when(F.col("y") >= 40, F.col("y")))
    return fd.parallel_arrays(series_json(t, ["y"]), "json", ["y"], ["station"]).withColumn("y", F.round("y", 9))


@query("src7_station_records", "SELECT CAST(user_id AS INT) AS station, CAST(user_id % 3 AS INT) AS kind, time_bucket(INTERVAL 1 SECOND, ts) AS ts, round((value - 32) * 5 / 9, 6) AS temp_c, round(value * 0.44704::DOUBLE, 6) AS wind_ms FROM events WHERE user_id % 3 IN (0, 1)")
def src7(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").selectExpr("CAST(user_id AS INT) AS station", "CAST(user_id % 3 AS INT) AS sensor_type", "timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS ts", "value")
    g = e.groupBy("station", "sensor_type").agg(F.collect_list(F.struct("ts", F.col("value").alias("temp"), F.col("value").alias("wind_speed"), F.lit(0.0).alias("rain_in"))).alias("data"))
    docs = g.groupBy("station").agg(F.to_json(F.struct(F.collect_list(F.struct("sensor_type", "data")).alias("sensors"))).alias("json"))
    return rounded(fd.station_records(docs, "json", [0, 1], ["station"]).drop("rain_mm"), "temp_c", "wind_ms")


@query("src8_gauge_readings", "SELECT CAST(user_id AS INT) AS station, time_bucket(INTERVAL 1 MINUTE, ts) AS ts, CASE WHEN event_type <> 'error' THEN value END AS value, event_type AS quality FROM events")
def src8(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"), F.col("event_type").alias("quality"))
    docs = read(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("station")).agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("json"))
    return fd.gauge_readings(docs, "json", ["station"])


@query("src9_buoy_pivot", "SELECT station, hour, arg_max(v, event_id) FILTER (event_id % 3 = 0) AS a, arg_max(v, event_id) FILTER (event_id % 3 = 1) AS b FROM obs WHERE event_id % 5 <> 0 GROUP BY ALL")
def src9(spark: SparkSession, d: str) -> DataFrame:
    o = obs(spark, d).withColumns({"name": F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int")), "forecast": F.col("event_id") % 5 == 0})
    return fd.buoy_results(o, ["station"], "hour", "name", ["a", "b"], "v", "forecast", "event_id")


@query("src10_flagged_csv", "SELECT station, ts, v FROM obs WHERE event_id % 4 <> 0")
def src10(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    o = obs(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("v").alias("v"), F.when(F.col("event_id") % 4 == 0, 4).otherwise(1).alias("flag"), "station")
    o.write.partitionBy("station").csv(path, header=True)
    return fd.flagged_csv(spark, path, "v", "station int").select("station", "ts", "v")


@query("src11_sectioned_csv", "SELECT hour AS ob_time, round(arg_min(v, station) * 0.514444::DOUBLE, 6) AS wind_ms FROM hourly WHERE hour(hour) % 2 = 0 GROUP BY 1")
def src11(spark: SparkSession, d: str) -> DataFrame:
    """A file for each station and day; rows of every other hour are of a kind that is left out, and the first file wins."""
    path = shared_folder(spark, "sections")
    h = obs(spark, d).groupBy("station", "hour").agg(F.avg("v").alias("v"))
    kind = F.when(F.hour("hour") % 2 == 0, "SYNOP").otherwise("METAR")
    line = F.concat_ws(",", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"), kind, F.col("v").cast("string"), F.lit("NA"))
    files = h.groupBy("station", F.to_date("hour").alias("day")).agg(F.array_join(F.concat(F.array(F.lit("title,x"), F.lit("data"), F.lit("ob_time,met_domain_name,wind_speed,wind_direction")), F.array_sort(F.collect_list(line)), F.array(F.lit("end data"), F.lit(""))), "\n").alias("value"))
    files.repartition("station", "day").write.partitionBy("station", "day").option("lineSep", "\n").text(path)
    return rounded(fd.sectioned_csv(spark, f"{path}/station=*/day=*").select("ob_time", "wind_ms"), "wind_ms")


@query("src12_report_lines", "SELECT 'S' || station AS station, time_bucket(INTERVAL 1 MINUTE, ts) AS ts, CAST(event_id % 360 AS DOUBLE) AS wind_dir, CAST(10 + event_id % 30 AS DOUBLE) AS wind_kt, CAST(event_id % 30 AS DOUBLE) AS temp_c, -CAST(event_id % 10 AS DOUBLE) AS dew_c FROM obs WHERE station = 2 AND event_id % 6 <> 0")
def src12(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    i = F.col("event_id")
    report = F.when(i % 6 == 0, F.lit("METAR XXXX NIL=")).otherwise(F.concat(F.lit("METAR XXXX "), F.lpad((i % 360).cast("string"), 3, "0"), two(10 + i % 30), F.lit("KT 9999 "), two(i % 30), F.lit("/M"), two(i % 10), F.lit(" Q1013=")))
    lines = obs(spark, d).select(F.concat_ws(",", F.concat(F.lit("S"), F.col("station").cast("string")), F.date_format("ts", "yyyy,MM,dd,HH,mm"), report).alias("line"))
    return fd.report_lines(lines, "line", "S2").drop("report")


@query("src13_spot_series", "SELECT station, valid, CAST(round(date_diff('minute', run, valid) / 60) AS INT) AS lead, round(CASE WHEN y >= 50 THEN y ELSE (y + 5 + y - 3) / 2 END, 9) AS temp FROM (SELECT *, CAST(CAST(valid AS DATE) AS TIMESTAMP) AS run FROM truth)")
def src13(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    point = F.struct(F.date_format("valid", ISO).alias("time"), F.when(y >= 50, y).alias("screenTemperature"), (y + 5).alias("maxScreenAirTemp"), (y - 3).alias("minScreenAirTemp"))
    docs = truth(spark, d).groupBy("station", F.to_date("valid").cast("timestamp_ntz").alias("run")).agg(F.to_json(F.struct(F.collect_list(point).alias("timeSeries"))).alias("json"))
    return fd.spot_series(docs, "json", "run", ["station"]).withColumn("temp", F.round("temp", 9))


@query("snk1_partitioned_write", "SELECT station, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(v), 6) AS total FROM obs GROUP BY ALL")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    path, o = shared_folder(spark, "days"), obs(spark, d)
    tree.write_days(o, path, ["station"], "ts")
    tree.write_days(o.where("station = 1"), path, ["station"], "ts")  # replaces its own partitions and no other
    return rounded(tree.read_tree(spark, path).groupBy("station", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total")


@query("snk2_merge_write", "SELECT event_id, station, ts, v + 1 AS v FROM obs WHERE event_id % 2 = 0 UNION ALL SELECT event_id, station, ts, v FROM obs WHERE event_id % 2 = 1")
def snk2(spark: SparkSession, d: str) -> DataFrame:
    path, o = shared_folder(spark, "merged"), obs(spark, d).drop("hour")
    tree.merge_days(o.withColumn("batch", F.lit(1)), path, ["station"], "ts", ["event_id"], "batch")
    tree.merge_days(o.where("event_id % 2 = 0").withColumns({"v": F.col("v") + 1, "batch": F.lit(2)}), path, ["station"], "ts", ["event_id"], "batch")
    return tree.read_tree(spark, path).select("event_id", "station", "ts", "v")


@query("snk3_merge_predictions", "SELECT station, model, valid, lead, max(run) AS run FROM fcst GROUP BY ALL")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.dedup import merge_latest
    from .views import fcst

    f, keys = fcst(spark, d), ["station", "model", "valid", "lead"]
    return merge_latest(f.where("event_id % 3 = 0"), f.where("event_id % 3 <> 0"), keys, ["run"]).select(*keys, "run")


@query("snk4_skip_empty", "SELECT event_id FROM (SELECT *, count(CASE WHEN value > 100 THEN value END) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS c FROM events) WHERE c > 0")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumns({"m": F.when(F.col("value") > 100, F.col("value")), "day": F.to_date("ts")})
    return tree.with_any(e, ["user_id", "day"], "m").select("event_id")


@query("snk5_staged_copy", "SELECT station, count(*) AS n, min(ts) AS first_ts FROM obs WHERE station IN (0, 1) GROUP BY 1")
def snk5(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "staged")
    obs(spark, d).where("station IN (0, 1)").write.parquet(path)
    return spark.read.parquet(path).groupBy("station").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("snk6_history_json", "SELECT station, count(*) AS n, round(max(v), 6) AS top FROM hourly GROUP BY 1")
def snk6(spark: SparkSession, d: str) -> DataFrame:
    from .views import hourly

    path = shared_folder(spark, "history")
    tree.write_history(hourly(spark, d), path, ["station"])
    back = spark.read.schema("station int, rows array<struct<hour: string, v: double, n: long>>").json(path)
    return rounded(back.select("station", F.size("rows").cast("long").alias("n"), F.array_max(F.transform("rows", lambda r: r["v"])).alias("top")), "top")


@query("st1_merge_stream", "SELECT event_id, station, ts, v FROM obs")
def st1(spark: SparkSession, d: str) -> DataFrame:
    source, path, checkpoint = shared_folder(spark, "arriving"), shared_folder(spark, "table"), shared_folder(spark, "progress")
    o = obs(spark, d).drop("hour")
    o.unionByName(o.where("event_id % 10 = 0")).write.parquet(source)
    stream = spark.readStream.schema(o.schema).parquet(source)
    arrivals.merge_arrivals(stream, path, checkpoint, ["station"], "ts", ["event_id"]).awaitTermination()
    return tree.read_tree(spark, path).select("event_id", "station", "ts", "v")


@query("st2_complete_hours_stream", """, o AS (SELECT station, time_bucket(INTERVAL 1 HOUR, ts) AS hour, sum(v) AS total, count(v) AS n FROM obs GROUP BY ALL), m AS (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 2 HOURS AS mark FROM obs)
SELECT station, hour, round(total, 6) AS total FROM o, m WHERE n = 4 AND hour + INTERVAL 1 HOUR <= mark""")
def st2(spark: SparkSession, d: str) -> DataFrame:
    source, path, checkpoint = shared_folder(spark, "readings"), shared_folder(spark, "hours"), shared_folder(spark, "progress")
    o = obs(spark, d).select("station", F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("+00:00"))).alias("ts"), "v")
    o.write.parquet(source)
    stream = arrivals.complete_hours(spark.readStream.schema(o.schema).parquet(source), ["station"], "ts", "v", 4)
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema("station int, hour timestamp, total double").parquet(path)
    return rounded(out.select("station", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("hour").cast("timestamp_ntz")).alias("hour"), "total"), "total")
