"""Hand-worked feeds, sinks and streams: missing values, malformed rows, repeats and empty inputs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from skerry import plans
from skerry.sources import feeds as fd, shared, snapshots, tree
from skerry.streaming import arrivals


def t(h: int, m: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, 1, h, m)


def texts(spark, *values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "k int, j string")


def test_parallel_arrays(spark):
    good = {"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "a": [1.0, None, 3.0], "b": [None, None, 4.0]}}
    short = {"hourly": {"time": ["2024-01-01T05:00", "2024-01-01T06:00"], "a": [7.0]}}
    rows = fd.parallel_arrays(texts(spark, good, short, None, "no json", {"hourly": {"time": [], "a": []}}), "j", ["a", "b"], ["k"]).collect()
    assert sorted((r.k, r.valid, r.a, r.b) for r in rows) == [(0, t(0), 1.0, None), (0, t(2), 3.0, 4.0), (1, t(5), 7.0, None)]


def test_previous_runs(spark):
    doc = {"hourly": {"time": ["2024-01-01T12:00"], "a_previous_day1": [1.0], "a_previous_day2": [None], "a_previous_day3": [3.0]}}
    rows = fd.previous_runs(texts(spark, doc), "j", ["a"], [1, 2, 3], ["k"]).collect()
    assert sorted((r.lead, r.a, r.run) for r in rows) == [(24, 1.0, t(12) - dt.timedelta(hours=24)), (72, 3.0, t(12) - dt.timedelta(hours=72))]


def test_station_records(spark):
    doc = {"sensors": [{"sensor_type": 45, "data": [{"ts": 1704067200, "temp": 212.0, "wind_speed": 10.0, "rain_in": 1.0}, {"ts": 1704067260, "temp": None}]}, {"sensor_type": 9, "data": [{"ts": 1704067200, "temp": 1.0}]}, {"sensor_type": 45, "data": []}]}
    rows = sorted(fd.station_records(texts(spark, doc, None), "j", [45]).collect(), key=lambda r: r.ts)
    assert [(r.ts, r.temp_c, r.rain_mm) for r in rows] == [(t(0), 100.0, 25.4), (t(0, 1), None, None)] and abs(rows[0].wind_ms - 4.4704) < 1e-9


def test_gauge_readings(spark):
    doc = {"items": [{"dateTime": "2024-01-01T00:15:00Z", "value": "0.2", "quality": "Good"}, {"dateTime": "2024-01-01T00:30:00Z", "value": "NaNsense", "quality": None}]}
    assert sorted((r.ts, r.value, r.quality) for r in fd.gauge_readings(texts(spark, doc, {"items": []}, None), "j").collect()) == [(t(0, 15), 0.2, "Good"), (t(0, 30), None, None)]


def test_buoy_results(spark):
    rows = [("s", t(0), "a", 1.0, False, 1), ("s", t(0), "a", 2.0, False, 2), ("s", t(0), "a", 9.0, True, 3), ("s", t(0), "b", 5.0, None, 1), ("s", t(0), "other", 7.0, False, 9), ("s", t(1), "b", None, False, 1)]
    got = fd.buoy_results(spark.createDataFrame(rows, "k string, t timestamp_ntz, n string, v double, f boolean, o int"), ["k"], "t", "n", ["a", "b"], "v", "f", "o")
    assert sorted((r.t, r.a, r.b) for r in got.collect()) == [(t(0), 2.0, 5.0), (t(1), None, None)]


def test_flagged_csv(spark, tmp_path):
    (tmp_path / "station=3").mkdir()
    (tmp_path / "station=3" / "x.csv").write_text("ts,v,flag\n2024-01-01 00:00:00,1.5,1\n2024-01-01 01:00:00,2.5,4\n2024-01-01 02:00:00,NaN,1\n2024-01-01 03:00:00,,1\n2024-01-01 04:00:00,3.5,\n")
    assert [(r.station, r.ts, r.v) for r in fd.flagged_csv(spark, str(tmp_path), "v", "station int").collect()] == [(3, t(0), 1.5)]


def test_report_lines(spark):
    lines = ["EGXX,2024,01,01,00,20,METAR EGXX 010020Z 27015G25KT 9999 05/M01 Q1010", "EGXX,2024,01,01,00,50,METAR EGXX 010050Z NIL=", "EGYY,2024,01,01,00,20,METAR EGYY 27010KT", "EGXX,2024,01,01,01,20,METAR EGXX VRB02KT ////", "broken"]
    rows = sorted(fd.report_lines(spark.createDataFrame([(x,) for x in lines], "line string"), "line", "EGXX").collect(), key=lambda r: r.ts)
    assert [(r.ts, r.wind_dir, r.wind_kt, r.temp_c, r.dew_c) for r in rows] == [(t(0, 20), 270.0, 15.0, 5.0, -1.0), (t(1, 20), None, None, None, None)]


def test_spot_series(spark):
    doc = {"timeSeries": [{"time": "2024-01-01T03:00Z", "screenTemperature": 4.0, "maxScreenAirTemp": 9.0, "minScreenAirTemp": 1.0}, {"time": "2024-01-01T04:00Z", "maxScreenAirTemp": 9.0, "minScreenAirTemp": 1.0}, {"time": "2024-01-01T05:00Z", "maxScreenAirTemp": 9.0}]}
    df = texts(spark, doc, None).withColumn("run", F.lit(t(0, 20)).cast("timestamp_ntz"))
    assert sorted((r.valid, r.lead, r.temp) for r in fd.spot_series(df, "j", "run").collect()) == [(t(3), 3, 4.0), (t(4), 4, 5.0), (t(5), 5, None)]


def test_merges_keep_other_partitions_and_repeat_safely(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda *r: spark.createDataFrame(list(r), "s string, t timestamp_ntz, v double, b int")
    day2 = t(0) + dt.timedelta(days=1)
    tree.merge_days(rows(("x", t(0), 1.0, 1), ("x", day2, 2.0, 1), ("y", t(0), 3.0, 1)), path, ["s"], "t", ["s", "t"], "b")
    for _ in range(2):  # the same batch twice
        tree.merge_days(rows(("x", t(0), 9.0, 2), ("x", t(5), 4.0, 2), ("x", t(5), 5.0, 3)), path, ["s"], "t", ["s", "t"], "b")
    got = sorted((r.s, r.t, r.v) for r in tree.read_tree(spark, path).collect())
    assert got == [("x", t(0), 9.0), ("x", t(5), 5.0), ("x", day2, 2.0), ("y", t(0), 3.0)]
    tree.merge_days(rows(("x", t(0), 1.0, 9)).limit(0), path, ["s"], "t", ["s", "t"], "b")
    assert tree.read_tree(spark, path).count() == 4


def test_streams(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "s", t(0)), (1, "s", t(0)), (2, "s", t(1)), (3, None, t(2))], "id int, s string, ts timestamp_ntz")
    df.write.parquet(source)
    for _ in range(2):  # nothing new the second time
        arrivals.merge_arrivals(spark.readStream.schema(df.schema).parquet(source), path, str(tmp_path / "progress"), ["s"], "ts", ["id"]).awaitTermination()
    assert sorted(r.id for r in tree.read_tree(spark, path).collect()) == [1, 2, 3]
    hours = spark.createDataFrame([("s", t(0, m), 1.0) for m in (0, 15, 30, 45)] + [("s", t(1, 0), 1.0), ("s", t(6, 0), 1.0), ("s", None, 1.0)], "s string, ts timestamp, v double")
    hours.write.parquet(str(tmp_path / "hours"))
    stream = arrivals.complete_hours(spark.readStream.schema(hours.schema).parquet(str(tmp_path / "hours")), ["s"], "ts", "v", 4)
    stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "whole")).option("checkpointLocation", str(tmp_path / "p2")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.s, r.total) for r in spark.read.schema("s string, hour timestamp, total double").parquet(str(tmp_path / "whole")).collect()] == [("s", 4.0)]


def test_a_shared_folder_is_asked_for(spark):
    assert shared.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def month(spark, days=30):
    return spark.createDataFrame([(s, t(h) + dt.timedelta(days=d), float(d)) for s in ("a", "b", None) for d in range(days) for h in (0, 23)], "s string, ts timestamp_ntz, v double")


def opened(df):
    """Days of the files that a plan would open."""
    return sorted({f.split("p_date=")[1].split("/")[0] for f in df.inputFiles()})


@pytest.mark.parametrize("logged", [True, False])
def test_a_range_opens_its_own_files(spark, tmp_path, logged):
    path, rows = str(tmp_path / "tree"), month(spark)
    if logged:
        tree.write_days(rows, path, ["s"], "ts")
    else:
        rows.withColumns({"p_s": F.col("s"), "p_date": F.to_date("ts")}).write.partitionBy("p_s", "p_date").parquet(path)
    got = tree.read_range(spark, path, "ts", "2024-01-05 12:00:00", "2024-01-06 12:00:00")
    assert opened(got) == ["2024-01-05", "2024-01-06"]
    assert sorted((r.s or "", r.ts.day, r.ts.hour) for r in got.collect()) == [(s, d, h) for s in ("", "a", "b") for d, h in ((5, 23), (6, 0))]
    one = tree.read_range(spark, path, "ts", "2024-01-05 00:00:00", "2024-01-05 23:59:59", {"s": ["a", None]})
    assert len({f.split("p_s=")[1].split("/")[0] for f in one.inputFiles()}) == 2
    assert sorted((r.s or "", r.ts.hour) for r in one.collect()) == [("", 0), ("", 23), ("a", 0), ("a", 23)]
    assert tree.read_range(spark, path, "ts", "2031-01-01", "2031-01-02", schema=rows.schema).count() == 0
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().head()
    got.count()
    assert "2024-01-04" not in scan.toString()


def test_a_range_of_a_plain_tree_needs_a_schema_where_nothing_is_there(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        tree.read_range(spark, str(tmp_path / "none"), "ts", "2024-01-01", "2024-01-02")


def test_merges_keep_null_keys_and_null_times(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), "i int, s string, t timestamp_ntz, b int")
    tree.merge_days(rows((1, None, t(0), 1), (2, "x", t(0), 1), (3, "x", None, 1)), path, ["s"], "t", ["i"], "b")
    tree.merge_days(rows((4, None, t(0), 2), (5, "x", t(0), 2), (6, "x", None, 2), (2, "x", t(0), 2)), path, ["s"], "t", ["i"], "b")
    assert sorted((r.i, r.b) for r in tree.read_tree(spark, path).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 2), (6, 2)]


@pytest.mark.parametrize("step", ["replace", "commit"])
def test_a_merge_that_dies_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(list(r), "i int, s string, t timestamp_ntz, b int")
    merge = lambda df: tree.merge_days(df, path, ["s"], "t", ["i"], "b")
    merge(rows((1, "x", t(0), 1), (2, "x", t(1), 1)))
    later = rows((1, "x", t(0), 2), (3, "y", t(1), 2))

    def dies(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        m.setattr(snapshots, step, dies)
        with pytest.raises(RuntimeError):
            merge(later)
    assert sorted((r.i, r.b) for r in tree.read_tree(spark, path).collect()) == [(1, 1), (2, 1)]
    merge(later)
    assert sorted((r.i, r.b) for r in tree.read_tree(spark, path).collect()) == [(1, 2), (2, 1), (3, 2)]


def test_two_writers_of_one_version(spark, tmp_path):
    path, df = str(tmp_path / "t"), month(spark, 1)
    before = snapshots.current(spark, path)
    tree.write_days(df, path, ["s"], "ts")
    with pytest.raises(Exception, match="exist"):
        snapshots.replace(df.withColumn("p_s", F.col("s")), path, ["p_s"], before)
    assert tree.read_tree(spark, path).count() == df.count()


def test_snapshots_leave_nothing_behind(spark, tmp_path):
    path, df = str(tmp_path / "t"), month(spark, 2)
    for n in range(8):
        tree.merge_days(df.withColumn("b", F.lit(n)), path, ["s"], "ts", ["s", "ts"], "b")
    assert len(list((tmp_path / "t").glob("b-*"))) == snapshots.KEEP
    assert len([f for f in (tmp_path / "t" / "_snapshots").iterdir() if not f.name.startswith(".")]) == snapshots.KEEP
    tree.merge_days(df.where("s = 'a'").withColumn("b", F.lit(9)), path, ["s"], "ts", ["s", "ts"], "b")
    rows = tree.read_tree(spark, path)
    assert sorted({(r.s, r.b) for r in rows.collect()}, key=str) == [("a", 9), ("b", 7), (None, 7)] and rows.count() == df.count()


def test_a_schema_that_grows(spark, tmp_path):
    path = str(tmp_path / "t")
    tree.merge_days(spark.createDataFrame([(1, "x", t(0), 1), (2, "x", t(1), 1)], "i int, s string, t timestamp_ntz, v int"), path, ["s"], "t", ["i"], "i")
    tree.merge_days(spark.createDataFrame([(3, "y", t(0), 7_000_000_000, 0.5)], "i int, s string, t timestamp_ntz, v long, w double"), path, ["s"], "t", ["i"], "i")
    rows = tree.read_tree(spark, path)
    assert dict(rows.dtypes)["v"] == "bigint" and sorted((r.i, r.v, r.w) for r in rows.collect()) == [(1, 1, None), (2, 1, None), (3, 7_000_000_000, 0.5)]
    with pytest.raises(ValueError, match="column v"):
        tree.merge_days(spark.createDataFrame([(4, "z", t(0), "n")], "i int, s string, t timestamp_ntz, v string"), path, ["s"], "t", ["i"], "i")
    assert tree.read_tree(spark, path).count() == 3


def test_a_plain_tree_is_taken_over(spark, tmp_path):
    path, df = str(tmp_path / "t"), month(spark, 2)
    df.withColumns({"p_s": F.col("s"), "p_date": F.to_date("ts")}).write.partitionBy("p_s", "p_date").parquet(path)
    tree.merge_days(df.where("s = 'a'").withColumn("v", F.lit(9.0)), path, ["s"], "ts", ["s", "ts"], "v")
    assert sorted((r.s or "", r.v) for r in tree.read_tree(spark, path).where("day(ts) = 2 AND hour(ts) = 0").collect()) == [("", 1.0), ("a", 9.0), ("b", 1.0)]


def test_files_in_other_units(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 500.0), ("b", 3.0), ("b", None), ("c", None)], "k string, v double")
    df.repartition("k").withColumn("p_k", F.col("k")).write.partitionBy("p_k").parquet(path)
    assert sorted((r.k, r.v) for r in tree.files_repaired(spark, path, "v").where("v IS NOT NULL").collect()) == [("a", 0.1), ("a", 0.2), ("b", 0.003), ("b", 0.5)]
    assert tree.files_repaired(spark, path, "v").count() == 6


def test_units_of_users_in_few_files(spark, tmp_path):
    """Users share files, and one user is in two; files do not grow with users."""
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, 0.1), (2, 500.0), (2, 3.0), (None, 400.0), (None, 4.0), (3, None)], "u int, v double")
    df.coalesce(1).write.parquet(path)
    spark.createDataFrame([(2, 7.0), (1, 0.2)], df.schema).coalesce(1).write.mode("append").parquet(path)
    got = sorted(((r.u or 0, r.v) for r in tree.files_repaired(spark, path, "v", 300.0, ["u"]).where("v IS NOT NULL").collect()))
    assert got == [(0, 0.004), (0, 0.4), (1, 0.1), (1, 0.2), (2, 0.003), (2, 0.007), (2, 0.5)]
    out = plans.QUERIES["prj1_unit_repair"](spark, "/root/testdata/sf0.01")
    assert len(out.inputFiles()) < 20  # of 150 users


def test_groups_with_any_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 2.0), (None, None)], "k string, v double")
    assert sorted((r.k or "", r.v or 0) for r in tree.with_any(df, ["k"], "v").collect()) == [("", 0), ("", 2.0), ("a", 0), ("a", 1.0)]


def test_folders_go_with_their_block(spark):
    with shared.scratch_folder(spark, "x") as path:
        spark.range(3).write.parquet(path)
    files, where = shared.file_system(spark, path)
    assert not files.exists(where)
