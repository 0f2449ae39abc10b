"""Terrain, daylight, named pairs, tiers and stored artefacts, worked by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from skerry import plans
from skerry.functions import weather as we
from skerry.plans import basics, tables

DATA = "/root/testdata/sf0.001"
BLOCK = "speed double, sine double, cosine double, dew double, pressure double"


def block(spark, *row):
    df = spark.createDataFrame([row], BLOCK).withColumn("gains", F.array(*[F.lit(float(10 * s)) for s in range(8)]))
    got = we.terrain_block(*[F.col(c) for c in ("speed", "sine", "cosine", "dew", "pressure", "gains")], F.lit(0.2), F.lit(0.1))
    return df.select(*[c.alias(k) for k, c in got.items()]).first()


def test_wind_from_the_west_climbs_a_slope_to_the_east(spark):
    r = block(spark, 10.0, -1.0, 0.0, 10.0, 1000.0)
    e = 6.112 * math.exp(17.62 * 10 / (10 + 243.12))
    assert r.uplift == pytest.approx(2.0) and r.upwind_gain == 60.0  # sector 6 is west
    assert r.uplift_humidity == pytest.approx(2.0 * 622 * e / (1000 - 0.378 * e))


def test_wind_down_the_slope_has_no_uplift(spark):
    r = block(spark, 10.0, 1.0, 0.0, 10.0, 1000.0)
    assert (r.uplift, r.uplift_humidity, r.upwind_gain) == (0.0, 0.0, 20.0)


@pytest.mark.parametrize("row", [(None, -1.0, 0.0, 10.0, 1000.0), (10.0, None, None, 10.0, 1000.0)])
def test_missing_wind_is_no_uplift(spark, row):
    assert block(spark, *row).uplift == 0.0


@pytest.mark.parametrize("dew,pressure", [(None, 1000.0), (10.0, None), (10.0, 0.0)])
def test_missing_humidity_takes_uplift_times_humidity_alone(spark, dew, pressure):
    r = block(spark, 10.0, -1.0, 0.0, dew, pressure)
    assert r.uplift == pytest.approx(2.0) and r.uplift_humidity == 0.0


def test_directions_around_north_are_one_sector(spark):
    for degrees in (350.0, 0.0, 20.0):
        assert block(spark, 1.0, math.sin(math.radians(degrees)), math.cos(math.radians(degrees)), None, None).upwind_gain == 0.0


def test_the_sun_is_judged_at_each_place(spark):
    rows = [(dt.datetime(2024, 6, 21, 20), 60.0, 0.0, True), (dt.datetime(2024, 6, 21, 20), 40.0, 0.0, False), (dt.datetime(2024, 1, 5, 12), 50.0, 0.0, True), (dt.datetime(2024, 1, 5, 12), 50.0, 180.0, False), (dt.datetime(2024, 1, 5, 12), 75.0, 0.0, False)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, lat double, lon double, day boolean").withColumn("sine", we.sine_altitude("ts", F.col("lat"), F.col("lon")))
    assert [r.sine > 0 for r in df.collect()] == [r[3] for r in rows]
    assert df.select(we.sine_altitude("ts", F.lit(None).cast("double"), 0.0).alias("s")).first().s is None


def test_pairs_are_those_named(spark):
    h = dt.datetime(2024, 1, 1)
    hours = spark.createDataFrame([(s, h, float(s)) for s in range(6)], "station int, hour timestamp_ntz, v double")
    named = spark.createDataFrame([(4, 1), (2, 3), (2, 3), (2, 9)], "a int, b int")  # repeated, and a station without rows
    got = basics.station_pairs(hours, named, "v").collect()
    assert sorted((r.a, r.b, r.v_a, r.v_b) for r in got) == [(2, 3, 2.0, 3.0), (4, 1, 4.0, 1.0)]


def test_plans_have_no_cross_join(spark):
    for name in ("jn11_two_stations", "agg13_agreement", "dq3_coverage_guard", "ts5_terrain_block", "ts9_tiers_by_lead"):
        plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_tiers_hold_what_they_require(spark):
    rows = plans.QUERIES["ts9_tiers_by_lead"](spark, "/root/testdata/sf0.01").collect()
    assert {r.tier for r in rows} == {"long", "short"}
    for r in rows:
        assert r.click is not None and r.error is not None and r.valid.hour in (0, 12)
        assert r.tier == "long" or r.view is not None and r.valid >= dt.datetime(2024, 1, 10)
    short = {(r.station, r.valid, r.lead) for r in rows if r.tier == "short"}
    assert short <= {(r.station, r.valid, r.lead) for r in rows if r.tier == "long"}


def made(spark, days: int):
    rows = [(24, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 2.0 * i + 1, float(i), float(i), float(i) + 1, None) for i in range(days)]
    return spark.createDataFrame(rows, "lead int, valid timestamp_ntz, y double, mean double, click double, error double, view double")


def test_artefacts_hold_their_test_errors(spark):
    from skerry.operators import models as ml

    found = ml.about(spark, *tables.artefacts(spark, made(spark, 30))).collect()
    assert sorted((r.features[0], r.cutoff.day) for r in found) == [("click", 16), ("click", 23), ("mean", 16), ("mean", 23)]
    last = next(r for r in found if r.cutoff.day == 23 and r.features == ["mean"])
    assert last.measures["test_mae"] == pytest.approx(0, abs=1e-6)  # a straight line
    assert last.measures["best_mae"] == pytest.approx(sum(i for i in range(22, 30)) / 8)  # error's, one above click


def test_no_artefact_without_rows_on_both_sides(spark):
    assert tables.artefacts(spark, made(spark, 10)) == [] and tables.artefacts(spark, made(spark, 0)) == []
