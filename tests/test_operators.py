"""Hand-worked cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from skerry.functions import weather as we
from skerry.operators import audit as au, calibrate as cal, dedup as dd, joins as jn, models as ml, pooling as po, spells as sp, verify as vf, windows as wn
from skerry.plans.basics import from_floor
from skerry.plans.training import LEAKING, vectors
from skerry.sources import feeds as fd, tree


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def test_brier_of_ten(spark):
    df = spark.createDataFrame([(0.3, int(i < 3)) for i in range(10)], "p double, y int")
    assert df.agg(vf.brier("p", "y")).first()[0] == pytest.approx(0.21)
    sure = spark.createDataFrame([(1.0, 1, 0.0), (0.0, 0, 1.0)], "p double, y int, q double")
    assert sure.agg(vf.brier("p", "y"), vf.brier("q", "y")).first()[:] == (0.0, 1.0)


def test_reliability_keeps_empty_bins(spark):
    df = spark.createDataFrame([("k", p, y) for p, y in zip([0.05] * 4 + [0.95] * 2, [0, 1, 0, 0, 1, 1])], "k string, p double, y int")
    got = {r.bin: (r.n, r.observed) for r in vf.reliability(df, ["k"], "p", "y", 10).collect()}
    assert got[0] == (4, 0.25) and got[9] == (2, 1.0) and len(got) == 10 and got[5] == (0, None)


def test_contingency(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 1], [1, 0, 1, 0, 1])), "f int, y int")
    r = df.agg(*vf.contingency("f", "y")).first()
    assert (r.hits, r.misses, r.false_alarms, r.true_negatives) == (2, 1, 1, 1)
    assert (r.hit_rate, r.false_alarm_ratio, r.csi) == pytest.approx((2 / 3, 1 / 3, 0.5))
    assert spark.createDataFrame(list(zip([1, 1, 1, 0], [1, 0, 0, 0])), "f int, y int").agg(*vf.contingency("f", "y")).first().frequency_bias == 3


def test_mean_absolute_error(spark):
    df = spark.createDataFrame(list(zip([1.0, 2.0, 3.0], [0.5, 2.5, 4.0])), "f double, y double")
    assert df.agg(*vf.errors("f", "y")).first().mae == pytest.approx(2 / 3)


def test_crps_of_a_mixture(spark):
    q = F.array(*map(F.lit, (0.1, 0.3, 0.7, 1.5, 3.0)))
    assert spark.range(1).select(vf.mixed_crps(F.lit(0.6), q, F.lit(0.5), 500)).first()[0] == pytest.approx(0.2456, abs=2e-3)


def test_pit_of_a_dry_day(spark):
    for pi, want in ((0.4, 0.3), (0.9, 0.05)):
        assert spark.range(1).select(we.mixed_pit(F.lit(pi), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0] == pytest.approx(want)


def day(spark, wet, hours=range(24)):
    rows = [(1, f"2024-05-01 {h:02d}:00:00", 0.1 if h in wet else 0.0) for h in hours]
    return ntz(spark.createDataFrame(rows, "k int, hour string, v double"), "hour")


@pytest.mark.parametrize("wet, longest", [(set(), 9), (set(range(24)), 0), ({9, 14, 16, 17}, 4)])
def test_dry_windows(spark, wet, longest):
    s = sp.daily_spells(day(spark, wet), ["k"], "hour", "v", 0.1, 9, 9)
    has = {r.window: r.has for r in sp.windows_of(s, (3, 4, 6)).collect()}
    assert has == {n: int(longest >= n) for n in (3, 4, 6)}


def test_a_missing_hour_drops_the_day(spark):
    assert sp.daily_spells(day(spark, set(), [h for h in range(24) if h != 12]), ["k"], "hour", "v", 0.1, 9, 9).count() == 0
    assert sp.daily_spells(day(spark, set(), [h for h in range(24) if h != 3]), ["k"], "hour", "v", 0.1, 9, 9).count() == 1


def test_smaller_lead_or_freshest(spark):
    df = spark.createDataFrame([(1, 24, 5, "a"), (1, 48, 9, "b")], "valid int, lead int, made int, x string")
    assert dd.latest_per_valid(df, ["valid"]).first().x == "a"
    assert dd.freshest_per_valid(df, ["valid"]).first().x == "b"


def test_merge_keeps_the_freshest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, made int, x string")
    new = spark.createDataFrame([(2, 2, "c"), (3, 1, "d")], "k int, made int, x string")
    assert {r.k: r.x for r in dd.merge_latest(old, new, ["k"], ["made"]).collect()} == {1: "a", 2: "c", 3: "d"}


def test_asof_has_no_tolerance_and_keeps_null_values(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("m", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, 1.0), ("k", 5, None)], "k string, t int, v double")
    for part in (None, lambda t: F.floor(t / 3), lambda t: t):
        got = {(r.k, r.t): (r.asof, r.v) for r in jn.asof_join(left, right, ["k"], "t", "t", ["v"], part).collect()}
        assert got == {("k", 1): (None, None), ("k", 5): (5, None), ("k", 9): (5, None), ("m", 9): (None, None)}


def test_quintiles_of_seven(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(7)], "k int, v double")
    assert [r.quintile for r in wn.quintile(df, ["k"], ["v"]).orderBy("v").collect()] == [0, 0, 1, 2, 2, 3, 4]


def test_rolling_window_leaves(spark):
    df = ntz(spark.createDataFrame([(1, "2024-01-01 05:00:00", 2.0), (1, "2024-01-02 05:00:00", 4.0), (1, "2024-01-09 05:00:00", 8.0)], "k int, t string, v double"), "t")
    got = {str(r.day): r["mean"] for r in wn.rolling_mean(df, ["k"], "t", F.col("v"), 3).collect()}
    assert got == {"2024-01-01": 2.0, "2024-01-02": 3.0, "2024-01-03": 3.0, "2024-01-04": 4.0, "2024-01-09": 8.0}


def test_pooled_rows_weigh_by_n(spark):
    df = spark.createDataFrame([("k", 10, 1.0, False, "a"), ("k", 30, 2.0, True, "b")], "k string, n int, mae double, drift boolean, label string")
    r = vf.pool_rows(df, ["k"], "n", ["mae"], "drift", "label").first()
    assert (r.mae, r.n, r.drift, r.label) == (1.75, 40, True, "b")


def test_drift_needs_enough_rows(spark):
    df = spark.createDataFrame([(19, 9.0), (20, 9.0)], "n int, mae double")
    assert [r[0] for r in df.orderBy("n").select(vf.drift(F.col("mae"), F.col("n"), F.lit(24), F.lit(1.0), 20, 1.5, 0.0)).collect()] == [False, True]


def test_band_decision(spark):
    df = spark.createDataFrame([("b", 72, 0.10, 48), ("b", 96, 0.12, 48)], "band string, candidate int, score double, incumbent int")
    assert po.decide_band(df, ["band"], "incumbent", 0.05).first().chosen == 72


def test_isotonic(spark):
    df = spark.createDataFrame([(i / 20, int(i % 3 == 0 or i > 12)) for i in range(20)], "p double, y int")
    got = [r.calibrated for r in cal.apply_knots(df, cal.isotonic_knots(df, "p", "y"), "p").orderBy("p").collect()]
    assert len(got) == 20 and got == sorted(got)
    flat = spark.createDataFrame([(0.2, 1), (0.8, 0)], "p double, y int")
    assert {r.calibrated for r in cal.apply_knots(flat, cal.isotonic_knots(flat, "p", "y"), "p").collect()} == {0.5}


def test_conformal_coverage(spark):
    base = spark.range(4000).select("id", F.rand(3).alias("p"), F.rand(5).alias("u")).withColumn("wet", (F.col("u") < F.col("p")).cast("int")).withColumn("k", F.lit(1)).persist()
    t = cal.conformal_thresholds(base.where("id % 2 = 0"), ["k"], "p", "wet", 0.1)
    tagged = cal.conformal_tag(base.where("id % 2 = 1"), t, ["k"], "p")
    ok = tagged.select(F.avg(((F.col("tag") == "Ambiguous") | ((F.col("tag") == "Wet") == (F.col("wet") == 1))).cast("int"))).first()[0]
    assert ok >= 0.88


def test_retrain_guard(spark):
    schema = "k int, n int, n_features int, missing double, label_rate double"
    old = spark.createDataFrame([(1, 100, 5, 0.1, 0.5), (2, 100, 5, 0.1, 0.5)], schema)
    new = spark.createDataFrame([(1, 60, 6, 0.1, 0.5), (2, 100, 5, 0.1, 0.5), (3, 1, 1, 0.0, 0.0)], schema)
    assert sorted((r.k, r.check) for r in au.retrain_guard(new, old, ["k"]).collect()) == [(1, "features"), (1, "rows")]


def test_merge_write_last_wins_and_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    one = ntz(spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0, 1), (1, "2024-01-02 00:00:00", 2.0, 1)], "s int, t string, v double, b int"), "t")
    tree.merge_days(one, path, ["s"], "t", ["s", "t"], "b")
    two = ntz(spark.createDataFrame([(1, "2024-01-02 00:00:00", 5.0, 2)], "s int, t string, v double, b int"), "t")
    for _ in range(2):
        tree.merge_days(two, path, ["s"], "t", ["s", "t"], "b")
    assert [r.v for r in tree.read_tree(spark, path).orderBy("t").collect()] == [1.0, 5.0]


def test_partition_names_do_not_hide_columns(spark, tmp_path):
    spark.createDataFrame([("real", 1)], "Model string, x int").write.parquet(str(tmp_path / "model=dir"))
    assert tree.read_tree(spark, str(tmp_path)).first().Model == "real"
    assert tree.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_sectioned_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\ndata\nob_time,met_domain_name,wind_speed,wind_direction\n2024-01-01 00:00:00,SYNOP,10,180\n2024-01-01 01:00:00,METAR,10,180\n2024-01-01 02:00:00,SYNOP,NA,180\nend data\n")
    r = fd.sectioned_csv(spark, str(tmp_path)).collect()
    assert len(r) == 1 and r[0].wind_ms == pytest.approx(5.14444) and r[0].direction == 180


def test_guards_refuse(spark):
    with pytest.raises(ValueError):
        from_floor(spark.range(1), None)
    with pytest.raises(ValueError, match="hold the truth"):
        ml.replay(spark, "none", spark.range(1), ["y"], vectors, LEAKING)


def test_directions(spark):
    r = spark.range(1).select(we.in_sector(F.lit(10.0), 300, 60), we.in_sector(F.lit(90.0), 300, 60), we.direction(F.lit(1.0), F.lit(0.0)), we.compass(F.lit("ssw"))).first()
    assert r[0] and not r[1] and r[2] == pytest.approx(270) and r[3] == 202.5


def test_saturation_at_zero(spark):
    assert spark.range(1).select(we.saturation_hpa(F.lit(0.0))).first()[0] == pytest.approx(6.11, abs=0.01)
    assert math.isclose(spark.range(1).select(we.apparent(F.lit(20.0), F.lit(10.0), F.lit(2.0))).first()[0], 17.9)
