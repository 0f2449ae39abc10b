"""Hand-worked cases of the time, rank, spell and pooling operators: nulls, ties, gaps, repeats and empty tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skerry.functions import weather as we
from skerry.operators import audit as au, calibrate as ca, joins as jn, pooling as po, spells as sp, verify as vf, windows as wn


def at(hour: float, day: int = 1) -> dt.datetime:
    return dt.datetime(2024, 1, day) + dt.timedelta(hours=hour)


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column).first()[0]


def test_quintile_of_seven_and_ties(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 2, 2, 3, 4, 5)], "k int, v double")
    assert sorted(r.quintile for r in wn.quintile(df, ["k"], ["v"]).collect()) == [0, 0, 1, 2, 2, 3, 4]


def test_nearest(spark):
    left = spark.createDataFrame([(1, "s", at(10)), (2, "s", at(0)), (3, "s", None), (4, None, at(10)), (5, "t", at(10)), (6, "s", at(23.9)), (6, "s", at(23.9))], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([("s", at(9.5), 1), ("s", at(10.5), 2), ("s", at(2), 3), ("s", at(0.1, 2), 4), ("s", at(0.1, 2), 5), ("t", at(12), 6), ("s", None, 7), (None, at(10), 8)], "k string, rt timestamp_ntz, v int")
    got = sorted((r.id, r.v) for r in jn.nearest_join(left, right, ["k"], "ts", "rt", ["v"], 3600, ["v"]).collect())
    assert got == [(1, 1), (2, None), (3, None), (4, None), (5, None), (6, 4), (6, 4)]  # the earlier of two as near; 5 is two hours off
    exact = jn.nearest_join(left.where("id = 1"), spark.createDataFrame([("s", at(10), 9), ("s", at(9.99), 1)], right.schema), ["k"], "ts", "rt", ["v"], 3600).first()
    assert (exact.v, exact.near) == (9, at(10))
    assert jn.nearest_join(left, right.limit(0), ["k"], "ts", "rt", ["v"], 3600).where("v IS NOT NULL").count() == 0


def test_nearest_across_parts_is_brute_force(spark):
    a = [(i, i % 2, at(i * 1.7)) for i in range(120)]
    b = [(i % 2, at(i * 2.3 + 0.2), i) for i in range(90)]
    left, right = spark.createDataFrame(a, "id int, k int, ts timestamp_ntz"), spark.createDataFrame(b, "k int, rt timestamp_ntz, v int")
    got = {r.id: r.v for r in jn.nearest_join(left, right, ["k"], "ts", "rt", ["v"], 7200).collect()}
    for i, k, t in a:
        near = [(abs((rt - t).total_seconds()), rt, v) for kk, rt, v in b if kk == k and abs((rt - t).total_seconds()) <= 7200]
        assert got[i] == (min(near)[2] if near else None)


def test_no_frame_is_read_anew_for_each_row(spark):
    """A frame that ends with its group is quadratic in the rows of a part."""
    df = spark.createDataFrame([(1, at(5), 2.0)], "k int, ts timestamp_ntz, v double")
    for out in (jn.nearest_join(df, df.withColumnRenamed("ts", "rt"), ["k"], "ts", "rt", ["v"], 3600), sp.dry_by_and_wet_since(df, ["k"], "ts", "v", 1.0)):
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


def test_logit_pool_of_a_certain_forecast(spark):
    """0 pools to 0, as in the SQL of pool3_logit_weight, and not to what a number near 0 would give; weight 0, where the pool has no value, is not chosen."""
    df = spark.createDataFrame([("a", 0.0, 0.5, 1), ("a", 0.8, 0.6, 1), ("b", 0.3, 1.0, 1), ("b", 0.2, 0.9, 1), ("c", 0.0, 0.0, 0), ("d", 0.0, 1.0, 0)], "k string, a double, b double, y int")
    got = {r.k: (r.weight, r.brier) for r in po.best_logit_weight(df, ["k"], "a", "b", "y").collect()}
    assert got["a"] == (1.0, pytest.approx((1 + 0.04) / 2, abs=1e-12))
    assert got["b"][0] == 0.0 and got["b"][1] == pytest.approx(0.01 / 2, abs=1e-12)
    assert got["c"] == (0.05, 0.0)
    assert got["d"][0] == 0.0 and got["d"][1] != got["d"][1]


def test_lagged_and_range(spark):
    left = spark.createDataFrame([(1, at(5), 2), (1, at(1), 2), (2, at(5), 2), (None, at(5), 2)], "k int, t timestamp_ntz, lead int")
    right = spark.createDataFrame([(1, at(3), 7.0), (2, at(4), 8.0)], "k int, t timestamp_ntz, y double")
    assert sorted((r.k or 0, r.t, r.b) for r in jn.lagged(left, right, ["k"], "t", "y", F.col("lead"), "b").collect() if r.b) == [(1, at(5), 7.0)]
    points = spark.createDataFrame([(0,), (5,), (9,), (10,), (None,)], "v int")
    bands = spark.createDataFrame([(0, 5, "a"), (5, 10, "b")], "low int, high int, name string")
    assert sorted((r.v, r.name) for r in jn.range_join(points, bands, "v", "low", "high").collect()) == [(0, "a"), (5, "b"), (9, "b")]


def test_islands_and_changes(spark):
    df = spark.createDataFrame([(1, at(h), f) for h, f in ((0, True), (1, True), (2, None), (3, True), (5, True), (6, False))], "k int, t timestamp_ntz, f boolean")
    assert sorted((r.start, r.end, r.n) for r in wn.islands(df, ["k"], "t", "f", 3600).collect()) == [(at(0), at(1), 2), (at(3), at(3), 1), (at(5), at(5), 1)]
    assert [r.streak for r in wn.changes(df, ["k"], ["t"], F.col("f")).orderBy("t").collect()] == [1, 1, 2, 3, 3, 4]


def test_trailing_sums_need_every_hour(spark):
    df = spark.createDataFrame([(1, at(h), 1.0 if h != 4 else None) for h in (0, 1, 2, 3, 4, 5, 6, 8)], "k int, h timestamp_ntz, v double")
    got = {r.h: (r.sum_3, r.wet_3) for r in wn.trailing(df, ["k"], "h", "v", 3, 1.0).collect()}
    assert got[at(2)] == (3.0, 3) and got[at(3)] == (3.0, 3) and all(got[at(h)] == (None, None) for h in (0, 1, 4, 5, 6, 8))


def test_dry_run_stops_at_wet_and_at_gaps(spark):
    df = spark.createDataFrame([(1, at(h), v) for h, v in ((0, 0.0), (1, 0.1), (2, 0.2), (3, 0.0), (4, 0.0), (6, 0.0), (7, None), (8, 0.0))], "k int, h timestamp_ntz, v double")
    assert [r.dry_hours for r in wn.dry_run(df, ["k"], "h", "v", 0.1).orderBy("h").collect()] == [1, 2, 0, 1, 2, 1, 0, 1]


def test_lines(spark):
    df = spark.createDataFrame([(1, at(0), 0.0), (1, at(4), 8.0), (1, at(5), None), (2, at(0), 3.0)], "k int, t timestamp_ntz, v double")
    got = [(r.k, r.hour, r.v) for r in wn.hourly_line(df, ["k"], "t", "v").orderBy("k", "hour").collect()]
    assert got == [(1, at(h), 2.0 * h) for h in range(4)] + [(1, at(4), 8.0), (1, at(5), None), (2, at(0), 3.0)]
    north = spark.createDataFrame([(1, at(0), 350.0), (1, at(2), 10.0)], "k int, t timestamp_ntz, d double")
    assert [round(r.d, 6) % 360 for r in wn.hourly_direction(north, ["k"], "t", "d").orderBy("hour").collect()] == [350.0, 0.0, 10.0]
    assert wn.hourly_line(df.limit(0), ["k"], "t", "v").count() == 0


def test_split_is_checked(spark):
    good = [(1, at(i)) for i in range(20)]
    few = [(2, at(i)) for i in range(9)]
    tied = [(3, at(min(i, 13))) for i in range(20)]  # the last of training and the first of validation are one time
    got = {}
    for r in wn.split_checked(spark.createDataFrame(good + few + tied, "k int, t timestamp_ntz"), ["k"], "t").collect():
        got.setdefault(r.k, []).append((r.part, r.ok))
    assert sorted(got[1]) == sorted([("train", True)] * 14 + [("validation", True)] * 3 + [("test", True)] * 3)
    assert {ok for _, ok in got[2]} == {False} and {ok for _, ok in got[3]} == {False}


def test_spells(spark):
    hours = [(1, at(h), 9.0 if h in (2, 3, 5) else 0.0) for h in (0, 1, 2, 3, 4, 5, 7)] + [(1, at(8), None)]
    df = spark.createDataFrame(hours, "k int, h timestamp_ntz, v double")
    assert sorted((r.start, r.end) for r in sp.wet_bands(df, ["k"], "h", "v", 5.0).collect()) == [(at(2), at(4)), (at(5), at(6))]
    day = sp.daily_spells(df, ["k"], "h", "v", 5.0, 0, 6).collect()
    assert [(r.dry_hours, r.longest) for r in day] == [(3, 2)]
    assert sp.daily_spells(df, ["k"], "h", "v", 5.0, 0, 9).count() == 0  # not all hours are there
    assert sorted(r.start_hour for r in sp.valid_starts(df, ["k"], "h", "v", 5.0, 0, 9, 2).collect()) == [0]


def test_weights(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, 0.25), (1, 1.0, 0.0, 0.75), (2, 0.5, 0.5, 1.0), (3, 0.0, 1.0, 2.0), (4, None, 1.0, 1.0)], "k int, a double, b double, y double")
    assert {r.k: r.weight for r in po.best_weight(df, ["k"], "a", "b", "y").collect()} == {1: 0.5, 2: 0.5, 3: 0.0, 4: 0.5}


def test_incumbents(spark):
    def decide(inc, *rows):
        df = spark.createDataFrame([(1, c, s, g, "base", inc) for c, s, g in rows], "k int, candidate string, selected_on double, graded_on double, base string, inc string")
        r = po.decide_with_incumbent(df, ["k"], "base", "inc", 0.05, 0.03).first()
        return r.pick, r.passes

    base = ("base", 0.3, 1.0)
    assert decide(None, base, ("a", 0.1, 0.9)) == ("a", True)
    assert decide(None, base, ("a", 0.1, 0.96)) == ("a", False)  # less than 5 %
    assert decide("b", base, ("a", 0.1, 0.9), ("b", 0.2, 0.92)) == ("b", True)  # 0.9 is not 3 % better than 0.92
    assert decide("b", base, ("a", 0.1, 0.88), ("b", 0.2, 0.92)) == ("a", True)
    assert decide("b", base, ("b", 0.1, 0.97)) == ("b", True)  # an incumbent needs 2 %
    assert decide("gone", base, ("a", 0.1, 0.9)) == ("a", True)
    assert decide(None, ("base", 0.1, 1.0), ("a", 0.3, 0.5)) == ("base", False)
    assert decide(None, base, ("a", None, 0.1)) == ("base", False)
    assert decide("b", base, ("a", 0.1, None), ("b", 0.2, 0.9)) == ("b", True)


def test_mixture_crps_is_the_sum_over_its_parts(spark):
    pi, q = 0.6, [1.0, 2.0, 4.0]
    mass = [(0.0, 1 - pi)] + [(x, pi / 3) for x in q]
    for y in (0.0, 0.5, 3.0, 9.0):
        want = sum(m * abs(x - y) for x, m in mass) - sum(m * n * abs(x - z) for x, m in mass for z, n in mass) / 2
        assert one(spark, vf.mixture_crps(F.lit(pi), F.array(*map(F.lit, q)), F.lit(y))) == pytest.approx(want)


def test_histogram_and_pooled_bins(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.19), (1, 1.0), (2, 0.5), (2, None)], "k int, p double")
    h = df.groupBy("k").agg(vf.histogram(F.col("p"), 5).alias("bins"))
    assert {r.k: list(r.bins) for r in h.collect()} == {1: [2, 0, 0, 0, 1], 2: [0, 0, 1, 0, 0]}
    assert list(h.agg(vf.pool_bins("bins", 5).alias("b")).first().b) == [2, 0, 1, 0, 1]


def test_curves(spark):
    score = lambda knots, x: round(one(spark, we.piecewise(F.lit(float(x)), knots)), 6)
    assert [score(we.FRICTION, x) for x in (-5, 4, 5, 10, 17.5, 40)] == [0.0, 0.83, 1.0, 1.0, 0.625, 0.25]
    assert [score(we.AIR, x) for x in (0, 4, 5, 8, 10, 20, 30)] == [0.0, 0.28, 0.4, 1.0, 1.0, 0.15, 0.0]
    assert [score(we.WIND, x) for x in (0, 5, 10, 15, 25, 60)] == [0.6, 1.0, 1.0, 0.5, 0.3, 0.1]
    smooth = lambda curve, x: round(one(spark, we.smooth_penalty(F.lit(float(x)), curve)), 6)
    assert [smooth(we.DEW, x) for x in (-1, 0, 1.5, 3, 9)] == [0.15, 0.15, 0.575, 1.0, 1.0]
    assert [smooth(we.SALT, x) for x in (80, 85, 92.5, 100)] == [1.0, 1.0, 0.675, 0.35]
    assert one(spark, we.blended(F.array(F.lit(1.0), F.lit(0.25)))) == pytest.approx((0.5 * 0.25) ** 0.5)
    assert [one(spark, we.tier(F.lit(x))) for x in (0.7, 0.69, 0.5, 0.3, 0.1)] == ["prime", "good", "good", "marginal", "poor"]


def test_feature_summary_and_changes(spark):
    df = spark.createDataFrame([(1, float(i), None) for i in range(101)] + [(2, None, None), (2, 4.0, None)], "k int, a double, b double")
    got = {(r.k, r.feature): r for r in au.feature_summary(df, ["k"], ["a", "b"]).collect()}
    a = got[1, "a"]
    assert (a.n, a.missing, a.mean, a.p01, a.p99) == (101, 0.0, 50.0, 1.0, 99.0) and (got[2, "a"].missing, got[2, "a"].p01, got[2, "a"].std) == (0.5, 4.0, None)
    assert (got[1, "b"].n, got[1, "b"].missing, got[1, "b"].p01) == (101, 1.0, None)
    new, old = (spark.createDataFrame(rows, "k int, n int, place string") for rows in ([(1, 10, "x"), (2, 10, "y"), (3, 1, "z")], [(1, 10, "x"), (2, 20, "q")]))
    assert sorted(map(tuple, au.changed(new, old, ["k"], {"rows": ("n", 0.3), "location": ("place", None)}).collect())) == [(2, "location", "q", "y"), (2, "rows", "20", "10")]


def test_coverage(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    actual = spark.createDataFrame([(1, at(5)), (2, at(1)), (2, None)], "k int, t timestamp_ntz")
    assert {r.k: r.state for r in au.coverage(expected, actual, ["k"], "t", F.lit(at(4))).collect()} == {1: "ok", 2: "stale", 3: "missing"}


def test_knots_are_lines(spark):
    knots = spark.createDataFrame([(0.2, 0.1), (0.4, 0.5), (0.40005, 0.6), (0.9, 0.6)], "x double, value double")
    ps = [0.0, 0.2, 0.3, 0.4, 0.400025, 0.40005, 0.5, 0.9, 1.0, None]
    got = {r.p: r.calibrated for r in ca.apply_knots(spark.createDataFrame([(p,) for p in ps], "p double"), knots, "p").collect()}
    want = [0.1, 0.1, 0.3, 0.5, 0.55, 0.6, 0.6, 0.6, 0.6, None]
    assert [got[p] for p in ps] == [w if w is None else pytest.approx(w) for w in want]
    flat = ca.apply_knots(spark.createDataFrame([(0.0,), (0.7,), (1.0,)], "p double"), spark.createDataFrame([(0.0, 0.3), (1.0, 0.3)], "x double, value double"), "p")
    assert {r.calibrated for r in flat.collect()} == {0.3}


def test_isotonic_fit_rises(spark):
    rows = [(i / 100, int(i > 30) if i % 7 else 1 - int(i > 30)) for i in range(101)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y int")
    points = sorted((r.x, r.value) for r in ca.isotonic_knots(df, "p", "y").collect())
    assert len(points) > 1 and [v for _, v in points] == sorted(v for _, v in points) and all(0 <= v <= 1 for _, v in points)
    out = ca.apply_knots(df, ca.isotonic_knots(df, "p", "y"), "p")
    brier = out.agg(vf.brier("p", "y"), vf.brier("calibrated", "y")).first()
    assert brier[1] < brier[0]


def test_exact_windows(spark):
    days = spark.createDataFrame([(1, [0.5, 0.5, 0.5]), (2, [0.99, 0.01, 0.01]), (3, [0.5, None, 0.5]), (4, [0.5])], "k int, p array<double>")
    got = {r.k: r for r in sp.exact_windows(days, ["k"], 3, (1, 2, 3), 2, 0.0).collect()}
    assert set(got) == {1, 2}
    assert [got[1][c] for c in ("p_1", "p_2", "p_3", "longest_mean", "start_0", "start_1")] == pytest.approx([7 / 8, 3 / 8, 1 / 8, 11 / 8, 2 / 8, 1 / 8])
    assert got[2].start_1 > 0.9 and got[2].p_2 == pytest.approx(got[2].start_0 + got[2].start_1)
    tied = sp.exact_windows(days.where("k = 1"), ["k"], 3, (3,), 2, 1.0).first()
    assert tied.p_3 == pytest.approx(0.5)  # hours that always agree


def test_comfort_index(spark):
    powers = we.exponents(4, 6)
    assert len(powers) == 210 == len(set(powers)) and powers[:9] == [(i, 0, 0, 0) for i in range(7)] + [(0, 1, 0, 0), (1, 1, 0, 0)] and powers[-1] == (0, 0, 0, 6)
    only = lambda n: [float(p == n) for p in powers]
    value = lambda n, *xs: one(spark, we.comfort_index(*[F.lit(x) for x in xs], only(n)))
    assert value((1, 1, 0, 0), 10.0, 2.0, 12.0, 1.0) == 10 + 10 * 2
    assert value((0, 0, 2, 1), 10.0, 2.0, 12.0, 3.0) == 10 + 4 * 3
    assert value((0, 1, 0, 0), 10.0, 0.1, 12.0, 1.0) == 10.5 and value((0, 1, 0, 0), 10.0, 99.0, 12.0, 1.0) == 27
    assert one(spark, we.comfort_index(F.lit(10.0), F.lit(None).cast("double"), F.lit(12.0), F.lit(1.0), only((0, 1, 0, 0)))) is None
    with pytest.raises(ValueError, match="210"):
        we.comfort_index(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), [1.0])
