"""Bands against all pairs; isotonic fits against pooling one by one; dry windows of long days against all outcomes."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from skerry.operators import calibrate as ca, joins as jn, spells as sp


@pytest.mark.parametrize("edges", [jn.EDGES, 3])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_range_join(spark, monkeypatch, edges, how):
    """With few edges in an expression, and with more than it may hold."""
    monkeypatch.setattr(jn, "EDGES", edges)
    rng = random.Random(4)
    points = [(i, rng.choice([rng.uniform(-20, 120), float(rng.randrange(0, 100, 10)), -1e9, 1e9])) for i in range(200)] + [(900, None)]
    bands = [(a, a + rng.choice([0, 5, 30]), f"b{n}") for n, a in enumerate(range(-10, 100, 10))] + [(None, 5, "x"), (3, None, "y")]
    out = jn.range_join(spark.createDataFrame(points, "i int, v double"), spark.createDataFrame(bands, "low int, high int, band string"), "v", "low", "high", how)
    want = [(i, b) for i, v in points for a, z, b in bands if None not in (v, a, z) and a <= v < z]
    if how == "left":
        want += [(i, None) for i, _ in points if i not in {j for j, _ in want}]
    assert sorted((r.i, r.band) for r in out.collect() if r.band) == sorted(w for w in want if w[1])
    assert {r.i for r in out.collect() if r.band is None} == {i for i, b in want if b is None}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "low int, high int, band string")
    assert jn.range_join(spark.createDataFrame(points, "i int, v double"), none, "v", "low", "high", how).count() == (len(points) if how == "left" else 0)


def pooled(rows):
    """Blocks (low, high, mean) of one p after another."""
    cells = {}
    for p, y in rows:
        if None not in (p, y):
            cells.setdefault(p, []).append(y)
    out = []
    for p in sorted(cells):
        out.append([p, p, sum(cells[p]), len(cells[p])])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            low, _, y, n = out.pop(-2)
            out[-1] = [low, out[-1][1], out[-1][2] + y, out[-1][3] + n]
    return [(a, b, y / n) for a, b, y, n in out]


@pytest.mark.parametrize("kind", ["noisy", "rising", "falling", "ties", "one"])
def test_isotonic_is_exact(spark, kind):
    rng = random.Random(kind)
    p = [rng.random() if kind != "ties" else rng.randrange(9) / 8 for _ in range(1 if kind == "one" else 700)]
    y = {"noisy": lambda x: int(rng.random() < x), "rising": lambda x: x, "falling": lambda x: 1 - x, "ties": lambda x: int(rng.random() < x), "one": lambda x: 1}[kind]
    rows = [(x, float(y(x))) for x in p] + [(None, 1.0), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, y double").repartition(6)
    want = pooled(rows)
    got = sorted((r.low, r.high, r.y / r.n) for r in ca.isotonic_blocks(df, "p", "y").collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    knots = sorted((r.x, r.value) for r in ca.isotonic_knots(df, "p", "y").collect())
    flat = lambda pairs: [x for pair in pairs for x in pair]
    assert flat(knots) == pytest.approx(flat([((a + b) / 2, v) for a, b, v in want] if len(want) > 1 else [(0.0, want[0][2]), (1.0, want[0][2])]))

    def line(x):
        before, behind = [k for k in knots if k[0] <= x], [k for k in knots if k[0] > x]
        if not before or not behind:
            return (before[-1] if before else behind[0])[1]
        (a, va), (b, vb) = before[-1], behind[0]
        return va + (vb - va) * (x - a) / (b - a)

    tried = [(-1.0,), (2.0,), (None,), *[(x / 50,) for x in range(51)]]
    out = ca.apply_knots(spark.createDataFrame(tried, "p double"), ca.isotonic_knots(df, "p", "y"), "p").collect()
    assert len(out) == len(tried) and all(r.calibrated is None if r.p is None else r.calibrated == pytest.approx(line(r.p)) for r in out)


def enumerated(q, rho):
    """{longest: chance}, and chances of where the first run of three begins, over all outcomes."""
    q = [min(0.99, max(0.01, x)) for x in q]
    longest, begins = {}, {}
    for wet in product((True, False), repeat=len(q)):
        p = q[0] if wet[0] else 1 - q[0]
        for h in range(1, len(q)):
            a, b = q[h], q[h - 1]
            s = rho * (a * (1 - a)) ** 0.5
            g = a + s * ((1 - b) / b) ** 0.5 if wet[h - 1] else a - s * (b / (1 - b)) ** 0.5
            g = min(1.0, max(0.0, g))
            p *= g if wet[h] else 1 - g
        text = "".join(".d"[not w] for w in wet)
        longest[max(map(len, text.split(".")))] = longest.get(max(map(len, text.split("."))), 0) + p
        begins[text.find("ddd")] = begins.get(text.find("ddd"), 0) + p
    return longest, begins


@pytest.mark.parametrize("hours,rho", [(6, 0.0), (6, 0.5), (9, 0.8)])
def test_windows_by_all_outcomes(spark, hours, rho):
    rng = random.Random(hours)
    days = [(k, [rng.random() for _ in range(hours)], rho) for k in range(3)] + [(9, [0.5] * (hours - 1), rho)]
    out = sp.exact_windows(spark.createDataFrame(days, "k int, p array<double>, rho double"), ["k"], hours, (1, 3, hours), 3, "rho", quantiles=(0.1, 0.5)).collect()
    assert {r.k for r in out} == {0, 1, 2}
    assert not [x for x in out if abs(x.p_1 + enumerated(days[x.k][1], rho)[0].get(0, 0) - 1) > 1e-9]
    for r in out:
        longest, begins = enumerated(days[r.k][1], rho)
        assert [r.p_1, r.p_3, r[f"p_{hours}"], r.longest_mean] == pytest.approx([sum(p for b, p in longest.items() if b >= w) for w in (1, 3, hours)] + [sum(b * p for b, p in longest.items())])
        assert [r[f"start_{h}"] for h in range(hours - 2)] == pytest.approx([begins.get(h, 0) for h in range(hours - 2)])
        for q in (0.1, 0.5):
            assert r[f"longest_q{round(100 * q)}"] == min(b for b in range(hours + 1) if sum(longest.get(k, 0) for k in range(b + 1)) >= q)


def test_neighbour_correlation(spark):
    rows = [("a", f"2024-01-0{d} {h:02d}:00:00", float((h // 3 + d) % 2)) for d in range(1, 9) for h in range(8, 17)] + [("b", "2024-01-01 08:00:00", 1.0), ("b", "2024-01-01 10:00:00", 0.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r.k: r.rho for r in sp.neighbour_correlation(df, ["k"], "t", "v", 1.0).collect()}
    assert set(got) == {"a"} and got["a"] == pytest.approx(0.25, abs=0.02)  # three turns in eight hours


def test_neighbour_correlation_of_hours_that_are_all_alike(spark):
    """No variance: as the SQL of run8_fitted_windows has it, the upper bound; without a value, 0."""
    rows = [("wet", h, 2.0) for h in range(8, 17)] + [("dry", h, 0.0) for h in range(8, 17)] + [("one pair", 8, 0.0), ("one pair", 9, 2.0), ("null", 8, 1.0), ("null", 9, None)]
    rows += [("now", 8, 0.0), ("now", 9, 2.0), ("now", 11, 2.0), ("now", 12, 2.0)]
    df = spark.createDataFrame(rows, "k string, h int, v double").select("k", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, h)").alias("t"), "v")
    got = {r.k: r.rho for r in sp.neighbour_correlation(df, ["k"], "t", "v", 1.0).collect()}
    assert got == {"wet": 0.95, "dry": 0.95, "one pair": 0.95, "null": 0.0, "now": 0.95}


def test_days_of_a_zone_with_summer_time(spark):
    """Clocks go forward on 31 March 2024 at 01:00 UTC: the range 0 to 4 has three hours that day, and 9 to 12 begins an hour earlier from then on."""
    import datetime as dt

    hours = [("a", dt.datetime(2024, 3, 29) + dt.timedelta(hours=h), float(h % 5 == 0)) for h in range(96)] + [(None, dt.datetime(2024, 3, 30, 9), None), (None, dt.datetime(2024, 3, 30, 10), 0.0)]
    df = spark.createDataFrame(hours, "k string, t timestamp_ntz, v double")
    read = lambda start, end: {(r.k, r.day.day): (r.state, r.dry_hours, r.longest) for r in sp.local_day_spells(df, ["k"], "t", "v", 0.5, "Europe/London", start, end).where("day < '2024-04-02'").collect()}
    night = read(0, 4)
    assert night["a", 30][0] == "whole" and night["a", 31] == ("other length", None, None) and night[None, 30] == ("hours missing", None, None)
    day = read(9, 12)
    for d, first in ((29, 9), (30, 9), (31, 8), (1, 8)):
        at = (dt.datetime(2024, 4 if d == 1 else 3, d, first) - dt.datetime(2024, 3, 29)) // dt.timedelta(hours=1)
        dry = "".join("d" if h % 5 else "." for h in range(at, at + 3))
        assert day["a", d] == ("whole", dry.count("d"), max(map(len, dry.split("."))))


def test_combined_forecasts_know_their_runs(spark):
    import datetime as dt

    from skerry.operators import verify as vf

    run = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(1, "a", 2.0, run(0)), (1, "b", 4.0, run(6)), (1, "c", None, run(23)), (2, "b", 1.0, run(3)), (3, "c", None, run(1))]
    wide = vf.with_origins(spark.createDataFrame(rows, "k int, m string, x double, run timestamp_ntz"), ["k"], "m", ("a", "b", "c"), "x", "run")
    got = vf.combined(wide, ["k"], {"any": (("a", "b", "c"), False), "both": (("a", "b"), True)}).collect()
    assert sorted((r.k, r.version, r.f, r.made.hour, r.parts) for r in got) == [(1, "any", 3.0, 6, 2), (1, "both", 3.0, 6, 2), (2, "any", 1.0, 3, 1)]
