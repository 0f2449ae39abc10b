"""Running values over parts against a plain walk over all rows; selection against sorting."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skerry.operators import scans as sc, select as se, windows as wn

START = dt.datetime(2024, 1, 1)
HOUR = 3600
#: From parts of five hours to one part.
WIDTHS = (5 * HOUR, 24 * HOUR, 10_000 * HOUR)


def hours(seed: int, n: int = 160) -> list[tuple]:
    """(k, t, v): hours with gaps, long runs of one state, nulls, and a null key."""
    rng, out = random.Random(seed), []
    for k in ("a", "b", None):
        h = rng.randrange(40)
        for _ in range(n):
            h += rng.choice([1] * 12 + [2, 3, 30])
            out.append((k, START + dt.timedelta(hours=h), rng.choice([0.0, 0.0, 0.0, 1.0, 2.0, None]) if rng.random() < 0.5 else (0.0 if (h // 17) % 2 else 5.0)))
    rng.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").repartition(3)


def series(rows):
    for k in ("a", "b", None):
        yield k, sorted(r[1:] for r in rows if r[0] == k)


def plain(df, *names):
    return sorted(((r[n] for n in names) and tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("width", WIDTHS)
def test_against_a_walk(spark, width):
    rows = hours(width)
    df = frame(spark, rows)
    one = dt.timedelta(hours=1)
    filled, streaks, dry, sums, since, seen = [], [], [], [], [], []
    for k, own in series(rows):
        last = start = before = previous = None
        streak, run, state = 0, 0, object()
        at = dict(own)
        for t, v in own:
            last = v if v is not None else last
            filled.append((k, t, last))
            now = None if v is None else v >= 1
            streak += now is not state and (now != state or state is None or now is None)
            state = now
            streaks.append((k, t, streak))
            ok = v is not None and v <= 1
            run = (run + 1 if before == t - one and run else 1) if ok else 0
            dry.append((k, t, run))
            back = [at.get(t - i * one) for i in range(4)]
            full = None not in back
            sums.append((k, t, sum(back) if full else None, sum(x >= 1 for x in back) if full else None))
            start = (start if previous else t) if now else None
            previous = now
            if now:
                since.append((k, t, start, next((u for u, x in own if u > t and x is not None and x < 1), None)))
            seen.append((k, t, before))
            before = t
    assert plain(sc.forward_fill(df, ["k"], "t", ["v"], width), "k", "t", "v") == sorted(filled, key=str)
    assert plain(sc.changes(df, ["k"], ["t"], F.col("v") >= 1, width), "k", "t", "streak") == sorted(streaks, key=str)
    assert plain(sc.dry_run(df, ["k"], "t", "v", 1.0, width), "k", "t", "dry_hours") == sorted(dry, key=str)
    assert plain(sc.trailing(df, ["k"], "t", "v", 4, 1.0, width), "k", "t", "sum_4", "wet_4") == sorted(sums, key=str)
    assert plain(sc.dry_by_and_wet_since(df, ["k"], "t", "v", 1.0, width), "k", "t", "wet_since", "dry_by") == sorted(since, key=str)
    assert plain(sc.gaps(df, ["k"], "t", width), "k", "t", "last_seen") == sorted(seen, key=str)


@pytest.mark.parametrize("width", WIDTHS)
def test_islands(spark, width):
    rows, want = hours(width + 1), []
    for k, own in series(rows):
        run = []
        for t, v in [*own, (START + dt.timedelta(days=999), 9.0)]:
            ok = v is not None and v < 1
            if run and (not ok or t - run[-1] > dt.timedelta(hours=1)):
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run += [t] * ok
    df = frame(spark, rows)
    for short in (False, True):
        got = sc.islands(df.withColumn("dry", F.col("v") < 1), ["k"], "t", "dry", HOUR, width, short)
        assert plain(got, "k", "start", "end", "n") == sorted(want, key=str)


@pytest.mark.parametrize("width", WIDTHS)
def test_lines(spark, width):
    rows, want = hours(width + 2, 60), []
    for k, own in series(rows):
        for i, (t, v) in enumerate(own):
            u, x = own[i + 1] if i + 1 < len(own) else (t + dt.timedelta(hours=1), None)
            n = (u - t) // dt.timedelta(hours=1)
            want += [(k, t + dt.timedelta(hours=j), v if v is None or x is None else round(v + (x - v) * j / n, 9)) for j in range(n)]
    got = sc.hourly_line(frame(spark, rows), ["k"], "t", "v", width=width).withColumn("v", F.round("v", 9))
    assert plain(got, "k", "hour", "v") == sorted(want, key=str)


def test_one_long_series_is_not_one_task(spark):
    """Three years of one station: no task of any job sees more than its share."""
    df = spark.range(26_000).select(F.lit("a").alias("k"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("t"), (F.col("id") % 7).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for out in (
            sc.forward_fill(df, ["k"], "t", ["v"]), sc.changes(df, ["k"], ["t"], F.col("v") >= 3), sc.dry_run(df, ["k"], "t", "v", 1.0),
            sc.trailing(df, ["k"], "t", "v", 24, 1.0), sc.dry_by_and_wet_since(df, ["k"], "t", "v", 0.0), sc.gaps(df, ["k"], "t"),
        ):
            sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 26_000 and max(sizes) < 26_000 / 3, sizes
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty(spark):
    df = frame(spark, hours(1)).limit(0)
    for out in (sc.forward_fill(df, ["k"], "t", ["v"]), sc.changes(df, ["k"], ["t"], F.col("v") >= 1), sc.dry_run(df, ["k"], "t", "v", 1.0), sc.trailing(df, ["k"], "t", "v", 4, 1.0), sc.hourly_line(df, ["k"], "t", "v")):
        assert out.count() == 0


def values(seed):
    rng = random.Random(seed)
    spread = lambda: rng.choice([0.0, 0.0, rng.random(), rng.random() * 1e-9, 10.0 ** rng.randrange(-20, 20), -5.0])
    return [(k, spread(), rng.randrange(4), START + dt.timedelta(microseconds=rng.randrange(50))) for k in ["a"] * 700 + ["b"] * 90 + [None] * 40 + ["c"] for _ in (0,)]


@pytest.mark.parametrize("few,buckets", [(10_000, 4096), (5, 64)])
def test_selection(spark, few, buckets):
    rows = values(few)
    df = spark.createDataFrame(rows, "k string, v double, i int, t timestamp_ntz").repartition(4)
    ranks = lambda n: [F.lit(0), F.floor(n / 3), n - 1, F.when(n > 100, F.lit(50)), n]
    found = se.boundaries(df, ["k"], ["v", "i", "t"], ranks, few, buckets)
    got = {(r.key.k0, r.i): (r.n, *r["at"]) for r in found.collect()}
    want = {}
    for k in ("a", "b", "c", None):
        own = sorted((v, float(i), float((t - START) // dt.timedelta(microseconds=1) + 1704067200_000_000)) for kk, v, i, t in rows if kk == k)
        for j, r in enumerate([0, len(own) // 3, len(own) - 1, 50 if len(own) > 100 else None]):
            if r is not None:
                want[k, j] = (len(own), *own[r])
    assert got == want


def test_selection_writes_no_rows(spark, tmp_path):
    """What is written is a row for each key and rank."""
    df = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 50_000).alias("v"))
    got = se.ranked_values(df, ["k"], "v", lambda n: [F.floor(n / 2), F.floor(n * 0.99)], ["mid", "top"]).first()
    assert (got.n, got.mid, got.top) == (50_000, 25_000.0, 49_500.0)


def test_quintiles_and_splits(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([0.0, 1.0]), i) for i in range(101)] + [("b", float(i), i) for i in range(4)] + [(None, 1.0, 0), ("c", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    got = {(r.k, r.v, r.i): r.quintile for r in wn.quintile(df, ["k"], ["v", "i"]).collect()}
    for k in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == k and r[1] is not None)
        assert [got[r] for r in own] == [min(4, j * 5 // len(own)) for j in range(len(own))]
    assert got["c", None, 1] == 0 and len(got) == len(rows)
    equal = spark.createDataFrame([("a", 1.0)] * 23 + [("a", 0.0)] * 2, "k string, v double")
    assert sorted(r.quintile for r in wn.quintile(equal, ["k"], ["v"]).collect()) == sorted(min(4, j * 5 // 25) for j in range(25))
    times = spark.createDataFrame([("a", START + dt.timedelta(hours=h // 3)) for h in range(30)], "k string, t timestamp_ntz")
    parts = wn.split_checked(times, ["k"], "t")
    assert {(r.t.hour, r.part, r.ok) for r in parts.collect()} == {(h, "train" if h < 7 else "validation" if h == 7 else "test", True) for h in range(10)}
