"""Queries that build feature tables, find spells, derive tables and audit them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import weather as we
from ..operators import aggregates as ag, audit as au, dedup as dd, joins as jn, scans as sc, spells as sp, verify as vf, windows as wn
from .basics import CELL, PIVOT_SQL, rounded, wide
from .registry import query
from .scoring import TS1_SQL, training_table
from .views import MODELS, WET, fcst, hourly, pred, read, truth

ANGLES_SQL = "round(sin(2 * pi() * hour(valid) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(valid) / 24), 6) AS hour_cos, round(sin(2 * pi() * (dayofyear(valid) - 1) / 365), 6) AS doy_sin, round(cos(2 * pi() * (dayofyear(valid) - 1) / 365), 6) AS doy_cos"


@query("ts1_training_table", TS1_SQL + f" SELECT station, valid, lead, {', '.join(MODELS)}, round(y, 9) AS y, round(f_mean, 9) AS f_mean, round(f_std, 6) AS f_std, round(f_range, 6) AS f_range, {ANGLES_SQL} FROM table_")
def ts1(spark: SparkSession, d: str) -> DataFrame:
    t = training_table(spark, d).drop("f_max")
    return rounded(t.withColumns({c: F.round(c, 9) for c in ("y", "f_mean")}), "f_std", "f_range", "hour_sin", "hour_cos", "doy_sin", "doy_cos")


@query("ts2_rich_table", "SELECT station, valid, lead, " + ", ".join(f"max(x) FILTER (model = '{m}') AS {m}_x, max(run) FILTER (model = '{m}') AS {m}_run" for m in MODELS) + ", round(avg(x), 9) AS x_mean, round(avg(event_id % 100), 9) AS k_mean FROM latest GROUP BY ALL")
def ts2(spark: SparkSession, d: str) -> DataFrame:
    """Several variables for each model, and their means: one generated list of pivots."""
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    pivots = [F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}") for m in MODELS for v in ("x", "run")]
    return cells.groupBy("station", "valid", "lead").agg(*pivots, F.round(F.avg("x"), 9).alias("x_mean"), F.round(F.avg(F.col("event_id") % 100), 9).alias("k_mean"))


@query("ts3_wet_table", f", w AS (SELECT station, valid, lead, {PIVOT_SQL}, avg(CAST(x >= 45 AS INT)) AS wet_share FROM latest GROUP BY ALL) SELECT w.* REPLACE (round(wet_share, 6) AS wet_share), CAST(y >= 45 AS INT) AS wet FROM w JOIN truth USING (station, valid)")
def ts3(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    share = cells.groupBy("station", "valid", "lead").agg(*[F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in MODELS], F.round(F.avg((F.col("x") >= WET).cast("int")), 6).alias("wet_share"))
    return share.join(truth(spark, d), ["station", "valid"]).withColumn("wet", (F.col("y") >= WET).cast("int")).drop("y")


TRAIL_SQL = "hs AS (SELECT station, hour, v, date_diff('hour', TIMESTAMP '1970-01-01', hour) AS k FROM hourly)"


@query("ts6_trailing", f""", {TRAIL_SQL}, t AS (SELECT station, hour, v, k, count(v) OVER w AS c, sum(v) OVER w AS s, count(*) FILTER (v >= 45) OVER w AS wet FROM hs WINDOW w AS (PARTITION BY station ORDER BY k RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)),
st AS (SELECT *, CASE WHEN v > 45 THEN k WHEN lag(k) OVER (PARTITION BY station ORDER BY k) IS NULL OR lag(k) OVER (PARTITION BY station ORDER BY k) < k - 1 THEN k - 1 END AS stop FROM t)
SELECT station, hour, CASE WHEN c = 24 THEN round(s, 6) END AS sum_24, CASE WHEN c = 24 THEN wet END AS wet_24, k - last_value(stop IGNORE NULLS) OVER (PARTITION BY station ORDER BY k ROWS UNBOUNDED PRECEDING) AS dry_hours FROM st""")
def ts6(spark: SparkSession, d: str) -> DataFrame:
    h = wn.trailing(hourly(spark, d).drop("n"), ["station"], "hour", "v", 24, WET)
    return rounded(wn.dry_run(h, ["station"], "hour", "v", WET).select("station", "hour", "sum_24", "wet_24", "dry_hours"), "sum_24")


@query("ts7_lead_slope", "SELECT station, valid, model, round(regr_slope(x, lead), 9) AS slope FROM latest WHERE lead > 24 GROUP BY ALL HAVING count(*) >= 2")
def ts7(spark: SparkSession, d: str) -> DataFrame:
    """Slope over leads longer than the target's: what was known before the target's run."""
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).where("lead > 24")
    return cells.groupBy("station", "valid", "model").agg(F.regr_slope("x", "lead").alias("slope"), F.count("*").alias("k")).where("k >= 2").select("station", "valid", "model", F.round("slope", 9).alias("slope"))


@query("ts8_exact_tiers", "SELECT a.station, a.valid, max(a.x) FILTER (a.lead = 24) AS x24, max(a.x) FILTER (a.lead = 48) AS x48, max(b.x) AS optional FROM (SELECT * FROM latest WHERE model = 'click' AND hour(valid) IN (0, 12)) a LEFT JOIN (SELECT station, valid, max(x) AS x FROM latest WHERE model = 'view' AND lead = 24 GROUP BY ALL) b USING (station, valid) GROUP BY ALL")
def ts8(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    core = cells.where((F.col("model") == "click") & F.hour("valid").isin(0, 12)).groupBy("station", "valid").agg(*[F.max(F.when(F.col("lead") == h, F.col("x"))).alias(f"x{h}") for h in (24, 48)])
    optional = cells.where("model = 'view' AND lead = 24").groupBy("station", "valid").agg(F.max("x").alias("optional"))
    return core.join(optional, ["station", "valid"], "left")


@query("ts15_chronological_split", """SELECT station, part, count(*) AS n, min(valid) AS first_valid, max(valid) AS last_valid FROM (SELECT *, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.85::DOUBLE * n) THEN 'validation' ELSE 'test' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY valid) AS k, count(*) OVER (PARTITION BY station) AS n FROM truth)) GROUP BY ALL""")
def ts15(spark: SparkSession, d: str) -> DataFrame:
    return split_by_time(truth(spark, d), ["station"], "valid").groupBy("station", "part").agg(F.count("*").alias("n"), F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"))


def split_by_time(df: DataFrame, keys: list[str], time: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """df with part: train, validation or test, in order of time within each key."""
    return wn.split_by_rank(df, keys, time, lambda n: [F.floor(n * F.lit(train)), F.floor(n * F.lit(train + validation))])


@query("ts16_cutoff_split", "SELECT CASE WHEN valid >= TIMESTAMP '2024-01-23' THEN 'test' WHEN valid >= TIMESTAMP '2024-01-08' THEN 'recent' ELSE 'old' END AS part, count(*) AS n FROM latest GROUP BY 1")
def ts16(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return cells.groupBy(F.when(F.col("valid") >= at("2024-01-23 00:00:00"), "test").when(F.col("valid") >= at("2024-01-08 00:00:00"), "recent").otherwise("old").alias("part")).agg(F.count("*").alias("n"))


@query("ts17_deaccumulate", """, c AS (SELECT station, model, valid, lead, sum(x) OVER (PARTITION BY station, model, valid ORDER BY lead ROWS UNBOUNDED PRECEDING) AS total FROM latest)
SELECT station, model, valid, lead, round(greatest(0, total - coalesce(lag(total) OVER (PARTITION BY station, model, valid ORDER BY lead), 0)), 6) AS step FROM c""")
def ts17(spark: SparkSession, d: str) -> DataFrame:
    keys = Window.partitionBy("station", "model", "valid").orderBy("lead")
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).withColumn("total", F.sum("x").over(keys.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.greatest(F.lit(0.0), F.col("total") - F.coalesce(F.lag("total").over(keys), F.lit(0.0)))
    return rounded(cells.select("station", "model", "valid", "lead", step.alias("step")), "step")


@query("ts18_hourly_line", """, s AS (SELECT station, valid, y, lead(valid) OVER w AS nv, lead(y) OVER w AS ny FROM truth WINDOW w AS (PARTITION BY station ORDER BY valid)),
e AS (SELECT *, unnest(range(coalesce(date_diff('hour', valid, nv), 1))) AS k FROM s)
SELECT station, valid + to_hours(k) AS hour, round(CASE WHEN ny IS NULL THEN y ELSE y + (ny - y) * k / date_diff('hour', valid, nv) END, 9) AS y FROM e""")
def ts18(spark: SparkSession, d: str) -> DataFrame:
    return wn.hourly_line(truth(spark, d), ["station"], "valid", "y").withColumn("y", F.round("y", 9))


@query("ts19_forward_fill", "SELECT station, hour, round(last_value(CASE WHEN n >= 4 THEN v END IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS v FROM hourly")
def ts19(spark: SparkSession, d: str) -> DataFrame:
    sparse = hourly(spark, d).select("station", "hour", F.when(F.col("n") >= 4, F.col("v")).alias("v"))
    return rounded(wn.forward_fill(sparse, ["station"], "hour", ["v"]), "v")


@query("ts20_targets", "SELECT lead, time_bucket(INTERVAL 1 DAY, m) + to_hours(lead + h) AS valid FROM (SELECT max(ts) AS m FROM events), (SELECT DISTINCT lead FROM fcst), range(24) r(h)")
def ts20(spark: SparkSession, d: str) -> DataFrame:
    anchor = read(spark, d, "events").agg(F.max("ts").alias("m")).select(F.to_date("m").cast("timestamp_ntz").alias("day"))
    leads = fcst(spark, d).select("lead").distinct()
    return leads.join(F.broadcast(anchor)).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("lead", (F.col("day") + F.make_dt_interval(F.lit(0), F.col("lead") + F.col("h"))).alias("valid"))


@query("ts21_upper_air_age", """, o AS (SELECT event_id, ts, user_id % 5 AS station, event_type FROM events), u AS (SELECT * FROM o WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY station, ts ORDER BY event_id DESC) = 1)
SELECT l.event_id, r.event_id AS used, date_diff('minute', r.ts, l.ts) AS age FROM (SELECT * FROM o WHERE event_type <> 'view') l ASOF LEFT JOIN u r ON l.station = r.station AND l.ts >= r.ts""")
def ts21(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "events").selectExpr("event_id", "ts", "CAST(user_id % 5 AS INT) AS station", "event_type")
    right = dd.latest(o.where("event_type = 'view'"), ["station", "ts"], ["event_id"]).withColumn("used", F.col("event_id"))
    out = jn.asof_join(o.where("event_type <> 'view'"), right, ["station"], "ts", "ts", ["used"], lambda t: F.to_date(t))
    minute = lambda c: F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.date_trunc("MINUTE", F.col(c)).cast("timestamp_ntz"))
    return out.select("event_id", "used", (minute("ts") - minute("asof")).alias("age"))


@query("ts22_masked_source", f"SELECT station, valid, lead, CASE WHEN hour(valid) IN (0, 12) THEN click END AS click, error FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL)")
def ts22(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).select("station", "valid", "lead", F.when(F.hour("valid").isin(0, 12), F.col("click")).alias("click"), "error")


DAY_SQL = """, i AS (SELECT station, CAST(hour AS DATE) AS day, hour(hour) AS h, v < 45 AS dry, v FROM hourly WHERE hour(hour) BETWEEN 9 AND 14),
whole AS (SELECT station, day, count(*) FILTER (dry) AS dry_hours FROM i GROUP BY ALL HAVING count(DISTINCT h) = 6),
runs AS (SELECT station, day, count(*) AS n FROM (SELECT station, day, h - row_number() OVER (PARTITION BY station, day ORDER BY h) AS g FROM i WHERE dry) GROUP BY station, day, g),
sp AS (SELECT w.station, w.day, dry_hours, coalesce(max(n), 0) AS longest FROM whole w LEFT JOIN runs USING (station, day) GROUP BY ALL)"""


def spells(spark: SparkSession, d: str) -> DataFrame:
    return sp.daily_spells(hourly(spark, d), ["station"], "hour", "v", WET, 9, 6)


@query("run1_dry_windows", DAY_SQL + " SELECT station, day, dry_hours, longest, w AS \"window\", CAST(longest >= w AS INT) AS has FROM sp, (VALUES (2), (3), (4)) t(w)")
def run1(spark: SparkSession, d: str) -> DataFrame:
    return sp.windows_of(spells(spark, d), (2, 3, 4))


@query("run2_day_features", """, m AS (SELECT station, model, CAST(valid AS DATE) AS day, sum(x) AS total, max(x) AS top, count(*) FILTER (x >= 45) AS wet FROM latest WHERE lead = 24 GROUP BY ALL)
SELECT station, day, round(avg(total), 6) AS mean, round(sqrt(greatest(0, avg(total * total) - avg(total) ** 2)), 6) AS std, max(top) AS top, round(avg(CAST(wet > 0 AS INT)), 6) AS agreement FROM m GROUP BY ALL""")
def run2(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).where("lead = 24").withColumn("day", F.to_date("valid"))
    m = cells.groupBy("station", "model", "day").agg(F.sum("x").alias("total"), F.max("x").alias("top"), F.count_if(F.col("x") >= WET).alias("wet"))
    mean, std, *_ = ag.spread("total")
    return rounded(m.groupBy("station", "day").agg(mean, std, F.max("top").alias("top"), F.avg((F.col("wet") > 0).cast("int")).alias("agreement")), "mean", "std", "agreement")


@query("run3_valid_starts", DAY_SQL + " SELECT station, day, CAST(a.h AS INT) AS start_hour FROM i a WHERE (SELECT count(*) FROM i b WHERE b.station = a.station AND b.day = a.day AND b.dry AND b.h BETWEEN a.h AND a.h + 2) = 3")
def run3(spark: SparkSession, d: str) -> DataFrame:
    return sp.valid_starts(hourly(spark, d), ["station"], "hour", "v", WET, 9, 15, 3)


@query("run4_wet_bands", """SELECT station, min(hour) AS start, max(hour) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM (SELECT station, hour, date_diff('hour', TIMESTAMP '1970-01-01', hour) - row_number() OVER (PARTITION BY station ORDER BY hour) AS g FROM hourly WHERE v >= 45) GROUP BY station, g""")
def run4(spark: SparkSession, d: str) -> DataFrame:
    return sp.wet_bands(hourly(spark, d), ["station"], "hour", "v", WET)


@query("run5_dry_by", """, m AS (SELECT *, v >= 45 AS wet, coalesce(lag(v >= 45) OVER (PARTITION BY station ORDER BY hour), false) AS before FROM hourly)
SELECT station, hour, since AS wet_since, dry_by FROM (SELECT *, last_value(CASE WHEN wet AND NOT before THEN hour END IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS UNBOUNDED PRECEDING) AS since,
first_value(CASE WHEN NOT wet THEN hour END IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dry_by FROM m) WHERE wet""")
def run5(spark: SparkSession, d: str) -> DataFrame:
    return sp.dry_by_and_wet_since(hourly(spark, d), ["station"], "hour", "v", WET).select("station", "hour", "wet_since", "dry_by")


@query("run6_missing_streaks", """, g AS (SELECT station, hour, lag(hour) OVER (PARTITION BY station ORDER BY hour) AS before FROM hourly)
SELECT station, before AS last_seen, hour AS next_seen, date_diff('hour', before, hour) - 1 AS missing FROM g WHERE date_diff('hour', before, hour) > 1 ORDER BY missing DESC, station, next_seen LIMIT 10""")
def run6(spark: SparkSession, d: str) -> DataFrame:
    g = sc.gaps(hourly(spark, d), ["station"], "hour").withColumn("missing", F.timestamp_diff("HOUR", F.col("last_seen"), F.col("hour")) - 1)
    return g.where("missing > 0").select("station", "last_seen", F.col("hour").alias("next_seen"), "missing").orderBy(F.desc("missing"), "station", "next_seen").limit(10)


@query("run7_label_agreement", DAY_SQL + """, l AS (SELECT station, day, w, longest >= w AS has FROM sp, (VALUES (2), (3), (4)) t(w))
SELECT a.station AS a, b.station AS b, a.w AS "window", count(*) AS n, count(*) FILTER (a.has = b.has) AS agree, count(*) FILTER (a.has AND NOT b.has) AS only_first FROM l a JOIN l b USING (day, w) WHERE a.station < b.station GROUP BY ALL""")
def run7(spark: SparkSession, d: str) -> DataFrame:
    lab = sp.windows_of(spells(spark, d), (2, 3, 4))
    one, two = (lab.select(F.col("station").alias(n), "day", "window", F.col("has").alias(f"has_{n}")) for n in "ab")
    both = one.join(two, ["day", "window"]).where("a < b")
    return both.groupBy("a", "b", "window").agg(F.count("*").alias("n"), F.count_if(F.col("has_a") == F.col("has_b")).alias("agree"), F.count_if((F.col("has_a") == 1) & (F.col("has_b") == 0)).alias("only_first"))


@query("run9_start_curve", DAY_SQL + """, s AS (SELECT station, day, h, v / (v + 50) AS p FROM i JOIN whole USING (station, day)) SELECT station, day, CAST(h AS INT) AS h, round((1 - p) * 0.8 / nullif(sum(1 - p) OVER (PARTITION BY station, day), 0), 6) AS share FROM s""")
def run9(spark: SparkSession, d: str) -> DataFrame:
    i = hourly(spark, d).where(F.hour("hour").between(9, 14)).select("station", F.to_date("hour").alias("day"), F.hour("hour").alias("h"), (1 - F.col("v") / (F.col("v") + 50)).alias("weight"), F.lit(0.8).alias("total"))
    whole = i.join(spells(spark, d), ["station", "day"], "left_semi")
    return rounded(sp.start_curve(whole, ["station", "day"], "weight", "total").select("station", "day", "h", "share"), "share")


@query("ev14_window_verification", DAY_SQL + """, l AS (SELECT station, day, w, CAST(longest >= w AS INT) AS has FROM sp, (VALUES (2), (3), (4)) t(w)), f AS (SELECT station, day, 1 - avg(v / (v + 50)) AS p FROM i GROUP BY ALL)
SELECT station, w AS "window", count(*) AS n, round(avg((p - has) ** 2), 6) AS brier, round(avg(has), 6) AS base_rate FROM l JOIN f USING (station, day) GROUP BY ALL""")
def ev14(spark: SparkSession, d: str) -> DataFrame:
    i = hourly(spark, d).where(F.hour("hour").between(9, 14)).groupBy("station", F.to_date("hour").alias("day")).agg((1 - F.avg(F.col("v") / (F.col("v") + 50))).alias("p"))
    j = sp.windows_of(spells(spark, d), (2, 3, 4)).join(i, ["station", "day"])
    return rounded(j.groupBy("station", "window").agg(F.count("*").alias("n"), vf.brier("p", "has").alias("brier"), F.avg("has").alias("base_rate")), "brier", "base_rate")


@query("ev15_start_hour_scores", DAY_SQL + """, c AS (SELECT station, day, h, (1 - v / (v + 50)) / sum(1 - v / (v + 50)) OVER (PARTITION BY station, day) AS q FROM i JOIN whole USING (station, day) WHERE h <= 12),
t AS (SELECT station, day, h FROM i a WHERE h <= 12 AND (SELECT count(*) FROM i b WHERE b.station = a.station AND b.day = a.day AND b.dry AND b.h BETWEEN a.h AND a.h + 2) = 3),
k AS (SELECT station, day, count(*) AS starts FROM t GROUP BY ALL), j AS (SELECT c.station, c.day, c.h, c.q, CASE WHEN t.h IS NULL THEN 0 ELSE 1.0::DOUBLE / k.starts END AS y FROM c JOIN k USING (station, day) LEFT JOIN t ON t.station = c.station AND t.day = c.day AND t.h = c.h WHERE k.starts < 4)
SELECT station, count(*) AS days, round(avg(b), 6) AS brier, round(avg(CAST(hit AS INT)), 6) AS top1 FROM (SELECT station, day, sum((q - y) ** 2) AS b, arg_max(y, q * 1000 - h / 1000.0) > 0 AS hit FROM j GROUP BY ALL) GROUP BY 1""")
def ev15(spark: SparkSession, d: str) -> DataFrame:
    """Start-hour curves against the starts that came true, on informative days: some start, and not all."""
    h = hourly(spark, d)
    curve = h.where(F.hour("hour").between(9, 12)).select("station", F.to_date("hour").alias("day"), F.hour("hour").alias("h"), (1 - F.col("v") / (F.col("v") + 50)).alias("w")).join(spells(spark, d), ["station", "day"], "left_semi")
    curve = curve.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("station", "day")))
    starts = sp.valid_starts(h, ["station"], "hour", "v", WET, 9, 15, 3).where("start_hour <= 12").withColumnRenamed("start_hour", "h")
    n = starts.groupBy("station", "day").agg(F.count("*").alias("starts")).where("starts < 4")
    j = curve.join(n, ["station", "day"]).join(starts.withColumn("one", F.lit(1)), ["station", "day", "h"], "left").withColumn("y", F.when(F.col("one") == 1, 1 / F.col("starts")).otherwise(0.0))
    days = j.groupBy("station", "day").agg(F.sum(F.pow(F.col("q") - F.col("y"), F.lit(2.0))).alias("b"), F.max_by("y", F.struct("q", -F.col("h"))).alias("top"))
    return rounded(days.groupBy("station").agg(F.count("*").alias("days"), F.avg("b").alias("brier"), F.avg((F.col("top") > 0).cast("int")).alias("top1")), "brier", "top1")


@query("ev22_observed_windows", DAY_SQL + ", k AS (SELECT DISTINCT station, CAST(valid AS DATE) AS day FROM pred) SELECT k.station, k.day, sp.longest >= 3 AS has FROM k LEFT JOIN sp USING (station, day)")
def ev22(spark: SparkSession, d: str) -> DataFrame:
    keys = pred(spark, d).select("station", F.to_date("valid").alias("day")).distinct()
    return keys.join(spells(spark, d), ["station", "day"], "left").select("station", "day", (F.col("longest") >= 3).alias("has"))


@query("drv1_feels_like", f", w AS (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) SELECT station, valid, lead, round(t + 0.33::DOUBLE * e - 0.7::DOUBLE * least(20, error / 10) - 4, 4) AS feels FROM (SELECT *, click / 10 AS t, 6.112::DOUBLE * exp(17.67::DOUBLE * (click / 10) / (click / 10 + 243.5)) * least(100, view) / 100 AS e FROM w WHERE click + error + view IS NOT NULL)")
def drv1(spark: SparkSession, d: str) -> DataFrame:
    """Newest value of each input, side by side, clamped and combined."""
    w = wide(spark, d).where("click + error + view IS NOT NULL")
    t = F.col("click") / 10
    vapour = we.magnus_hpa(t) * F.least(F.lit(100.0), F.col("view")) / 100
    return w.select("station", "valid", "lead", F.round(we.apparent(t, vapour, F.least(F.lit(20.0), F.col("error") / 10)), 4).alias("feels"))


@query("drv2_conditions", f", w AS (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL), s AS (SELECT station, valid, lead, least(1, click / 50) AS a, least(1, error / 50) AS b, least(1, view / 50) AS c FROM w WHERE click + error + view IS NOT NULL) SELECT station, valid, lead, round(sqrt(pow(a * b * c, 1 / 3.0::DOUBLE) * least(a, b, c)), 6) AS score, CASE WHEN a <= b AND a <= c THEN 'click' WHEN b <= c THEN 'error' ELSE 'view' END AS limiting FROM s")
def drv2(spark: SparkSession, d: str) -> DataFrame:
    """Root of the geometric mean times the worst factor, and which factor is worst."""
    names = ("click", "error", "view")
    w = wide(spark, d).where("click + error + view IS NOT NULL")
    factors = F.array(*[F.struct(we.piecewise(F.col(m), ((0, 0), (50, 1))).alias("score"), F.lit(i).alias("i"), F.lit(m).alias("name")) for i, m in enumerate(names)])
    w = w.withColumn("f", factors).withColumn("worst", F.array_min("f"))
    product = F.aggregate("f", F.lit(1.0), lambda a, x: a * x["score"])
    return w.select("station", "valid", "lead", F.round(F.sqrt(F.pow(product, F.lit(1 / 3)) * F.col("worst.score")), 6).alias("score"), F.col("worst.name").alias("limiting"))


@query("drv3_badges", "SELECT station, valid, CASE WHEN firing >= 4 THEN 'severe' WHEN firing >= 2 THEN 'watch' ELSE 'none' END AS badge FROM (SELECT station, valid, count(DISTINCT model) FILTER (x >= 60) AS firing FROM latest GROUP BY ALL)")
def drv3(spark: SparkSession, d: str) -> DataFrame:
    n = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).groupBy("station", "valid").agg(F.countDistinct(F.when(F.col("x") >= 60, F.col("model"))).alias("firing"))
    return n.select("station", "valid", F.when(F.col("firing") >= 4, "severe").when(F.col("firing") >= 2, "watch").otherwise("none").alias("badge"))


@query("drv4_daily_summary", "SELECT station, CAST(hour AS DATE) AS day, round(avg(v), 9) AS mean, CAST(arg_min(hour(hour), v * 1000000 + hour(hour)) AS INT) AS driest, count(*) FILTER (v >= 45) AS wet FROM hourly GROUP BY ALL")
def drv4(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumns({"day": F.to_date("hour"), "h": F.hour("hour")})
    return h.groupBy("station", "day").agg(F.round(F.avg("v"), 9).alias("mean"), F.min_by("h", F.struct("v", "h")).alias("driest"), F.count_if(F.col("v") >= WET).alias("wet"))


@query("drv5_rain_days", "SELECT station, CAST(hour - INTERVAL 9 HOURS AS DATE) AS day, round(sum(v), 6) AS total, count(*) AS n FROM hourly GROUP BY ALL HAVING count(*) >= 22")
def drv5(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).withColumn("day", F.to_date(F.col("hour") - F.expr("INTERVAL 9 HOURS")))
    return rounded(h.groupBy("station", "day").agg(F.sum("v").alias("total"), F.count("*").alias("n")).where("n >= 22"), "total")


@query("drv6_day_card", "SELECT station, CAST(hour AS DATE) AS day, round(min(v), 6) AS low, round(max(v), 6) AS top, round(avg(v), 9) AS mean FROM hourly GROUP BY ALL")
def drv6(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly(spark, d).groupBy("station", F.to_date("hour").alias("day")).agg(F.min("v").alias("low"), F.max("v").alias("top"), F.round(F.avg("v"), 9).alias("mean")), "low", "top")


@query("drv7_start_table", DAY_SQL + ", s AS (SELECT station, day, a.h FROM i a WHERE (SELECT count(*) FROM i b WHERE b.station = a.station AND b.day = a.day AND b.dry AND b.h BETWEEN a.h AND a.h + 2) = 3) SELECT station, day, string_agg(CAST(h AS VARCHAR), ',' ORDER BY h) AS starts FROM s GROUP BY ALL")
def drv7(spark: SparkSession, d: str) -> DataFrame:
    starts = sp.valid_starts(hourly(spark, d), ["station"], "hour", "v", WET, 9, 15, 3)
    return starts.groupBy("station", "day").agg(F.array_join(F.array_sort(F.collect_list("start_hour")), ",").alias("starts"))


@query("dq1_feature_summary", f", w AS (SELECT lead, {PIVOT_SQL} FROM latest GROUP BY station, valid, lead), u AS (" + " UNION ALL ".join(f"SELECT lead, '{m}' AS feature, {m} AS value FROM w" for m in MODELS) + ") SELECT lead, feature, count(*) AS n, round(avg(CAST(value IS NULL AS INT)), 6) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99 FROM u GROUP BY ALL")
def dq1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(au.feature_summary(wide(spark, d), ["lead"], MODELS), "missing", "mean", "std", "p01", "p99")


@query("dq2_retrain_guard", """, s AS (SELECT station, valid >= TIMESTAMP '2024-01-20' AS new, count(*) AS n, CASE WHEN station = 1 AND valid >= TIMESTAMP '2024-01-20' THEN 6 ELSE 5 END AS n_features, avg(CAST(x < 10 AS INT)) AS missing, avg(CAST(x >= 45 AS INT)) AS label_rate FROM latest GROUP BY ALL),
j AS (SELECT c.station, c.n AS cn, p.n AS pn, c.n_features AS cf, p.n_features AS pf, c.missing AS cm, p.missing AS pm, c.label_rate AS cl, p.label_rate AS pl FROM s c JOIN s p USING (station) WHERE c.new AND NOT p.new)
SELECT station, 'rows' AS "check", pn::DOUBLE AS old, cn::DOUBLE AS new FROM j WHERE abs(cn / pn - 1) > 0.3 UNION ALL SELECT station, 'features', pf, cf FROM j WHERE cf <> pf
UNION ALL SELECT station, 'missing', round(pm, 6), round(cm, 6) FROM j WHERE abs(cm - pm) > 0.2 UNION ALL SELECT station, 'label_rate', round(pl, 6), round(cl, 6) FROM j WHERE abs(cl - pl) > 0.1""")
def dq2(spark: SparkSession, d: str) -> DataFrame:
    new = F.col("valid") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    s = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).withColumns({"new": new, "n_features": F.when((F.col("station") == 1) & new, 6).otherwise(5)})
    s = s.groupBy("station", "new", "n_features").agg(F.count("*").alias("n"), F.avg((F.col("x") < 10).cast("int")).alias("missing"), F.avg((F.col("x") >= WET).cast("int")).alias("label_rate"))
    return rounded(au.retrain_guard(s.where("new"), s.where("NOT new"), ["station"]), "old", "new")


@query("dq3_coverage_guard", """SELECT m.station, m.model, CASE WHEN max(f.valid) IS NULL THEN 'missing' WHEN max(f.valid) < TIMESTAMP '2024-01-30 12:00:00' THEN 'stale' ELSE 'ok' END AS state
FROM (SELECT r_regionkey AS station, model FROM region, (SELECT DISTINCT model FROM fcst)) m LEFT JOIN fcst f ON f.station = m.station AND f.model = m.model GROUP BY ALL""")
def dq3(spark: SparkSession, d: str) -> DataFrame:
    f = fcst(spark, d)
    expected = read(spark, d, "region").select(F.col("r_regionkey").alias("station")).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    return au.coverage(expected, f, ["station", "model"], "valid", F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


@query("dq4_gap_audit", f", w AS (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) SELECT lead, month(valid) AS m, count(*) AS anchors, count(*) FILTER (click IS NULL) AS missing, count(*) FILTER (click IS NULL AND view IS NULL) AS both_missing FROM w GROUP BY ALL")
def dq4(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).groupBy("lead", F.month("valid").cast("long").alias("m")).agg(F.count("*").alias("anchors"), F.count_if(F.col("click").isNull()).alias("missing"), F.count_if(F.col("click").isNull() & F.col("view").isNull()).alias("both_missing"))


@query("dq5_retrain_summary", """, a AS (SELECT version, station, lead, max(made) AS made, avg(abs(f - y)) AS mae FROM pred GROUP BY ALL), b AS (SELECT *, min(mae) OVER (PARTITION BY station, lead) AS best FROM a)
SELECT version, station, lead, made, round(100 * (mae - best) / nullif(best, 0), 6) AS percent FROM b WHERE made >= TIMESTAMP '2024-01-20'""")
def dq5(spark: SparkSession, d: str) -> DataFrame:
    a = pred(spark, d).groupBy("version", "station", "lead").agg(F.max("made").alias("made"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"))
    best = F.min("mae").over(Window.partitionBy("station", "lead"))
    a = a.withColumn("best", best).where(F.col("made") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return a.select("version", "station", "lead", "made", F.round(F.try_divide(100 * (F.col("mae") - F.col("best")), "best"), 6).alias("percent"))


@query("dq6_cells", "SELECT DISTINCT station, version, lead FROM pred")
def dq6(spark: SparkSession, d: str) -> DataFrame:
    meta = pred(spark, d).groupBy("station", "version").agg(F.collect_set("lead").alias("leads"))
    return meta.select("station", "version", F.explode("leads").alias("lead"))


