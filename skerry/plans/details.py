"""Queries for the finer parts of tables, spells, derived tables and audits: picks, rich fields, day features, conditions, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import weather as we
from ..operators import aggregates as ag, audit as au, calibrate as cal, dedup as dd, joins as jn, spells as sp, windows as wn
from .basics import CELL, PIVOT_SQL, rounded, wide
from .features import DAY_SQL, TRAIL_SQL, spells
from .registry import query
from .scoring import CONFORMAL_SQL, WIDE_SQL, three
from .views import MODELS, WET, fcst, hourly, pred, read, truth

HOURS = (0, 6, 12, 18)


def run_picks(leads: tuple[int, ...], cycles: tuple[int, ...], around: tuple[int, ...]) -> list[tuple[int, int, int, int, int]]:
    """(target, valid hour, run hour, days back, lead) of the runs in the cycles that are `around` hours off the target lead, for each valid hour."""
    found = []
    for target in leads:
        for hour in HOURS:
            for lead in (target + a for a in around):
                if (hour - lead) % 24 in cycles:
                    found.append((target, hour, (hour - lead) % 24, -((hour - lead) // 24), lead))
    return found


def picks(spark: SparkSession) -> DataFrame:
    """Strict picks hit the target lead on the main cycles; averaging ones lie three hours to either side, on the cycles between."""
    rows = [("strict", *p) for p in run_picks((12, 24, 48), HOURS, (0,))] + [("averaging", *p) for p in run_picks((12, 24, 48, 72), (3, 15), (-3, 3))]
    return F.broadcast(spark.createDataFrame(rows, "strategy string, target int, valid_hour int, run_hour int, days int, age int"))  # seven leads, four hours


def picked(f: DataFrame, choice: DataFrame) -> DataFrame:
    at = F.timestamp_diff("HOUR", F.col("run"), F.col("valid"))
    on = (F.hour("valid") == F.col("valid_hour")) & (F.hour("run") == F.col("run_hour")) & (F.to_date("run") == F.date_sub(F.to_date("valid"), F.col("days"))) & (at == F.col("age"))
    return f.join(choice, on)


@query("flt8_strict_and_averaging", """, a AS (SELECT *, date_diff('hour', run, valid) AS age FROM fcst)
SELECT strategy, target, model, count(*) AS n, round(avg(x), 6) AS mean FROM (
SELECT 'strict' AS strategy, CAST(age AS INT) AS target, model, x FROM a WHERE age IN (12, 24, 48) AND hour(run) IN (0, 6, 12, 18)
UNION ALL SELECT 'averaging', t.target, model, x FROM a JOIN (VALUES (12), (24), (48), (72)) t(target) ON abs(age - t.target) = 3 WHERE hour(run) IN (3, 15)) GROUP BY ALL""")
def flt8_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(picked(fcst(spark, d), picks(spark)).groupBy("strategy", "target", "model").agg(F.count("*").alias("n"), F.avg("x").alias("mean")), "mean")


CLIMATE_SQL = """, b AS (SELECT CAST(floor((y + 22.5::DOUBLE) / 45) AS BIGINT) % 8 AS sector, month(valid) AS m, y, radians(y * 4) AS r, hour(valid) AS h FROM truth),
bins AS (SELECT sector, m, count(*) AS n, avg(y) AS level, avg(y * y) AS square, avg(sin(r)) AS east, avg(cos(r)) AS north, avg(y / (y + 50)) AS share, avg(ln(1 + y)) AS log FROM b GROUP BY ALL HAVING count(*) >= 10)"""


def climate_bins(spark: SparkSession, d: str, least: int) -> DataFrame:
    """Six derived measures by sector and month, from bins of at least so many rows."""
    y = F.col("y")
    t = truth(spark, d).withColumns({"sector": we.sector(y).cast("long"), "m": F.month("valid").cast("long")})
    rad = F.radians(y * 4)
    derived = {"level": y, "square": y * y, "east": F.sin(rad), "north": F.cos(rad), "share": y / (y + 50), "log": F.log(1 + y)}
    return t.groupBy("sector", "m").agg(F.count("*").alias("n"), *[F.avg(e).alias(k) for k, e in derived.items()]).where(F.col("n") >= least)


@query("agg15_climate_six", CLIMATE_SQL + " SELECT sector, m, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("level", "square", "east", "north", "share", "log")) + " FROM bins")
def agg15_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(climate_bins(spark, d, 10), "level", "square", "east", "north", "share", "log")


@query("jn14_sector_and_month", CLIMATE_SQL + " SELECT station, valid, round(x, 6) AS x, round(bins.level, 6) AS level, round(bins.share, 6) AS share FROM latest LEFT JOIN bins ON bins.sector = CAST(floor((x + 22.5::DOUBLE) / 45) AS BIGINT) % 8 AND bins.m = month(valid) WHERE model = 'click' AND lead = 24")
def jn14_full(spark: SparkSession, d: str) -> DataFrame:
    """Each forecast with the climate of its own sector and month; 96 bins at most are broadcast."""
    f = dd.latest(fcst(spark, d).where("model = 'click' AND lead = 24"), CELL, ["run", "event_id"]).withColumns({"sector": we.sector(F.col("x")).cast("long"), "m": F.month("valid").cast("long")})
    j = f.join(F.broadcast(climate_bins(spark, d, 10)), ["sector", "m"], "left")
    return rounded(j.select("station", "valid", "x", "level", "share"), "x", "level", "share")


GAPS_SQL = f", w AS (SELECT station, valid, lead, max(run) AS run, {PIVOT_SQL} FROM latest GROUP BY ALL), k AS (SELECT *, month(valid) AS m, hour(valid) AS h, hour(run) AS r, CAST(lead AS BIGINT) AS l FROM w)"
SHARES = ("click", "view")


def gap_keys(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    w = cells.groupBy("station", "valid", "lead").agg(F.max("run").alias("run"), *[F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in MODELS])
    return w.withColumns({"m": F.month("valid").cast("long"), "h": F.hour("valid").cast("long"), "r": F.hour("run").cast("long"), "l": F.col("lead").cast("long")})


@query("agg12_by_month_and_run_hour", GAPS_SQL + " SELECT CASE WHEN m IS NOT NULL THEN 'm' WHEN h IS NOT NULL THEN 'h' WHEN r IS NOT NULL THEN 'r' ELSE 'l' END AS \"by\", coalesce(m, h, r, l) AS value, count(*) AS n, " + ", ".join(f"round(avg(CAST({c} IS NULL AS INT)), 6) AS null_{c}" for c in SHARES) + ", count(*) FILTER (click IS NULL AND view IS NULL) AS both_null FROM k GROUP BY GROUPING SETS ((m), (h), (r), (l))")
def agg12_full(spark: SparkSession, d: str) -> DataFrame:
    both = F.count_if(F.col("click").isNull() & F.col("view").isNull()).alias("both_null")
    g = ag.null_shares_by_each(gap_keys(spark, d), ["m", "h", "r", "l"], SHARES, both)
    return rounded(g.select("by", F.coalesce("m", "h", "r", "l").alias("value"), "n", *[f"null_{c}" for c in SHARES], "both_null"), *[f"null_{c}" for c in SHARES])


CURVES_SQL = """, i AS (SELECT station, hour, v, n, v / 4 - 5 AS rock, v / 25 - 0.5::DOUBLE AS margin, 70 + v / 3 AS rh, v / 3 - 5 AS air, v / 2 AS wind, v / 800 AS film, v / 120 AS p FROM hourly),
t AS (SELECT *, least(1, greatest(0, margin / 3)) AS tm, least(1, greatest(0, (rh - 85) / 15)) AS ts, least(1, greatest(0, (film - 0.01::DOUBLE) / 0.04::DOUBLE)) AS tf FROM i),
c AS (SELECT *, CASE WHEN rock < 5 THEN greatest(0, 1 - (5 - rock) * 0.17::DOUBLE) WHEN rock <= 10 THEN 1 ELSE 0.25 + 0.75 * greatest(0, 1 - (rock - 10) / 15) END AS friction,
0.15::DOUBLE + 0.85::DOUBLE * (tm * tm * (3 - 2 * tm)) AS dew, 1 - 0.65::DOUBLE * (ts * ts * (3 - 2 * ts)) AS salt, 1 - 0.92::DOUBLE * (tf * tf * (3 - 2 * tf)) AS wet,
CASE WHEN air < 5 THEN greatest(0, 0.4::DOUBLE - (5 - air) * 0.12::DOUBLE) WHEN air < 8 THEN 0.4::DOUBLE + (air - 5) / 3 * 0.6::DOUBLE WHEN air <= 10 THEN 1 WHEN air <= 20 THEN 1 - (air - 10) / 10 * 0.85::DOUBLE ELSE greatest(0, 0.15::DOUBLE - (air - 20) * 0.03::DOUBLE) END AS comfort,
CASE WHEN wind <= 5 THEN 0.6::DOUBLE + wind / 5 * 0.4::DOUBLE WHEN wind <= 10 THEN 1 WHEN wind <= 15 THEN 1 - (wind - 10) / 5 * 0.5 ELSE greatest(0.1::DOUBLE, 0.5 - (wind - 15) * 0.02::DOUBLE) END AS breeze FROM t)"""


def curves(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows with rock temperature, dew margin, humidity, air, wind, water film and rain chance made of the reading, and a score for each."""
    v = F.col("v")
    i = hourly(spark, d).withColumns({"rock": v / 4 - 5, "margin": v / 25 - 0.5, "rh": 70 + v / 3, "air": v / 3 - 5, "wind": v / 2, "film": v / 800, "p": v / 120})
    return i.withColumns({
        "friction": we.piecewise(F.col("rock"), we.FRICTION), "dew": we.smooth_penalty(F.col("margin"), we.DEW), "salt": we.smooth_penalty(F.col("rh"), we.SALT),
        "wet": we.smooth_penalty(F.col("film"), we.FILM), "comfort": we.piecewise(F.col("air"), we.AIR), "breeze": we.piecewise(F.col("wind"), we.WIND),
    })


@query("fn16_condition_curves", CURVES_SQL + " SELECT station, hour, " + ", ".join(f"round({c}, 9) AS {c}" for c in ("friction", "dew", "salt", "wet", "comfort", "breeze")) + " FROM c")
def fn16_full(spark: SparkSession, d: str) -> DataFrame:
    names = ("friction", "dew", "salt", "wet", "comfort", "breeze")
    return curves(spark, d).select("station", "hour", *[F.round(n, 9).alias(n) for n in names])


SUN_SQL = """, g0 AS (SELECT *, 2 * pi() * (dayofyear(hour) + hour(hour) / 24 - 1) / 365 AS g FROM c),
g1 AS (SELECT *, 0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS decl,
229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS late FROM g0),
lit AS (SELECT *, sin(radians(50.0::DOUBLE + station)) * sin(decl) + cos(radians(50.0::DOUBLE + station)) * cos(decl) * cos(pi() / 12 * ((hour(hour) * 60 + 4 * (2 * station - 5) + late) / 60 - 12)) AS sine FROM g1)"""


@query("drv2_gates_and_tiers", CURVES_SQL + SUN_SQL + """, f AS (SELECT station, hour, CASE WHEN sine <= 0 THEN 'dark' WHEN p >= 0.5 THEN 'rain' WHEN film >= 0.2::DOUBLE THEN 'soaked' END AS gate, [friction * salt, dew, comfort, breeze, least(1 - p, wet)] AS s FROM lit),
g AS (SELECT *, list_min(s) AS worst, sqrt(exp((ln(greatest(s[1], 1e-6)) + ln(greatest(s[2], 1e-6)) + ln(greatest(s[3], 1e-6)) + ln(greatest(s[4], 1e-6)) + ln(greatest(s[5], 1e-6))) / 5) * list_min(s)) AS score FROM f)
SELECT station, hour, gate, CASE WHEN gate IS NULL THEN round(score, 6) END AS score, CASE WHEN gate IS NOT NULL THEN 'off' WHEN score >= 0.7::DOUBLE THEN 'prime' WHEN score >= 0.5 THEN 'good' WHEN score >= 0.3::DOUBLE THEN 'marginal' ELSE 'poor' END AS tier,
CASE WHEN gate IS NULL THEN ['friction', 'condensation', 'air', 'wind', 'rain'][list_position(s, worst)] END AS limiting FROM g""")
def drv2_full(spark: SparkSession, d: str) -> DataFrame:
    """Gates first, of them the sun below the station's horizon; then the blend of five factors, its tier, and the first of the worst factors."""
    sun = we.sine_altitude("hour", 50.0 + F.col("station"), 2.0 * F.col("station") - 5)
    gate = F.when(sun <= 0, "dark").when(F.col("p") >= 0.5, "rain").when(F.col("film") >= 0.2, "soaked")
    scores = F.array(F.col("friction") * F.col("salt"), F.col("dew"), F.col("comfort"), F.col("breeze"), F.least(1 - F.col("p"), F.col("wet")))
    c = curves(spark, d).withColumns({"gate": gate, "s": scores}).withColumn("blend", we.blended(F.col("s")))
    names = F.array(*map(F.lit, ("friction", "condensation", "air", "wind", "rain")))
    open_ = F.col("gate").isNull()
    limiting = F.element_at(names, F.array_position("s", F.array_min("s")).cast("int"))
    return c.select("station", "hour", "gate", F.when(open_, F.round("blend", 6)).alias("score"), F.when(open_, we.tier(F.col("blend"))).otherwise("off").alias("tier"), F.when(open_, limiting).alias("limiting"))


@query("drv3_triggers", f", w AS (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL), low AS (SELECT station, valid, lead, count(*) FILTER (x < 30) AS mist, count(*) FILTER (x >= 60) AS base FROM latest GROUP BY ALL)" + """, t AS (SELECT station, valid, lead, coalesce(click >= 60, false)::INT + coalesce(sqrt(error / 20) * (view / 5) >= 15, false)::INT AS sea, (mist >= 2)::INT + (base >= 2)::INT AS cloud FROM w JOIN low USING (station, valid, lead))
SELECT station, valid, lead, sea, cloud, CASE WHEN sea = 0 THEN 'none' WHEN sea = 1 THEN 'amber' ELSE 'red' END AS sea_badge, CASE WHEN cloud = 0 THEN 'none' WHEN cloud = 1 THEN 'amber' ELSE 'red' END AS cloud_badge FROM t""")
def drv3_full(spark: SparkSession, d: str) -> DataFrame:
    """Sea state: high tide, and run-up by the root of wave height times period, each left out where an input is missing. Low cloud: mist and cloud base, each by the number of sources that signal it."""
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    pivots = [F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in ("click", "error", "view")]
    w = cells.groupBy("station", "valid", "lead").agg(*pivots, F.count_if(F.col("x") < 30).alias("mist"), F.count_if(F.col("x") >= 60).alias("base"))
    fired = lambda *conditions: sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions[1:]), F.coalesce(conditions[0], F.lit(False)).cast("int"))
    badge = lambda c: F.when(F.col(c) == 0, "none").when(F.col(c) == 1, "amber").otherwise("red").alias(f"{c}_badge")
    w = w.withColumns({"sea": fired(F.col("click") >= 60, F.sqrt(F.col("error") / 20) * (F.col("view") / 5) >= 15), "cloud": fired(F.col("mist") >= 2, F.col("base") >= 2)})
    return w.select("station", "valid", "lead", "sea", "cloud", badge("sea"), badge("cloud"))


@query("drv4_tags_by_day", CONFORMAL_SQL + """, g AS (SELECT station, version, lead, valid, p, CASE WHEN 1 - p <= threshold AND NOT p <= threshold THEN 'Wet' WHEN p <= threshold AND NOT 1 - p <= threshold THEN 'Dry' ELSE 'Ambiguous' END AS tag FROM pred JOIN th USING (station, version, lead))
SELECT station, version, CAST(valid AS DATE) AS day, round(avg(p), 6) AS mean, CAST(arg_min(hour(valid), p * 1000000 + hour(valid)) AS INT) AS driest, count(*) FILTER (tag = 'Wet') AS wet, count(*) FILTER (tag = 'Dry') AS dry, count(*) FILTER (tag = 'Ambiguous') AS ambiguous FROM g GROUP BY ALL""")
def drv4_full(spark: SparkSession, d: str) -> DataFrame:
    p, keys = pred(spark, d), ["station", "version", "lead"]
    g = cal.conformal_tag(p, cal.conformal_thresholds(p, keys, "p", "wet", 0.1), keys, "p").withColumn("h", F.hour("valid"))
    tags = [F.count_if(F.col("tag") == t).alias(t.lower()) for t in ("Wet", "Dry", "Ambiguous")]
    return rounded(g.groupBy("station", "version", F.to_date("valid").alias("day")).agg(F.avg("p").alias("mean"), F.min_by("h", F.struct("p", "h")).alias("driest"), *tags), "mean")


@query("drv6_card_with_nearest", """, c AS (SELECT station, CAST(hour AS DATE) AS day, min(v) AS low, max(v) AS top, avg(v) AS mean, CAST(arg_min(hour(hour), v * 1000000 + hour(hour)) AS INT) AS driest FROM hourly GROUP BY ALL),
k AS (SELECT c.station, c.day, o.ts, o.event_id, abs(date_diff('microsecond', o.ts, CAST(c.day AS TIMESTAMP) + INTERVAL 12 HOURS)) AS gap FROM c JOIN obs o ON o.station = c.station AND o.ts BETWEEN CAST(c.day AS TIMESTAMP) + INTERVAL 10 HOURS AND CAST(c.day AS TIMESTAMP) + INTERVAL 14 HOURS),
n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY station, day ORDER BY gap, ts, event_id) = 1)
SELECT c.station, c.day, round(low, 6) AS low, round(top, 6) AS top, round(mean, 9) AS mean, driest, n.event_id AS noon FROM c LEFT JOIN n USING (station, day)""")
def drv6_full(spark: SparkSession, d: str) -> DataFrame:
    """The day's extremes, and the reading nearest to noon within two hours."""
    from .views import obs

    h = hourly(spark, d).withColumn("h", F.hour("hour"))
    cards = h.groupBy("station", F.to_date("hour").alias("day")).agg(F.min("v").alias("low"), F.max("v").alias("top"), F.round(F.avg("v"), 9).alias("mean"), F.min_by("h", F.struct("v", "h")).alias("driest"))
    noon = cards.withColumn("noon_at", F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"))
    readings = obs(spark, d).select("station", "ts", F.col("event_id").alias("noon"))
    return rounded(jn.nearest_join(noon, readings, ["station"], "noon_at", "ts", ["noon"], 7200, ["noon"]).select("station", "day", "low", "top", "mean", "driest", "noon"), "low", "top")


#: Ten measures of a forecast beside each other, as the driver's rows have one.
FIELDS = {f"q{i}": e for i, e in enumerate(("x", "x * x", "x / 2", "CAST(event_id % 97 AS DOUBLE)", "CAST(event_id * 7 % 101 AS DOUBLE)", "x + event_id % 5", "x - event_id % 3", "CAST(event_id % 4 AS DOUBLE)", "x * (event_id % 2)", "CAST(lead AS DOUBLE) + event_id % 11"))}


@query("ts2_ten_fields", ", f AS (SELECT station, valid, lead, model, " + ", ".join(f"{e} AS {q}" for q, e in FIELDS.items()) + " FROM latest) SELECT station, valid, lead, " + ", ".join(f"round(max({q}) FILTER (model = '{m}'), 6) AS {m}_{q}" for m in MODELS for q in FIELDS) + ", " + ", ".join(f"round(avg({q}), 6) AS {q}_mean, round(sqrt(greatest(0, avg({q} * {q}) - avg({q}) ** 2)), 4) AS {q}_std" for q in FIELDS) + " FROM f GROUP BY ALL")
def ts2_full(spark: SparkSession, d: str) -> DataFrame:
    """Ten measures for each model, their means and population deviations: 70 columns in one aggregation, from one list."""
    f = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).selectExpr("station", "valid", "lead", "model", *[f"{e} AS {q}" for q, e in FIELDS.items()])
    own = [F.round(F.max(F.when(F.col("model") == m, F.col(q))), 6).alias(f"{m}_{q}") for m in MODELS for q in FIELDS]
    over = [c for q in FIELDS for mean, std, *_ in [ag.spread(q)] for c in (F.round(mean, 6).alias(f"{q}_mean"), F.round(std, 4).alias(f"{q}_std"))]
    return f.groupBy("station", "valid", "lead").agg(*own, *over)


TRAIL72_SQL = f""", {TRAIL_SQL}, t AS (SELECT station, hour, v, k, count(v) OVER a AS c24, sum(v) OVER a AS s24, count(*) FILTER (v >= 45) OVER a AS w24, count(v) OVER b AS c72, sum(v) OVER b AS s72, count(*) FILTER (v >= 45) OVER b AS w72 FROM hs
WINDOW a AS (PARTITION BY station ORDER BY k RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY station ORDER BY k RANGE BETWEEN 71 PRECEDING AND CURRENT ROW)),
st AS (SELECT *, CASE WHEN v > 45 THEN k WHEN lag(k) OVER (PARTITION BY station ORDER BY k) IS NULL OR lag(k) OVER (PARTITION BY station ORDER BY k) < k - 1 THEN k - 1 END AS stop FROM t),
tr AS (SELECT station, hour, CASE WHEN c24 = 24 THEN s24 END AS sum_24, CASE WHEN c24 = 24 THEN w24 END AS wet_24, CASE WHEN c72 = 72 THEN s72 END AS sum_72, CASE WHEN c72 = 72 THEN w72 END AS wet_72, k - last_value(stop IGNORE NULLS) OVER (PARTITION BY station ORDER BY k ROWS UNBOUNDED PRECEDING) AS dry_hours FROM st)"""
TRAILS = ("sum_24", "wet_24", "sum_72", "wet_72", "dry_hours")


def trails(spark: SparkSession, d: str) -> DataFrame:
    h = hourly(spark, d).drop("n")
    for hours in (24, 72):
        h = wn.trailing(h, ["station"], "hour", "v", hours, WET)
    return wn.dry_run(h, ["station"], "hour", "v", WET).select("station", "hour", *TRAILS)


@query("ts6_trailing_72", TRAIL72_SQL + " SELECT station, hour, round(sum_24, 6) AS sum_24, wet_24, round(sum_72, 6) AS sum_72, wet_72, dry_hours FROM tr")
def ts6_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trails(spark, d), "sum_24", "sum_72")


COMPOSED_SQL = TRAIL72_SQL + ", w AS (SELECT station, valid, lead, max(run) AS run, " + ", ".join(f"max(x) FILTER (model = '{m}') AS {m}, max(event_id % 97) FILTER (model = '{m}') AS {m}_humidity, max(event_id * 7 % 101) FILTER (model = '{m}') AS {m}_pressure" for m in MODELS) + """ FROM latest GROUP BY ALL),
sl AS (SELECT station, valid, avg(slope) AS slope FROM (SELECT station, valid, model, regr_slope(x, lead) AS slope FROM latest WHERE lead > 24 GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
rich AS (SELECT w.*, round(sl.slope, 9) AS slope, round(sum_24, 6) AS sum_24, wet_24, round(sum_72, 6) AS sum_72, wet_72, dry_hours, CAST(y >= 45 AS INT) AS wet FROM w JOIN truth USING (station, valid) LEFT JOIN tr ON tr.station = w.station AND tr.hour = w.run LEFT JOIN sl ON sl.station = w.station AND sl.valid = w.valid)"""


def composed(spark: SparkSession, d: str, made: dict[str, str] | None = None, *more: Column) -> DataFrame:
    """Wet table with humidity and pressure of each model, what the gauge had seen when the run began, and the slope over longer leads; more: aggregates over a row's models, in the same pass, of columns made by SQL."""
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).withColumns({"humidity": F.col("event_id") % 97, "pressure": F.col("event_id") * 7 % 101})
    own = [F.max(F.when(F.col("model") == m, F.col(v))).alias(m if v == "x" else f"{m}_{v}") for m in MODELS for v in ("x", "humidity", "pressure")]
    rows = cells.withColumns({k: F.expr(e) for k, e in made.items()}) if made else cells
    w = rows.groupBy("station", "valid", "lead").agg(F.max("run").alias("run"), *own, *more)
    slopes = cells.where("lead > 24").groupBy("station", "valid", "model").agg(F.regr_slope("x", "lead").alias("slope"), F.count("*").alias("k")).where("k >= 2")
    slopes = slopes.groupBy("station", "valid").agg(F.avg("slope").alias("slope"))
    w = w.join(truth(spark, d).withColumn("wet", (F.col("y") >= WET).cast("int")).drop("y"), ["station", "valid"])
    w = w.join(trails(spark, d).withColumnRenamed("hour", "run"), ["station", "run"], "left").join(slopes, ["station", "valid"], "left")
    return rounded(w.withColumn("slope", F.round("slope", 9)), "sum_24", "sum_72")


@query("ts4_rich_wet_composed", COMPOSED_SQL + " SELECT * FROM rich")
def ts4_full(spark: SparkSession, d: str) -> DataFrame:
    return composed(spark, d)


@query("ts8_tiers_and_leads", """, f AS (SELECT *, date_diff('hour', run, valid) AS age FROM fcst WHERE hour(valid) IN (0, 12) AND (model <> 'view' OR hour(run) IN (0, 6, 12, 18)) AND (model <> 'signup' OR (date_diff('hour', run, valid) IN (24, 48) AND hour(run) IN (0, 6, 12, 18)))),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY station, model, valid, lead ORDER BY run DESC, event_id DESC) = 1),
w AS (SELECT station, valid, """ + ", ".join(f"max(x) FILTER (model = '{m}' AND lead = {h}) AS {m}_{h}" for m in MODELS for h in (24, 48)) + """ FROM l GROUP BY ALL)
SELECT *, CASE WHEN click_24 IS NOT NULL AND error_24 IS NOT NULL AND view_24 IS NOT NULL THEN 'A' WHEN click_24 IS NOT NULL AND error_24 IS NOT NULL THEN 'B' ELSE 'C' END AS tier FROM w""")
def ts8_full(spark: SparkSession, d: str) -> DataFrame:
    """One model on its main cycles alone, another by its strict picks; then the latest run, a column for each model and lead, and the tier that a row's models allow."""
    f = fcst(spark, d).where(F.hour("valid").isin(0, 12) & ((F.col("model") != "view") | F.hour("run").isin(*HOURS)))
    strict = picks(spark).where("strategy = 'strict' AND target > 12").select("valid_hour", "run_hour", "days", "age")
    own = picked(f.where("model = 'signup'"), strict).select(f.columns)
    l = dd.latest(f.where("model <> 'signup'").unionByName(own), CELL, ["run", "event_id"])  # noqa: E741
    w = ag.pivot_two(l, ["station", "valid"], "model", MODELS, "lead", (24, 48), "x")
    core = F.col("click_24").isNotNull() & F.col("error_24").isNotNull()
    return w.withColumn("tier", F.when(core & F.col("view_24").isNotNull(), "A").when(core, "B").otherwise("C"))


@query("ts15_checked_split", """, k AS (SELECT station, valid, row_number() OVER (PARTITION BY station ORDER BY valid) AS k, count(*) OVER (PARTITION BY station) AS n FROM truth),
p AS (SELECT station, valid, n, CASE WHEN k <= floor(0.7::DOUBLE * n) THEN 'train' WHEN k <= floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validation' ELSE 'test' END AS part FROM k),
e AS (SELECT station, n >= 10 AND coalesce(max(valid) FILTER (part = 'train') < min(valid) FILTER (part = 'validation'), false) AND coalesce(max(valid) FILTER (part = 'validation') < min(valid) FILTER (part = 'test'), false) AS ok FROM p GROUP BY station, n)
SELECT p.station, part, e.ok, count(*) AS rows, min(valid) AS first_valid, max(valid) AS last_valid FROM p JOIN e USING (station) GROUP BY ALL""")
def ts15_full(spark: SparkSession, d: str) -> DataFrame:
    s = wn.split_checked(truth(spark, d), ["station"], "valid")
    return s.groupBy("station", "part", "ok").agg(F.count("*").alias("rows"), F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"))


@query("ts18_direction_by_lead", """, c AS (SELECT station, lead, valid, radians(x * 3.6::DOUBLE) AS r FROM latest WHERE model = 'click'),
s AS (SELECT station, lead, valid, sin(r) AS a, cos(r) AS b, lead(valid) OVER w AS nv, lead(sin(r)) OVER w AS na, lead(cos(r)) OVER w AS nb FROM c WINDOW w AS (PARTITION BY station, lead ORDER BY valid)),
e AS (SELECT *, unnest(range(coalesce(date_diff('hour', valid, nv), 1))) AS k FROM s),
l AS (SELECT station, lead, valid + to_hours(k) AS hour, CASE WHEN nv IS NULL THEN a ELSE a + (na - a) * k / date_diff('hour', valid, nv) END AS a, CASE WHEN nv IS NULL THEN b ELSE b + (nb - b) * k / date_diff('hour', valid, nv) END AS b FROM e)
SELECT station, lead, hour, round((degrees(atan2(a, b)) + 360) % 360, 4) AS degrees FROM l""")
def ts18_full(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d).where("model = 'click'"), CELL, ["run", "event_id"]).select("station", "lead", "valid", (F.col("x") * 3.6).alias("degrees"))
    return wn.hourly_direction(cells, ["station", "lead"], "valid", "degrees").withColumn("degrees", F.round("degrees", 4))


@query("run2_model_days", """, c AS (SELECT station, model, CAST(valid AS DATE) AS day, valid, x FROM latest WHERE lead = 24),
r AS (SELECT station, model, day, max(n) AS longest FROM (SELECT station, model, day, count(*) AS n FROM (SELECT *, date_diff('hour', TIMESTAMP '1970-01-01', valid) // 6 - row_number() OVER (PARTITION BY station, model, day ORDER BY valid) AS g FROM c WHERE x < 45) GROUP BY station, model, day, g) GROUP BY ALL),
m AS (SELECT c.station, c.model, c.day, sum(x) AS total, max(x) AS top, count(*) FILTER (x >= 45) AS wet, coalesce(any_value(r.longest), 0) AS longest, max(x / (x + 50)) AS chance FROM c LEFT JOIN r USING (station, model, day) GROUP BY ALL),
e AS (SELECT station, day, avg(f) AS env_mean, min(f) AS env_low, max(f) AS env_top FROM (SELECT station, day, valid, avg(x) AS f FROM c GROUP BY ALL) GROUP BY ALL)
SELECT station, day, count(*) AS models, round(avg(total), 6) AS total_mean, round(sqrt(greatest(0, avg(total * total) - avg(total) ** 2)), 4) AS total_std, max(top) AS top, round(avg(wet), 6) AS wet_mean, round(avg(longest), 6) AS longest_mean, max(longest) AS longest_max,
round(avg(CAST(longest >= 2 AS INT)), 6) AS has_share, round(max(chance), 6) AS chance, round(any_value(env_mean), 6) AS env_mean, round(any_value(env_low), 6) AS env_low, round(any_value(env_top), 6) AS env_top FROM m JOIN e USING (station, day) GROUP BY ALL""")
def run2_full(spark: SparkSession, d: str) -> DataFrame:
    """Each model's day: total, wettest slot, wet slots, longest dry run, a window of two slots or not, largest chance; then the models together, and the envelope of their mean."""
    c = dd.latest(fcst(spark, d).where("lead = 24"), CELL, ["run", "event_id"]).withColumns({"day": F.to_date("valid"), "dry": F.col("x") < WET})
    longest = wn.islands(c, ["station", "model", "day"], "valid", "dry", 6 * 3600, short=True).groupBy("station", "model", "day").agg(F.max("n").alias("longest"))
    m = c.groupBy("station", "model", "day").agg(F.sum("x").alias("total"), F.max("x").alias("top"), F.count_if(F.col("x") >= WET).alias("wet"), F.max(F.col("x") / (F.col("x") + 50)).alias("chance"))
    m = m.join(longest, ["station", "model", "day"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    mean, std, *_ = ag.spread("total")
    days = m.groupBy("station", "day").agg(F.count("*").alias("models"), F.round(mean, 6).alias("total_mean"), F.round(std, 4).alias("total_std"), F.max("top").alias("top"), F.avg("wet").alias("wet_mean"), F.avg("longest").alias("longest_mean"), F.max("longest").alias("longest_max"), F.avg((F.col("longest") >= 2).cast("int")).alias("has_share"), F.max("chance").alias("chance"))
    slots = c.groupBy("station", "day", "valid").agg(F.avg("x").alias("f"))
    env = slots.groupBy("station", "day").agg(F.avg("f").alias("env_mean"), F.min("f").alias("env_low"), F.max("f").alias("env_top"))
    return rounded(days.join(env, ["station", "day"]), "wet_mean", "longest_mean", "has_share", "chance", "env_mean", "env_low", "env_top")


@query("run7_nesting_and_coverage", DAY_SQL + """, l AS (SELECT station, day, longest >= 2 AS h2, longest >= 3 AS h3, longest >= 4 AS h4 FROM sp), a AS (SELECT DISTINCT station, CAST(hour AS DATE) AS day FROM hourly)
SELECT a.station, month(a.day) AS m, count(*) AS days, count(l.day) AS labelled, count(*) FILTER (h4 AND NOT h3 OR h3 AND NOT h2) AS broken, count(*) FILTER (h2) AS has_2, count(*) FILTER (h3) AS has_3, count(*) FILTER (h4) AS has_4 FROM a LEFT JOIN l ON l.station = a.station AND l.day = a.day GROUP BY ALL""")
def run7_full(spark: SparkSession, d: str) -> DataFrame:
    """Days with a label by month, and whether a longer window ever comes without the shorter ones."""
    labels = sp.windows_of(spells(spark, d), (2, 3, 4)).groupBy("station", "day").agg(*[F.max(F.when(F.col("window") == w, F.col("has"))).alias(f"h{w}") for w in (2, 3, 4)])
    days = hourly(spark, d).select("station", F.to_date("hour").alias("day")).distinct().join(labels, ["station", "day"], "left")
    on = lambda w: F.col(f"h{w}") == 1
    broken = (on(4) & ~on(3)) | (on(3) & ~on(2))
    return days.groupBy("station", F.month("day").cast("long").alias("m")).agg(F.count("*").alias("days"), F.count("h2").alias("labelled"), F.count_if(broken).alias("broken"), *[F.count_if(on(w)).alias(f"has_{w}") for w in (2, 3, 4)])


RADIANT_SQL = """, w AS (SELECT station, valid, lead, max(run) AS newest, min(run) AS oldest, count(*) AS inputs, """ + PIVOT_SQL + """ FROM latest GROUP BY ALL),
i AS (SELECT station, valid, lead, newest, oldest, click / 4 AS t, least(100, view) AS rh, least(20, error / 10) AS wind, greatest(0, purchase * 8) AS sw, least(1, greatest(0, signup / 80)) AS cloud FROM w WHERE inputs = 5),
e AS (SELECT *, 6.112::DOUBLE * exp(17.67::DOUBLE * t / (t + 243.5)) * rh / 100 AS vp FROM i),
r AS (SELECT *, ((1 - cloud) * 1.24::DOUBLE * pow(greatest(vp, 0.01::DOUBLE) / (t + 273.15), 1 / 7.0::DOUBLE) + cloud) * 5.67e-8 * pow(t + 273.15, 4.0) AS down, 0.97::DOUBLE * 5.67e-8 * pow(t + 273.15, 4.0) AS up FROM e)"""


@query("drv1_five_inputs", RADIANT_SQL + """ SELECT station, valid, lead, round(pow((0.3::DOUBLE * sw + 0.5 * 0.97::DOUBLE * (down + up)) / (0.97::DOUBLE * 5.67e-8), 0.25) - 273.15, 3) AS radiant, round(t + 0.33::DOUBLE * vp - 0.7::DOUBLE * wind - 4, 4) AS feels,
newest, date_diff('hour', oldest, newest) AS spread_hours, CASE WHEN oldest = valid - to_hours(lead) THEN 'exact' ELSE 'reported' END AS source FROM r""")
def drv1_full(spark: SparkSession, d: str) -> DataFrame:
    """Newest value of five inputs, all of which must be there, clamped; mean radiant and apparent temperature; and where the inputs' runs lie."""
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    pivots = [F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in MODELS]
    w = cells.groupBy("station", "valid", "lead").agg(F.max("run").alias("newest"), F.min("run").alias("oldest"), F.count("*").alias("inputs"), *pivots).where(F.col("inputs") == len(MODELS))
    t, cloud = F.col("click") / 4, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("signup") / 80))
    vapour = we.magnus_hpa(t) * F.least(F.lit(100.0), F.col("view")) / 100
    radiant = we.mean_radiant(t, F.greatest(F.lit(0.0), F.col("purchase") * 8), cloud, vapour)
    feels = we.apparent(t, vapour, F.least(F.lit(20.0), F.col("error") / 10))
    exact = F.col("oldest") == F.col("valid") - F.make_dt_interval(F.lit(0), F.col("lead"))
    return w.select("station", "valid", "lead", F.round(radiant, 3).alias("radiant"), F.round(feels, 4).alias("feels"), "newest", F.timestamp_diff("HOUR", F.col("oldest"), F.col("newest")).alias("spread_hours"), F.when(exact, "exact").otherwise("reported").alias("source"))


@query("dq1_label_rate", f", w AS (SELECT station, lead, valid, {PIVOT_SQL} FROM latest GROUP BY ALL) SELECT lead, count(*) AS n, round(avg(CAST(y >= 45 AS INT)), 6) AS label_rate, " + ", ".join(f"round(avg(CAST({m} IS NULL AS INT)), 6) AS missing_{m}" for m in MODELS) + " FROM w JOIN truth USING (station, valid) GROUP BY 1")
def dq1_full(spark: SparkSession, d: str) -> DataFrame:
    t = wide(spark, d).join(truth(spark, d), ["station", "valid"])
    missing = [F.round(F.avg(F.col(m).isNull().cast("int")), 6).alias(f"missing_{m}") for m in MODELS]
    return rounded(t.groupBy("lead").agg(F.count("*").alias("n"), F.avg((F.col("y") >= WET).cast("int")).alias("label_rate"), *missing), "label_rate")


@query("dq2_location_guard", """, s AS (SELECT station, valid >= TIMESTAMP '2024-01-20' AS new, count(*) AS n, CASE WHEN station = 1 AND valid >= TIMESTAMP '2024-01-20' THEN 'moved' ELSE 'place ' || station END AS location FROM latest GROUP BY ALL),
j AS (SELECT c.station, c.n AS cn, p.n AS pn, c.location AS cl, p.location AS pl FROM s c JOIN s p USING (station) WHERE c.new AND NOT p.new)
SELECT station, 'rows' AS "check", CAST(pn AS VARCHAR) AS old, CAST(cn AS VARCHAR) AS new FROM j WHERE abs(cn / pn - 1) > 0.3 UNION ALL SELECT station, 'location', pl, cl FROM j WHERE cl <> pl""")
def dq2_full(spark: SparkSession, d: str) -> DataFrame:
    """Rows that grew or shrank too much, and a location that is another one than before; values as text."""
    new = F.col("valid") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    s = dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).withColumn("new", new)
    s = s.withColumn("location", F.when((F.col("station") == 1) & F.col("new"), "moved").otherwise(F.concat(F.lit("place "), F.col("station").cast("string"))))
    s = s.groupBy("station", "new", "location").agg(F.count("*").alias("n"))
    return au.changed(s.where("new"), s.where("NOT new"), ["station"], {"rows": ("n", 0.3), "location": ("location", None)})


@query("dq4_three_part_audit", GAPS_SQL + """, g AS (SELECT station, hour, lag(hour) OVER (PARTITION BY station ORDER BY hour) AS before FROM hourly)
SELECT 'share' AS part, 'month ' || m AS name, round(avg(CAST(click IS NULL AS INT)), 6) AS value FROM k GROUP BY m
UNION ALL SELECT 'streak', 'station ' || station, max(date_diff('hour', before, hour) - 1)::DOUBLE FROM g WHERE date_diff('hour', before, hour) > 1 GROUP BY station
UNION ALL SELECT 'presence', 'lead ' || lead, round(count(purchase) / count(*), 6) FROM w WHERE click IS NOT NULL GROUP BY lead""")
def dq4_full(spark: SparkSession, d: str) -> DataFrame:
    """Shares of missing cells, the longest streak without a reading, and how often one source is there where another is."""
    k = gap_keys(spark, d)
    part = lambda df, name, label, value: df.select(F.lit(name).alias("part"), label.alias("name"), F.round(value, 6).alias("value"))
    shares = k.groupBy("m").agg(F.avg(F.col("click").isNull().cast("int")).alias("value"))
    gap = F.timestamp_diff("HOUR", F.lag("hour").over(Window.partitionBy("station").orderBy("hour")), F.col("hour")) - 1
    streaks = hourly(spark, d).withColumn("gap", gap).where("gap > 0").groupBy("station").agg(F.max("gap").cast("double").alias("value"))
    present = k.where("click IS NOT NULL").groupBy("lead").agg((F.count("purchase") / F.count("*")).alias("value"))
    named = lambda word, c: F.concat(F.lit(f"{word} "), F.col(c).cast("string"))
    return part(shares, "share", named("month", "m"), F.col("value")).unionByName(part(streaks, "streak", named("station", "station"), F.col("value"))).unionByName(part(present, "presence", named("lead", "lead"), F.col("value")))


@query("pool2_split_and_graded", WIDE_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY station, lead ORDER BY valid) <= floor(0.7::DOUBLE * count(*) OVER (PARTITION BY station, lead)) AS train FROM t3 WHERE pa IS NOT NULL AND pb IS NOT NULL),
f AS (SELECT station, lead, least(1, greatest(0, coalesce(sum((wet - pb) * (pa - pb)) / nullif(sum((pa - pb) ** 2), 0), 0.5))) AS weight FROM k WHERE train GROUP BY ALL)
SELECT station, lead, round(any_value(weight), 6) AS weight, count(*) AS n, round(avg((weight * pa + (1 - weight) * pb - wet) ** 2), 6) AS fitted, round(avg(((pa + pb) / 2 - wet) ** 2), 6) AS equal, round(avg((pa - wet) ** 2), 6) AS a, round(avg((pb - wet) ** 2), 6) AS b FROM k JOIN f USING (station, lead) WHERE NOT train GROUP BY ALL""")
def pool2_full(spark: SparkSession, d: str) -> DataFrame:
    """The weight from the first 70 % of each series, graded on the rest against equal weights and both alone."""
    from ..operators import pooling as po, verify as vf
    from .features import split_by_time

    t = split_by_time(three(spark, d, "click", "error"), ["station", "lead"], "valid")
    j = t.where("part <> 'train'").join(po.best_weight(t.where("part = 'train'"), ["station", "lead"], "pa", "pb", "wet"), ["station", "lead"])
    j = j.withColumns({"pool": F.col("weight") * F.col("pa") + (1 - F.col("weight")) * F.col("pb"), "half": (F.col("pa") + F.col("pb")) / 2})
    scores = [vf.brier(c, "wet").alias(n) for c, n in (("pool", "fitted"), ("half", "equal"), ("pa", "a"), ("pb", "b"))]
    return rounded(j.groupBy("station", "lead").agg(F.first("weight").alias("weight"), F.count("*").alias("n"), *scores), "weight", "fitted", "equal", "a", "b")


def _chain_sql(hours: int, rho: float) -> str:
    parts = ["CASE WHEN s & 1 = 1 THEN q[1] ELSE 1 - q[1] END"]
    for h in range(1, hours):
        a, b, r = f"q[{h + 1}]", f"q[{h}]", f"{rho}::DOUBLE * sqrt(q[{h + 1}] * (1 - q[{h + 1}]))"
        given = f"CASE WHEN (s >> {h - 1}) & 1 = 1 THEN least(1, greatest(0, {a} + {r} * sqrt((1 - {b}) / {b}))) ELSE least(1, greatest(0, {a} - {r} * sqrt({b} / (1 - {b})))) END"
        parts.append(f"CASE WHEN (s >> {h}) & 1 = 1 THEN {given} ELSE 1 - ({given}) END")
    return " * ".join(f"({p})" for p in parts)


def _dry_sql(start: int, length: int) -> str:
    return f"(s & {((1 << length) - 1) << start} = 0)"


@query("run8_exact_windows", ", h AS (SELECT station, CAST(hour AS DATE) AS day, list(least(0.99::DOUBLE, greatest(0.01::DOUBLE, v / (v + 50))) ORDER BY hour) AS q FROM hourly WHERE hour(hour) BETWEEN 9 AND 14 GROUP BY ALL HAVING count(*) = 6), o AS (SELECT *, " + _chain_sql(6, 0.5) + " AS p FROM h, range(64) r(s)) SELECT station, day, " + ", ".join(f"round(sum(p) FILTER ({' OR '.join(_dry_sql(k, w) for k in range(7 - w))}), 6) AS p_{w}" for w in (2, 3, 4)) + ", round(" + " + ".join(f"coalesce(sum(p) FILTER ({' OR '.join(_dry_sql(k, w) for k in range(7 - w))}), 0)" for w in range(1, 7)) + ", 6) AS longest_mean, " + ", ".join(f"round(sum(p) FILTER ({_dry_sql(k, 3)}" + "".join(f" AND NOT {_dry_sql(j, 3)}" for j in range(k)) + f"), 6) AS start_{k}" for k in range(4)) + " FROM o GROUP BY ALL")
def run8_exact(spark: SparkSession, d: str) -> DataFrame:
    """Dry windows by exact chances, folded over a day's six hours: no draws. The twin adds up all 64 outcomes."""
    i = hourly(spark, d).where(F.hour("hour").between(9, 14)).withColumn("day", F.to_date("hour"))
    days = i.groupBy("station", "day").agg(F.array_sort(F.collect_list(F.struct("hour", (F.col("v") / (F.col("v") + 50)).alias("q")))).alias("hs"))
    out = sp.exact_windows(days.select("station", "day", F.col("hs.q").alias("p")), ["station", "day"], 6, (2, 3, 4), 3, 0.5)
    return rounded(out, *[c for c in out.columns if c not in ("station", "day")])


def _longest_sql(hours: int) -> str:
    """The longest dry run of outcome s, by trying lengths from the top."""
    return "CASE " + " ".join(f"WHEN {' OR '.join(_dry_sql(k, w) for k in range(hours + 1 - w))} THEN {w}" for w in range(hours, 0, -1)) + " ELSE 0 END"


QUANTILE_SQL = lambda name, q: f"min(best) FILTER (below >= {q}::DOUBLE) AS {name}"


@query("run8_fitted_windows", ", i AS (SELECT *, CAST(hour AS DATE) AS day FROM hourly WHERE hour(hour) BETWEEN 8 AND 16), l AS (SELECT station, CAST(v >= 45 AS DOUBLE) AS now, CASE WHEN date_diff('hour', lag(hour) OVER w, hour) = 1 THEN lag(CAST(v >= 45 AS DOUBLE)) OVER w END AS before FROM i WINDOW w AS (PARTITION BY station, day ORDER BY hour)), c AS (SELECT station, coalesce(least(0.95::DOUBLE, greatest(0, corr(now, before))), 0) AS rho FROM l WHERE before IS NOT NULL GROUP BY 1), h AS (SELECT station, day, list(least(0.99::DOUBLE, greatest(0.01::DOUBLE, v / (v + 50))) ORDER BY hour) AS q FROM i GROUP BY ALL HAVING count(*) = 9), o AS (SELECT station, day, rho, s, " + _chain_sql(9, "rho") + " AS p, " + _longest_sql(9) + " AS best FROM h JOIN c USING (station), range(512) r(s)), b AS (SELECT station, day, rho, best, sum(p) AS p FROM o GROUP BY ALL), a AS (SELECT *, sum(p) OVER (PARTITION BY station, day ORDER BY best) AS below FROM b) SELECT station, day, round(any_value(rho), 6) AS rho, round(coalesce(sum(p) FILTER (best >= 3), 0), 6) AS p_3, round(coalesce(sum(p) FILTER (best >= 5), 0), 6) AS p_5, round(sum(p * best), 6) AS longest_mean, " + QUANTILE_SQL("longest_q25", 0.25) + ", " + QUANTILE_SQL("longest_q50", 0.5) + ", " + QUANTILE_SQL("longest_q90", 0.9) + " FROM a GROUP BY station, day")
def run8_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Nine hours a day, with the correlation of neighbouring hours that each station's readings have, and quantiles of the longest dry run."""
    i = hourly(spark, d).where(F.hour("hour").between(8, 16))
    rho = sp.neighbour_correlation(i, ["station"], "hour", "v", WET)
    days = i.groupBy("station", F.to_date("hour").alias("day")).agg(F.array_sort(F.collect_list(F.struct("hour", (F.col("v") / (F.col("v") + 50)).alias("q")))).alias("hs")).join(rho, "station")
    out = sp.exact_windows(days.select("station", "day", "rho", F.col("hs.q").alias("p")), ["station", "day", "rho"], 9, (3, 5), 3, "rho", quantiles=(0.25, 0.5, 0.9))
    return rounded(out.select("station", "day", "rho", "p_3", "p_5", "longest_mean", "longest_q25", "longest_q50", "longest_q90"), "rho", "p_3", "p_5", "longest_mean")


#: In place of the published coefficients, which are a parameter: some for every monomial, so that all of them are reached.
INDEX = [((i * 37) % 101 - 50) / 50 / 10.0 ** (a + b + c + 2 * e) for i, (a, b, c, e) in enumerate(we.exponents(4, 6))]


@query("fn9_index_of_210_terms", ", e AS (SELECT event_id, value % 40 AS t, value % 10 / 10 AS c FROM events), i AS (SELECT event_id, t, greatest(0.5, c * 10) AS v, least(70, greatest(-30, c * 60 - 10)) AS d, c * 3 AS p FROM e) SELECT event_id, round(t + " + " + ".join(f"({c!r}::DOUBLE * pow(t, {a}) * pow(v, {b}) * pow(d, {k}) * pow(p, {e}))" for c, (a, b, k, e) in zip(INDEX, we.exponents(4, 6)) if c) + ", 4) AS index FROM i")
def fn9_full(spark: SparkSession, d: str) -> DataFrame:
    from .expressions import events

    t, c = F.col("t"), F.col("c")
    return events(spark, d).select("event_id", F.round(we.comfort_index(t, c * 10, t + c * 60 - 10, c * 3, INDEX), 4).alias("index"))
