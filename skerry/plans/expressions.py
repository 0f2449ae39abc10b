"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import weather as we
from .basics import PIVOT_SQL, rounded, wide
from .features import ANGLES_SQL
from .registry import query
from .views import MODELS, read, truth


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, with a temperature t (0..40), a direction deg (0..360) and a share c (0..1) made of the value."""
    return read(spark, d, "events").selectExpr("event_id", "ts", "value", "value % 40 AS t", "value * 7 % 360 AS deg", "value % 10 / 10 AS c", "props", "event_type", "user_id")


EVENTS_SQL = ", e AS (SELECT event_id, ts, value, value % 40 AS t, value * 7 % 360 AS deg, value % 10 / 10 AS c, props, event_type, user_id FROM events)"


@query("fn1_calendar", f"SELECT station, valid, {ANGLES_SQL} FROM truth")
def fn1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(truth(spark, d).select("station", "valid", *we.calendar_angles("valid")), "hour_sin", "hour_cos", "doy_sin", "doy_cos")


@query("fn2_row_spread", f", w AS (SELECT station, valid, lead, {PIVOT_SQL}, avg(x) AS mean, sqrt(greatest(0, avg(x * x) - avg(x) ** 2)) AS std, max(x) - min(x) AS range, max(x) AS largest FROM latest GROUP BY ALL) SELECT station, valid, lead, round(mean, 6) AS mean, round(std, 4) AS std, round(range, 6) AS range, largest FROM w")
def fn2(spark: SparkSession, d: str) -> DataFrame:
    out = wide(spark, d).select("station", "valid", "lead", *we.row_spread(MODELS))
    return rounded(out, "mean", "range").withColumn("std", F.round("std", 4))


@query("fn3_wind", EVENTS_SQL + """ SELECT event_id, round(sin(radians(deg)), 6) AS s, CAST(floor((deg + 22.5) / 45) AS INT) % 8 AS sector, CASE WHEN deg >= 315 OR deg < 45 THEN 'N' WHEN deg < 135 THEN 'E' WHEN deg < 225 THEN 'S' ELSE 'W' END AS quadrant,
round((degrees(atan2(-t, -(c + 0.5))) + 360) % 360, 4) AS direction FROM e""")
def fn3(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(F.sin(F.radians("deg")), 6).alias("s"), we.sector(F.col("deg")).alias("sector"), we.quadrant(F.col("deg")).alias("quadrant"), F.round(we.direction(F.col("t"), F.col("c") + 0.5), 4).alias("direction"))


@query("fn4_sectors", EVENTS_SQL + " SELECT event_id, (deg - 300 + 720) % 360 <= 120 AS inside, round(least(1, greatest(0, 1 - (abs((deg - 300 - 60 + 180 + 720) % 360 - 180) - 60) / 30)), 4) AS onshore FROM e")
def fn4(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", we.in_sector(F.col("deg"), 300, 60).alias("inside"), F.round(we.onshore(F.col("deg"), 300, 60, 30), 4).alias("onshore"))


def magnus(x: str) -> str:
    return f"(6.112::DOUBLE * exp(17.67::DOUBLE * {x} / ({x} + 243.5)))"


@query("fn5_humidity", EVENTS_SQL + f""" SELECT event_id, round(exp(2.7150305::DOUBLE * ln(t + 273.15) - 2836.5744::DOUBLE * pow(t + 273.15, -2) - 6028.076559::DOUBLE / (t + 273.15) + 19.54263612::DOUBLE - 0.02737830188::DOUBLE * (t + 273.15) + 0.000016261698::DOUBLE * pow(t + 273.15, 2) + 7.0229056e-10 * pow(t + 273.15, 3) - 1.8680009e-13 * pow(t + 273.15, 4)) * 0.01, 5) AS saturation,
round({magnus('t')}, 5) AS magnus, round(least(100, greatest(0, 100 * {magnus('(t - 10 * c)')} / {magnus('t')})), 5) AS rh, round(0.622::DOUBLE * {magnus('t')} / (1013.25 - 0.378::DOUBLE * {magnus('t')}), 7) AS q, round(10 * c, 6) AS depression FROM e""")
def fn5(spark: SparkSession, d: str) -> DataFrame:
    t, dew = F.col("t"), F.col("t") - 10 * F.col("c")
    return events(spark, d).select("event_id", F.round(we.saturation_hpa(t), 5).alias("saturation"), F.round(we.magnus_hpa(t), 5).alias("magnus"), F.round(we.relative_humidity(t, dew), 5).alias("rh"), F.round(we.specific_humidity(t, F.lit(1013.25)), 7).alias("q"), F.round(10 * F.col("c"), 6).alias("depression"))


@query("fn6_gust_ratio", EVENTS_SQL + " SELECT event_id, round(least(4, greatest(0.5, value / greatest(t, 0.5))), 6) AS ratio FROM e")
def fn6(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(we.gust_ratio(F.col("value"), F.col("t")), 6).alias("ratio"))


@query("fn7_uplift", EVENTS_SQL + " SELECT event_id, round(greatest(0, (t - 20) * 0.3::DOUBLE + (c - 0.5) * 2), 6) AS uplift, round(greatest(0, (t - 20) * 0.3::DOUBLE + (c - 0.5) * 2) * c, 6) AS moist FROM e")
def fn7(spark: SparkSession, d: str) -> DataFrame:
    up = we.uplift(F.col("t") - 20, F.col("c") - 0.5, F.lit(0.3), F.lit(2.0))
    return events(spark, d).select("event_id", F.round(up, 6).alias("uplift"), F.round(up * F.col("c"), 6).alias("moist"))


RADIATION_SQL = """, g AS (SELECT *, 2 * pi() * (dayofyear(ts) + (hour(ts) + minute(ts) / 60) / 24 - 1) / 365 AS g FROM e),
s AS (SELECT *, 0.006918::DOUBLE - 0.399912::DOUBLE * cos(g) + 0.070257::DOUBLE * sin(g) - 0.006758::DOUBLE * cos(2 * g) + 0.000907::DOUBLE * sin(2 * g) - 0.002697::DOUBLE * cos(3 * g) + 0.00148::DOUBLE * sin(3 * g) AS decl,
229.18::DOUBLE * (0.000075::DOUBLE + 0.001868::DOUBLE * cos(g) - 0.032077::DOUBLE * sin(g) - 0.014615::DOUBLE * cos(2 * g) - 0.040849::DOUBLE * sin(2 * g)) AS late FROM g),
a AS (SELECT *, least(1, greatest(-1, sin(radians(50.5::DOUBLE)) * sin(decl) + cos(radians(50.5::DOUBLE)) * cos(decl) * cos(pi() / 12 * ((hour(ts) * 60 + minute(ts) + 4 * -4.0::DOUBLE + late) / 60 - 12)))) AS sine, 6.112::DOUBLE * exp(17.67::DOUBLE * t / (t + 243.5)) AS vp FROM s),
r AS (SELECT *, CASE WHEN sine <= 0 THEN value ELSE least(value, 825 * sine * (1 - 0.65::DOUBLE * c)) END AS sw, ((1 - c) * 1.24::DOUBLE * pow(greatest(vp, 0.01) / (t + 273.15), 1 / 7.0::DOUBLE) + c) * 5.67e-8 * pow(t + 273.15, 4) AS down, 0.97::DOUBLE * 5.67e-8 * pow(t + 273.15, 4) AS up FROM a)"""


@query("fn8_radiation", EVENTS_SQL + RADIATION_SQL + " SELECT event_id, round(sine, 6) AS sine, round(sw, 4) AS sw, round(down, 4) AS down, round(up, 4) AS up, round(pow((0.3::DOUBLE * sw + 0.5 * 0.97::DOUBLE * (down + up)) / (0.97::DOUBLE * 5.67e-8), 0.25) - 273.15, 4) AS radiant FROM r")
def fn8(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("sine", we.sine_altitude("ts", 50.5, -4.0))
    t, c, vp = F.col("t"), F.col("c"), we.magnus_hpa(F.col("t"))
    e = e.withColumn("sw", we.capped_shortwave(F.col("value"), c, F.col("sine")))
    return e.select("event_id", F.round("sine", 6).alias("sine"), F.round("sw", 4).alias("sw"), F.round(we.longwave_down(t, c, vp), 4).alias("down"), F.round(we.longwave_up(t), 4).alias("up"), F.round(we.mean_radiant(t, F.col("sw"), c, vp), 4).alias("radiant"))


@query("fn9_comfort", EVENTS_SQL + f""", f AS (SELECT *, t + 0.33::DOUBLE * {magnus('t')} - 0.7::DOUBLE * c * 10 - 4 AS feels FROM e) SELECT event_id, round(feels, 5) AS apparent, round(1.5::DOUBLE + 2 * t * c - 0.01::DOUBLE * t * t, 6) AS poly,
CASE WHEN feels < -40 THEN 'extreme cold' WHEN feels < -27 THEN 'very strong cold' WHEN feels < -13 THEN 'strong cold' WHEN feels < 0 THEN 'moderate cold' WHEN feels < 9 THEN 'slight cold' WHEN feels < 26 THEN 'none' WHEN feels < 32 THEN 'moderate heat' WHEN feels < 38 THEN 'strong heat' WHEN feels < 46 THEN 'very strong heat' ELSE 'extreme heat' END AS band FROM f""")
def fn9(spark: SparkSession, d: str) -> DataFrame:
    """The polynomial's terms are a parameter: any comfort index of that form is one call."""
    at = we.apparent(F.col("t"), we.magnus_hpa(F.col("t")), F.col("c") * 10)
    poly = we.polynomial([(1.5, (0, 0)), (2.0, (1, 1)), (-0.01, (2, 0))], F.col("t"), F.col("c"))
    return events(spark, d).select("event_id", F.round(at, 5).alias("apparent"), F.round(poly, 6).alias("poly"), we.stress_band(at).alias("band"))


@query("fn10_probability")
def fn10(spark: SparkSession, d: str) -> DataFrame:
    y, pi = F.when(F.col("c") < 0.3, 0.0).otherwise(F.col("value")), F.lit(0.6)
    return events(spark, d).select("event_id", F.round(we.normal_cdf((F.col("t") - 20) / 10), 6).alias("cdf"), F.round(we.exceedance(pi, F.lit(3.0), F.lit(1.0), y), 6).alias("over"), F.round(we.mixed_pit(pi, F.lit(3.0), F.lit(1.0), y), 6).alias("pit"))


@query("fn11_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def fn11(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", we.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query("fn12_composite_key", "SELECT event_id, event_type AS station, CAST(user_id % 7 AS INT) AS hours FROM events")
def fn12(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.col("event_type"), F.lit("/window_"), (F.col("user_id") % 7).cast("string"), F.lit("h"))
    e = read(spark, d, "events").withColumn("key", key)
    return e.select("event_id", F.regexp_extract("key", "^(.*)/window_", 1).alias("station"), F.regexp_extract("key", r"/window_(\d+)h$", 1).cast("int").alias("hours"))


@query("fn13_feature_hash", EVENTS_SQL + " SELECT event_id, sha256(printf('%.6f', value) || '|' || CASE WHEN c > 0.5 THEN 'null' ELSE printf('%.6f', value) END) AS h FROM e")
def fn13(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("maybe", F.when(F.col("c") <= 0.5, F.col("value")))
    return e.select("event_id", we.feature_hash(["value", "maybe"]).alias("h"))


@query("fn14_local_days", "SELECT day, timezone('UTC', timezone('Europe/London', day + INTERVAL 9 HOURS)) AS utc_start, timezone('UTC', timezone('Europe/London', day + INTERVAL 18 HOURS)) AS utc_end, date_diff('hour', timezone('UTC', timezone('Europe/London', day + INTERVAL 9 HOURS)), timezone('UTC', timezone('Europe/London', day + INTERVAL 18 HOURS))) AS utc_hours FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)")
def fn14(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *we.day_range_utc(F.col("day"), "Europe/London", 9, 18))


@query("fn15_units", EVENTS_SQL + " SELECT event_id, round(value * 0.514444::DOUBLE, 6) AS ms, round((value - 32) * 5 / 9, 6) AS c, round(value * 33.8639::DOUBLE, 4) AS hpa, CASE event_type WHEN 'click' THEN 0.0 WHEN 'error' THEN 22.5 END AS deg FROM e")
def fn15(spark: SparkSession, d: str) -> DataFrame:
    point = F.when(F.col("event_type") == "click", "n").when(F.col("event_type") == "error", "nne").otherwise("?")
    return events(spark, d).select("event_id", F.round(F.col("value") * we.KNOTS, 6).alias("ms"), F.round(we.celsius(F.col("value")), 6).alias("c"), F.round(F.col("value") * we.INHG, 4).alias("hpa"), we.compass(point).alias("deg"))


@query("fn16_scoring_curves", EVENTS_SQL + ", x AS (SELECT *, least(1, greatest(0, (value - 20) / 60)) AS u FROM e) SELECT event_id, round(CASE WHEN t <= 5 THEN 0.4 WHEN t <= 12 THEN 0.4::DOUBLE + (t - 5) * (0.6::DOUBLE / 7) WHEN t <= 20 THEN 1 WHEN t <= 30 THEN 1 - (t - 20) * (0.85::DOUBLE / 10) ELSE 0.15 END, 6) AS comfort, round(u * u * (3 - 2 * u), 6) AS step FROM x")
def fn16(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(we.piecewise(F.col("t"), ((5, 0.4), (12, 1.0), (20, 1.0), (30, 0.15))), 6).alias("comfort"), F.round(we.smoothstep(F.col("value"), 20, 80), 6).alias("step"))
