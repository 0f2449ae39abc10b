"""Training tables of single measures: one form, configured by a spec; each measure is one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import weather as we
from ..operators import dedup as dd, joins as jn, windows as wn
from .basics import CELL, rounded
from .registry import query
from .views import WET, fcst, hourly, read, truth


@dataclass(frozen=True)
class Spec:
    """Which models a measure needs and may have, the leads it is built for, and its truth column."""

    required: Sequence[str]
    optional: Sequence[str]
    leads: Sequence[int]
    truth: str = "y"


def element_table(cells: DataFrame, observed: DataFrame, spec: Spec, *extra) -> DataFrame:
    """Latest cells by model, spread over all models of the spec, calendar angles and truth; rows lacking a required model are left out."""
    models = [*spec.required, *spec.optional]
    wide = cells.where(F.col("lead").isin(*spec.leads)).groupBy("station", "valid", "lead").agg(*[F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in models])
    for m in spec.required:
        wide = wide.where(F.col(m).isNotNull())
    mean, std, span, top = we.row_spread(models)
    return wide.join(observed, ["station", "valid"]).where(F.col(spec.truth).isNotNull()).select("station", "valid", "lead", *models, spec.truth, mean, std, span, top, *extra)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), CELL, ["run", "event_id"])


def table_sql(spec: Spec, extra: str = "") -> str:
    models = [*spec.required, *spec.optional]
    among = ", ".join(f"'{m}'" for m in models)
    cols = ", ".join(f"max(x) FILTER (model = '{m}') AS {m}" for m in models)
    need = " AND ".join(f"{m} IS NOT NULL" for m in spec.required)
    return f""", w AS (SELECT station, valid, lead, {cols}, avg(x) AS mean, sqrt(greatest(0, avg(x * x) - avg(x) ** 2)) AS std, max(x) - min(x) AS range, max(x) AS largest FROM latest
WHERE lead IN ({', '.join(map(str, spec.leads))}) AND model IN ({among}) GROUP BY ALL)
SELECT station, valid, lead, {', '.join(models)}, round(y, 9) AS y, round(mean, 9) AS mean, round(std, 4) AS std, round(range, 6) AS range, largest{extra} FROM w JOIN truth USING (station, valid) WHERE {need}"""


def finished(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.round(c, 9) for c in ("y", "mean")}).withColumn("std", F.round("std", 4)), "range")


HUMIDITY = Spec(("click", "error"), ("purchase",), (24, 48, 72))
WIND = Spec(("click",), ("error", "signup", "view"), (24, 48))
CLOUD = Spec(("purchase", "signup"), ("view",), (24, 48))
RADIATION = Spec(("error",), ("view",), (24,))
GUST = Spec(("click", "signup"), (), (24, 48, 72))


@query("ts10_humidity_table", table_sql(HUMIDITY))
def ts10(spark: SparkSession, d: str) -> DataFrame:
    return finished(element_table(cells(spark, d), truth(spark, d), HUMIDITY))


@query("ts11_wind_table", table_sql(WIND))
def ts11(spark: SparkSession, d: str) -> DataFrame:
    return finished(element_table(cells(spark, d), truth(spark, d), WIND))


@query("ts12_cloud_table", table_sql(CLOUD, ", least(100, largest) AS capped"))
def ts12(spark: SparkSession, d: str) -> DataFrame:
    return finished(element_table(cells(spark, d), truth(spark, d), CLOUD, F.least(F.lit(100.0), F.greatest("purchase", "signup", "view")).alias("capped")))


@query("ts13_radiation_table", table_sql(RADIATION, ", hour(valid) BETWEEN 6 AND 18 AS daylight"))
def ts13(spark: SparkSession, d: str) -> DataFrame:
    return finished(element_table(cells(spark, d), truth(spark, d), RADIATION, F.hour("valid").between(6, 18).alias("daylight")))


@query("ts14_gust_table", table_sql(GUST, ", round(least(4, greatest(0.5, click / greatest(signup, 0.5))), 6) AS ratio"))
def ts14(spark: SparkSession, d: str) -> DataFrame:
    return finished(element_table(cells(spark, d), truth(spark, d), GUST, F.round(we.gust_ratio(F.col("click"), F.col("signup")), 6).alias("ratio")))


RICH_SQL = """, hs AS (SELECT station, hour, v, date_diff('hour', TIMESTAMP '1970-01-01', hour) AS k FROM hourly),
past AS (SELECT station, hour, CASE WHEN count(v) OVER w = 3 THEN sum(v) OVER w END AS sum_3 FROM hs WINDOW w AS (PARTITION BY station ORDER BY k RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
slope AS (SELECT station, valid, avg(s) AS slope_mean, count(s) AS slopes FROM (SELECT station, valid, model, regr_slope(x, lead) AS s FROM latest WHERE lead > 24 GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
w AS (SELECT station, valid, max(run) AS run, avg(x) AS mean, avg(CAST(x >= 45 AS INT)) AS share FROM latest WHERE lead = 24 GROUP BY ALL)"""


def rich(spark: SparkSession, d: str) -> DataFrame:
    """Lead 24: mean and wet share over models, what had fallen by the time of the newest run, and the lead-safe trend."""
    c = cells(spark, d)
    base = c.where("lead = 24").groupBy("station", "valid").agg(F.max("run").alias("run"), F.avg("x").alias("mean"), F.avg((F.col("x") >= WET).cast("int")).alias("share"))
    past = wn.trailing(hourly(spark, d).drop("n"), ["station"], "hour", "v", 3, WET).select("station", F.col("hour").alias("run"), "sum_3")
    slopes = c.where("lead > 24").groupBy("station", "valid", "model").agg(F.regr_slope("x", "lead").alias("s"), F.count("*").alias("k")).where("k >= 2")
    slopes = slopes.groupBy("station", "valid").agg(F.avg("s").alias("slope_mean"), F.count("s").alias("slopes"))
    return base.join(past, ["station", "run"], "left").join(slopes, ["station", "valid"], "left").join(truth(spark, d), ["station", "valid"])


@query("ts4_rich_wet_table", RICH_SQL + " SELECT w.station, valid, run, round(mean, 9) AS mean, round(share, 6) AS share, round(sum_3, 6) AS sum_3, round(slope_mean, 9) AS slope_mean, slopes, CAST(y >= 45 AS INT) AS wet FROM w JOIN truth USING (station, valid) LEFT JOIN past ON past.station = w.station AND past.hour = run LEFT JOIN slope USING (station, valid)")
def ts4(spark: SparkSession, d: str) -> DataFrame:
    r = rich(spark, d).withColumn("wet", (F.col("y") >= WET).cast("int")).drop("y").withColumns({c: F.round(c, 9) for c in ("mean", "slope_mean")})
    return rounded(r, "share", "sum_3")


@query("ts5_pooled_terrain_table", RICH_SQL + " SELECT w.station, valid, round(share, 6) AS share, n_name AS terrain, round(greatest(0, (mean - 50) * n_regionkey), 6) AS uplift FROM w JOIN truth USING (station, valid) JOIN nation ON n_nationkey = w.station")
def ts5(spark: SparkSession, d: str) -> DataFrame:
    """All stations in one table, with a small table of their terrain; the station stays a column."""
    terrain = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS station", "n_name AS terrain", "CAST(n_regionkey AS DOUBLE) AS dx")
    r = rich(spark, d).join(F.broadcast(terrain), "station")
    return rounded(r.select("station", "valid", "share", "terrain", we.uplift(F.col("mean") - 50, F.lit(0.0), F.col("dx"), F.lit(0.0)).alias("uplift")), "share", "uplift")


@query("ts9_exact_wet_tiers", """, a AS (SELECT station, valid, lead, max(x) FILTER (model = 'click') AS click, max(x) FILTER (model = 'error') AS error FROM latest WHERE hour(valid) IN (0, 6, 12, 18) GROUP BY ALL),
u AS (SELECT station, valid, event_id, x FROM fcst WHERE model = 'view' QUALIFY row_number() OVER (PARTITION BY station, valid ORDER BY event_id DESC) = 1)
SELECT a.station, a.valid, a.lead, click, error, u.valid AS asof, u.x AS upper FROM a ASOF LEFT JOIN u ON a.station = u.station AND a.valid >= u.valid WHERE click IS NOT NULL AND error IS NOT NULL""")
def ts9(spark: SparkSession, d: str) -> DataFrame:
    """Exact runs on the hour grid, required models together, and the latest upper-air value at or before each valid time."""
    wide = cells(spark, d).where(F.hour("valid").isin(0, 6, 12, 18)).groupBy("station", "valid", "lead").agg(*[F.max(F.when(F.col("model") == m, F.col("x"))).alias(m) for m in ("click", "error")])
    upper = dd.latest(fcst(spark, d).where("model = 'view'"), ["station", "valid"], ["event_id"]).withColumnRenamed("x", "upper")
    return jn.asof_join(wide.where("click IS NOT NULL AND error IS NOT NULL"), upper, ["station"], "valid", "valid", ["upper"], lambda t: F.year(t) * 12 + F.month(t))


