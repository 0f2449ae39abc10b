"""Training tables in full: the terrain block over all stations, exact runs in tiers, and the summary of stored artefacts."""

from __future__ import annotations

import datetime as dt

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import weather as we
from ..operators import dedup as dd, models as ml
from ..sources.shared import shared_folder, written
from .basics import CELL
from .details import COMPOSED_SQL, HOURS, composed, picked, picks
from .registry import query
from .scoring import WIDE_SQL, three
from .views import fcst, read

#: Wind direction, wind speed, dew point and pressure beside each forecast, as the driver's rows have one measure.
AUX = {"rad": "radians(x * 3.6D)", "speed": "CAST(event_id % 97 AS DOUBLE) / 5", "dew": "CASE WHEN event_id % 11 > 0 THEN CAST(event_id * 7 % 101 AS DOUBLE) / 5 END", "surface": "1000.0D + event_id % 31"}
AUX_SQL = ", ".join(f"{e.replace('3.6D', '3.6::DOUBLE').replace('1000.0D', '1000.0::DOUBLE')} AS {k}" for k, e in AUX.items())
MEANS = {"sine": "avg(sin(rad))", "cosine": "avg(cos(rad))", "speed": "avg(speed)", "dew": "avg(dew)", "surface": "avg(surface)"}
#: Of each station: height over its cell, relief, ruggedness, the slope to the east and the north. The gain of sector s is (5 * station + 3 * s) % 8.
SITE = {"elevation": "n_nationkey * 10.0 - 5", "relief": "20.0 + 3 * n_nationkey", "ruggedness": "2.0 + 1.5 * n_nationkey", "dx": "(n_regionkey - 2) / 10.0", "dy": "(n_nationkey - 12) / 100.0"}
BLOCK = ("wind_sin", "wind_cos", "upwind_gain", "uplift", "uplift_humidity")


def terrain(spark: SparkSession, d: str) -> DataFrame:
    """A row for each station: 25 at every size."""
    sites = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS station", *[f"CAST({e} AS DOUBLE) AS {k}" for k, e in SITE.items()])
    return sites.withColumn("gains", F.array(*[((5 * F.col("station") + 3 * s) % 8).cast("double") for s in range(8)]))


@query("ts5_terrain_block", COMPOSED_SQL + f""", aux AS (SELECT station, valid, lead, {', '.join(f'{e} AS {k}' for k, e in MEANS.items())} FROM (SELECT station, valid, lead, {AUX_SQL} FROM latest) GROUP BY ALL),
site AS (SELECT CAST(n_nationkey AS INT) AS station, {', '.join(f'CAST({e} AS DOUBLE) AS {k}' for k, e in SITE.items())} FROM nation),
bl AS (SELECT aux.station, valid, lead, elevation, relief, ruggedness, sine, cosine, (5 * station + 3 * (CAST(floor(((degrees(atan2(sine, cosine)) + 360) % 360 + 22.5::DOUBLE) / 45) AS INT) % 8)) % 8 AS gain,
greatest(0, -speed * sine * dx - speed * cosine * dy) AS up, surface, 6.112::DOUBLE * exp(17.62::DOUBLE * dew / (dew + 243.12::DOUBLE)) AS e FROM aux JOIN site USING (station))
SELECT rich.*, elevation, relief, ruggedness, round(sine, 9) AS wind_sin, round(cosine, 9) AS wind_cos, CAST(gain AS DOUBLE) AS upwind_gain, round(up, 9) AS uplift,
round(up * CASE WHEN e IS NULL THEN 0 ELSE greatest(0, 622 * e / (surface - 0.378::DOUBLE * e)) END, 9) AS uplift_humidity FROM rich JOIN bl USING (station, valid, lead)""")
def ts5_full(spark: SparkSession, d: str) -> DataFrame:
    """The composed wet table of all stations with nine terrain features, the station among them; means over models come from the pass that spreads the models."""
    means = [F.expr(e).alias(f"__{k}") for k, e in MEANS.items()]
    t = composed(spark, d, AUX, *means).join(F.broadcast(terrain(spark, d)), "station")
    block = we.terrain_block(F.col("__speed"), F.col("__sine"), F.col("__cosine"), F.col("__dew"), F.col("__surface"), F.col("gains"), F.col("dx"), F.col("dy"))
    return t.withColumns({k: F.round(c, 9) for k, c in block.items()}).drop("gains", "dx", "dy", *[f"__{k}" for k in MEANS])


#: A tier: the day from which its models are there, and those that a row must have.
TIERS = {"long": ("2024-01-01", ("click", "error")), "short": ("2024-01-10", ("click", "error", "view"))}
AIR = ("click", "error", "view")
UPPER = {"t850": "CAST(event_id % 61 AS DOUBLE) / 2 - 15", "rh850": "CAST(event_id * 7 % 101 AS DOUBLE)"}
LEAST = 4


@query("ts9_tiers_by_lead", f""", own AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in UPPER.items())} FROM fcst WHERE run = valid - to_hours(lead) AND hour(valid) IN (0, 6, 12, 18) AND model IN {AIR} AND (model <> 'click' OR hour(run) IN (0, 12))
QUALIFY row_number() OVER (PARTITION BY station, model, valid, lead ORDER BY run DESC, event_id DESC) = 1),
w AS (SELECT station, valid, lead, {', '.join(f"max({v}) FILTER (model = '{m}') AS {n}" for m in AIR for v, n in (('x', m), ('t850', f't850_{m}'), ('rh850', f'rh850_{m}')))}, avg(t850) AS t850_mean, avg(rh850) AS rh850_mean FROM own GROUP BY ALL),
av AS (SELECT station, valid, t.lead, x AS averaged FROM fcst JOIN (VALUES (24), (48), (72)) t(lead) ON abs(date_diff('hour', run, valid) - t.lead) = 3 WHERE model = 'signup' AND hour(run) IN (3, 15) QUALIFY row_number() OVER (PARTITION BY station, valid, t.lead ORDER BY run DESC, event_id DESC) = 1),
ob AS (SELECT CAST(user_id % 3 AS INT) AS station, time_bucket(INTERVAL 6 HOURS, ts) AS valid, avg(value) AS y FROM events GROUP BY ALL HAVING count(*) >= {LEAST}),
ti AS ({' UNION ALL '.join(f"SELECT '{t}' AS tier, * FROM w WHERE valid >= TIMESTAMP '{day}' AND " + ' AND '.join(f'{m} IS NOT NULL' for m in need) for t, (day, need) in TIERS.items())})
SELECT ti.* REPLACE (round(t850_mean, 9) AS t850_mean, round(rh850_mean, 9) AS rh850_mean), averaged, CAST(y >= 45 AS INT) AS wet FROM ti JOIN ob USING (station, valid) LEFT JOIN av USING (station, valid, lead)""")
def ts9_full(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose age is the lead exactly, one model on its main cycles alone; upper air of each model and its mean; another model by its averaging picks, where there is one; truth of whole slots; a row in each tier that it qualifies for."""
    f = fcst(spark, d)
    exact = F.timestamp_diff("HOUR", F.col("run"), F.col("valid")) == F.col("lead")
    own = f.where(exact & F.hour("valid").isin(*HOURS) & F.col("model").isin(*AIR) & ((F.col("model") != "click") | F.hour("run").isin(0, 12)))
    own = dd.latest(own, CELL, ["run", "event_id"]).withColumns({k: F.expr(e) for k, e in UPPER.items()})
    pivots = [F.max(F.when(F.col("model") == m, F.col(v))).alias(n) for m in AIR for v, n in (("x", m), ("t850", f"t850_{m}"), ("rh850", f"rh850_{m}"))]
    w = own.groupBy("station", "valid", "lead").agg(*pivots, *[F.round(F.avg(k), 9).alias(f"{k}_mean") for k in UPPER])
    fits = [F.when((F.col("valid") >= F.lit(f"{day} 00:00:00").cast("timestamp_ntz")) & F.expr(" AND ".join(f"{m} IS NOT NULL" for m in need)), t) for t, (day, need) in TIERS.items()]
    w = w.withColumn("tier", F.explode(F.array_compact(F.array(*fits))))
    around = picks(spark).where("strategy = 'averaging' AND target > 12").select("target", "valid_hour", "run_hour", "days", "age")
    averaged = dd.latest(picked(f.where("model = 'signup'"), around).drop("lead"), ["station", "valid", "target"], ["run", "event_id"]).select("station", "valid", F.col("target").alias("lead"), F.col("x").alias("averaged"))
    slots = f.groupBy("station", "valid").agg(F.avg("x").alias("y"), F.count("*").alias("n")).where(F.col("n") >= LEAST)
    return w.join(slots.select("station", "valid", (F.col("y") >= 45).cast("int").alias("wet")), ["station", "valid"]).join(averaged, ["station", "valid", "lead"], "left")


#: A phase of artefacts: the one feature that its models have. Each is trained again after so many days of the table.
PHASES, AGES = ("mean", "click"), (15, 22)


def artefacts(spark: SparkSession, t: DataFrame) -> list[str]:
    """A stored artefact for each phase and cutoff, with a linear model for each lead that has rows before and after it; their folders. t: (lead, valid, y, mean, click, error, view)."""
    first = t.agg(F.min("valid")).first()[0]
    roots = []
    for cutoff in [first + dt.timedelta(days=n) for n in AGES] if first else []:
        before = F.col("valid") < F.lit(cutoff).cast("timestamp_ntz")
        leads = [r.lead for r in t.groupBy("lead").agg(F.count_if(before).alias("a"), F.count_if(~before).alias("b")).where("a > 0 AND b > 0").select("lead").collect()]
        for phase in PHASES if leads else ():
            rows = VectorAssembler(inputCols=[phase], outputCol="x").transform(t)
            fits = {lead: LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(rows.where(before & (F.col("lead") == lead))) for lead in leads}
            scored = None
            for lead, model in fits.items():
                p = model.transform(rows.where(~before & (F.col("lead") == lead)))
                scored = p if scored is None else scored.unionByName(p)
            error = lambda c: F.avg(F.abs(F.col(c) - F.col("y")))
            found = scored.groupBy("lead").agg(error("prediction").alias("test_mae"), F.least(*map(error, AIR)).alias("best_mae")).collect()  # a row for each lead
            roots.append(shared_folder(spark, f"artefact-{phase}"))
            ml.store(spark, roots[-1], fits, [phase], cutoff, {r.lead: {"test_mae": r.test_mae, "best_mae": r.best_mae} for r in found})
    return roots


@query("dq5_stored_artefacts", WIDE_SQL + f""", m AS (SELECT *, (click + error + view) / 3 AS mean FROM t3 WHERE click + error + view IS NOT NULL),
k AS (SELECT phase, (SELECT min(valid) FROM m) + to_days(days) AS cutoff FROM (VALUES ('mean'), ('click')) p(phase), (VALUES (15), (22)) c(days)),
r AS (SELECT phase, cutoff, CASE phase WHEN 'mean' THEN mean ELSE click END AS f, m.* FROM m, k),
fit AS (SELECT phase, cutoff, lead, regr_slope(y, f) AS s, regr_intercept(y, f) AS i FROM r WHERE valid < cutoff GROUP BY ALL),
e AS (SELECT phase, cutoff, lead, avg(abs(s * f + i - y)) AS test_mae, least(avg(abs(click - y)), avg(abs(error - y)), avg(abs(view - y))) AS best_mae FROM r JOIN fit USING (phase, cutoff, lead) WHERE valid >= cutoff GROUP BY ALL)
SELECT phase, lead, cutoff, round(test_mae, 6) AS test_mae, round(best_mae, 6) AS best_mae, round(100 * (test_mae - best_mae) / nullif(best_mae, 0), 6) AS percent FROM e QUALIFY row_number() OVER (PARTITION BY phase, lead ORDER BY cutoff DESC) = 1""")
def dq5_full(spark: SparkSession, d: str) -> DataFrame:
    """Models fitted and stored at two cutoffs in two phases; of each phase and lead the newest artefact, read back from its folder, beside the best single source of its test rows."""
    t = three(spark, d, *AIR).where("click + error + view IS NOT NULL").withColumn("mean", (F.col("click") + F.col("error") + F.col("view")) / 3)
    t = written(t.select("station", "lead", "valid", "y", "mean", *AIR), "phases")
    roots = artefacts(spark, t)
    kind = "phase string, lead int, cutoff timestamp_ntz, test_mae double, best_mae double, percent double"
    if not roots:
        return spark.createDataFrame([], kind)
    found = ml.about(spark, *roots).withColumn("phase", F.col("features")[0])
    s = ml.retrain_summary(found, ["phase"], dt.datetime(1970, 1, 1))
    return s.select("phase", F.col("lead").cast("int").alias("lead"), "cutoff", *[F.round(c, 6).alias(c) for c in ("test_mae", "best_mae", "percent")])
