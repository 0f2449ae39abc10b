"""Queries that verify, calibrate and pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import calibrate as cal, dedup as dd, joins as jn, pooling as po, verify as vf, windows as wn
from .basics import PIVOT_SQL, ROLLING, rounded, side_by_side, wide
from .registry import query
from .views import MODELS, WET, hourly, pred, prob, truth

ERRORS_SQL = "round(avg(abs(f - y)), 6) AS mae, round(sqrt(avg((f - y) * (f - y))), 6) AS rmse, round(avg(f - y), 6) AS bias, count(f - y) AS n"


def scores(df: DataFrame, keys: list[str]) -> DataFrame:
    return rounded(df.groupBy(*keys).agg(*vf.errors("f", "y")), "mae", "rmse", "bias")


@query("ev1_errors", f"SELECT version, lead, {ERRORS_SQL} FROM pred GROUP BY ALL")
def ev1(spark: SparkSession, d: str) -> DataFrame:
    return scores(pred(spark, d), ["version", "lead"])


@query("ev2_stratified_mae", """SELECT version, quintile, CASE WHEN y % 360 >= 315 OR y % 360 < 45 THEN 'N' WHEN y % 360 < 135 THEN 'E' WHEN y % 360 < 225 THEN 'S' ELSE 'W' END AS quadrant, round(avg(abs(f - y)), 6) AS mae, count(*) AS n FROM (
SELECT *, CAST(least(4, floor((row_number() OVER (PARTITION BY version ORDER BY y, station, valid, lead) - 1) * 5 / count(*) OVER (PARTITION BY version))) AS INT) AS quintile FROM pred) GROUP BY ALL""")
def ev2(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.weather import quadrant

    q = wn.quintile(pred(spark, d), ["version"], ["y", "station", "valid", "lead"])
    return rounded(q.groupBy("version", "quintile", quadrant(F.col("y")).alias("quadrant")).agg(F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"), F.count("*").alias("n")), "mae")


@query("ev3_brier_skill", """, b AS (SELECT *, avg(wet) OVER (PARTITION BY month(valid), hour(valid)) AS clim FROM pred)
SELECT version, station, lead, round(avg((p - wet) * (p - wet)), 6) AS brier, round(avg((clim - wet) * (clim - wet)), 6) AS reference, count(*) AS n,
round(1 - avg((p - wet) * (p - wet)) / nullif(avg((clim - wet) * (clim - wet)), 0), 6) AS skill FROM b GROUP BY ALL""")
def ev3(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d).withColumns({"m": F.month("valid"), "h": F.hour("valid")})
    p = p.join(cal.climatology(p, ["m", "h"], "wet"), ["m", "h"])
    return rounded(vf.brier_scores(p, ["version", "station", "lead"], "p", "wet", "clim"), "brier", "reference", "skill")


@query("ev4_reliability", """, b AS (SELECT *, CAST(least(9, floor(p * 10)) AS INT) AS bin FROM pred)
SELECT v.version, s.bin, count(b.p) AS n, round(avg(b.p), 6) AS mean_p, round(avg(b.wet), 6) AS observed
FROM (SELECT DISTINCT version FROM pred) v CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(10)) s LEFT JOIN b ON b.version = v.version AND b.bin = s.bin GROUP BY ALL""")
def ev4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vf.reliability(pred(spark, d), ["version"], "p", "wet", 10), "mean_p", "observed")


@query("ev5_contingency", """, c AS (SELECT version, count(*) FILTER (f >= 45 AND wet = 1) AS hits, count(*) FILTER (f < 45 AND wet = 1) AS misses, count(*) FILTER (f >= 45 AND wet = 0) AS false_alarms, count(*) FILTER (f < 45 AND wet = 0) AS true_negatives FROM pred GROUP BY 1)
SELECT *, round(hits / nullif(hits + misses, 0), 6) AS hit_rate, round(false_alarms / nullif(hits + false_alarms, 0), 6) AS false_alarm_ratio, round(hits / nullif(hits + misses + false_alarms, 0), 6) AS csi, round((hits + false_alarms) / nullif(hits + misses, 0), 6) AS frequency_bias FROM c""")
def ev5(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d).withColumn("yes", (F.col("f") >= WET).cast("int"))
    return rounded(p.groupBy("version").agg(*vf.contingency("yes", "wet")), "hit_rate", "false_alarm_ratio", "csi", "frequency_bias")


LEVELS = (0.1, 0.3, 0.5, 0.7, 0.9)
QUANTILES_SQL = "q AS (SELECT station, lead, valid, any_value(y) AS y, list_sort(list(f)) AS q FROM pred GROUP BY ALL HAVING count(*) = 5)"


def members(spark: SparkSession, d: str) -> DataFrame:
    """The five models of a cell, sorted, where all are there."""
    g = pred(spark, d).groupBy("station", "lead", "valid").agg(F.first("y").alias("y"), F.array_sort(F.collect_list("f")).alias("q"))
    return g.where(F.size("q") == 5)


PINBALL_SQL = " + ".join(f"greatest((y - q[{i + 1}]) * {v}, (q[{i + 1}] - y) * (1 - {v}::DOUBLE))" for i, v in enumerate(LEVELS))


@query("ev6_crps_quantiles", f", {QUANTILES_SQL} SELECT lead, round(avg(({PINBALL_SQL}) * 0.4), 6) AS crps, round(avg(abs(q[3] - y)), 6) AS crps_single FROM q GROUP BY 1")
def ev6(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d)
    return rounded(m.groupBy("lead").agg(F.avg(vf.crps_quantiles(F.col("q"), LEVELS, F.col("y"))).alias("crps"), F.avg(F.abs(F.col("q")[2] - F.col("y"))).alias("crps_single")), "crps", "crps_single")


@query("ev7_crps_ensemble", f", {QUANTILES_SQL}, e AS (SELECT *, unnest(q) AS a FROM q), s AS (SELECT station, lead, valid, avg(abs(a - y)) AS near, any_value(q) AS q FROM e GROUP BY ALL), pairs AS (SELECT s.lead, s.station, s.valid, any_value(near) AS near, avg(abs(x.a - z.a)) AS apart FROM s JOIN e x USING (station, lead, valid) JOIN e z USING (station, lead, valid) GROUP BY ALL) SELECT lead, round(avg(near - apart / 2), 6) AS crps FROM pairs GROUP BY 1")
def ev7(spark: SparkSession, d: str) -> DataFrame:
    return rounded(members(spark, d).groupBy("lead").agg(F.avg(vf.crps_ensemble(F.col("q"), F.col("y"))).alias("crps")), "crps")


@query("ev8_amounts", f""", {QUANTILES_SQL}, pq AS (SELECT *, 0.6::DOUBLE AS pi, CASE WHEN y < 45 THEN 0 ELSE y END AS amount FROM q)
SELECT lead, count(*) AS n, round(avg(CAST(amount BETWEEN q[1] AND q[5] AS INT)), 6) AS covered, round(avg(abs(q[3] - amount)) FILTER (amount > 0), 6) AS wet_mae,
round(avg((pi * (CAST(q[1] > 60 AS INT) + CAST(q[2] > 60 AS INT) + CAST(q[3] > 60 AS INT) + CAST(q[4] > 60 AS INT) + CAST(q[5] > 60 AS INT)) / 5 - CAST(amount > 60 AS INT)) ** 2), 6) AS brier_60,
count(*) FILTER (amount = 0) AS dry FROM pq GROUP BY 1""")
def ev8(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).withColumns({"pi": F.lit(0.6), "amount": F.when(F.col("y") < WET, 0.0).otherwise(F.col("y"))})
    over = F.size(F.filter("q", lambda x: x > 60)) / 5
    return rounded(m.groupBy("lead").agg(F.count("*").alias("n"), F.avg(F.col("amount").between(F.col("q")[0], F.col("q")[4]).cast("double")).alias("covered"), F.avg(F.when(F.col("amount") > 0, F.abs(F.col("q")[2] - F.col("amount")))).alias("wet_mae"), F.avg(F.pow(F.col("pi") * over - (F.col("amount") > 60).cast("int"), F.lit(2.0))).alias("brier_60"), F.count_if(F.col("amount") == 0).alias("dry")), "covered", "wet_mae", "brier_60")


def verified(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """Per key: errors of the mean of models, the best single model, and the persistence error; nothing is collected."""
    p = pred(spark, d)
    mean = p.groupBy("station", "lead", "valid").agg(F.avg("f").alias("f"), F.first("y").alias("y"))
    past = jn.lagged(mean, truth(spark, d), ["station"], "valid", "y", F.col("lead"), "before")
    own = past.groupBy(*keys).agg(*vf.errors("f", "y"), F.avg(F.abs(F.col("before") - F.col("y"))).alias("persistence_mae"))
    return own.join(vf.best_single(p, keys, "version", "f", "y"), keys)


VERIFIED_SQL = """, m AS (SELECT station, lead, valid, avg(f) AS f, any_value(y) AS y FROM pred GROUP BY ALL),
o AS (SELECT m.station, m.lead, avg(abs(f - m.y)) AS mae, sqrt(avg((f - m.y) ** 2)) AS rmse, avg(f - m.y) AS bias, count(*) AS n, avg(abs(t.y - m.y)) AS persistence_mae FROM m LEFT JOIN truth t ON t.station = m.station AND t.valid = m.valid - to_hours(m.lead) GROUP BY ALL),
b AS (SELECT station, lead, version AS best, best_mae FROM (SELECT station, lead, version, avg(abs(f - y)) AS best_mae FROM pred GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY station, lead ORDER BY best_mae, version) = 1)"""
VERIFIED_COLUMNS = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, n, round(persistence_mae, 6) AS persistence_mae, best, round(best_mae, 6) AS best_mae"


@query("ev9_verification", f"{VERIFIED_SQL} SELECT station, lead, {VERIFIED_COLUMNS} FROM o JOIN b USING (station, lead)")
def ev9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(verified(spark, d, ["station", "lead"]), "mae", "rmse", "bias", "persistence_mae", "best_mae")


@query("ev10_actual_lead", f"SELECT version, CAST(date_diff('hour', made, valid) // 6 * 6 AS INT) AS bucket, {ERRORS_SQL} FROM pred GROUP BY ALL")
def ev10(spark: SparkSession, d: str) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.col("made"), F.col("valid"))
    return scores(pred(spark, d).withColumn("bucket", (F.floor(hours / 6) * 6).cast("int")), ["version", "bucket"])


@query("ev11_wet_verification", f"""SELECT station, version, lead, count(*) AS n, round(avg((p - wet) ** 2), 6) AS brier, round(avg(wet), 6) AS base_rate, round(avg(p), 6) AS mean_p FROM pred GROUP BY ALL""")
def ev11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pred(spark, d).groupBy("station", "version", "lead").agg(F.count("*").alias("n"), vf.brier("p", "wet").alias("brier"), F.avg("wet").alias("base_rate"), F.avg("p").alias("mean_p")), "brier", "base_rate", "mean_p")


@query("ev12_monthly_breakdown", f"SELECT version, month(valid) AS m, hour(valid) AS h, {ERRORS_SQL} FROM pred GROUP BY ALL")
def ev12(spark: SparkSession, d: str) -> DataFrame:
    return scores(pred(spark, d).withColumns({"m": F.month("valid").cast("long"), "h": F.hour("valid").cast("long")}), ["version", "m", "h"])


@query("ev13_day_buckets", f"SELECT version, CAST(greatest(0, lead - 1) // 24 * 24 + 24 AS INT) AS bucket, {ERRORS_SQL}, round(avg(CAST(y BETWEEN f - 20 AND f + 20 AS INT)), 6) AS covered FROM pred GROUP BY ALL")
def ev13(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d).withColumn("bucket", F.expr("CAST(greatest(0, lead - 1) DIV 24 * 24 + 24 AS INT)"))
    covered = F.avg(F.col("y").between(F.col("f") - 20, F.col("f") + 20).cast("double")).alias("covered")
    return rounded(p.groupBy("version", "bucket").agg(*vf.errors("f", "y"), covered), "mae", "rmse", "bias", "covered")


@query("ev16_drift_flags", f"{VERIFIED_SQL} SELECT station, lead, n >= 20 AND mae > (1.05 + 0.1::DOUBLE * (lead - 24) / 24) * best_mae AS drifted FROM o JOIN b USING (station, lead)")
def ev16(spark: SparkSession, d: str) -> DataFrame:
    v = verified(spark, d, ["station", "lead"])
    return v.select("station", "lead", vf.drift(F.col("mae"), F.col("n"), F.col("lead"), F.col("best_mae"), 20, 1.05, 0.1).alias("drifted"))


@query("ev17_best_single", f"{VERIFIED_SQL} SELECT station, lead, best, round(best_mae, 6) AS best_mae FROM b")
def ev17(spark: SparkSession, d: str) -> DataFrame:
    long = vf.unpivot(wide(spark, d), ["station", "valid", "lead"], MODELS, "version", "f").where("f IS NOT NULL").join(truth(spark, d), ["station", "valid"])
    return rounded(vf.best_single(long, ["station", "lead"], "version", "f", "y"), "best_mae")


@query("ev18_rolling_brier", ", " + ROLLING.format(keys="version, lead", v="(p - wet) ** 2") + " SELECT version, lead, day, round(sum(s) / sum(c), 6) AS mean, sum(c)::BIGINT AS n FROM days JOIN daily ON d BETWEEN day - 13 AND day GROUP BY ALL HAVING sum(c) > 0")
def ev18(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wn.rolling_mean(pred(spark, d), ["version", "lead"], "valid", F.pow(F.col("p") - F.col("wet"), F.lit(2.0)), 14), "mean")


@query("ev19_panel_buckets", """, k AS (SELECT *, date_diff('hour', made, valid) AS hours FROM pred), e AS (
SELECT station, version, valid, panel, f, y FROM k JOIN (VALUES (24, 48), (48, 72), (72, 96)) t(panel, upto) ON hours >= panel AND hours < upto QUALIFY row_number() OVER (PARTITION BY station, version, valid, panel ORDER BY hours, made DESC) = 1)
SELECT version, panel, count(*) AS n, round(avg(abs(f - y)), 6) AS mae FROM e GROUP BY ALL""")
def ev19(spark: SparkSession, d: str) -> DataFrame:
    leads = pred(spark, d).select("lead").distinct()  # a row for each panel lead
    bands = leads.select(F.col("lead").alias("panel"), (F.col("lead") + 24).alias("upto"))
    p = pred(spark, d).withColumn("hours", F.timestamp_diff("HOUR", F.col("made"), F.col("valid")))
    one = dd.latest_per_valid(jn.range_join(p, bands, "hours", "panel", "upto"), ["station", "version", "valid", "panel"], "hours", "made")
    return rounded(one.groupBy("version", "panel").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae")), "mae")


@query("ev20_pooled_rows", """, r AS (SELECT station, version, lead, count(*) AS n, avg(abs(f - y)) AS mae, avg((p - wet) ** 2) AS brier, avg(abs(f - y)) > 45 AS drifted FROM pred GROUP BY ALL)
SELECT version, lead, round(sum(mae * n) / sum(n), 6) AS mae, round(sum(brier * n) / sum(n), 6) AS brier, sum(n)::BIGINT AS n, bool_or(drifted) AS drifted, arg_max(station, n * 10 + station) AS station FROM r GROUP BY ALL""")
def ev20(spark: SparkSession, d: str) -> DataFrame:
    r = pred(spark, d).groupBy("station", "version", "lead").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"), vf.brier("p", "wet").alias("brier")).withColumn("drifted", F.col("mae") > 45)
    return rounded(vf.pool_rows(r, ["version", "lead"], "n", ["mae", "brier"], "drifted", "station"), "mae", "brier")


@query("ev21_phases_side_by_side", """, r AS (SELECT station, lead, version, count(*) AS n, avg(abs(f - y)) AS mae FROM pred GROUP BY ALL)
SELECT station, lead, median(n) AS median_n, """ + ", ".join(f"round(max(mae) FILTER (version = '{m}'), 6) AS {m}" for m in MODELS) + " FROM r GROUP BY ALL HAVING count(DISTINCT version) > 1")
def ev21(spark: SparkSession, d: str) -> DataFrame:
    r = pred(spark, d).groupBy("station", "lead", "version").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"))
    cells = r.groupBy("station", "lead").agg(F.percentile("n", 0.5).alias("median_n"), F.countDistinct("version").alias("k"), *[F.max(F.when(F.col("version") == m, F.round("mae", 6))).alias(m) for m in MODELS])
    return cells.where("k > 1").drop("k")


@query("ev23_freshness_ladder", """, h AS (SELECT CAST(user_id % 5 AS INT) AS station, time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS src, avg(value) AS f FROM events GROUP BY ALL)
SELECT src, count(*) AS n, count(*) FILTER (f >= 45 AND v >= 45) AS hits, count(*) FILTER (f < 45 AND v >= 45) AS misses, count(*) FILTER (f >= 45 AND v < 45) AS false_alarms,
round(count(*) FILTER (f >= 45 AND v >= 45) / count(*) FILTER (f >= 45 OR v >= 45), 6) AS csi, round(corr(f, v), 6) AS r FROM h JOIN hourly USING (station, hour) GROUP BY 1""")
def ev23(spark: SparkSession, d: str) -> DataFrame:
    from .views import read

    e = read(spark, d, "events").selectExpr("CAST(user_id % 5 AS INT) AS station", "CAST(to_date(ts) AS TIMESTAMP_NTZ) + make_dt_interval(0, hour(ts)) AS hour", "event_type AS src", "value")
    j = e.groupBy("station", "hour", "src").agg(F.avg("value").alias("f")).join(hourly(spark, d), ["station", "hour"])
    a, b = F.col("f") >= WET, F.col("v") >= WET
    return rounded(j.groupBy("src").agg(F.count("*").alias("n"), F.count_if(a & b).alias("hits"), F.count_if(~a & b).alias("misses"), F.count_if(a & ~b).alias("false_alarms"), F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("csi"), F.corr("f", "v").alias("r")), "csi", "r")


CONFORMAL_SQL = """, s AS (SELECT *, CASE WHEN wet = 1 THEN 1 - p ELSE p END AS s FROM pred), r AS (SELECT *, row_number() OVER (PARTITION BY station, version, lead ORDER BY s, valid) AS k, count(*) OVER (PARTITION BY station, version, lead) AS n FROM s),
th AS (SELECT station, version, lead, n, s AS threshold FROM r WHERE k = least(n, ceil(0.9::DOUBLE * (n + 1))))"""


@query("cal2_conformal_thresholds", CONFORMAL_SQL + " SELECT station, version, lead, n, round(threshold, 9) AS threshold FROM th")
def cal2(spark: SparkSession, d: str) -> DataFrame:
    t = cal.conformal_thresholds(pred(spark, d), ["station", "version", "lead"], "p", "wet", 0.1)
    return t.withColumn("threshold", F.round("threshold", 9))


@query("cal3_conformal_tags", CONFORMAL_SQL + " SELECT version, lead, CASE WHEN 1 - p <= threshold AND NOT p <= threshold THEN 'Wet' WHEN p <= threshold AND NOT 1 - p <= threshold THEN 'Dry' ELSE 'Ambiguous' END AS tag, count(*) AS n FROM pred JOIN th USING (station, version, lead) GROUP BY ALL")
def cal3(spark: SparkSession, d: str) -> DataFrame:
    p, keys = pred(spark, d), ["station", "version", "lead"]
    return cal.conformal_tag(p, cal.conformal_thresholds(p, keys, "p", "wet", 0.1), keys, "p").groupBy("version", "lead", "tag").agg(F.count("*").alias("n"))


@query("cal1_isotonic", """, cells AS (SELECT p AS x, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w FROM prob GROUP BY 1),
pre AS (SELECT x, s, w, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM cells),
ab AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS m FROM pre a JOIN pre b ON b.i >= a.i),
mi AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM ab),
fit AS (SELECT i, round(max(m), 12) AS value FROM mi GROUP BY 1), kn AS (SELECT (min(x) + max(x)) / 2 AS x, value FROM fit JOIN pre USING (i) GROUP BY value),
ln AS (SELECT x, value, lead(x) OVER (ORDER BY x) AS nx, lead(value) OVER (ORDER BY x) AS nv FROM kn),
j AS (SELECT prob.*, ln.x AS lx, ln.value, nx, nv FROM prob ASOF LEFT JOIN ln ON prob.p >= ln.x)
SELECT id, p, y, round(CASE WHEN lx IS NULL THEN (SELECT min_by(value, x) FROM kn) WHEN nx IS NULL THEN value ELSE value + (nv - value) * (p - lx) / (nx - lx) END, 9) AS calibrated FROM j""")
def cal1(spark: SparkSession, d: str) -> DataFrame:
    """The twin has each value as the largest of the least means over stretches around it."""
    p = prob(spark, d)
    return cal.apply_knots(p, cal.isotonic_knots(p, "p", "y"), "p").withColumn("calibrated", F.round("calibrated", 9))


@query("cal4_logistic_calibration")
def cal4(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    amount = pred(spark, d).select("station", "lead", "valid", "version", "wet", F.log1p(F.col("f") / 0.1).alias("z"))
    rows = VectorAssembler(inputCols=["z"], outputCol="x").transform(amount)
    model = LogisticRegression(featuresCol="x", labelCol="wet", regParam=0.0).fit(rows)
    z = float(model.intercept) + float(model.coefficients[0]) * F.col("z")
    return amount.select("station", "lead", "valid", "version", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


@query("cal5_wet_climatology", """, c AS (SELECT month(valid) AS m, hour(valid) AS h, avg(CAST(y >= 45 AS INT)) AS clim FROM truth WHERE station < 2 GROUP BY ALL)
SELECT station, valid, round(coalesce(clim, (SELECT avg(CAST(y >= 45 AS INT)) FROM truth WHERE station < 2)), 6) AS clim FROM truth LEFT JOIN c ON m = month(valid) AND h = hour(valid) WHERE station = 2""")
def cal5(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).select("station", "valid", F.month("valid").alias("m"), F.hour("valid").alias("h"), (F.col("y") >= WET).cast("int").alias("wet"))
    train = t.where("station < 2")
    out = cal.with_climatology(t.where("station = 2"), cal.climatology(train, ["m", "h"], "wet"), ["m", "h"], train.agg(F.avg("wet").alias("clim_all")))
    return rounded(out.select("station", "valid", "clim"), "clim")


@query("cal6_value_climatology", "SELECT station, month(valid) AS m, hour(valid) AS h, round(avg(y), 6) AS clim FROM truth GROUP BY ALL")
def cal6(spark: SparkSession, d: str) -> DataFrame:
    t = truth(spark, d).withColumns({"m": F.month("valid").cast("long"), "h": F.hour("valid").cast("long")})
    return rounded(cal.climatology(t, ["station", "m", "h"], "y"), "clim")


WIDE_SQL = f", w AS (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL), t3 AS (SELECT w.*, y, CAST(y >= 45 AS INT) AS wet, click / (click + 50) AS pa, error / (error + 50) AS pb, view / (view + 50) AS pc FROM w JOIN truth USING (station, valid))"


def three(spark: SparkSession, d: str, *models: str) -> DataFrame:
    """Probabilities of some models side by side, with the outcome."""
    first = side_by_side(spark, d, *models).withColumns({f"p{'abc'[i]}": F.col(m) / (F.col(m) + 50) for i, m in enumerate(models)})
    return first.join(truth(spark, d), ["station", "valid"]).withColumn("wet", (F.col("y") >= WET).cast("int"))


@query("pool1_mean_of_three", WIDE_SQL + " SELECT lead, count(*) AS n, round(avg(((pa + pb + pc) / 3 - wet) ** 2), 6) AS pooled, round(avg((pa - wet) ** 2), 6) AS a, round(avg((pb - wet) ** 2), 6) AS b, round(avg((pc - wet) ** 2), 6) AS c FROM t3 WHERE pa IS NOT NULL AND pb IS NOT NULL AND pc IS NOT NULL GROUP BY 1")
def pool1(spark: SparkSession, d: str) -> DataFrame:
    t = three(spark, d, "click", "error", "view").withColumn("pool", po.mean_of("pa", "pb", "pc"))
    return rounded(t.groupBy("lead").agg(F.count("*").alias("n"), *[vf.brier(c, "wet").alias(n) for c, n in (("pool", "pooled"), ("pa", "a"), ("pb", "b"), ("pc", "c"))]), "pooled", "a", "b", "c")


@query("pool2_best_weight", WIDE_SQL + " SELECT station, lead, round(least(1, greatest(0, coalesce(sum((wet - pb) * (pa - pb)) / nullif(sum((pa - pb) ** 2), 0), 0.5))), 6) AS weight FROM t3 WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL")
def pool2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(po.best_weight(three(spark, d, "click", "error"), ["station", "lead"], "pa", "pb", "wet"), "weight")


@query("pool3_logit_weight", WIDE_SQL + """, g AS (SELECT station, lead, k / 20.0::DOUBLE AS weight, avg((1 / (1 + exp(-(ln(pa / (1 - pa)) * (k / 20.0::DOUBLE) + ln(pb / (1 - pb)) * (1 - k / 20.0::DOUBLE)))) - wet) ** 2) AS brier FROM t3, range(21) r(k) WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY ALL)
SELECT station, lead, weight, round(brier, 6) AS brier FROM g QUALIFY row_number() OVER (PARTITION BY station, lead ORDER BY brier, weight) = 1""")
def pool3(spark: SparkSession, d: str) -> DataFrame:
    return rounded(po.best_logit_weight(three(spark, d, "click", "error"), ["station", "lead"], "pa", "pb", "wet"), "brier")


@query("pool4_station_weights", "SELECT version, lead, valid, round(sum(p * (r_regionkey + 1)) / sum(r_regionkey + 1), 6) AS p FROM pred JOIN region ON r_regionkey = station GROUP BY ALL HAVING count(DISTINCT station) = 3")
def pool4(spark: SparkSession, d: str) -> DataFrame:
    from .views import read

    w = read(spark, d, "region").selectExpr("CAST(r_regionkey AS INT) AS station", "CAST(r_regionkey + 1 AS DOUBLE) AS weight")
    return rounded(po.weighted_composite(pred(spark, d), w, "station", ["version", "lead", "valid"], "p", 3), "p")


POLICY_SQL = """, c AS (SELECT version, CAST(hour(valid) AS INT) AS band, lead AS candidate, valid < TIMESTAMP '2024-01-21' AS early, avg((p - wet) ** 2) AS score FROM pred GROUP BY ALL)"""


def policy_scores(spark: SparkSession, d: str) -> DataFrame:
    """Brier score of each candidate lead by version, band and part of the record."""
    p = pred(spark, d).withColumns({"band": F.hour("valid"), "early": F.col("valid") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")})
    return p.groupBy("version", "band", F.col("lead").alias("candidate"), "early").agg(vf.brier("p", "wet").alias("score"))


@query("pool5_lead_policy_fit", POLICY_SQL + " SELECT version, band, candidate, round(max(score) FILTER (early), 6) AS selected_on, round(max(score) FILTER (NOT early), 6) AS graded_on FROM c GROUP BY ALL")
def pool5(spark: SparkSession, d: str) -> DataFrame:
    s = policy_scores(spark, d).groupBy("version", "band", "candidate")
    return rounded(s.agg(F.max(F.when(F.col("early"), F.col("score"))).alias("selected_on"), F.max(F.when(~F.col("early"), F.col("score"))).alias("graded_on")), "selected_on", "graded_on")


@query("pool6_band_decision", POLICY_SQL + """, b AS (SELECT version, band, min(score) FILTER (candidate = 48) AS own, arg_min(candidate, score) AS best, min(score) AS top FROM c WHERE early GROUP BY ALL)
SELECT version, band, CASE WHEN own IS NOT NULL AND top > own * (1 - 0.05::DOUBLE) THEN 48 ELSE best END AS chosen, round(CASE WHEN own IS NOT NULL AND top > own * (1 - 0.05::DOUBLE) THEN own ELSE top END, 6) AS score,
NOT (own IS NOT NULL AND top > own * (1 - 0.05::DOUBLE)) AND best <> 48 AS changed FROM b""")
def pool6(spark: SparkSession, d: str) -> DataFrame:
    s = policy_scores(spark, d).where("early").withColumn("incumbent", F.lit(48))
    return rounded(po.decide_band(s, ["version", "band"], "incumbent", 0.05), "score")


@query("pool7_apply_policy", """SELECT p.version, p.station, p.valid, coalesce(b.use, 72) AS use, round(avg(p.p), 6) AS p FROM (SELECT *, date_diff('hour', made, valid) AS hours FROM pred) p
LEFT JOIN (VALUES (0, 30, 24), (30, 54, 48)) b(low, high, use) ON p.hours >= b.low AND p.hours < b.high GROUP BY ALL""")
def pool7(spark: SparkSession, d: str) -> DataFrame:
    p = pred(spark, d).withColumn("hours", F.timestamp_diff("HOUR", F.col("made"), F.col("valid")))
    bands = pred(spark, d).select("lead").distinct().where("lead <= 48").select((F.col("lead") - F.when(F.col("lead") == 24, 24).otherwise(18)).alias("low"), (F.col("lead") + 6).alias("high"), F.col("lead").alias("use"))
    joined = jn.range_join(p, bands, "hours", "low", "high", "left")
    return rounded(joined.groupBy("version", "station", "valid", F.coalesce("use", F.lit(72)).alias("use")).agg(F.avg("p").alias("p")), "p")


@query("pool8_truth_gate", "SELECT station, count(*) AS n, count(*) / 720.0::DOUBLE >= 0.7 AS enough FROM (SELECT DISTINCT station, hour FROM hourly) GROUP BY 1")
def pool8(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).groupBy("station").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") / 720 >= 0.7)


TS1_SQL = f""", lean AS (SELECT station, valid, lead, {PIVOT_SQL}, avg(x) AS f_mean, sqrt(greatest(0, avg(x * x) - avg(x) ** 2)) AS f_std, max(x) - min(x) AS f_range FROM latest GROUP BY ALL),
table_ AS (SELECT * FROM lean JOIN truth USING (station, valid) WHERE coalesce({', '.join(MODELS)}) IS NOT NULL),
sc AS (SELECT station, lead, count(*) AS n, avg(abs(f_mean - y)) AS mae, sqrt(avg((f_mean - y) ** 2)) AS rmse, avg(f_mean - y) AS bias, avg(f_std) AS spread FROM table_ GROUP BY ALL),
one AS (SELECT station, lead, version AS best, m AS best_mae FROM (SELECT station, lead, version, avg(abs(f - y)) AS m FROM (UNPIVOT (SELECT station, valid, lead, y, {', '.join(MODELS)} FROM table_) ON {', '.join(MODELS)} INTO NAME version VALUE f) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY station, lead ORDER BY m, version) = 1)"""


def training_table(spark: SparkSession, d: str) -> DataFrame:
    """TS1: latest run of each cell, a column for each model, spread and calendar features, joined to truth; all leads in one plan."""
    from ..functions.weather import calendar_angles, row_spread

    t = wide(spark, d).join(truth(spark, d), ["station", "valid"]).where(F.coalesce(*MODELS).isNotNull())
    return t.select("station", "valid", "lead", *MODELS, "y", *[c.alias(n) for c, n in zip(row_spread(MODELS), ("f_mean", "f_std", "f_range", "f_max"))], *calendar_angles("valid"))


@query("ts1_ev9_verify_by_lead", TS1_SQL + " SELECT station, lead, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(bias, 6) AS bias, round(spread, 6) AS spread, best, round(best_mae, 6) AS best_mae FROM sc JOIN one USING (station, lead)")
def ts1_ev9(spark: SparkSession, d: str) -> DataFrame:
    """One pass over the table: the mean of the sources is scored beside them, as one source more."""
    t = training_table(spark, d)
    long = vf.unpivot(t, ["station", "lead", "y", "f_std"], (*MODELS, "f_mean"), "version", "f").where("f IS NOT NULL")
    by = long.groupBy("station", "lead", "version").agg(*vf.errors("f", "y"), F.avg("f_std").alias("spread"))
    own = F.col("version") == "f_mean"
    top = F.min(F.when(~own, F.struct(F.col("mae").alias("best_mae"), F.col("version").alias("best"))))
    one = by.groupBy("station", "lead").agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in ("mae", "rmse", "bias", "n", "spread")], top.alias("top"))
    return rounded(one.select("station", "lead", "mae", "rmse", "bias", "n", "spread", "top.best", "top.best_mae"), "mae", "rmse", "bias", "spread", "best_mae")
