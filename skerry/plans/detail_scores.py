"""Queries for the finer parts of verification and pooling: mixtures, baselines, breakdowns, ladders, incumbents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import weather as we
from ..operators import calibrate as cal, dedup as dd, joins as jn, pooling as po, spells as sp, verify as vf, windows as wn
from .basics import CELL, ROLLING, rounded
from .features import DAY_SQL, spells
from .registry import query
from .scoring import QUANTILES_SQL, members
from .views import MODELS, WET, fcst, hourly, pred, truth


def cdf_sql(z: str) -> str:
    """The normal distribution by the same approximation as functions.weather.normal_cdf."""
    t = f"(1 / (1 + 0.3275911::DOUBLE * (abs({z}) / sqrt(2.0::DOUBLE))))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    erf = f"(1 - {poly} * exp(-({z}) * ({z}) / 2))"
    return f"(0.5 * (1 + CASE WHEN ({z}) < 0 THEN -{erf} ELSE {erf} END))"


EXCEED = (50, 60, 80)
MIXED_SQL = f""", {QUANTILES_SQL}, a AS (SELECT lead, 0.6::DOUBLE AS pi, CASE WHEN y < 45 THEN 0 ELSE y END AS y, [greatest(x, 1.0) FOR x IN q] AS q FROM q),
m AS (SELECT *, ln(q[3]) AS mu, greatest(0.05::DOUBLE, (ln(q[5]) - ln(q[1])) / 2.5631::DOUBLE) AS sigma FROM a),
s AS (SELECT *, (1 - pi) * y + pi / 5 * (abs(q[1] - y) + abs(q[2] - y) + abs(q[3] - y) + abs(q[4] - y) + abs(q[5] - y)) - (1 - pi) * pi / 5 * list_sum(q)
 - (pi / 5) ** 2 * (-4 * q[1] - 2 * q[2] + 2 * q[4] + 4 * q[5]) AS crps, CASE WHEN y <= 0 THEN (1 - pi) / 2 ELSE 1 - pi + pi * {cdf_sql('((ln(greatest(y, 1e-9)) - mu) / sigma)')} END AS pit FROM m)"""


@query("ev8_mixture_and_pit", MIXED_SQL + " SELECT lead, count(*) AS n, count(*) FILTER (y >= 45) AS wet_n, round(avg(crps), 5) AS crps, round(avg(pit), 5) AS pit_mean, " + ", ".join(f"count(*) FILTER (least(9, floor(pit * 10)) = {i}) AS pit_{i}" for i in range(10)) + ", round(avg(CAST(y BETWEEN q[1] AND q[5] AS INT)), 6) AS covered, round(avg(abs(q[3] - y)) FILTER (y >= 45), 6) AS wet_mae, " + ", ".join(f"round(avg((pi * (1 - {cdf_sql(f'((ln({t}.0) - mu) / sigma)')}) - CAST(y >= {t} AS INT)) ** 2), 5) AS brier_{t}" for t in EXCEED) + " FROM s GROUP BY 1")
def ev8_full(spark: SparkSession, d: str) -> DataFrame:
    """Amounts that are nil with some probability and else lognormal: CRPS of the quantile mixture, PIT histogram, coverage, wet error, Brier scores of exceedance."""
    q = F.transform("q", lambda x: F.greatest(x, F.lit(1.0)))
    m = members(spark, d).withColumns({"pi": F.lit(0.6), "y": F.when(F.col("y") < WET, 0.0).otherwise(F.col("y")), "q": q})
    m = m.withColumns({"mu": F.log(F.col("q")[2]), "sigma": F.greatest(F.lit(0.05), (F.log(F.col("q")[4]) - F.log(F.col("q")[0])) / 2.5631)})
    pi, mu, sigma, y = (F.col(c) for c in ("pi", "mu", "sigma", "y"))
    m = m.withColumns({"crps": vf.mixture_crps(pi, F.col("q"), y), "pit": we.mixed_pit(pi, mu, sigma, y)})
    briers = [F.round(F.avg(F.pow(we.exceedance(pi, mu, sigma, F.lit(float(t))) - (y >= t).cast("int"), F.lit(2.0))), 5).alias(f"brier_{t}") for t in EXCEED]
    out = m.groupBy("lead").agg(F.count("*").alias("n"), F.count_if(y >= WET).alias("wet_n"), F.round(F.avg("crps"), 5).alias("crps"), F.round(F.avg("pit"), 5).alias("pit_mean"), vf.histogram(F.col("pit"), 10).alias("bins"), F.avg(y.between(F.col("q")[0], F.col("q")[4]).cast("int")).alias("covered"), F.avg(F.when(y >= WET, F.abs(F.col("q")[2] - y))).alias("wet_mae"), *briers)
    return rounded(out.select("*", *[F.col("bins")[i].alias(f"pit_{i}") for i in range(10)]).drop("bins"), "covered", "wet_mae")


@query("ev11_baselines_and_reliability", """, c AS (SELECT *, avg(wet) OVER (PARTITION BY month(valid), hour(valid)) AS clim FROM pred),
j AS (SELECT c.*, CASE WHEN t.y IS NULL THEN NULL WHEN t.y >= 45 THEN 1 ELSE 0 END AS before FROM c LEFT JOIN truth t ON t.station = c.station AND t.valid = c.valid - to_hours(c.lead)),
g AS (SELECT station, version, lead, count(*) AS n, sum(wet)::BIGINT AS wet_n, avg((p - wet) ** 2) AS brier, avg((clim - wet) ** 2) AS clim_brier, avg((before - wet) ** 2) AS persistence_brier, count(*) - count(before) AS dropped, count(*) FILTER (p >= 0.5) / nullif(sum(wet), 0) AS frequency_bias,
""" + ", ".join(f"count(*) FILTER (least(9, floor(p * 10)) = {i}) AS n_{i}, avg(wet) FILTER (least(9, floor(p * 10)) = {i}) AS seen_{i}" for i in range(10)) + """ FROM j GROUP BY ALL)
SELECT station, version, lead, n, wet_n, round(brier, 6) AS brier, round(clim_brier, 6) AS clim_brier, round(1 - brier / nullif(clim_brier, 0), 5) AS skill, round(persistence_brier, 6) AS persistence_brier, dropped, round(frequency_bias, 6) AS frequency_bias,
n >= 20 AND brier > (1.05::DOUBLE + 0.1::DOUBLE * greatest(0, (lead - 24) / 24)) * min(brier) OVER (PARTITION BY station, lead) AS drifted, """ + ", ".join(f"n_{i}, round(seen_{i}, 6) AS seen_{i}" for i in range(10)) + " FROM g")
def ev11_full(spark: SparkSession, d: str) -> DataFrame:
    """Wet probabilities by station, version and lead against climatology and persistence, with drift and a reliability row of ten bins."""
    p = pred(spark, d).withColumns({"m": F.month("valid"), "h": F.hour("valid")})
    p = p.join(cal.climatology(p, ["m", "h"], "wet"), ["m", "h"])
    j = jn.lagged(p, truth(spark, d).withColumnRenamed("y", "past"), ["station"], "valid", "past", F.col("lead"), "past").withColumn("before", (F.col("past") >= WET).cast("int"))
    at = F.least(F.lit(9), F.floor(F.col("p") * 10))
    bins = [c for i in range(10) for c in (F.count_if(at == i).alias(f"n_{i}"), F.round(F.avg(F.when(at == i, F.col("wet"))), 6).alias(f"seen_{i}"))]
    g = j.groupBy("station", "version", "lead").agg(F.count("*").alias("n"), F.sum("wet").alias("wet_n"), vf.brier("p", "wet").alias("brier"), vf.brier("clim", "wet").alias("clim_brier"), vf.brier("before", "wet").alias("persistence_brier"), (F.count("*") - F.count("before")).alias("dropped"), F.try_divide(F.count_if(F.col("p") >= 0.5), F.sum("wet")).alias("frequency_bias"), *bins)
    best = F.min("brier").over(Window.partitionBy("station", "lead"))
    g = g.withColumns({"skill": F.round(1 - F.try_divide("brier", "clim_brier"), 5), "drifted": vf.drift(F.col("brier"), F.col("n"), F.greatest(F.lit(24), F.col("lead")), best, 20, 1.05, 0.1)})
    return rounded(g, "brier", "clim_brier", "persistence_brier", "frequency_bias")


@query("ev12_month_and_quintile", """SELECT version, m, quintile, count(*) AS n, round(avg(abs(f - y)), 6) AS mae, round(avg(f - y), 6) AS bias FROM (
SELECT *, month(valid) AS m, CAST(least(4, floor((row_number() OVER (PARTITION BY version ORDER BY y, station, valid, lead) - 1) * 5 / count(*) OVER (PARTITION BY version))) AS INT) AS quintile FROM pred) GROUP BY ALL""")
def ev12_full(spark: SparkSession, d: str) -> DataFrame:
    q = wn.quintile(pred(spark, d), ["version"], ["y", "station", "valid", "lead"]).withColumn("m", F.month("valid").cast("long"))
    gap = F.col("f") - F.col("y")
    return rounded(q.groupBy("version", "m", "quintile").agg(F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias")), "mae", "bias")


@query("ev13_bands_and_period", """, w AS (SELECT p.*, CAST(greatest(0, lead) // 24 * 24 + 24 AS INT) AS bucket, CASE WHEN f > 20 THEN f - 15 END AS low, CASE WHEN f > 20 THEN f + 15 END AS high, f / 10 AS period, CASE WHEN y > 30 THEN y / 9 END AS period_seen FROM pred p)
SELECT version, bucket, count(*) AS n, round(avg(abs(f - y)), 6) AS mae, count(low) AS banded, round(avg(CAST(y BETWEEN low AND high AS INT)), 6) AS covered, count(low) >= 20 AND avg(CAST(y BETWEEN low AND high AS INT)) < 0.6 AS low_coverage,
count(period - period_seen) AS periods, round(avg(abs(period - period_seen)), 6) AS period_mae, round(avg(period - period_seen), 6) AS period_bias FROM w GROUP BY ALL""")
def ev13_full(spark: SparkSession, d: str) -> DataFrame:
    """By upper edge of the lead's day: error, coverage of the rows that have a band, and error of a second measure where it was observed."""
    f, y = F.col("f"), F.col("y")
    w = pred(spark, d).withColumns({"bucket": F.expr("CAST(greatest(0, lead) DIV 24 * 24 + 24 AS INT)"), "low": F.when(f > 20, f - 15), "high": F.when(f > 20, f + 15), "late": f / 10 - F.when(y > 30, y / 9)})
    inside = F.avg(F.when(F.col("low").isNotNull(), y.between(F.col("low"), F.col("high")).cast("int")))
    out = w.groupBy("version", "bucket").agg(F.count("*").alias("n"), F.avg(F.abs(f - y)).alias("mae"), F.count("low").alias("banded"), inside.alias("covered"), ((F.count("low") >= 20) & (inside < 0.6)).alias("low_coverage"), F.count("late").alias("periods"), F.avg(F.abs("late")).alias("period_mae"), F.avg("late").alias("period_bias"))
    return rounded(out, "mae", "covered", "period_mae", "period_bias")


@query("ev14_versions_and_drift", DAY_SQL + """, l AS (SELECT station, day, w, CAST(longest >= w AS INT) AS has FROM sp, (VALUES (2), (3), (4)) t(w)),
f AS (SELECT station, version, lead, CAST(valid AS DATE) AS day, 1 - max(p) AS p FROM pred GROUP BY ALL),
j AS (SELECT l.station, w, version, lead, p, has, avg(has) OVER (PARTITION BY l.station, w) AS base FROM l JOIN f ON f.station = l.station AND f.day = l.day),
g AS (SELECT station, w, version, lead, count(*) AS n, avg((p - has) ** 2) AS brier, avg((base - has) ** 2) AS reference, avg(p) AS mean_p FROM j GROUP BY ALL)
SELECT station, w AS "window", version, lead, n, round(brier, 6) AS brier, round(reference, 6) AS reference, round(1 - brier / nullif(reference, 0), 5) AS skill, round(mean_p, 6) AS mean_p, n >= 5 AND brier > 1.05::DOUBLE * min(brier) OVER (PARTITION BY station, w, lead) AS drifted FROM g""")
def ev14_full(spark: SparkSession, d: str) -> DataFrame:
    """Dry windows by station, window, version and lead: Brier score, skill against the base rate of all scored rows, drift against the best version."""
    f = pred(spark, d).groupBy("station", "version", "lead", F.to_date("valid").alias("day")).agg((1 - F.max("p")).alias("p"))
    j = sp.windows_of(spells(spark, d), (2, 3, 4)).join(f, ["station", "day"])
    j = j.join(j.groupBy("station", "window").agg(F.avg("has").alias("base")), ["station", "window"])
    g = j.groupBy("station", "window", "version", "lead").agg(F.count("*").alias("n"), vf.brier("p", "has").alias("brier"), vf.brier("base", "has").alias("reference"), F.avg("p").alias("mean_p"))
    best = F.min("brier").over(Window.partitionBy("station", "window", "lead"))
    g = g.withColumns({"skill": F.round(1 - F.try_divide("brier", "reference"), 5), "drifted": vf.drift(F.col("brier"), F.col("n"), F.lit(24), best, 5, 1.05, 0.0)})
    return rounded(g, "brier", "reference", "mean_p")


@query("ev15_log_loss", DAY_SQL + """, c AS (SELECT station, day, h, (1 - v / (v + 50)) / sum(1 - v / (v + 50)) OVER (PARTITION BY station, day) AS q FROM i JOIN whole USING (station, day) WHERE h <= 12),
t AS (SELECT station, day, h FROM i a WHERE h <= 12 AND (SELECT count(*) FROM i b WHERE b.station = a.station AND b.day = a.day AND b.dry AND b.h BETWEEN a.h AND a.h + 2) = 3),
k AS (SELECT station, day, count(*) AS starts FROM t GROUP BY ALL HAVING count(*) < 4), j AS (SELECT c.station, c.day, c.q, k.starts FROM c JOIN k USING (station, day) JOIN t ON t.station = c.station AND t.day = c.day AND t.h = c.h),
e AS (SELECT station, day, sum(-ln(greatest(q, 1e-12)) / starts) AS loss, ln(4.0::DOUBLE) AS uniform FROM j GROUP BY ALL)
SELECT station, count(*) AS days, round(avg(loss), 6) AS loss, round(avg(uniform), 6) AS uniform, round(1 - sum(loss) / sum(uniform), 6) AS skill FROM e GROUP BY 1""")
def ev15_full(spark: SparkSession, d: str) -> DataFrame:
    """Log loss of start-hour curves, the truth being spread evenly over the starts that came true, and the skill against an even curve of four starts."""
    h = hourly(spark, d)
    curve = h.where(F.hour("hour").between(9, 12)).select("station", F.to_date("hour").alias("day"), F.hour("hour").alias("h"), (1 - F.col("v") / (F.col("v") + 50)).alias("w")).join(spells(spark, d), ["station", "day"], "left_semi")
    curve = curve.withColumn("q", F.col("w") / F.sum("w").over(Window.partitionBy("station", "day")))
    starts = sp.valid_starts(h, ["station"], "hour", "v", WET, 9, 15, 3).where("start_hour <= 12").withColumnRenamed("start_hour", "h")
    n = starts.groupBy("station", "day").agg(F.count("*").alias("starts")).where("starts < 4")
    days = curve.join(starts, ["station", "day", "h"]).join(n, ["station", "day"]).groupBy("station", "day").agg(F.sum(-F.log(F.greatest("q", F.lit(1e-12))) / F.col("starts")).alias("loss"), F.log(F.lit(4.0)).alias("uniform"))
    return rounded(days.groupBy("station").agg(F.count("*").alias("days"), F.avg("loss").alias("loss"), (1 - F.sum("loss") / F.sum("uniform")).alias("skill"), F.avg("uniform").alias("uniform")), "loss", "uniform", "skill")


@query("ev18_rolling_mae", ", " + ROLLING.format(keys="version, lead", v="abs(f - y)") + " SELECT version, lead, day, round(sum(s) / sum(c), 6) AS mean, sum(c)::BIGINT AS n FROM days JOIN daily ON d BETWEEN day - 13 AND day GROUP BY ALL HAVING sum(c) > 0")
def ev18_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wn.rolling_mean(pred(spark, d), ["version", "lead"], "valid", F.abs(F.col("f") - F.col("y")), 14), "mean")


@query("ev20_pooled_bins", """, r AS (SELECT station, version, lead, count(*) AS n, avg(abs(f - y)) AS mae, avg((CAST(f >= 60 AS INT) - CAST(y >= 60 AS INT)) ** 2) AS brier_60, """ + ", ".join(f"count(*) FILTER (least(9, floor(p * 10)) = {i}) AS b{i}" for i in range(10)) + """ FROM pred GROUP BY ALL)
SELECT lead, version, sum(n)::BIGINT AS n, round(sum(mae * n) / sum(n), 6) AS mae, round(sum(brier_60 * n) / sum(n), 6) AS brier_60, 'station ' || arg_max(station, n * 10 + station) || CASE WHEN count(*) > 1 THEN ' (+' || (count(*) - 1) || ' more)' ELSE '' END AS label, """ + ", ".join(f"sum(b{i})::BIGINT AS b{i}" for i in range(10)) + " FROM r GROUP BY ALL")
def ev20_full(spark: SparkSession, d: str) -> DataFrame:
    """Verification rows of one version and lead as one: means by n, arrays of counts added up, and a label of the largest."""
    seen = F.pow((F.col("f") >= 60).cast("int") - (F.col("y") >= 60).cast("int"), F.lit(2.0))
    r = pred(spark, d).groupBy("station", "version", "lead").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"), F.avg(seen).alias("brier_60"), vf.histogram(F.col("p"), 10).alias("bins"))
    g = r.groupBy("lead", "version").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in ("mae", "brier_60")], F.sum("n").alias("n"), vf.pool_bins("bins", 10).alias("bins"), F.max_by("station", F.struct("n", "station")).alias("first"), F.count("*").alias("k"))
    more = F.when(F.col("k") > 1, F.concat(F.lit(" (+"), (F.col("k") - 1).cast("string"), F.lit(" more)"))).otherwise("")
    return rounded(g.select("lead", "version", "n", "mae", "brier_60", F.concat(F.lit("station "), F.col("first").cast("string"), more).alias("label"), *[F.col("bins")[i].alias(f"b{i}") for i in range(10)]), "mae", "brier_60")


@query("ev23_exact_hist_and_later", """, s AS (SELECT station, valid, avg(x) FILTER (lead = 24 AND run = valid - to_hours(lead)) AS exact, avg(x) FILTER (lead = 24) AS hist, avg(x) FILTER (lead = 48) AS later FROM fcst GROUP BY ALL),
j AS (SELECT * FROM s JOIN truth USING (station, valid) WHERE exact + hist + later IS NOT NULL), u AS (UNPIVOT j ON exact, hist, later INTO NAME src VALUE f)
SELECT src, count(*) AS n, count(*) FILTER (f >= 45 AND y >= 45) AS hits, count(*) FILTER (f < 45 AND y >= 45) AS misses, count(*) FILTER (f >= 45 AND y < 45) AS false_alarms, round(count(*) FILTER (f >= 45 AND y >= 45) / nullif(count(*) FILTER (f >= 45 OR y >= 45), 0), 6) AS csi, round(corr(f, y), 6) AS r FROM u GROUP BY 1""")
def ev23_full(spark: SparkSession, d: str) -> DataFrame:
    """Three freshnesses of one forecast on the hours that have all of them: the exact run, any run of that lead, and one a day older."""
    day = F.col("lead") == 24
    exact = day & (F.col("run") == F.col("valid") - F.make_dt_interval(F.lit(0), F.col("lead")))
    s = fcst(spark, d).groupBy("station", "valid").agg(*[F.avg(F.when(c, F.col("x"))).alias(n) for n, c in (("exact", exact), ("hist", day), ("later", F.col("lead") == 48))])
    long = vf.unpivot(s.dropna().join(truth(spark, d), ["station", "valid"]), ["station", "valid", "y"], ("exact", "hist", "later"), "src", "f")
    a, b = F.col("f") >= WET, F.col("y") >= WET
    return rounded(long.groupBy("src").agg(F.count("*").alias("n"), F.count_if(a & b).alias("hits"), F.count_if(~a & b).alias("misses"), F.count_if(a & ~b).alias("false_alarms"), F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("csi"), F.corr("f", "y").alias("r")), "csi", "r")


PAIRS_SQL = """, w AS (SELECT version, CAST(hour(valid) AS INT) AS band, valid < TIMESTAMP '2024-01-21' AS early, station, valid, any_value(wet) AS wet, max(p) FILTER (lead = 24) AS p24, max(p) FILTER (lead = 48) AS p48, max(p) FILTER (lead = 72) AS p72 FROM pred GROUP BY ALL),
u AS (UNPIVOT (SELECT version, band, early, wet, p24 AS s24, p48 AS s48, p72 AS s72, (p24 + p48) / 2 AS b24x48, (p24 + p72) / 2 AS b24x72, (p48 + p72) / 2 AS b48x72 FROM w) ON s24, s48, s72, b24x48, b24x72, b48x72 INTO NAME candidate VALUE p),
c AS (SELECT version, band, candidate, avg((p - wet) ** 2) FILTER (early) AS selected_on, avg((p - wet) ** 2) FILTER (NOT early) AS graded_on, count(*) FILTER (NOT early) AS n FROM u GROUP BY ALL)"""
CANDIDATES = {"s24": ("24",), "s48": ("48",), "s72": ("72",), "b24x48": ("24", "48"), "b24x72": ("24", "72"), "b48x72": ("48", "72")}


def lead_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(version, band, candidate, selected_on, graded_on, n): single leads, and means of two leads where both are there; Brier scores on the early and the late part of the record."""
    p = pred(spark, d).withColumns({"band": F.hour("valid"), "early": F.col("valid") < F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")})
    w = p.groupBy("version", "band", "early", "station", "valid").agg(F.first("wet").alias("wet"), *[F.max(F.when(F.col("lead") == h, F.col("p"))).alias(f"p{h}") for h in (24, 48, 72)])
    w = w.select("version", "band", "early", "wet", *[(sum((F.col(f"p{h}") for h in legs[1:]), F.col(f"p{legs[0]}")) / len(legs)).alias(name) for name, legs in CANDIDATES.items()])
    long = vf.unpivot(w, ["version", "band", "early", "wet"], list(CANDIDATES), "candidate", "p").where("p IS NOT NULL")
    miss = F.pow(F.col("p") - F.col("wet"), F.lit(2.0))
    return long.groupBy("version", "band", "candidate").agg(F.avg(F.when(F.col("early"), miss)).alias("selected_on"), F.avg(F.when(~F.col("early"), miss)).alias("graded_on"), F.count_if(~F.col("early")).alias("n"))


@query("pool5_singles_and_pairs", PAIRS_SQL + " SELECT version, band, candidate, round(selected_on, 6) AS selected_on, round(graded_on, 6) AS graded_on, n FROM c")
def pool5_full(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lead_candidates(spark, d), "selected_on", "graded_on")


INCUMBENTS = {0: "s72", 6: "s72", 12: "b24x48"}


@query("pool6_incumbents", PAIRS_SQL + """, i AS (SELECT c.*, 's48' AS base, CASE band WHEN 0 THEN 's72' WHEN 6 THEN 's72' WHEN 12 THEN 'b24x48' END AS inc FROM c),
g AS (SELECT version, band, any_value(inc) AS inc, arg_min(candidate, (selected_on, candidate)) FILTER (selected_on IS NOT NULL) AS best, max(graded_on) FILTER (candidate = inc) AS inc_grade, max(graded_on) FILTER (candidate = base) AS base_grade FROM i GROUP BY ALL),
b AS (SELECT g.*, i.graded_on AS best_grade FROM g LEFT JOIN i ON i.version = g.version AND i.band = g.band AND i.candidate = g.best),
d AS (SELECT *, inc_grade IS NOT NULL AND best <> inc AND NOT coalesce(best_grade <= inc_grade * 0.97::DOUBLE, false) AS stays FROM b),
p AS (SELECT version, band, base_grade, CASE WHEN stays THEN inc ELSE best END AS pick, CASE WHEN stays THEN inc_grade ELSE best_grade END AS graded, inc FROM d)
SELECT version, band, pick, round(graded, 6) AS graded, round(100 * (base_grade - graded) / nullif(base_grade, 0), 5) AS percent, coalesce(pick <> 's48' AND graded <= base_grade * (1 - CASE WHEN pick IS NOT DISTINCT FROM inc THEN 0.02::DOUBLE ELSE 0.05::DOUBLE END), false) AS passes FROM p""")
def pool6_full(spark: SparkSession, d: str) -> DataFrame:
    """The pick of each band against the live one and the base: 5 % to beat the base, 3 % to unseat an incumbent, which needs 2 % itself."""
    inc = F.create_map(*[F.lit(x) for pair in INCUMBENTS.items() for x in pair])
    c = lead_candidates(spark, d).withColumns({"base": F.lit("s48"), "inc": F.try_element_at(inc, "band")})
    out = po.decide_with_incumbent(c, ["version", "band"], "base", "inc", 0.05, 0.03)
    return out.select("version", "band", "pick", F.round("graded", 6).alias("graded"), F.round("percent", 5).alias("percent"), "passes")


@query("fn10_probability_curves", f""", e AS (SELECT event_id, value, value % 40 AS t, value % 10 / 10 AS c FROM events), a AS (SELECT *, CASE WHEN c < 0.3::DOUBLE THEN 0 ELSE value END AS y FROM e), z AS (SELECT *, (ln(greatest(y, 1e-9)) - 3.0) AS z FROM a)
SELECT event_id, round({cdf_sql('((t - 20) / 10)')}, 5) AS cdf, round(CASE WHEN y <= 0 THEN 0.6::DOUBLE ELSE 0.6::DOUBLE * (1 - {cdf_sql('z')}) END, 5) AS over, round(CASE WHEN y <= 0 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE + 0.6::DOUBLE * {cdf_sql('z')} END, 5) AS pit FROM z""")
def fn10_full(spark: SparkSession, d: str) -> DataFrame:
    from .expressions import events

    y, pi = F.when(F.col("c") < 0.3, 0.0).otherwise(F.col("value")), F.lit(0.6)
    return events(spark, d).select("event_id", F.round(we.normal_cdf((F.col("t") - 20) / 10), 5).alias("cdf"), F.round(we.exceedance(pi, F.lit(3.0), F.lit(1.0), y), 5).alias("over"), F.round(we.mixed_pit(pi, F.lit(3.0), F.lit(1.0), y), 5).alias("pit"))


@query("cal4_apply_logistic", " SELECT station, lead, valid, version, round(1 / (1 + exp(-(-4.0 + 0.7::DOUBLE * ln(1 + f / 0.1::DOUBLE)))), 6) AS p FROM pred")
def cal4_apply(spark: SparkSession, d: str) -> DataFrame:
    """A stored logistic curve over log amounts."""
    z = -4.0 + 0.7 * F.log1p(F.col("f") / 0.1)
    return pred(spark, d).select("station", "lead", "valid", "version", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


VERSIONS = {"all": (MODELS, False), "pair": (("click", "error"), True), "view": (("view",), True)}
VERSIONS_SQL = """, c AS (SELECT station, lead, valid, 'all' AS version, avg(x) AS f, max(run) AS made FROM latest GROUP BY ALL UNION ALL SELECT station, lead, valid, 'pair', avg(x), max(run) FROM latest WHERE model IN ('click', 'error') GROUP BY ALL HAVING count(DISTINCT model) = 2
UNION ALL SELECT station, lead, valid, 'view', x, run FROM latest WHERE model = 'view'), j AS (SELECT c.*, t.y, p.y AS before, r.x AS ref FROM c JOIN truth t USING (station, valid) LEFT JOIN truth p ON p.station = c.station AND p.valid = c.valid - to_hours(c.lead) LEFT JOIN latest r ON r.station = c.station AND r.valid = c.valid AND r.lead = c.lead AND r.model = 'view')"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Combined forecasts with the newest run that they are made of, beside truth, what was true a lead before, and the reference source."""
    keys = ["station", "lead", "valid"]
    wide = vf.with_origins(dd.latest(fcst(spark, d), CELL, ["run", "event_id"]), keys, "model", MODELS, "x", "run")
    c = vf.combined(wide.withColumn("ref", F.col("view.value")), [*keys, "ref"], VERSIONS).join(truth(spark, d), ["station", "valid"])
    return jn.lagged(c, truth(spark, d), ["station"], "valid", "y", F.col("lead"), "before")


@query("ev9_by_version_and_lead", VERSIONS_SQL + """, g AS (SELECT lead, model AS best, avg(abs(x - y)) AS best_mae FROM latest JOIN truth USING (station, valid) GROUP BY ALL), s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY lead ORDER BY best_mae, best) = 1)
SELECT version, lead, round(avg(abs(f - y)), 6) AS mae, round(sqrt(avg((f - y) ** 2)), 6) AS rmse, round(avg(f - y), 6) AS bias, count(*) AS n, round(avg(abs(before - y)), 6) AS persistence_mae, round(avg(abs(ref - y)), 6) AS reference_mae, any_value(best) AS best, round(any_value(best_mae), 6) AS best_mae FROM j JOIN s USING (lead) GROUP BY version, lead""")
def ev9_full(spark: SparkSession, d: str) -> DataFrame:
    """Each version and lead against persistence, the reference source and the best single source."""
    own = versions(spark, d).groupBy("version", "lead").agg(*vf.errors("f", "y"), F.avg(F.abs(F.col("before") - F.col("y"))).alias("persistence_mae"), F.avg(F.abs(F.col("ref") - F.col("y"))).alias("reference_mae"))
    single = vf.best_single(pred(spark, d), ["lead"], "version", "f", "y")
    return rounded(own.join(single, "lead"), "mae", "rmse", "bias", "persistence_mae", "reference_mae", "best_mae")


@query("ev10_freshest_contributing_run", VERSIONS_SQL + " SELECT version, lead, CAST(date_diff('hour', made, valid) // 6 * 6 AS INT) AS bucket, count(*) AS n, round(avg(abs(f - y)), 6) AS mae, round(avg(f - y), 6) AS bias FROM j GROUP BY ALL")
def ev10_full(spark: SparkSession, d: str) -> DataFrame:
    """By the age of the newest run that a version is made of, in buckets of six hours."""
    hours = F.timestamp_diff("HOUR", F.col("made"), F.col("valid"))
    v = versions(spark, d).withColumn("bucket", (F.floor(hours / 6) * 6).cast("int"))
    mae, _, bias, n = vf.errors("f", "y")
    return rounded(v.groupBy("version", "lead", "bucket").agg(n, mae, bias), "mae", "bias")


@query("run1_local_days", """, z AS (SELECT station, v, CAST(hour + INTERVAL 9 HOURS AS DATE) AS day, hour(hour + INTERVAL 9 HOURS) AS h FROM hourly),
i AS (SELECT * FROM z WHERE h BETWEEN 9 AND 14), r AS (SELECT station, day, count(*) AS n FROM (SELECT station, day, h - row_number() OVER (PARTITION BY station, day ORDER BY h) AS g FROM i WHERE v < 45) GROUP BY station, day, g),
k AS (SELECT station, day, count(*) AS hours, count(*) FILTER (v < 45) AS dry_hours FROM i GROUP BY ALL), m AS (SELECT station, day, max(n) AS longest FROM r GROUP BY ALL), a AS (SELECT DISTINCT station, day FROM z)
SELECT a.station, a.day, CASE WHEN coalesce(hours, 0) = 6 THEN 'whole' ELSE 'hours missing' END AS state, CASE WHEN hours = 6 THEN dry_hours END AS dry_hours, CASE WHEN hours = 6 THEN coalesce(longest, 0) END AS longest FROM a LEFT JOIN k ON k.station = a.station AND k.day = a.day LEFT JOIN m ON m.station = a.station AND m.day = a.day""")
def run1_full(spark: SparkSession, d: str) -> DataFrame:
    """Days of a zone, from 9 to 15 by its clocks."""
    return sp.local_day_spells(hourly(spark, d), ["station"], "hour", "v", WET, "Asia/Tokyo", 9, 15)


@query("run1_dropped_days", """, z AS (SELECT station, v, CAST(hour + INTERVAL 9 HOURS AS DATE) AS day, hour(hour + INTERVAL 9 HOURS) AS h FROM hourly), k AS (SELECT station, day, count(*) FILTER (h BETWEEN 9 AND 14) AS hours FROM z GROUP BY ALL)
SELECT station, CASE WHEN hours = 6 THEN 'whole' ELSE 'hours missing' END AS state, count(*) AS days FROM k GROUP BY ALL""")
def run1_dropped(spark: SparkSession, d: str) -> DataFrame:
    return sp.local_day_spells(hourly(spark, d), ["station"], "hour", "v", WET, "Asia/Tokyo", 9, 15).groupBy("station", "state").agg(F.count("*").alias("days"))
