"""Queries on sources, filters, latest-run rules, joins, aggregates, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregates as ag, dedup as dd, joins as jn, windows as wn
from ..sources import tree
from ..sources.shared import shared_folder
from .registry import query
from .views import MODELS, WET, fcst, hourly, obs, pred, read, truth

R6 = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, R6) for n in names})


CELL = ["station", "model", "valid", "lead"]
HIGH = "[" + ", ".join(f"'{m}'" for m in MODELS[:3]) + "]"


@query("src1_read_tree", "SELECT event_type AS model, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def src1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tree.without_nan(tree.read_tree(spark, f"{d}/events.parquet")).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("src2_read_subtrees", "SELECT count(*) AS n, count(n_nationkey) AS nations, count(r_regionkey) AS regions FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)")
def src2(spark: SparkSession, d: str) -> DataFrame:
    return tree.read_tree(spark, f"{d}/nation.parquet", f"{d}/region.parquet").agg(F.count("*").alias("n"), F.count("n_nationkey").alias("nations"), F.count("r_regionkey").alias("regions"))


@query("src3_missing_tree", "SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1")
def src3(spark: SparkSession, d: str) -> DataFrame:
    events = read(spark, d, "events")
    return events.unionByName(tree.read_or_empty(spark, f"{d}/no_such_table", events.schema)).groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"))


@query("src4_optional_column", "SELECT event_id, 10000.0::DOUBLE AS visibility, value FROM events")
def src4(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", tree.column_or(e, "visibility", 10000.0), tree.column_or(e, "value", 0.0).alias("value"))


@query("flt1_training_filter", f"SELECT station, model, lead, count(*) AS n FROM fcst WHERE list_contains({HIGH}, model) AND lead IN (24, 48) GROUP BY ALL")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).where(F.col("model").isin(*MODELS[:3]) & F.col("lead").isin(24, 48)).groupBy("station", "model", "lead").agg(F.count("*").alias("n"))


def live_as_of(df: DataFrame, as_of: str, first: str, last: str, source: str | None = None, excluded: str = "offset_day", least_lead: int | None = None) -> DataFrame:
    """Runs known at as_of for valid times in [first, last]; rows of the excluded source go, rows without a source stay."""
    out = df.where((F.col("run") <= F.lit(as_of).cast("timestamp_ntz")) & F.col("valid").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    if source:
        out = out.where(F.col(source).isNull() | (F.col(source) != excluded))
    return out if least_lead is None else out.where(F.col("run") <= F.col("valid") - F.make_dt_interval(F.lit(0), F.lit(least_lead)))


@query("flt2_live_as_of", """SELECT event_id, station, model, run, valid FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'offset_day' ELSE 'reported' END AS source FROM fcst)
WHERE (source IS NULL OR source <> 'offset_day') AND run <= TIMESTAMP '2024-01-12 00:00:00' AND valid BETWEEN TIMESTAMP '2024-01-12 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00' AND run <= valid - INTERVAL 48 HOURS""")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    df = fcst(spark, d).withColumn("source", F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'offset_day' ELSE 'reported' END"))
    return live_as_of(df, "2024-01-12 00:00:00", "2024-01-12 00:00:00", "2024-01-15 00:00:00", "source", least_lead=48).select("event_id", "station", "model", "run", "valid")


@query("flt3_source_by_lead", "SELECT lead, CASE WHEN lead = 24 THEN 'hist' ELSE 'archive' END AS source, count(*) AS n FROM fcst GROUP BY ALL")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).groupBy("lead", F.when(F.col("lead") == 24, "hist").otherwise("archive").alias("source")).agg(F.count("*").alias("n"))


PIVOT_SQL = ", ".join(f"max(x) FILTER (model = '{m}') AS {m}" for m in MODELS)


def wide(spark: SparkSession, d: str) -> DataFrame:
    return ag.pivot_max(dd.latest(fcst(spark, d), CELL, ["run", "event_id"]), ["station", "valid", "lead"], "model", MODELS, "x")


@query("flt4_required_models", f"SELECT * FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) WHERE click IS NOT NULL AND error IS NOT NULL AND coalesce(purchase, signup, view) IS NOT NULL")
def flt4(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).where(F.col("click").isNotNull() & F.col("error").isNotNull() & F.coalesce("purchase", "signup", "view").isNotNull())


def from_floor(df: DataFrame, floor: str | None, full_history: bool = False) -> DataFrame:
    """Rows valid from the floor on; a missing floor is refused unless full history is asked for."""
    if floor is None and not full_history:
        raise ValueError("no floor for valid times: give one, or ask for full history")
    return df if floor is None else df.where(F.col("valid") >= F.lit(floor).cast("timestamp_ntz"))


@query("flt5_valid_floor", "SELECT station, count(*) AS n FROM fcst WHERE valid >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def flt5(spark: SparkSession, d: str) -> DataFrame:
    return from_floor(fcst(spark, d), "2024-01-10 00:00:00").groupBy("station").agg(F.count("*").alias("n"))


@query("flt6_hour_grid", "SELECT hour(valid) AS h, count(*) AS n FROM fcst WHERE hour(valid) IN (0, 12) AND CAST(valid AS DATE) >= DATE '2024-01-05' GROUP BY 1")
def flt6(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).where(F.hour("valid").isin(0, 12) & (F.to_date("valid") >= F.lit("2024-01-05").cast("date"))).groupBy(F.hour("valid").cast("long").alias("h")).agg(F.count("*").alias("n"))


@query("flt7_model_cycles", "SELECT model, count(*) AS n FROM fcst WHERE model <> 'click' OR hour(run) IN (0, 6, 12, 18) GROUP BY 1")
def flt7(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).where((F.col("model") != "click") | F.hour("run").isin(0, 6, 12, 18)).groupBy("model").agg(F.count("*").alias("n"))


@query("flt8_run_picks", "SELECT f.event_id, p.r_regionkey AS pick FROM fcst f JOIN region p ON hour(f.valid) = p.r_regionkey * 6 AND f.lead = 24 * (1 + p.r_regionkey % 3)")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    picks = read(spark, d, "region").selectExpr("CAST(r_regionkey * 6 AS INT) AS pick_hour", "CAST(24 * (1 + r_regionkey % 3) AS INT) AS pick_lead", "r_regionkey AS pick")
    f = fcst(spark, d)
    return f.join(F.broadcast(picks), (F.hour("valid") == F.col("pick_hour")) & (F.col("lead") == F.col("pick_lead"))).select("event_id", "pick")


@query("flt9_rows_with_truth", "SELECT count(*) AS n FROM fcst f WHERE EXISTS (SELECT 1 FROM truth t WHERE t.station = f.station AND t.valid = f.valid AND t.y > 50)")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).join(truth(spark, d).where("y > 50"), ["station", "valid"], "left_semi").agg(F.count("*").alias("n"))


@query("flt10_leak_guard", "SELECT station, model, valid, lead FROM (SELECT * FROM fcst QUALIFY row_number() OVER (PARTITION BY station, model, valid ORDER BY run DESC, event_id DESC) = 1) WHERE run <= valid - INTERVAL 26 HOURS")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    newest = dd.latest(fcst(spark, d), ["station", "model", "valid"], ["run", "event_id"])
    return newest.where("run <= valid - INTERVAL 26 HOURS").select("station", "model", "valid", "lead")


@query("flt11_range_read", "SELECT ts, v FROM obs WHERE station IN (1, 3) AND v IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-05' ORDER BY ts")
def flt11(spark: SparkSession, d: str) -> DataFrame:
    """Of the tree by station and day, two stations and three days are listed and opened."""
    path = shared_folder(spark, "range")
    tree.write_days(obs(spark, d), path, ["station"], "ts")
    rows = tree.read_range(spark, path, "ts", "2024-01-03 00:00:00", "2024-01-05 00:00:00", {"station": [1, 3]})
    return rows.where("v IS NOT NULL").select("ts", "v").orderBy("ts")


@query("prj1_unit_repair", "SELECT event_id, round(CASE WHEN max(value) OVER (PARTITION BY user_id) > 300 THEN value / 1000 ELSE value END, 9) AS value FROM events")
def prj1(spark: SparkSession, d: str) -> DataFrame:
    """Some users are in other units. A tree has as many files as tasks wrote it, and each holds many users: one for each user would be more files the more users there are."""
    path = shared_folder(spark, "units")
    read(spark, d, "events").select("event_id", "value", F.col("user_id").alias("p_user")).write.parquet(path)
    return tree.files_repaired(spark, path, "value", 300, ["p_user"]).select("event_id", F.round("value", 9).alias("value"))


@query("prj2_unit_repair_once", "SELECT event_id, round(value * 3600, 6) AS value, 1 AS unit_version FROM events")
def prj2(spark: SparkSession, d: str) -> DataFrame:
    once = tree.scaled_once(read(spark, d, "events"), "value", 3600.0)
    return rounded(tree.scaled_once(once, "value", 3600.0).select("event_id", "value", "unit_version"), "value")


@query("win1_latest_run", "SELECT station, valid, model, run, x FROM fcst QUALIFY row_number() OVER (PARTITION BY station, valid, model ORDER BY run DESC, event_id DESC) = 1")
def win1(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), ["station", "valid", "model"], ["run", "event_id"]).select("station", "valid", "model", "run", "x")


@query("win2_latest_run_by_lead", "SELECT station, valid, model, lead, run, x FROM latest")
def win2(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).select("station", "valid", "model", "lead", "run", "x")


@query("win3_shortest_lead", "SELECT station, valid, model, lead, run FROM fcst QUALIFY row_number() OVER (PARTITION BY station, valid, model ORDER BY lead, run DESC, event_id) = 1")
def win3(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest_per_valid(fcst(spark, d), ["station", "valid", "model"], "lead", "run", ["event_id"]).select("station", "valid", "model", "lead", "run")


@query("win4_latest_version", "SELECT station, lead, valid, version, made FROM pred QUALIFY row_number() OVER (PARTITION BY station, lead, valid ORDER BY version DESC, made DESC) = 1")
def win4(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(pred(spark, d), ["station", "lead", "valid"], ["version", "made"]).select("station", "lead", "valid", "version", "made")


@query("win5_latest_per_valid", "SELECT version, station, valid, lead, made FROM pred QUALIFY row_number() OVER (PARTITION BY version, station, valid ORDER BY lead, made DESC) = 1")
def win5(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest_per_valid(pred(spark, d), ["version", "station", "valid"]).select("version", "station", "valid", "lead", "made")


@query("win6_freshest_per_valid", "SELECT version, station, valid, lead, made FROM pred QUALIFY row_number() OVER (PARTITION BY version, station, valid ORDER BY made DESC, lead) = 1")
def win6(spark: SparkSession, d: str) -> DataFrame:
    return dd.freshest_per_valid(pred(spark, d), ["version", "station", "valid"], "made", ["lead"]).select("version", "station", "valid", "lead", "made")


@query("win7_best_face", """SELECT station, valid, version, p, f FROM (
  SELECT * FROM pred QUALIFY row_number() OVER (PARTITION BY station, valid, version ORDER BY lead, made DESC) = 1)
QUALIFY row_number() OVER (PARTITION BY station, valid ORDER BY p, f DESC, version) = 1""")
def win7(spark: SparkSession, d: str) -> DataFrame:
    best = dd.best_by_group(pred(spark, d), ["station", "valid"], [F.col("lead").asc(), F.col("made").desc()], ["version"], [F.col("p").asc(), F.col("f").desc(), F.col("version").asc()])
    return best.select("station", "valid", "version", "p", "f")


@query("win8_change_islands", """SELECT station, streak, wet, count(*) AS n, min(ts) AS first_ts FROM (
  SELECT *, sum(chg) OVER (PARTITION BY station ORDER BY ts, event_id) AS streak FROM (
    SELECT *, v >= 45 AS wet, CASE WHEN lag(v >= 45) OVER (PARTITION BY station ORDER BY ts, event_id) = (v >= 45) THEN 0 ELSE 1 END AS chg FROM obs)) GROUP BY ALL""")
def win8(spark: SparkSession, d: str) -> DataFrame:
    return wn.changes(obs(spark, d), ["station"], ["ts", "event_id"], F.col("v") >= WET).groupBy("station", "streak", (F.col("v") >= WET).alias("wet")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("win9_quintile", """SELECT station, quintile, count(*) AS n, round(avg(y), 6) AS mean FROM (
  SELECT *, CAST(least(4, floor((row_number() OVER (PARTITION BY station ORDER BY y, valid) - 1) * 5 / count(*) OVER (PARTITION BY station))) AS INT) AS quintile FROM truth) GROUP BY ALL""")
def win9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wn.quintile(truth(spark, d), ["station"], ["y", "valid"]).groupBy("station", "quintile").agg(F.count("*").alias("n"), F.avg("y").alias("mean")), "mean")


ROLLING = """daily AS (SELECT {keys}, CAST(valid AS DATE) AS d, sum({v}) AS s, count({v}) AS c FROM pred GROUP BY ALL),
days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS day FROM daily)"""


@query("win10_rolling_window", ", " + ROLLING.format(keys="version, lead", v="abs(f - y)") + " SELECT version, lead, day, round(sum(s) / sum(c), 6) AS mean, sum(c)::BIGINT AS n FROM days JOIN daily ON d BETWEEN day - 6 AND day GROUP BY ALL HAVING sum(c) > 0")
def win10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wn.rolling_mean(pred(spark, d), ["version", "lead"], "valid", F.abs(F.col("f") - F.col("y")), 7), "mean")


@query("win11_latest_version_per_bucket", "SELECT station, valid, bucket, max(version) AS version, arg_max(f, version) AS f FROM (SELECT *, lead // 48 AS bucket FROM pred QUALIFY row_number() OVER (PARTITION BY station, valid, lead // 48, version ORDER BY lead) = 1) GROUP BY ALL")
def win11(spark: SparkSession, d: str) -> DataFrame:
    one = dd.first_by(pred(spark, d).withColumn("bucket", F.expr("CAST(lead DIV 48 AS INT)")), ["station", "valid", "bucket", "version"], [F.col("lead").asc()])
    return one.groupBy("station", "valid", "bucket").agg(F.max("version").alias("version"), F.max_by("f", "version").alias("f"))


@query("jn1_forecast_truth", "SELECT station, valid, lead, model, x, round(y, 9) AS y FROM latest JOIN truth USING (station, valid)")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).join(truth(spark, d), ["station", "valid"]).select("station", "valid", "lead", "model", "x", F.round("y", 9).alias("y"))


@query("jn2_optional_model", """SELECT a.station, a.valid, a.lead, a.x AS click, b.x AS view FROM (SELECT * FROM latest WHERE model = 'click') a
LEFT JOIN (SELECT * FROM latest WHERE model = 'view') b USING (station, valid, lead)""")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    cells = dd.latest(fcst(spark, d), CELL, ["run", "event_id"])
    one, other = (cells.where(F.col("model") == m).select("station", "valid", "lead", F.col("x").alias(m)) for m in ("click", "view"))
    return one.join(other, ["station", "valid", "lead"], "left")


def _asof_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey % 10 AS k", "l_shipdate AS t")
    right = read(spark, d, "orders").selectExpr("o_custkey % 10 AS k", "o_orderdate AS t", "o_orderkey", "o_totalprice AS price")
    return left, dd.latest(right, ["k", "t"], ["o_orderkey"])


@query("jn3_asof", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, r.t AS asof, r.price, r.o_orderkey FROM (SELECT *, l_suppkey % 10 AS k FROM lineitem) l
ASOF LEFT JOIN (SELECT o_custkey % 10 AS k, o_orderdate AS t, o_orderkey, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 10, o_orderdate ORDER BY o_orderkey DESC) = 1) r
ON l.k = r.k AND l.l_shipdate >= r.t""")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    left, right = _asof_sides(spark, d)
    return jn.asof_join(left, right, ["k"], "t", "t", ["price", "o_orderkey"], lambda t: F.trunc(t.cast("date"), "month")).select("l_orderkey", "l_linenumber", "l_partkey", "asof", "price", "o_orderkey")


@query("jn4_nearest", """SELECT a.event_id, arg_min(b.event_id, abs(epoch_us(b.ts) - epoch_us(a.ts)) * 1000000000000::HUGEINT + CASE WHEN b.ts > a.ts THEN 100000000000 ELSE 0 END + b.event_id) AS near_id
FROM (SELECT event_id, ts, user_id % 5 AS station FROM events WHERE event_type = 'view') a LEFT JOIN (SELECT event_id, ts, user_id % 5 AS station FROM events WHERE event_type <> 'view') b ON a.station = b.station AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 3600000000 GROUP BY 1""")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    """One type of event next to all the others of its station."""
    e = read(spark, d, "events").selectExpr("event_id", "ts", "CAST(user_id % 5 AS INT) AS station", "event_type")
    right = e.where("event_type <> 'view'").withColumn("near_id", F.col("event_id"))
    return jn.nearest_join(e.where("event_type = 'view'"), right, ["station"], "ts", "ts", ["near_id"], 3600, ["near_id"]).select("event_id", "near_id")


@query("jn5_persistence", "SELECT p.lead, count(*) AS n, count(*) - count(t.y) AS missed, round(avg(abs(t.y - p.y)), 6) AS mae FROM pred p LEFT JOIN truth t ON t.station = p.station AND t.valid = p.valid - to_hours(p.lead) GROUP BY 1")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    p = jn.lagged(pred(spark, d), truth(spark, d), ["station"], "valid", "y", F.col("lead"), "before")
    return rounded(p.groupBy("lead").agg(F.count("*").alias("n"), (F.count("*") - F.count("before")).alias("missed"), F.avg(F.abs(F.col("before") - F.col("y"))).alias("mae")), "mae")


def side_by_side(spark: SparkSession, d: str, *models: str) -> DataFrame:
    """(station, lead, valid, one column a model) of cells that have all of the models: one scan, one window, one pivot."""
    w = ag.pivot_max(dd.latest(fcst(spark, d).where(F.col("model").isin(*models)), CELL, ["run", "event_id"]), ["station", "lead", "valid"], "model", models, "x")
    return w.dropna(subset=list(models))


@query("jn6_five_way", f"SELECT station, lead, valid, round(click + error + purchase + signup + view, 6) AS total FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) WHERE click + error + purchase + signup + view IS NOT NULL")
def jn6(spark: SparkSession, d: str) -> DataFrame:
    return side_by_side(spark, d, *MODELS).select("station", "lead", "valid", F.round(sum((F.col(m) for m in MODELS[1:]), F.col(MODELS[0])), R6).alias("total"))


@query("jn7_three_way", f"SELECT station, lead, valid, click, error, view FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) WHERE click IS NOT NULL AND error IS NOT NULL AND view IS NOT NULL")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    return side_by_side(spark, d, "click", "error", "view")


@query("jn8_equal_mean", "SELECT a.station, a.lead, a.valid, round((a.x + b.x) / 2, 6) AS mean FROM latest a JOIN latest b USING (station, lead, valid) WHERE a.model = 'click' AND b.model = 'error'")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    return side_by_side(spark, d, "click", "error").select("station", "lead", "valid", F.round((F.col("click") + F.col("error")) / 2, R6).alias("mean"))


@query("jn9_full_outer", """SELECT station, valid, lead, a.x AS click, b.x AS view FROM (SELECT * FROM latest WHERE model = 'click') a FULL JOIN (SELECT * FROM latest WHERE model = 'view') b USING (station, valid, lead)""")
def jn9(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d)
    return w.select("station", "valid", "lead", "click", "view").where("click IS NOT NULL OR view IS NOT NULL")


@query("jn10_presence", """SELECT a.station, a.lead, count(*) AS anchors, count(b.x) AS present FROM (SELECT * FROM latest WHERE model = 'click') a
LEFT JOIN (SELECT * FROM latest WHERE model = 'purchase') b USING (station, valid, lead) GROUP BY ALL""")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).where("click IS NOT NULL").groupBy("station", "lead").agg(F.count("*").alias("anchors"), F.count("purchase").alias("present"))


def station_pairs(hours: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """(a, b, hour, <column>_a, <column>_b) for each of the named pairs (a, b) whose stations both have the hour: the rows are those of the pairs, however many stations there are."""
    one, two = (hours.select(F.col("station").alias(n), "hour", *[F.col(c).alias(f"{c}_{n}") for c in columns]) for n in "ab")
    return one.join(pairs.select("a", "b").distinct(), "a").join(two, ["b", "hour"]).select("a", "b", "hour", *[f"{c}_{n}" for c in columns for n in "ab"])


def region_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each region with each of a larger key among the first five, as pairs of stations."""
    return read(spark, d, "region").selectExpr("CAST(r_regionkey AS INT) AS a").where("a < 4").select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(4))).alias("b"))


@query("jn11_two_stations", "SELECT a.station AS a, b.station AS b, a.hour, round(a.v, 6) AS v_a, round(b.v, 6) AS v_b FROM hourly a JOIN hourly b USING (hour) WHERE a.station < b.station")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    return rounded(station_pairs(hourly(spark, d), region_pairs(spark, d), "v"), "v_a", "v_b")


@query("jn12_composite", "SELECT hour, round(sum(v * (station + 1)) / sum(station + 1), 6) AS v FROM hourly JOIN region ON r_regionkey = station GROUP BY hour HAVING count(DISTINCT station) = 5")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.pooling import weighted_composite

    weights = read(spark, d, "region").selectExpr("CAST(r_regionkey AS INT) AS station", "CAST(r_regionkey + 1 AS DOUBLE) AS weight")
    return rounded(weighted_composite(hourly(spark, d), weights, "station", ["hour"], "v", 5), "v")


@query("jn13_range", "SELECT r.r_regionkey AS band, count(*) AS n, round(avg(o.v), 6) AS mean FROM obs o JOIN region r ON o.v >= r.r_regionkey * 40 AND o.v < (r.r_regionkey + 1) * 40 GROUP BY 1")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    bands = read(spark, d, "region").selectExpr("r_regionkey AS band", "r_regionkey * 40 AS low", "(r_regionkey + 1) * 40 AS high")
    return rounded(jn.range_join(obs(spark, d), bands, "v", "low", "high").groupBy("band").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), "mean")


@query("jn14_sector_lookup", "SELECT e.event_id, n.n_name AS sector_name FROM events e JOIN nation n ON CAST(floor((e.value % 360 + 22.5) / 45) AS INT) % 8 = n.n_nationkey")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.weather import sector

    names = read(spark, d, "nation").selectExpr("CAST(n_nationkey AS INT) AS sector", "n_name AS sector_name")
    return read(spark, d, "events").withColumn("sector", sector(F.col("value") % 360)).join(F.broadcast(names), "sector").select("event_id", "sector_name")


@query("agg1_pivot_models", f"SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL")
def agg1(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d)


@query("agg2_pivot_two_keys", "SELECT station, valid, " + ", ".join(f"max(x) FILTER (model = '{m}' AND lead = {h}) AS {m}_{h}" for m in MODELS[:3] for h in (24, 48)) + " FROM latest GROUP BY ALL")
def agg2(spark: SparkSession, d: str) -> DataFrame:
    return ag.pivot_two(dd.latest(fcst(spark, d), CELL, ["run", "event_id"]), ["station", "valid"], "model", MODELS[:3], "lead", (24, 48), "x")


@query("agg3_report_pivot", f"SELECT station, valid, {PIVOT_SQL} FROM (SELECT * FROM fcst QUALIFY row_number() OVER (PARTITION BY station, valid, model ORDER BY run DESC, event_id DESC) = 1) GROUP BY ALL")
def agg3(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), ["station", "valid", "model"], ["run", "event_id"]).groupBy("station", "valid").pivot("model", list(MODELS)).agg(F.first("x"))


@query("agg4_complete_hours", "SELECT station, hour, round(sum(v), 6) AS total, count(v) AS n FROM obs GROUP BY ALL HAVING count(v) = 4")
def agg4(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ag.complete_total(obs(spark, d), ["station", "hour"], "v", 4), "total")


@query("agg5_hourly_means", "SELECT station, hour, round(v, 6) AS v FROM hourly")
def agg5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(hourly(spark, d).select("station", "hour", "v"), "v")


@query("agg6_station_rollup", "SELECT station, hour, round(avg(v), 6) AS mean, max(v) AS top, min(v) AS low, round(sum(v), 6) AS total, round((degrees(atan2(avg(sin(radians(v))), avg(cos(radians(v))))) + 360) % 360, 4) AS direction FROM obs GROUP BY ALL HAVING count(v) > 0")
def agg6(spark: SparkSession, d: str) -> DataFrame:
    out = obs(spark, d).groupBy("station", "hour").agg(F.avg("v").alias("mean"), F.max("v").alias("top"), F.min("v").alias("low"), F.sum("v").alias("total"), ag.circular_mean(F.col("v")).alias("direction"), F.count("v").alias("n"))
    return rounded(out.where("n > 0").drop("n"), "mean", "total").withColumn("direction", F.round("direction", 4))


@query("agg7_model_means", "SELECT station, valid, lead, round(avg(x), 6) AS mean, round(avg(sin(radians(x))), 6) AS mean_sin, round(avg(cos(radians(x))), 6) AS mean_cos FROM latest GROUP BY ALL")
def agg7(spark: SparkSession, d: str) -> DataFrame:
    rad = F.radians("x")
    return rounded(dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).groupBy("station", "valid", "lead").agg(F.avg("x").alias("mean"), F.avg(F.sin(rad)).alias("mean_sin"), F.avg(F.cos(rad)).alias("mean_cos")), "mean", "mean_sin", "mean_cos")


@query("agg8_signal_counts", "SELECT station, valid, count(DISTINCT model) FILTER (x >= 60) AS firing, count(DISTINCT model) AS able FROM latest GROUP BY ALL")
def agg8(spark: SparkSession, d: str) -> DataFrame:
    return dd.latest(fcst(spark, d), CELL, ["run", "event_id"]).groupBy("station", "valid").agg(F.countDistinct(F.when(F.col("x") >= 60, F.col("model"))).alias("firing"), F.countDistinct("model").alias("able"))


@query("agg9_inventory", "SELECT model, station, count(*) AS n, min(valid) AS first_valid, max(valid) AS last_valid, count(*) FILTER (x > 1) AS good, round(sum(x), 6) AS total FROM fcst GROUP BY ALL")
def agg9(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fcst(spark, d).groupBy("model", "station").agg(F.count("*").alias("n"), F.min("valid").alias("first_valid"), F.max("valid").alias("last_valid"), F.count_if(F.col("x") > 1).alias("good"), F.sum("x").alias("total")), "total")


@query("agg10_model_summary", "SELECT model, count(x) AS n, min(x) AS low, round(avg(x), 6) AS mean, max(x) AS top, count(*) FILTER (x >= 45) AS wet, round(sum(x), 6) AS total FROM fcst GROUP BY 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(fcst(spark, d).groupBy("model").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.avg("x").alias("mean"), F.max("x").alias("top"), F.count_if(F.col("x") >= WET).alias("wet"), F.sum("x").alias("total")), "mean", "total")


@query("agg11_months", "SELECT o_orderstatus, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct(F.year("o_orderdate"), F.month("o_orderdate")).alias("months"))


@query("agg12_null_shares", f"SELECT lead, hour(valid) AS h, count(*) AS n, " + ", ".join(f"round(avg(CAST({m} IS NULL AS INT)), 6) AS null_{m}" for m in MODELS) + ", count(*) FILTER (click IS NULL AND error IS NULL) AS both_null" + f" FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) GROUP BY ALL")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    w = wide(spark, d).withColumn("h", F.hour("valid").cast("long"))
    both = F.count_if(F.col("click").isNull() & F.col("error").isNull()).alias("both_null")
    return rounded(ag.null_shares(w, ["lead", "h"], MODELS, both), *[f"null_{m}" for m in MODELS])


@query("agg13_agreement", """, j AS (SELECT a.station AS a, b.station AS b, a.v AS va, b.v AS vb, a.v >= 45 AS wa, b.v >= 45 AS wb FROM hourly a JOIN hourly b USING (hour) WHERE a.station < b.station),
c AS (SELECT a, b, count(*) FILTER (wa AND wb) AS both_wet, count(*) FILTER (wa AND NOT wb) AS only_a, count(*) FILTER (wb AND NOT wa) AS only_b, count(*) FILTER (NOT wa AND NOT wb) AS neither, count(*)::DOUBLE AS n, corr(va, vb) AS r FROM j GROUP BY ALL)
SELECT a, b, both_wet, only_a, only_b, neither, round(r, 6) AS r, round(((both_wet + neither) / n - ((both_wet + only_a) * (both_wet + only_b) + (neither + only_b) * (neither + only_a)) / (n * n)) / (1 - ((both_wet + only_a) * (both_wet + only_b) + (neither + only_b) * (neither + only_a)) / (n * n)), 6) AS kappa FROM c""")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    j = station_pairs(hourly(spark, d), region_pairs(spark, d), "v")
    wa, wb = F.col("v_a") >= WET, F.col("v_b") >= WET
    c = j.groupBy("a", "b").agg(F.count_if(wa & wb).alias("both_wet"), F.count_if(wa & ~wb).alias("only_a"), F.count_if(wb & ~wa).alias("only_b"), F.count_if(~wa & ~wb).alias("neither"), F.corr("v_a", "v_b").alias("r"))
    n = F.expr("CAST(both_wet + only_a + only_b + neither AS DOUBLE)")
    chance = F.expr("(both_wet + only_a) * (both_wet + only_b) + (neither + only_b) * (neither + only_a)") / (n * n)
    return c.select("a", "b", "both_wet", "only_a", "only_b", "neither", F.round("r", R6).alias("r"), F.round(F.try_divide((F.col("both_wet") + F.col("neither")) / n - chance, 1 - chance), R6).alias("kappa"))


@query("agg14_class_balance", "SELECT station, count(*) AS n, " + ", ".join(f"count(*) FILTER (y >= {t}) AS over_{t}" for t in (40, 45, 50, 60)) + " FROM truth GROUP BY 1")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    return truth(spark, d).groupBy("station").agg(F.count("*").alias("n"), *[F.count_if(F.col("y") >= t).alias(f"over_{t}") for t in (40, 45, 50, 60)])


@query("agg15_climate_bins", "SELECT CAST(floor((v % 360 + 22.5) / 45) AS INT) % 8 AS sector, month(ts) AS m, count(*) AS n, round(avg(v), 6) AS mean, round(avg(v * v), 6) AS mean_square FROM obs GROUP BY ALL HAVING count(*) >= 100")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.weather import sector

    bins = obs(spark, d).groupBy(sector(F.col("v") % 360).alias("sector"), F.month("ts").cast("long").alias("m")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("mean_square"))
    return rounded(bins.where("n >= 100"), "mean", "mean_square")


@query("agg16_correlations", """, s AS (SELECT CAST(hour AS DATE) AS day, station, CAST(hour(hour) AS INT) AS slot, CAST(v < 45 AS INT)::DOUBLE AS x FROM hourly WHERE hour(hour) BETWEEN 9 AND 14)
SELECT a.slot AS a, b.slot AS b, round((avg(a.x * b.x) - avg(a.x) * avg(b.x)) / sqrt(greatest(avg(a.x * a.x) - avg(a.x) * avg(a.x), 1e-12) * greatest(avg(b.x * b.x) - avg(b.x) * avg(b.x), 1e-12)), 6) AS corr
FROM s a JOIN s b ON a.day = b.day AND a.station = b.station GROUP BY ALL""")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    s = hourly(spark, d).where(F.hour("hour").between(9, 14)).select(F.concat_ws("/", F.to_date("hour"), "station").alias("day"), F.hour("hour").alias("slot"), (F.col("v") < WET).cast("double").alias("x"))
    return rounded(ag.correlation_table(s, "day", "slot", "x"), "corr")


@query("srt1_published_order", "SELECT station, lead, valid, version, f FROM pred ORDER BY station, valid, lead, version")
def srt1(spark: SparkSession, d: str) -> DataFrame:
    return pred(spark, d).select("station", "lead", "valid", "version", "f").orderBy("station", "valid", "lead", "version")


@query("srt2_worst_dates", f"SELECT CAST(valid AS DATE) AS day, round(avg(CAST(click IS NULL AS INT)), 6) AS share FROM (SELECT station, valid, lead, {PIVOT_SQL} FROM latest GROUP BY ALL) GROUP BY 1 ORDER BY avg(CAST(click IS NULL AS INT)) DESC, day LIMIT 10")
def srt2(spark: SparkSession, d: str) -> DataFrame:
    by = wide(spark, d).groupBy(F.to_date("valid").alias("day")).agg(F.avg(F.col("click").isNull().cast("double")).alias("share"))
    return rounded(by.orderBy(F.desc("share"), "day").limit(10), "share")


@query("srt3_first_rows", "SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 25")
def srt3(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").orderBy("event_id").limit(25).select("event_id", "ts", "value")


@query("set1_legs", "SELECT DISTINCT leg, station, model, valid FROM (SELECT 24 AS leg, * FROM fcst WHERE lead = 24 UNION ALL SELECT 48 AS leg, * FROM fcst WHERE lead = 48)")
def set1(spark: SparkSession, d: str) -> DataFrame:
    f = fcst(spark, d)
    legs = [f.where(F.col("lead") == h).withColumn("leg", F.lit(h)) for h in (24, 48)]
    return legs[0].unionByName(legs[1]).select("leg", "station", "model", "valid").distinct()


@query("set2_merge_rows", "SELECT station, model, valid, lead, run FROM latest")
def set2(spark: SparkSession, d: str) -> DataFrame:
    f = fcst(spark, d)
    return dd.merge_latest(f.where("event_id % 2 = 0"), f.where("event_id % 2 = 1"), CELL, ["run", "event_id"]).select(*CELL, "run")


@query("set3_common_times", "SELECT hour FROM hourly GROUP BY hour HAVING count(DISTINCT station) = 5")
def set3(spark: SparkSession, d: str) -> DataFrame:
    return jn.common_to_all(hourly(spark, d), ["hour"], "station", 5)


@query("set4_distinct_keys", "SELECT DISTINCT station, model, lead FROM fcst")
def set4(spark: SparkSession, d: str) -> DataFrame:
    return fcst(spark, d).select("station", "model", "lead").distinct()


