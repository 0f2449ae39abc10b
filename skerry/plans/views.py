"""Role views: forecasts, truth, observations and scored predictions, bound to the driver's tables.

Each is made by one formula, written once for Spark and once for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import latest

MODELS = ("click", "error", "purchase", "signup", "view")
#: An hour or a slot counts as wet from this value on.
WET = 45.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _floor(ts: str, hours: int) -> str:
    return f"CAST(to_date({ts}) AS TIMESTAMP_NTZ) + make_dt_interval(0, CAST(hour({ts}) DIV {hours} * {hours} AS INT))"


def fcst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, model, run, valid, lead, x, event_id): x issued at `run` for `valid`, on a six-hour grid."""
    e = read(spark, sf_dir, "events")
    e = e.selectExpr("CAST(user_id % 3 AS INT) AS station", "event_type AS model", f"{_floor('ts', 6)} AS valid", "CAST(24 * (1 + event_id % 3) AS INT) AS lead", "value AS x", "event_id")
    return e.withColumn("run", F.expr("valid - make_dt_interval(0, lead + CAST(event_id % 4 AS INT))"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, valid, y): the mean of all values."""
    e = read(spark, sf_dir, "events").selectExpr("CAST(user_id % 3 AS INT) AS station", f"{_floor('ts', 6)} AS valid", "value")
    return e.groupBy("station", "valid").agg(F.avg("value").alias("y"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, ts, hour, v, event_id): raw readings."""
    return read(spark, sf_dir, "events").selectExpr("CAST(user_id % 5 AS INT) AS station", "ts", f"{_floor('ts', 1)} AS hour", "value AS v", "event_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, hour, v, n): hourly means and the readings behind them."""
    return obs(spark, sf_dir).groupBy("station", "hour").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, station, lead, valid, made, f, p, y, wet): latest forecasts beside what came, models as versions."""
    cells = latest(fcst(spark, sf_dir), ["station", "model", "valid", "lead"], ["run", "event_id"])
    joined = cells.join(truth(spark, sf_dir), ["station", "valid"])
    return joined.select(F.col("model").alias("version"), "station", "lead", "valid", F.col("run").alias("made"), F.col("x").alias("f"), (F.col("x") / (F.col("x") + 50)).alias("p"), "y", (F.col("y") >= WET).cast("int").alias("wet"))


def prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p, y): a probability and a 0/1 label for each labelled document."""
    d, q = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(q, "doc_id").selectExpr("doc_id AS id", "n_chars / (n_chars + 1500.0D) AS p", "CAST(quality AS INT) AS y")


SQL_VIEWS = f"""
fcst AS (
  SELECT *, valid - to_hours(CAST(lead + event_id % 4 AS BIGINT)) AS run FROM (
    SELECT CAST(user_id % 3 AS INT) AS station, event_type AS model, time_bucket(INTERVAL 6 HOURS, ts) AS valid,
           CAST(24 * (1 + event_id % 3) AS INT) AS lead, value AS x, event_id FROM events)),
latest AS (SELECT * FROM fcst QUALIFY row_number() OVER (PARTITION BY station, model, valid, lead ORDER BY run DESC, event_id DESC) = 1),
truth AS (SELECT CAST(user_id % 3 AS INT) AS station, time_bucket(INTERVAL 6 HOURS, ts) AS valid, avg(value) AS y FROM events GROUP BY ALL),
obs AS (SELECT CAST(user_id % 5 AS INT) AS station, ts, time_bucket(INTERVAL 1 HOUR, ts) AS hour, value AS v, event_id FROM events),
hourly AS (SELECT station, hour, avg(v) AS v, count(*) AS n FROM obs GROUP BY ALL),
pred AS (
  SELECT model AS version, station, lead, valid, run AS made, x AS f, x / (x + 50) AS p, y, CAST(y >= {WET} AS INT) AS wet
  FROM latest JOIN truth USING (station, valid)),
prob AS (SELECT doc_id AS id, n_chars / (n_chars + 1500.0::DOUBLE) AS p, CAST(quality AS INT) AS y FROM documents JOIN labels USING (doc_id))
"""
