"""Queries that fit and compare models, with pyspark.ml; rows stay in Spark."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import models as ml, pooling as pl, verify as vf
from ..sources.shared import shared_folder, written
from .basics import rounded
from .features import split_by_time, spells
from .registry import query
from .scoring import WIDE_SQL, three, training_table
from .views import MODELS, WET, hourly

LEADS = (24, 48, 72)
CALENDAR = ("hour_sin", "hour_cos", "doy_sin", "doy_cos")


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with x: the features, nulls as 0 beside a 0/1 column that says so, as Spark's trees take no missing value."""
    filled = {f"__{c}": F.coalesce(F.col(c), F.lit(0.0)) for c in features}
    gaps = {f"__no_{c}": F.col(c).isNull().cast("double") for c in features}
    out = df.withColumns({**filled, **gaps})
    return VectorAssembler(inputCols=[*filled, *gaps], outputCol="x").transform(out).drop(*filled, *gaps)


FEATURES = (*MODELS, "f_mean", "f_std", "f_range", *CALENDAR)


def split_table(spark: SparkSession, d: str) -> DataFrame:
    """The training table with vectors and parts, written once for the fits that read it; a lead that LEADS does not name is an error."""
    t = training_table(spark, d).withColumn("wet", (F.col("y") >= WET).cast("int"))
    t = split_by_time(t, ["station", "lead"], "valid").withColumn("held", F.col("part") == "validation")
    t = written(t, "training")
    if unknown := [r.lead for r in t.where(~F.col("lead").isin(*LEADS)).select("lead").distinct().limit(5).collect()]:
        raise ValueError(f"leads without a model: {unknown}")
    return vectors(t, FEATURES)


def regressor(trees: int = 12, seed: int = 7) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol="y", lossType="absolute", validationIndicatorCol="held", validationTol=1e-4, maxIter=trees, maxDepth=3, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


def at_once(spark: SparkSession, tasks: Sequence) -> list:
    """Results of functions that each run jobs on the driver's session, all submitted together; at most eight wait at a time."""
    with ThreadPool(max(1, min(8, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)


def fitted_by_lead(table: DataFrame, leads: Sequence[int], build, label: str) -> list[tuple[int, object]]:
    """A model for each lead, all fitted at once; the rows stay where they are."""
    rows = {lead: table.where((F.col("lead") == lead) & (F.col("part") != "test")) for lead in leads}
    models = at_once(table.sparkSession, [lambda m=build().setLabelCol(label), r=r: m.fit(r) for r in rows.values()])
    return list(zip(rows, models))


def steadied(t: DataFrame, leads: Sequence[int], build, label: str = "y") -> DataFrame:
    """(lead, station, valid, label, f_mean, part, model, base, f): validation and test rows under each lead's model.

    base is the lead's mean label before the validation part, and f the pool of model and base whose weight the validation
    rows choose: a model that learned nothing there gives way to its baseline. Fits see those rows only to know when to stop.
    """
    out, seen = None, t if build().isSet("validationIndicatorCol") else t.where("part = 'train'")
    for lead, model in fitted_by_lead(seen, leads, build, label):
        p = model.transform(t.where((F.col("lead") == lead) & (F.col("part") != "train")))
        p = p.select("lead", "station", "valid", label, "f_mean", "part", ml.forecast_of(model).alias("model"))
        out = p if out is None else out.unionByName(p)
    base = t.where("part = 'train'").groupBy("lead").agg(F.avg(label).alias("base"))
    return pl.held_to_baseline(out.join(F.broadcast(base), "lead", "left"), ["lead"], "model", "base", label, F.col("part") == "validation", "f")


@query("ml1_boosted_regression")
def ml1(spark: SparkSession, d: str) -> DataFrame:
    return steadied(split_table(spark, d), LEADS, regressor).where("part = 'test'").select("lead", "station", "valid", "y", F.round("f", 6).alias("f"))


def classifier(trees: int = 10) -> GBTClassifier:
    return GBTClassifier(featuresCol="x", labelCol="wet", validationIndicatorCol="held", maxIter=trees, maxDepth=3, seed=7)


@query("ml2_boosted_classifier")
def ml2(spark: SparkSession, d: str) -> DataFrame:
    return steadied(split_table(spark, d), LEADS, classifier, "wet").where("part = 'test'").select("station", "lead", "valid", "wet", F.round("f", 6).alias("p"))


@query("ml3_day_classifier")
def ml3(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    before = hourly(spark, d).where("hour(hour) < 9").groupBy("station", F.to_date("hour").alias("day")).agg(F.avg("v").alias("mean"), F.max("v").alias("top"), F.count("*").cast("double").alias("k"))
    rows = vectors(spells(spark, d).join(before, ["station", "day"], "left").withColumn("has", (F.col("longest") >= 3).cast("int")), ["mean", "top", "k"])
    rows = split_by_time(rows, ["station"], "day")
    if rows.where("part <> 'test'").isEmpty():  # no whole day yet
        return rows.select("station", "day", "has", F.lit(None).cast("double").alias("p"))
    model = GBTClassifier(featuresCol="x", labelCol="has", maxIter=8, maxDepth=2, seed=7).fit(rows.where("part <> 'test'"))
    return model.transform(rows.where("part = 'test'")).select("station", "day", "has", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("ml4_train_report")
def ml4(spark: SparkSession, d: str) -> DataFrame:
    """By lead: rows of each part, range of the label; errors on the test part of the steadied model, the model alone, the mean of the sources and the training mean; and the best single source on validation."""
    t = split_table(spark, d)
    arms = {"f": "test_mae", "model": "model_mae", "f_mean": "mean_mae", "base": "base_mae"}
    test = steadied(t, LEADS, lambda: regressor(6)).where("part = 'test'").groupBy("lead").agg(*[F.avg(F.abs(F.col(c) - F.col("y"))).alias(n) for c, n in arms.items()])
    parts = t.groupBy("lead").agg(*[F.count_if(F.col("part") == p).alias(f"n_{p}") for p in ("train", "validation", "test")], F.min("y").alias("low"), F.max("y").alias("top"))
    long = vf.unpivot(t.where("part = 'validation'"), ["lead", "y"], MODELS, "source", "f").where("f IS NOT NULL")
    return rounded(parts.join(test, "lead").join(vf.best_single(long, ["lead"], "source", "f", "y"), "lead"), "low", "top", *arms.values(), "best_mae")


def stored_models(spark: SparkSession, t: DataFrame, features: Sequence[str], trees: int = 6) -> str:
    """Fits a model for each lead on what lies before the test part, and stores them; the folder."""
    root = shared_folder(spark, "models")
    rows = t if "x" in t.columns else vectors(t, features)
    cutoff = rows.where("part = 'test'").agg(F.min("valid")).first()[0]
    ml.store(spark, root, dict(fitted_by_lead(rows, LEADS, lambda: regressor(trees), "y")), features, cutoff)
    return root


@query("ml5_score_live")
def ml5(spark: SparkSession, d: str) -> DataFrame:
    """The newest day scored with the stored model of each row's lead; rows that lack a required source are left out."""
    t = split_table(spark, d)
    root = stored_models(spark, t, FEATURES)
    last = t.agg(F.max("valid").alias("newest"))
    live = t.drop("x").join(F.broadcast(last)).where((F.col("valid") > F.col("newest") - F.expr("INTERVAL 24 HOURS")) & F.col("click").isNotNull()).drop("newest")
    return ml.replay(spark, root, live, FEATURES, vectors, LEAKING).select("station", "lead", "valid", F.round("prediction", 6).alias("f"))


LEAKING = {"y", "wet"}


@query("ml6_replay")
def ml6(spark: SparkSession, d: str) -> DataFrame:
    """Stored models over all of history, read back from their folder."""
    features = ("f_mean", "f_std", *CALENDAR)
    t = split_table(spark, d).drop("x")
    root = stored_models(spark, t, features, 5)
    return ml.replay(spark, root, t, features, vectors, LEAKING).select("station", "lead", "valid", F.round("prediction", 6).alias("f"))


@query("ml7_residual_size", WIDE_SQL + " SELECT lead, round(regr_r2(y - (click + error) / 2, view), 6) AS r2, round(corr(y - (click + error) / 2, view), 6) AS r, count(*) AS n FROM t3 WHERE click IS NOT NULL AND error IS NOT NULL AND view IS NOT NULL GROUP BY 1")
def ml7(spark: SparkSession, d: str) -> DataFrame:
    """How much of the residual a candidate feature explains: R2 of a least-squares line, by lead, in one aggregation."""
    t = three(spark, d, "click", "error", "view").withColumn("res", F.col("y") - (F.col("click") + F.col("error")) / 2)
    return rounded(t.groupBy("lead").agg(F.regr_r2("res", "view").alias("r2"), F.corr("res", "view").alias("r"), F.count("*").alias("n")), "r2", "r")


@query("ml7_residual_model")
def ml7_model(spark: SparkSession, d: str) -> DataFrame:
    t = three(spark, d, "click", "error", "view").withColumn("res", F.col("y") - (F.col("click") + F.col("error")) / 2)
    rows = vectors(split_by_time(t, ["station", "lead"], "valid"), ["view"])
    model = LinearRegression(featuresCol="x", labelCol="res", solver="normal").fit(rows.where("part = 'train'"))
    test = model.transform(rows.where("part <> 'train'"))
    mean = test.groupBy("lead").agg(F.avg("res").alias("m"))
    j = test.join(mean, "lead")
    return rounded(j.groupBy("lead").agg((1 - F.try_divide(F.sum(F.pow(F.col("res") - F.col("prediction"), F.lit(2.0))), F.sum(F.pow(F.col("res") - F.col("m"), F.lit(2.0))))).alias("r2"), F.count("*").alias("n")), "r2")


@query("ml8_paired_bootstrap")
def ml8(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the difference in error of two models over Poisson(1) resamples, whose counts come from hashes of row and draw."""
    t = three(spark, d, "click", "error").withColumn("gap", F.abs(F.col("click") - F.col("y")) - F.abs(F.col("error") - F.col("y")))
    drawn = t.select("lead", "gap", F.xxhash64("station", "lead", "valid").alias("id")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(200))))
    u = (F.pmod(F.xxhash64("id", "draw"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    # cumulative Poisson(1) probabilities
    times = sum((F.when(u > c, 1).otherwise(0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    means = drawn.withColumn("k", times).groupBy("lead", "draw").agg(F.try_divide(F.sum(F.col("gap") * F.col("k")), F.sum("k")).alias("m"))
    q = means.groupBy("lead").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select("lead", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("low", "middle", "high"))])


@query("ml9_bake_off", WIDE_SQL + """, a AS (SELECT lead, 'mean' AS arm, (click + error + view) / 3 AS f, y FROM t3 WHERE click + error + view IS NOT NULL AND valid >= TIMESTAMP '2024-01-23' UNION ALL SELECT lead, 'single', click, y FROM t3 WHERE click + error + view IS NOT NULL AND valid >= TIMESTAMP '2024-01-23'),
s AS (SELECT lead, arm, count(*) AS n, avg(abs(f - y)) AS mae FROM a GROUP BY ALL) SELECT lead, arm, n, round(mae, 6) AS mae, round(100 * (mae / max(mae) FILTER (arm = 'single') OVER (PARTITION BY lead) - 1), 6) AS percent FROM s""")
def ml9(spark: SparkSession, d: str) -> DataFrame:
    """Arms on one common test set: error and its change against the first arm."""
    t = three(spark, d, "click", "error", "view").where(F.col("valid") >= F.lit("2024-01-23 00:00:00").cast("timestamp_ntz"))
    t = t.withColumn("mean", (F.col("click") + F.col("error") + F.col("view")) / 3).withColumn("single", F.col("click"))
    s = vf.unpivot(t, ["lead", "y"], ("mean", "single"), "arm", "f").groupBy("lead", "arm").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"))
    base = F.max(F.when(F.col("arm") == "single", F.col("mae"))).over(Window.partitionBy("lead"))
    return rounded(s.withColumn("percent", 100 * (F.col("mae") / base - 1)), "mae", "percent")


@query("ml10_overlap_comparison", WIDE_SQL + " SELECT lead, count(*) AS n, round(avg(abs(click - y)), 6) AS click, round(avg(abs(error - y)), 6) AS error, round(avg(abs(view - y)), 6) AS view FROM t3 WHERE click IS NOT NULL AND error IS NOT NULL AND view IS NOT NULL GROUP BY 1")
def ml10(spark: SparkSession, d: str) -> DataFrame:
    t = three(spark, d, "click", "error", "view")
    return rounded(t.groupBy("lead").agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(m) - F.col("y"))).alias(m) for m in ("click", "error", "view")]), "click", "error", "view")


@query("ml1_importance")
def ml1_importance(spark: SparkSession, d: str) -> DataFrame:
    """Share of each feature in the splits of each lead's model, the mark of a missing value counted with it; the features' shares add up to one."""
    rows = []
    for lead, model in fitted_by_lead(split_table(spark, d), LEADS, regressor, "y"):
        shares = model.featureImportances.toArray()  # two a feature
        rows += [(lead, f, float(shares[i] + shares[i + len(FEATURES)])) for i, f in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "lead int, feature string, importance double")


def by_seed(spark: SparkSession, d: str, seeds: Sequence[int], trees: int) -> DataFrame:
    """(lead, seed, station, valid, y, f, best): test forecasts of a model a seed, beside the mean of the sources."""
    t, out = split_table(spark, d), None
    fits = at_once(spark, [lambda seed=seed: fitted_by_lead(t, LEADS, lambda: regressor(trees, seed), "y") for seed in seeds])
    for seed, fit in zip(seeds, fits):
        for lead, model in fit:
            p = model.transform(t.where((F.col("lead") == lead) & (F.col("part") == "test"))).select("lead", F.lit(seed).alias("seed"), "station", "valid", "y", F.col("prediction").alias("f"), F.col("f_mean").alias("mean"))
            out = p if out is None else out.unionByName(p)
    return written(out, "seeds")


@query("ml8_seed_stability")
def ml8_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Error by seed and lead, its sample deviation over the seeds, and the change against the mean of the sources."""
    p = by_seed(spark, d, (1, 2, 3), 4)
    e = p.groupBy("lead", "seed").agg(F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"), F.avg(F.abs(F.col("mean") - F.col("y"))).alias("base"))
    g = e.groupBy("lead").agg(F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("spread"), F.avg(F.col("mae") - F.col("base")).alias("delta"), F.stddev_samp(F.col("mae") - F.col("base")).alias("delta_spread"), F.count("*").alias("seeds"))
    return rounded(g, "mae", "spread", "delta", "delta_spread")


@query("ml8_bagging_grid")
def ml8_bags(spark: SparkSession, d: str) -> DataFrame:
    """Error of the mean of the first 1, 2 and 3 seeds' forecasts, by lead."""
    p = by_seed(spark, d, (1, 2, 3), 4)
    bags = p.withColumn("bag", F.explode(F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda k: k >= F.col("seed"))))
    f = bags.groupBy("lead", "bag", "station", "valid").agg(F.avg("f").alias("f"), F.first("y").alias("y"))
    return rounded(f.groupBy("lead", "bag").agg(F.avg(F.abs(F.col("f") - F.col("y"))).alias("mae"), F.count("*").alias("n")), "mae")


@query("ml7_seed_delta")
def ml7_delta(spark: SparkSession, d: str) -> DataFrame:
    """What a candidate feature takes off the error of a linear model of the residuals: mean and sample deviation over resampled training parts."""
    t = three(spark, d, "click", "error", "view").withColumn("res", F.col("y") - (F.col("click") + F.col("error")) / 2)
    rows = written(split_by_time(t, ["station", "lead"], "valid").select("station", "lead", "valid", "res", "view", "part"), "residuals")
    out = None
    for seed in (1, 2, 3):
        own = vectors(rows, ["view"])
        kept = own.where("part = 'train'").where(F.pmod(F.xxhash64("station", "lead", "valid", F.lit(seed)), F.lit(10)) < 8)
        model = LinearRegression(featuresCol="x", labelCol="res", solver="normal").fit(kept)
        gain = F.avg(F.abs("res")) - F.avg(F.abs(F.col("res") - F.col("prediction")))
        p = model.transform(own.where("part <> 'train'")).groupBy("lead").agg(gain.alias("delta")).withColumn("seed", F.lit(seed))
        out = p if out is None else out.unionByName(p)
    return rounded(out.groupBy("lead").agg(F.avg("delta").alias("delta"), F.stddev_samp("delta").alias("spread"), F.count("*").alias("seeds")), "delta", "spread")
