"""Fitted models against baselines on held-out rows, and the guards around them."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from skerry.operators import models as ml
from skerry.plans import training as tr
from skerry.plans.scoring import training_table
from skerry.plans.views import truth

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return tr.split_table(spark, DATA)


def test_regression_beats_the_mean_of_sources(spark, table):
    got = tr.ml1(spark, DATA)
    test = table.where("part = 'test'")
    assert got.count() == test.count() and got.where("f IS NULL").count() == 0
    j = got.join(test.select("lead", "station", "valid", "f_mean", "click"), ["lead", "station", "valid"])
    for r in j.groupBy("lead").agg(*[F.avg(F.abs(F.col(c) - F.col("y"))).alias(n) for c, n in (("f", "own"), ("f_mean", "mean"), ("click", "single"))]).collect():
        assert r.own < r.mean and r.own < r.single


def test_classifier_beats_the_base_rate(spark, table):
    got = tr.ml2(spark, DATA)
    rate = table.where("part = 'train'").agg(F.avg("wet")).first()[0]
    own, base, low, high = got.agg(F.avg(F.pow(F.col("p") - F.col("wet"), F.lit(2.0))), F.avg(F.pow(F.lit(rate) - F.col("wet"), F.lit(2.0))), F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1 and own < base


def planted(spark, signal: bool):
    """A table in three parts in time, whose label follows f_mean, or nothing."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / (1 << 20)
    t = spark.range(1800).withColumns({"lead": F.lit(24), "station": F.col("id") % 3, "valid": F.timestamp_seconds(F.col("id") * 3600), "f_mean": 10 * u(1)})
    t = t.withColumn("y", (F.col("f_mean") * 3 - 5 + u(2)) if signal else 10 * u(3))
    t = t.withColumn("wet", (F.col("y") >= 8).cast("int")).withColumn("part", F.when(F.col("id") < 1000, "train").when(F.col("id") < 1400, "validation").otherwise("test"))
    t = t.withColumns({"held": F.col("part") == "validation", **{f"n{k}": u(k + 10) for k in range(5)}})
    return tr.vectors(t, ["f_mean", *[f"n{k}" for k in range(5)]])


def squares(p, label):
    p = p.where("part = 'test'")
    assert p.count() == 400
    return p.agg(*[F.avg(F.pow(F.col(c) - F.col(label), F.lit(2.0))) for c in ("f", "model", "base", "f_mean")]).first()


@pytest.mark.parametrize("build,label", [(lambda: tr.regressor(30), "y"), (tr.classifier, "wet")])
def test_a_planted_signal_is_found(spark, build, label):
    own, _, base, mean = squares(tr.steadied(planted(spark, True), (24,), build, label), label)
    assert own < 0.2 * base and own < 0.2 * mean


@pytest.mark.parametrize("build,label", [(lambda: GBTRegressor(featuresCol="x", maxIter=20, maxDepth=6, seed=7), "y"), (lambda: GBTClassifier(featuresCol="x", maxIter=20, maxDepth=6, seed=7), "wet")])
def test_a_model_of_noise_gives_way_to_its_baseline(spark, build, label):
    """Deep trees without early stopping learn noise by heart."""
    own, model, base, _ = squares(tr.steadied(planted(spark, False), (24,), build, label), label)
    assert model > 1.1 * base and own < 1.02 * base


def test_pool_with_a_baseline_by_hand(spark):
    from skerry.operators import pooling as pl

    rows = [(1, 4.0, 0.0, 1.0, True), (1, 8.0, 0.0, 2.0, True), (1, 10.0, 2.0, 0.0, False), (1, None, 2.0, 0.0, False), (1, 6.0, None, 0.0, False), (2, 9.0, 1.0, 0.0, False), (None, 9.0, 1.0, None, True)]
    df = spark.createDataFrame(rows, "k int, f double, base double, y double, learn boolean")
    got = {(r.k, r.f, r.base): r.own for r in pl.held_to_baseline(df, ["k"], "f", "base", "y", F.col("learn"), "own").collect()}
    assert got == {(1, 4.0, 0.0): 1.0, (1, 8.0, 0.0): 2.0, (1, 10.0, 2.0): 4.0, (1, None, 2.0): 2.0, (1, 6.0, None): 6.0, (2, 9.0, 1.0): 1.0, (None, 9.0, 1.0): 1.0}
    assert pl.held_to_baseline(df.limit(0), ["k"], "f", "base", "y", F.col("learn"), "own").count() == 0


def test_day_classifier_gives_probabilities(spark):
    rows = tr.ml3(spark, DATA).collect()
    assert rows and all(0 <= r.p <= 1 and r.has in (0, 1) for r in rows)


def test_report_counts_the_parts(spark, table):
    want = {(r.lead, r.part): r["count"] for r in table.groupBy("lead", "part").count().collect()}
    for r in tr.ml4(spark, DATA).collect():
        assert (r.n_train, r.n_validation, r.n_test) == tuple(want[r.lead, p] for p in ("train", "validation", "test"))
        assert r.low <= r.top and 0 < r.test_mae < r.mean_mae and r.test_mae < r.best_mae


def test_live_rows_are_the_newest_day(spark, table):
    newest = table.agg(F.max("valid")).first()[0]
    live = tr.ml5(spark, DATA)
    assert live.count() > 0 and live.where((F.timestamp_diff("HOUR", F.col("valid"), F.lit(newest)) >= 24) | F.col("f").isNull()).count() == 0
    want = table.where(F.col("click").isNotNull() & (F.timestamp_diff("HOUR", F.col("valid"), F.lit(newest)) < 24)).count()
    assert live.count() == want


def test_replay_covers_all_history_and_fits_it(spark):
    got, t = tr.ml6(spark, DATA), training_table(spark, DATA)
    assert got.count() == t.count()
    j = got.join(truth(spark, DATA), ["station", "valid"]).where("lead = 24")
    own = j.agg(F.avg(F.pow(F.col("f") - F.col("y"), F.lit(2.0)))).first()[0]
    spread = j.agg(F.var_pop("y")).first()[0]
    assert own < spread  # the lead that it was fitted on


def test_leaks_and_unknown_leads_are_refused(spark, table, monkeypatch):
    with pytest.raises(ValueError, match="truth"):
        ml.replay(spark, "no folder", table, ["f_mean", "y"], tr.vectors, tr.LEAKING)
    monkeypatch.setattr(tr, "LEADS", (24, 48))
    with pytest.raises(ValueError, match="72"):
        tr.split_table(spark, DATA)


def test_importances_add_up(spark):
    got = tr.ml1_importance(spark, DATA).groupBy("lead").agg(F.sum("importance").alias("s"), F.count("*").alias("n"), F.min("importance").alias("low")).collect()
    assert len(got) == 3 and all(abs(r.s - 1) < 1e-9 and r.n == len(tr.FEATURES) and r.low >= 0 for r in got)


def test_seeds_and_bags(spark):
    seeds = tr.ml8_seeds(spark, DATA).collect()
    assert len(seeds) == 3 and all(r.seeds == 3 and r.spread >= 0 for r in seeds)
    bags = {(r.lead, r.bag): r.mae for r in tr.ml8_bags(spark, DATA).collect()}
    assert len(bags) == 9 and all(bags[lead, 3] <= 1.05 * bags[lead, 1] for lead in (24, 48, 72))
    delta = tr.ml7_delta(spark, DATA).collect()
    assert len(delta) == 3 and all(r.seeds == 3 for r in delta)


def test_a_stored_model_replays_in_another_session(spark, table):
    features = ("f_mean", "f_std")
    root = tr.stored_models(spark, table.drop("x"), features, 3)
    other = spark.newSession()
    again = lambda s: sorted((r.station, r.lead, r.valid, r.prediction, r.trained) for r in ml.replay(s, root, tr.training_table(s, DATA), features, tr.vectors).collect())
    one = again(spark)
    assert one == again(other) and len(one) == table.count() and {r[1] for r in one} == set(tr.LEADS)
    cutoff = table.where("part = 'test'").agg(F.min("valid")).first()[0]
    assert all(r[4] == (r[2] < cutoff) for r in one)
    for wrong in (("f_std", "f_mean"), ("f_mean",), ("f_mean", "f_range")):
        with pytest.raises(ValueError, match="other features"):
            ml.replay(other, root, table, wrong, tr.vectors)
    assert ml.replay(other, root, tr.training_table(other, DATA).limit(0), features, tr.vectors).count() == 0


def test_retrain_summary_reads_artefacts(spark, table):
    import datetime as dt

    fit = dict(tr.fitted_by_lead(tr.vectors(table.drop("x").where("lead = 24"), ("f_mean",)), (24,), lambda: tr.regressor(2), "y"))
    roots = [tr.shared_folder(spark, "artefact") for _ in range(3)]
    for day, root, own, best in zip((1, 5, 9), roots, (9.0, 8.0, 6.0), (8.0, 8.0, 8.0)):
        ml.store(spark, root, fit, ("f_mean",), dt.datetime(2024, 1, day), {24: {"test_mae": own, "best_mae": best}})
    got = ml.retrain_summary(ml.about(spark, *roots), [], dt.datetime(2024, 1, 1)).collect()
    assert [(r.lead, r.cutoff.day, r.test_mae, r.percent) for r in got] == [(24, 9, 6.0, -25.0)] and got[0].root.endswith(roots[2].split("/")[-1])
    assert ml.retrain_summary(ml.about(spark, *roots), [], dt.datetime(2024, 2, 1)).count() == 0
