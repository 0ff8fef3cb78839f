"""Searches on fixed objectives, and super learners."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import metrics
from pixelframe.plans import superlearn, tuning

SPACE = {"a": ("uniform", -2.0, 3.0), "b": ("log", 1e-3, 10.0), "n": ("int", 1, 9), "kind": ("choice", ["p", "q", "r"])}


def objective(p):
    return (p["a"] - 1) ** 2 + (math.log10(p["b"]) + 1) ** 2 + 0.2 * abs(p["n"] - 6) + {"p": 1.0, "q": 0.0, "r": 0.5}[p["kind"]]


def test_points_and_parameters():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p = tuning.value(SPACE, tuning.draw(SPACE, rng))
        assert -2 <= p["a"] <= 3 and 1e-3 <= p["b"] <= 10 and p["n"] in range(1, 10)
        again = tuning.value(SPACE, tuning.unit_of(SPACE, p))
        assert np.isclose(again["a"], p["a"]) and np.isclose(again["b"], p["b"]) and again["n"] == p["n"] and again["kind"] == p["kind"]


def test_models_of_trials_beat_random_draws():
    """Mean of the best loss over ten seeds of 60 trials."""
    found = {}
    for method in tuning.METHODS:
        bests = []
        for seed in range(10):
            rng, history = np.random.default_rng(seed), []
            for _ in range(60):
                unit = tuning.propose(SPACE, history, method, rng)
                history.append((unit, objective(tuning.value(SPACE, unit))))
            bests.append(min(loss for _, loss in history))
        found[method] = np.mean(bests)
    assert all(found[m] < 0.7 * found["random"] for m in ("tpe", "bayes", "anneal")), found
    with pytest.raises(ValueError):
        tuning.propose(SPACE, [], "other", np.random.default_rng(0))


def test_table_of_trials_is_kept_and_gone_on_from(spark, tmp_path):
    ran = []

    def some(p):
        ran.append(p)
        if p["kind"] == "r":
            raise RuntimeError("cannot be run")
        return objective(p)

    path = f"{tmp_path}/trials"
    first = tuning.search(spark, some, SPACE, 10, path, parallel=3)
    assert first.count() == len(ran) == 10 and first.where("loss IS NULL").count() == sum(p["kind"] == "r" for p in ran)
    more = tuning.search(spark, some, SPACE, 14, path, parallel=3)
    assert len(ran) == 14 and sorted(r["trial"] for r in more.collect()) == list(range(14))
    row = more.orderBy("loss").where("loss IS NOT NULL").first()
    assert np.isclose(objective(tuning.best(more)), row["loss"])
    steps = [r["best"] for r in tuning.improvement(more).orderBy("trial").collect() if r["best"] is not None]
    assert steps == sorted(steps, reverse=True) and steps[-1] == row["loss"]


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, (500, 2))
    y = np.where(x[:, 0] > 0, 4, 0) + x[:, 1] + rng.normal(0, 0.2, 500)
    return spark.createDataFrame([(i, i % 10, *map(float, r)) for i, r in enumerate(np.column_stack([x, y]))], "id long, g long, a double, b double, y double")


def test_super_learner_is_no_worse_than_its_bases(spark, waves):
    train, test = waves.where("id < 400"), waves.where("id >= 400")
    bases = [{"name": "ols"}, {"name": "randomforest", "trees": 5, "depth": 4}]
    learner = superlearn.learn(train, ["a", "b"], "y", ["id"], bases, folds=4)
    scores = {r["learner"]: r["r2"] for r in learner.scores().collect()}
    assert scores["meta ols"] > max(scores["p0 ols"], scores["p1 randomforest"]) - 0.01 and scores["p1 randomforest"] > scores["p0 ols"]
    assert metrics.regression(learner.predict(test), "y", "Prediction").first()["r2"] > 0.9
    assert learner.folds.count() == 400 and learner.folds.where("p0 IS NULL OR p1 IS NULL OR meta IS NULL").count() == 0


def test_folds_do_not_leak(spark, waves):
    """A row's out-of-fold prediction is that of a line through the other folds, and whole groups lie in one fold."""
    from pixelframe.operators import models

    learner = superlearn.learn(waves, ["a", "b"], "y", ["id"], [{"name": "ols"}], {"name": "mean"}, folds=3, group="g")
    rows = learner.folds
    assert rows.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    for k in range(3):
        line = models.ols(rows.where(F.col("fold") != k), ["a", "b"], "y")
        apart = line.predict(rows.where(F.col("fold") == k)).where("abs(p0 - Prediction) > 1e-9 OR abs(meta - p0) > 1e-9")
        assert apart.count() == 0
    # A target that is known for one fold alone does not reach that fold's predictions.
    odd = waves.withColumn("y", F.when(F.col("g") == 3, 1e6).otherwise(F.col("y")))
    leak = superlearn.learn(odd, ["a", "b"], "y", ["id"], [{"name": "ols"}], folds=10, group="g").folds
    assert leak.where("g = 3 AND (abs(p0) > 100 OR abs(meta) > 100)").count() == 0


def test_positive_weights_by_grid(spark):
    rng = np.random.default_rng(4)
    p = rng.normal(size=(200, 3))
    y = 0.7 * p[:, 0] + 0.2 * p[:, 1] - 0.5 * p[:, 2] + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([p, y])], "p0 double, p1 double, p2 double, y double")
    w = superlearn.positive_weights(df, ["p0", "p1", "p2"], "y").coef
    cost = lambda v: ((y - p @ np.array(v)) ** 2).sum()
    assert w[0] == 0 and (w[1:] >= 0).all() and w[3] == 0
    assert cost(w[1:]) <= min(cost(v) for v in itertools.product(*[np.linspace(0, 1, 21)] * 3)) + 1e-9
    learner = superlearn.learn(df.toDF("a", "b", "c", "y").withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "y", ["id"], [{"name": "ols"}, {"name": "bayesreg"}], {"name": "weights"}, folds=2)
    assert sum(learner.meta.state["linear"]["coef"]) > 0.8
    with pytest.raises(ValueError, match="rename"):
        superlearn.learn(df, ["p0", "p1"], "y", ["p2"], [{"name": "ols"}])


def test_super_learner_fits_all_rows_when_asked(spark, waves, monkeypatch):
    """Out-of-fold tables need a fit for each fold only; the models of all rows are fitted once, by the first prediction."""
    sizes, fit = [], superlearn.fit_model
    monkeypatch.setattr(superlearn, "fit_model", lambda df, cols, y, spec: sizes.append(df.count()) or fit(df, cols, y, spec))
    learner = superlearn.learn(waves, ["a", "b"], "y", ["id"], [{"name": "ols"}], folds=2)
    assert learner.folds.count() == 500 and sizes == [250] * 4  # a base and a meta model for each fold
    first = learner.predict(waves).count()
    assert first == learner.predict(waves).count() == 500 and sizes[4:] == [500, 500]
