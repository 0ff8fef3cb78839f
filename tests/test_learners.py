"""Support vector regression and stochastic variational models against closed or brute-force cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import learners, metrics, models


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, (1500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] + rng.normal(0, 0.05, 1500)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x, y]))], "id long, a double, b double, y double").repartition(5)


def test_sums_of_tasks_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(learners, "FAN", 3)
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("one")).repartition(20)
    got = learners.task_sums(df, ["x", "one"], lambda parts: np.sum([m.sum(axis=0) for m in parts] or [np.zeros(2)], axis=0))
    assert got.tolist() == [499_500.0, 1000.0]
    assert learners.task_sums(df.where("x < 0"), ["x"], lambda parts: next((m.sum(axis=0) for m in parts), None)) is None


def test_linear_svr_is_the_best_of_a_grid(spark):
    """A line through rows with outliers: no (slope, intercept) of a fine grid has a smaller cost."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 4, 80)
    y = 1.5 * x + 2 + rng.normal(0, 0.3, 80)
    y[:6] += 15
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    for C, epsilon in ((1.0, 0.1), (0.05, 0.5)):
        model = learners.svr(df, ["x"], "y", C=C, epsilon=epsilon, kernel="linear")
        cost = lambda w, b: 0.5 * w * w + C * np.maximum(np.abs(y - w * x - b) - epsilon, 0).sum()  # noqa: E731, B023
        best = min(cost(w, b) for w, b in itertools.product(np.linspace(0, 3, 151), np.linspace(0, 5, 251)))
        assert cost(model.coef[1], model.coef[0]) <= best * 1.002
        assert np.isclose(learners.svr_cost(df, model, "y", C, epsilon), cost(model.coef[1], model.coef[0]))
    # Outliers hardly move the line, unlike that of least squares.
    firm = learners.svr(df, ["x"], "y", C=1.0, kernel="linear")
    assert abs(firm.coef[1] - 1.5) < 0.3 and abs(firm.coef[0] - 2) < 0.5


def test_rbf_svr_on_rows_it_has_not_seen(spark, wave):
    train, test = wave.where("id < 1000"), wave.where("id >= 1000")
    model = learners.svr(train, ["a", "b"], "y", C=10.0, epsilon=0.05, gamma=0.5, n_features=60)
    out = model.predict(test)
    assert metrics.regression(out, "y", "Prediction").first()["r2"] > 0.97
    lines = metrics.regression(models.ols(train, ["a", "b"], "y").predict(test), "y", "Prediction").first()["r2"]
    assert lines < 0.8
    again = learners.Machine.of_state(model.state())
    assert np.allclose(sorted(r[0] for r in again.predict(test).select("Prediction").collect()), sorted(r[0] for r in out.select("Prediction").collect()))
    assert model.predict(spark.createDataFrame([(None, 1.0)], "a double, b double")).first()["Prediction"] is None
    with pytest.raises(ValueError, match="kernel"):
        learners.svr(train, ["a"], "y", kernel="other")
    with pytest.raises(ValueError, match="complete"):
        learners.svr(train.where("id < 0"), ["a"], "y")
    assert learners.svr(train.limit(50), ["a"], "y", n_features=5, iterations=2).predict(test).where("Prediction IS NULL").count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_stochastic_posterior_is_near_the_closed_one(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 3))
    y = 1 + x @ np.array([2.0, -1.0, 0.5]) + rng.normal(0, 0.7, 6000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])], "a double, b double, c double, y double").repartition(parts)
    cols = ["a", "b", "c"]
    exact = models.bayes_linear(df, cols, "y", iterations=20)
    got = learners.sgd_bayes(df, cols, "y", epochs=10)
    assert np.allclose(got.coef, exact.coef, atol=0.03) and np.isclose(got.noise, exact.noise, rtol=0.1)
    assert np.allclose(np.diag(got.cov), np.diag(exact.cov), rtol=0.15)
    held = learners.sgd_bayes(df, cols, "y", noise=0.5, prior=2.0, fit_noise=False, epochs=4)
    closed = models.bayes_linear(df, cols, "y", noise=0.5, prior=2.0)
    assert held.noise == 0.5 and np.allclose(held.coef, closed.coef, atol=0.03) and np.allclose(np.diag(held.cov), np.diag(closed.cov), rtol=0.15)
    row = got.predict(df.limit(5)).first()
    assert row["Variance"] > 0 and row["Lower quantile"] < row["Prediction"]


def test_stochastic_gaussian_process(spark, wave):
    train, test = wave.where("id < 1000"), wave.where("id >= 1000")
    add, model = learners.sgd_approx_gp(train, ["a", "b"], "y", n_features=25, epochs=6, batch=64)
    exact_add, exact = models.approx_gp(train, ["a", "b"], "y", n_features=25, noise=model.noise, prior=1.0)
    score = lambda a, m: metrics.regression(m.predict(a(test)), "y", "Prediction").first()["r2"]
    assert score(add, model) > 0.95 and abs(score(add, model) - score(exact_add, exact)) < 0.03
    with pytest.raises(ValueError):
        learners.sgd_bayes(train.where("id < 0"), ["a"], "y")
