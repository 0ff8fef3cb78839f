"""Variograms, kriging systems and regression kriging."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import kriging, models
from pixelframe.operators.kriging import MODELS, Variogram

POINTS = [(0.0, 0.0, 0.47), (1.9, 0.6, 0.56), (1.1, 3.2, 0.74), (0.0, 2.5, 1.47), (4.75, 3.8, 1.74)]


def _frame(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double, z double")


def _one(points, place, variogram, closest, drift=False):
    """A single system as in the textbook."""
    p = np.array(points, float)
    d = np.hypot(p[:, 0] - place[0], p[:, 1] - place[1])
    p = p[np.lexsort((p[:, 2], p[:, 1], p[:, 0], d))[:closest]]
    d = np.hypot(p[:, 0] - place[0], p[:, 1] - place[1])
    k = len(p)
    side = np.ones((k, 1)) if not drift else np.column_stack([np.ones(k), p[:, :2]])
    a = np.block([[variogram(np.hypot(p[:, None, 0] - p[:, 0], p[:, None, 1] - p[:, 1])), side], [side.T, np.zeros((side.shape[1],) * 2)]])
    b = np.concatenate([variogram(d), [1.0, *place][: side.shape[1]]])
    w = np.linalg.solve(a, b)
    return w[:k] @ p[:, 2], w @ b


def test_exact_variogram_by_pairs(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(0, 10, (60, 3))
    got = kriging.experimental(_frame(spark, [*p, (np.nan, 1, 1)]).replace(float("nan"), None), "x", "y", "z", 5)
    d, g = zip(*[(np.hypot(*(a[:2] - b[:2])), (a[2] - b[2]) ** 2 / 2) for a, b in itertools.combinations(p, 2)], strict=True)
    d, g = np.array(d), np.array(g)
    edges = d.min() + np.arange(6) * (d.max() - d.min()) / 5
    edges[-1] += 1e-3
    for k in range(5):
        inside = (d >= edges[k]) & (d < edges[k + 1])
        assert np.allclose([v[k] for v in got], [d[inside].mean(), g[inside].mean(), inside.sum()])


def test_variogram_by_cells_is_that_of_all_pairs(spark):
    """The same points summed up in cells: all pairs are there and the curve is the same."""
    rng = np.random.default_rng(2)
    xy = rng.uniform(0, 100, (1500, 2))
    z = np.sin(xy[:, 0] / 15) + np.cos(xy[:, 1] / 20) + rng.normal(0, 0.1, 1500)
    df = _frame(spark, np.column_stack([xy, z]))
    exact, cells = kriging.experimental(df, "x", "y", "z", 8), kriging.experimental(df, "x", "y", "z", 8, exact=10)
    assert exact[2].sum() == cells[2].sum() == 1500 * 1499 / 2
    assert np.allclose(exact[0], cells[0], rtol=0.02) and np.allclose(exact[1], cells[1], rtol=0.03)
    # Cells that hold one point each are exact but for the distance; copies of a place are pairs of distance near zero.
    twice = kriging.experimental(df.union(df), "x", "y", "z", 8, exact=10)
    assert twice[2].sum() == 3000 * 2999 / 2


@pytest.mark.parametrize("model", sorted(MODELS))
@pytest.mark.parametrize("weight", [False, True])
def test_fits_find_their_own_model(model, weight):
    d = np.linspace(0.5, 9, 12)
    true = {"linear": (0.7, 0.3), "power": (0.4, 1.4, 0.2)}.get(model, (2.0, 5.0, 0.3))
    got = kriging.fit_variogram(d, MODELS[model](true, d), model, weight)
    assert np.allclose(MODELS[model](got.parameters, d), MODELS[model](true, d), atol=2e-3)


@pytest.mark.parametrize("model", sorted(MODELS))
def test_no_grid_point_is_better_than_the_fit(model):
    """On noisy lags the fit's cost is not above that of any point of a fine grid within the bounds."""
    rng = np.random.default_rng(3)
    d = np.linspace(0.5, 9, 7)
    g = np.maximum(0.4 + 1.5 * (1 - np.exp(-d / 2)) + rng.normal(0, 0.15, 7), 0.01)
    cost = lambda p: (2 * (np.sqrt(1 + (MODELS[model](p, d) - g) ** 2) - 1)).sum()
    second = [np.linspace(0, g.max(), 40)] if model == "linear" else [np.linspace(0.001, 1.999, 40) if model == "power" else np.linspace(0.1, 9, 40), np.linspace(0, g.max(), 20)]
    first = np.linspace(0, 1 if model in ("linear", "power") else 3, 40)
    best = min(cost(p) for p in itertools.product(first, *second))
    assert cost(kriging.fit_variogram(d, g, model).parameters) <= best + 1e-6


@pytest.mark.parametrize("drift", [False, True])
@pytest.mark.parametrize("closest", [4, 10])
def test_predictions_are_exact_at_points_and_solve_the_system(spark, drift, closest):
    """The fitted linear variogram of five points; a grid around them, as the textbook solves it."""
    df = _frame(spark, POINTS)
    grid = [(0.5 * i, 0.5 * j) for i in range(11) for j in range(11)]
    out = kriging.krige(df, spark.createDataFrame(grid, "x double, y double"), "x", "y", "z", closest=closest, drift=drift)
    got = {(r["x"], r["y"]): (r["Prediction"], r["Variance"]) for r in out.collect()}
    assert len(got) == 121 and np.isclose(got[0.0, 0.0][0], 0.47) and np.isclose(got[0.0, 2.5][0], 1.47)
    distance, gamma, _ = kriging.experimental(df, "x", "y", "z")
    v = kriging.fit_variogram(distance, gamma, "linear")
    for place, value in got.items():
        assert np.allclose(value, _one(POINTS, place, v, closest, drift), atol=1e-7)


def test_many_points_clusters_and_odd_places(spark):
    rng = np.random.default_rng(4)
    p = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(40, 0.001, (300, 3)), rng.uniform(-20, 60, (50, 3))])
    places = [(-500.0, 7.0), (20.0, 20.0), (0.0, 0.0), (40.0, 40.0), (39.0, 2.0)]
    for model in ("linear", "spherical"):
        v = Variogram(model, (1.0, 0.1) if model == "linear" else (2.0, 10.0, 0.1))
        out = kriging.krige(_frame(spark, p), spark.createDataFrame([*places, (None, 1.0), places[0]], "x double, y double"), "x", "y", "z", v)
        got = [(r["x"], r["y"], r["Prediction"]) for r in out.collect()]
        assert len(got) == 7 and [g[2] for g in got if g[0] is None] == [None]
        for x, y, value in got:
            if x is not None:
                assert np.isclose(value, _one(p, (x, y), v, 10)[0], atol=1e-5)
    same = _frame(spark, [(1, 1, 2), (1, 1, 4), (3, 1, 3)])
    value = kriging.krige(same, spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "x", "y", "z", Variogram("linear", (1.0, 0.0))).first()["Prediction"]
    assert np.isclose(value, 3.0)  # equal places share their weight
    for empty in (0, 1):
        with pytest.raises(ValueError):
            kriging.krige(_frame(spark, POINTS[:empty]) if empty else _frame(spark, POINTS).where("x > 99"), df_places(spark), "x", "y", "z")


def df_places(spark):
    return spark.createDataFrame([(1.0, 1.0)], "x double, y double")


def test_drift_follows_a_plane(spark):
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 10, (40, 2))
    df = _frame(spark, np.column_stack([xy, 3 + 2 * xy[:, 0] - xy[:, 1]]))
    out = kriging.krige(df, spark.createDataFrame([(30.0, -5.0), (5.0, 5.0)], "x double, y double"), "x", "y", "z", Variogram("exponential", (1.0, 3.0, 0.1)), drift=True)
    assert all(np.isclose(r["Prediction"], 3 + 2 * r["x"] - r["y"], atol=1e-6) for r in out.collect())


def test_regression_kriging_mends_what_the_model_cannot_see(spark):
    rng = np.random.default_rng(6)
    xy, c = rng.uniform(0, 10, (400, 2)), rng.normal(size=400)
    z = 5 * c + np.sin(xy[:, 0] / 4) * 2 + np.cos(xy[:, 1] / 5)
    rows = [(i, *map(float, r)) for i, r in enumerate(np.column_stack([xy, c, z]))]
    df = spark.createDataFrame(rows, "id long, x double, y double, c double, z double")
    train, test = df.where("id < 300"), df.where("id >= 300")
    fit = lambda rows: models.bayes_linear(rows, ["c"], "z", iterations=5).predict
    out = kriging.ml_krige(train, test, fit, "x", "y", "z", ["id"], variogram="exponential")
    error = out.agg(F.avg(F.pow(F.col("z") - F.col("Prediction"), F.lit(2.0)))).first()[0]
    plain = fit(train)(test)
    assert out.count() == 100 and error < 0.1 * plain.agg(F.avg(F.pow(F.col("z") - F.col("Prediction"), F.lit(2.0)))).first()[0]
    r = out.join(plain.select("id", F.col("Prediction").alias("p"), F.col("Variance").alias("v")), "id").first()
    assert np.isclose(r["Prediction"], r["p"] + r["Residual"]) and r["Variance"] > r["v"] and r["Lower quantile"] < r["Prediction"] < r["Upper quantile"]
    no_variance = kriging.ml_krige(train, test.select("id", "x", "y", "c"), lambda rows: models.forest(rows.withColumn("z", F.col("z")), ["c"], "z", trees=3)[1], "x", "y", "z", ["id"], folds=2)
    assert no_variance.where("Prediction IS NULL").count() == 0


def test_a_variogram_of_many_rows_on_few_places_is_exact(spark):
    rng = np.random.default_rng(4)
    p = np.stack([np.arange(2500) % 37, np.arange(2500) % 23, rng.normal(size=2500)], axis=1)
    df = spark.createDataFrame(p.tolist(), "x double, y double, z double")
    a, b = np.triu_indices(len(p), 1)
    want = kriging._binned(np.sqrt(((p[a, :2] - p[b, :2]) ** 2).sum(axis=1)), (p[a, 2] - p[b, 2]) ** 2, np.ones(len(a)), 6)
    for g, w in zip(kriging.experimental(df, "x", "y", "z"), want, strict=True):
        assert np.allclose(g, w, rtol=1e-10)
