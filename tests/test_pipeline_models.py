"""Saved pipelines of every model, classifiers, cross-validation with groups and weights, validation of unseen points."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import classifiers, transforms
from pixelframe.plans import pipeline

GRID = {"x0": 0, "y0": 0, "dx": 1, "dy": 1, "width": 10, "height": 10}


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(240, 2))
    rows = [(i, float(p), float(q), float(3 * p - q + 0.3 * np.sin(5 * p)), "xyz"[int(p > 0) + int(p > 0.8)], i % 12, 1.0 + i % 3) for i, (p, q) in enumerate(a)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, label string, g long, w double").withColumn("a", F.when(F.col("id") % 17 > 0, F.col("a")))


SPECS = [
    {"name": "ols"}, {"name": "bayesreg"}, {"name": "ardregression"}, {"name": "sgdbayesreg", "epochs": 2}, {"name": "approxgp", "n_features": 4}, {"name": "sgdapproxgp", "n_features": 3, "epochs": 2},
    {"name": "svr", "n_features": 6, "iterations": 2}, {"name": "cubist", "depth": 2}, {"name": "multicubist", "trees": 2, "depth": 1}, {"name": "randomforest", "trees": 3}, {"name": "multirandomforest", "forests": 2, "trees": 2},
    {"name": "krige", "variogram": "exponential"}, {"name": "mlkrige", "base": {"name": "bayesreg"}, "x": "a", "y": "b", "key": ["id"], "folds": 2}, {"name": "elasticnet"}, {"name": "gradientboost", "maxIter": 3},
]


@pytest.mark.parametrize("spec", SPECS, ids=[s["name"] for s in SPECS])
def test_saved_pipelines_predict_the_same(spark, points, spec, tmp_path):
    config = pipeline.Config.parse({"features": ["a", "b"], "target": "y", "position": [], "grid": GRID, "transforms": ["mean", "standardise"], "model": spec, "key": ["id"]})
    bundle = pipeline.learn(points, None, config)
    bundle.save(points, f"{tmp_path}/saved")
    again = pipeline.Bundle.load(spark, f"{tmp_path}/saved")
    assert again.config == config
    want, got = ({r["id"]: (r["Prediction"], r["Variance"] if "Variance" in r else None) for r in b.predict(points).collect()} for b in (bundle, again))
    assert len(want) == 240 and want.keys() == got.keys()
    for i, (p, v) in want.items():
        assert np.isfinite(p) and np.isclose(p, got[i][0], atol=1e-9) and (v is None or np.isclose(v, got[i][1], atol=1e-9))


def test_every_transform_is_saved(spark, points):
    df = points.withColumn("n", (F.col("id") % 4))
    for name in transforms.STEPS:
        cols = ["n"] if name in ("onehot", "randomhot") else ["a", "b"]
        base = df if name in ("mean", "gaus", "nearest", "onehot", "randomhot") else df.na.drop()
        (model,) = transforms.chain(base, cols, [name])
        (again,) = transforms.load_chain(json.loads(json.dumps([model.saved()])))
        assert model.names == again.names
        want, got = ([tuple(r) for r in m.apply(base).orderBy("id").select(model.names).collect()] for m in (model, again))
        assert np.allclose(np.array(want, float), np.array(got, float), equal_nan=True), name


def test_gauss_imputer_of_many_columns(spark, monkeypatch):
    """The form for any number of columns gives what the spelled-out one gives, also where a whole row is missing."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    spelled = transforms.impute_gauss(df, list("abcd"))
    monkeypatch.setattr(transforms, "SPELLED", 2)
    rows = transforms.impute_gauss(df, list("abcd"))
    assert isinstance(rows, transforms.GaussImputer)
    one, two = (np.array([tuple(r) for r in m.apply(df).orderBy("id").select(*"abcd").collect()], float) for m in (spelled, rows))
    assert np.allclose(one, two) and not np.isnan(two).any()


def test_nearest_imputer_by_brute_force(spark, points):
    model = transforms.NearestImputer(points, ["a", "b"], nodes=50, k=3)
    ref = np.array(model.state["reference"])
    for r, s in zip(points.orderBy("id").collect(), model.apply(points).orderBy("id").collect(), strict=True):
        want = r["a"] if r["a"] is not None else ref[np.argsort((ref[:, 1] - r["b"]) ** 2, kind="stable")[:3], 0].mean()
        assert np.isclose(s["a"], want) and s["b"] == r["b"]


@pytest.mark.parametrize("name, options", [("logistic", {}), ("logisticrbf", {"n_features": 20}), ("forestclassifier", {"numTrees": 5}), ("boostedtrees", {"maxIter": 3}), ("svc", {"maxIter": 20})])
def test_classifiers_have_probabilities_and_are_saved(spark, points, name, options, tmp_path):
    model = classifiers.fit(name, points, ["a", "b"], "label", weight="w", **options)
    out = model.predict(points).cache()
    assert model.classes == ["x", "y", "z"] and out.columns == [*points.columns, "Prediction", "class", "p0", "p1", "p2"]
    assert out.where("a IS NULL").count() == 0 and out.where("abs(p0 + p1 + p2 - 1) > 1e-9 OR p0 < 0 OR p1 < 0 OR p2 < 0").count() == 0
    assert out.where("Prediction = label").count() / out.count() > 0.7
    model.save(points, f"{tmp_path}/c")
    again = classifiers.Classifier.load(points, f"{tmp_path}/c").predict(points)
    assert [tuple(r) for r in again.orderBy("id").select("id", "Prediction", "p1").collect()] == [tuple(r) for r in out.orderBy("id").select("id", "Prediction", "p1").collect()]
    with pytest.raises(ValueError):
        classifiers.fit("other", points, ["a"], "label")


def test_cross_validation_of_classes(spark, points, tmp_path):
    scores, found = pipeline.cross_validate_classes(points, ["a", "b"], "label", "logistic", ["id"], folds=3, group="g", weight="w")
    rows = found.collect()
    assert len({r["id"] for r in rows}) == len(rows) == points.where("a IS NOT NULL").count()
    groups = {}
    for r in rows:
        groups.setdefault(r["id"] % 12, set()).add(r["fold"])
    assert all(len(f) == 1 for f in groups.values())
    for s in scores.collect():
        own = [r for r in rows if r["fold"] == s["fold"]]
        w = sum(r["w"] for r in own)
        assert s["n"] == len(own) and np.isclose(s["accuracy"], sum(r["w"] * (r["truth"] == r["Prediction"]) for r in own) / w)
        assert np.isclose(s["log_loss"], sum(-r["w"] * np.log(np.clip(r[f"q{r['y']}"], 1e-5, 1 - 1e-5)) for r in own) / w) and s["auc"] > 0.8
    pipeline.export_cross_validation(scores, found, f"{tmp_path}/cv")
    assert spark.read.json(f"{tmp_path}/cv/scores").count() == 3 and spark.read.parquet(f"{tmp_path}/cv/predictions").count() == len(rows)


def test_cross_validation_with_groups_and_unseen_points(spark, points, tmp_path):
    config = pipeline.Config.parse({"features": ["a", "b"], "target": "y", "position": [], "grid": GRID, "model": {"name": "bayesreg"}, "key": ["id"], "folds": 3})
    scores = pipeline.cross_validate(points, None, config, group="g", weight="w").collect()
    assert len(scores) == 3 and all(r["r2"] > 0.8 for r in scores)
    bundle = pipeline.learn(points.where("id < 150"), None, config)
    found = pipeline.validate(bundle, points.where("id >= 150"), None, f"{tmp_path}/v").first()
    assert found["r2"] > 0.8 and found["mll"] is not None
    assert spark.read.option("header", True).csv(f"{tmp_path}/v/points").count() == 90 and spark.read.json(f"{tmp_path}/v/scores").first()["r2"] == found["r2"]


def test_areas_of_all_folds_at_once(spark, monkeypatch):
    """One running sum a class gives the area of every fold, and columns that no model uses are not written."""
    from pixelframe.operators import metrics, sampling

    rows = [(i, i % 3, i % 7, round((i * 37 % 101) / 101, 1), i % 2) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, fold int, g long, q1 double, y int").withColumn("q0", 1 - F.col("q1")).withColumn("comment", F.lit("x"))
    got = {r["fold"]: r["auc"] for r in metrics.macro_auc(df, "y", ["q0", "q1"], by=["fold"]).collect()}
    for k in range(3):
        assert abs(got[k] - metrics.macro_auc(df.where(F.col("fold") == k), "y", ["q0", "q1"]).first()["auc"]) < 1e-12
    written, write = [], pipeline.materialise
    monkeypatch.setattr(pipeline, "materialise", lambda df, name: written.append((name, df.columns)) or write(df, name))
    sums, total = [], sampling.running_total
    monkeypatch.setattr(metrics, "running_total", lambda *a: sums.append(1) or total(*a))
    scores, _ = pipeline.cross_validate_classes(df.drop("fold"), ["q1"], "y", "logistic", ["id"], folds=3, group="g", maxIter=2)
    assert scores.count() == 3 and len(sums) == 2
    assert set(dict(written)["folds"]) == {"id", "q1", "y", "g", "fold"}
