"""Attributions of forests against the enumeration of all sets of features."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from pixelframe.operators import attributions, models

COLS = ["a", "b", "c", "d"]


def _expected(node, x, known):
    """Value of a tree where only the ``known`` features of x are seen; other splits go both ways by their training rows."""
    if node.numDescendants() == 0:
        return node.prediction()
    i, at, left, right = node.split().featureIndex(), node.split().threshold(), node.leftChild(), node.rightChild()
    if i in known:
        return _expected(left if x[i] <= at else right, x, known)
    n = node.impurityStats().count()
    return (left.impurityStats().count() * _expected(left, x, known) + right.impurityStats().count() * _expected(right, x, known)) / n


def test_sums_and_enumeration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).round(2)
    y = 2 * x[:, 0] + x[:, 1] * x[:, 2] + np.where(x[:, 3] > 0, 1.5, 0) * x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x, y]))], "id long, a double, b double, c double, d double, y double")
    model, predict = models.forest(df, COLS, "y", trees=3, depth=4)
    out = attributions.forest_shap(predict(df), [model], COLS)
    apart = out.select(F.max(F.abs(F.col("shap_base") + sum((F.col(f"shap_{c}") for c in COLS), F.lit(0.0)) - F.col("Prediction")))).first()[0]
    assert apart < 1e-9 and out.count() == 300
    roots = [t._call_java("rootNode") for t in model.trees]
    for r in out.where("id < 6").collect():
        row = [r[c] for c in COLS]
        for i, c in enumerate(COLS):
            others = [j for j in range(4) if j != i]
            value = 0.0
            for k in range(4):
                w = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                for some in itertools.combinations(others, k):
                    value += w * sum(_expected(t, row, {*some, i}) - _expected(t, row, set(some)) for t in roots) / len(roots)
            assert np.isclose(value, r[f"shap_{c}"], atol=1e-9)
        assert np.isclose(r["shap_base"], sum(_expected(t, row, set()) for t in roots) / len(roots))


def test_null_rows_and_single_leaf(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 1.0, 5.0), (None, 1.0, 5.0)], "a double, b double, y double")
    model, _ = models.forest(df, ["a", "b"], "y", trees=2, depth=2)
    rows = attributions.forest_shap(df, [model], ["a", "b"]).orderBy("b", "a").collect()
    assert rows[0]["a"] is None and rows[0]["shap_a"] is None and rows[0]["shap_base"] is None
    assert [(r["shap_a"], r["shap_b"], r["shap_base"]) for r in rows[1:]] == [(0.0, 0.0, 5.0)] * 2
