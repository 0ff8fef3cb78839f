"""Rule committees: known trees, the housing sample, usage, neighbours."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.operators import metrics, rules

#: A housing sample of 15 rows (ten features, target).
HOUSING = [
    (0.006, 18.00, 2.310, 0.5380, 6.5750, 65.20, 4.0900, 1, 296.0, 15.30, 24.00), (0.027, 0.00, 7.070, 0.4690, 6.4210, 78.90, 4.9671, 2, 242.0, 17.80, 21.60), (0.027, 0.00, 7.070, 0.4690, 7.1850, 61.10, 4.9671, 2, 242.0, 17.80, 34.70),
    (0.032, 0.00, 2.180, 0.4580, 6.9980, 45.80, 6.0622, 3, 222.0, 18.70, 33.40), (0.069, 0.00, 2.180, 0.4580, 7.1470, 54.20, 6.0622, 3, 222.0, 18.70, 36.20), (0.029, 0.00, 2.180, 0.4580, 6.4300, 58.70, 6.0622, 3, 222.0, 18.70, 28.70),
    (0.088, 12.50, 7.870, 0.5240, 6.0120, 66.60, 5.5605, 5, 311.0, 15.20, 22.90), (0.144, 12.50, 7.870, 0.5240, 6.1720, 96.10, 5.9505, 5, 311.0, 15.20, 27.10), (0.211, 12.50, 7.870, 0.5240, 5.6310, 100.00, 6.0821, 5, 311.0, 15.20, 16.50),
    (0.170, 12.50, 7.870, 0.5240, 6.0040, 85.90, 6.5921, 5, 311.0, 15.20, 18.90), (0.224, 12.50, 7.870, 0.5240, 6.3770, 94.30, 6.3467, 5, 311.0, 15.20, 15.00), (0.117, 12.50, 7.870, 0.5240, 6.0090, 82.90, 6.2267, 5, 311.0, 15.20, 18.90),
    (0.093, 12.50, 7.870, 0.5240, 5.8890, 39.00, 5.4509, 5, 311.0, 15.20, 21.70), (0.629, 0.00, 8.140, 0.5380, 5.9490, 61.80, 4.7075, 4, 307.0, 21.00, 20.40), (0.637, 0.00, 8.140, 0.5380, 6.0960, 84.50, 4.4619, 4, 307.0, 21.00, 18.20),
]


def _r2(df, committee, y="y"):
    return metrics.regression(committee.predict(df), y, "Prediction").first()["r2"]


@pytest.fixture(scope="module")
def pieces(spark):
    """Three planes by two conditions, with a feature that means nothing."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 10, (3000, 3))
    y = np.where(x[:, 0] <= 5, 2 * x[:, 1] + 1, np.where(x[:, 1] <= 3, 50 - x[:, 0], 100 + 3 * x[:, 1])) + rng.normal(0, 0.05, 3000)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(np.column_stack([x, y]))], "id long, a double, b double, c double, y double")


def test_known_tree_is_found(spark, pieces):
    one = rules.fit(pieces, ["a", "b", "c"], "y", bins=64, smooth=0.0)
    assert _r2(pieces, one) > 0.97
    # Rules are disjoint and cover every row.
    held = pieces.select(sum(F.when(rules.filters.satisfied(c), 1).otherwise(0) for c, _, _ in one.members[0]).alias("n"))
    assert held.where("n <> 1").count() == 0
    firsts = [v for c, _, _ in one.members[0] for f, _, v in c if f == "a"]
    assert any(abs(v - 5) < 0.2 for v in firsts)
    for conditions, _, coef in one.members[0]:
        assert len({(c, op) for c, op, _ in conditions}) == len(conditions)
        if conditions and all(not (c == "a" and op == ">") for c, op, _ in conditions) and any(c == "a" and v < 5 for c, _, v in conditions):
            assert abs(coef.get("b", 0) - 2) < 0.1
    assert np.median([abs(coef.get("c", 0)) for _, _, coef in one.members[0]]) < 0.01


def test_a_plane_is_one_rule(spark):
    df = spark.range(500).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + 7)
    (rule,) = rules.fit(df, ["a", "b"], "y").members[0]
    assert rule[0] == [] and np.isclose(rule[1], 7, atol=1e-4) and np.isclose(rule[2]["a"], 3, atol=1e-4) and np.isclose(rule[2]["b"], -1, atol=1e-4)
    assert _r2(df, rules.fit(df, ["a", "b"], "y", members=3)) > 0.999999


def test_limits_and_options(spark, pieces):
    many = rules.fit(pieces, ["a", "b", "c"], "y")
    few = rules.fit(pieces, ["a", "b", "c"], "y", max_rules=2)
    assert len(few.members[0]) <= 2 < len(many.members[0]) and _r2(pieces, few) < _r2(pieces, many)
    bound = rules.fit(pieces, ["a", "b", "c"], "y", extrapolation=0)
    low, high = pieces.agg(F.min("y"), F.max("y")).first()
    far = spark.createDataFrame([(99.0, 99.0, 0.0), (-99.0, -99.0, 0.0), (None, 1.0, 1.0)], "a double, b double, c double")
    got = [r["Prediction"] for r in bound.predict(far).collect()]
    assert low <= got[1] and got[0] <= high and got[2] is None
    with pytest.raises(ValueError):
        rules.fit(pieces.where("id < 0"), ["a"], "y")
    flat = pieces.withColumn("a", F.lit(1.0)).withColumn("y", F.lit(4.0))
    assert np.isclose(rules.fit(flat, ["a", "b"], "y").predict(flat).first()["Prediction"], 4.0)


def test_housing_sample(spark):
    df = spark.createDataFrame([tuple(map(float, r)) for r in HOUSING], ", ".join(f"x{i} double" for i in range(10)) + ", y double")
    cols = [f"x{i}" for i in range(10)]
    scores = [_r2(df, rules.fit(df, cols, "y", members=2, sampling=90, seed=s)) for s in (0, 10)]
    many = _r2(df, rules.fit_many(df, cols, "y", trees=5, sampling=90, seed=1))
    assert all(0.68 < s < 0.8 for s in scores) and 0.5 < many < 0.95


def test_members_and_samples(spark, pieces):
    both = rules.fit(pieces, ["a", "b", "c"], "y", members=2, depth=1)
    one = rules.fit(pieces, ["a", "b", "c"], "y", members=1, depth=1)
    row = both.predict(pieces.where("id = 5")).select("*", *[v.alias(f"m{i}") for i, v in enumerate(both.values())]).first()
    assert np.isclose(row["Prediction"], (row["m0"] + row["m1"]) / 2) and np.isclose(row["Variance"], np.var([row["m0"], row["m1"]]))
    for (c1, i1, b1), (c2, i2, b2) in zip(both.members[0], one.members[0], strict=True):
        assert c1 == c2 and np.isclose(i1, i2) and b1.keys() == b2.keys() and np.allclose(list(b1.values()), list(b2.values()))
    many = rules.fit_many(pieces, ["a", "b", "c"], "y", trees=3, depth=2, members=2)
    assert len(many.members) == 6 and many.members[0] != many.members[2] and _r2(pieces, many) > 0.9
    again = rules.Committee.of_state(json.loads(json.dumps(many.state())))
    assert [r[0] for r in again.predict(pieces).select("Prediction").limit(20).collect()] == [r[0] for r in many.predict(pieces).select("Prediction").limit(20).collect()]


def test_usage_counts_rows_of_rules(spark, pieces):
    fixed = rules.Committee(["a", "b", "c"], [[([("a", "<=", 5.0)], 1.0, {"b": 2.0}), ([("a", ">", 5.0), ("b", "<=", 3.0)], 0.0, {"a": 1.0}), ([("a", ">", 5.0), ("b", ">", 3.0)], 0.0, {})]])
    rows = pieces.toPandas()
    low, mid = (rows["a"] <= 5).mean() * 100, ((rows["a"] > 5) & (rows["b"] <= 3)).mean() * 100
    got = {r["feature"]: (r["conditions"], r["models"]) for r in rules.usage(pieces, fixed).collect()}
    assert np.allclose(got["a"], (100, mid)) and np.allclose(got["b"], (100 - low, low)) and got["c"] == (0.0, 0.0)
    assert [tuple(r) for r in rules.usage(pieces.where("id < 0"), fixed).where("feature = 'a'").collect()] == [("a", 0.0, 0.0)]


def test_neighbours_mend_rules(spark, pieces):
    train, test = pieces.where("id < 2500"), pieces.where("id >= 2500")
    weak = rules.fit(train, ["a", "b"], "y", depth=1)
    mended = rules.composite(test, train, weak, "y", "id", "id")
    assert mended.count() == 500
    assert metrics.regression(mended, "y", "Prediction").first()["r2"] > _r2(test, weak)


def test_bins_by_halving_and_one_write(spark, monkeypatch):
    """A bin is the number of cuts below the value, whatever the value; a single split writes its rows once and no bins."""
    values = [float("-inf"), -1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 7.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for cuts in ([], [0.5], [0.0, 1.0], [-1.0, 0.0, 1.0, 2.0, 7.0]):
        got = df.select("v", rules.bin_of(F.col("v"), cuts).alias("b")).collect()
        assert [r["b"] for r in got] == [len(cuts) if r["v"] != r["v"] else sum(c < r["v"] for c in cuts) for r in got]
    written, write = [], rules.materialise
    monkeypatch.setattr(rules, "materialise", lambda df, name: written.append(name) or write(df, name))
    steps = spark.range(200).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") < 80, 0.0).otherwise(10.0).alias("y"))
    found = rules.fit(steps, ["a"], "y", depth=1)
    assert written == ["rules"] and found.predict(steps).where("abs(Prediction - y) > 3").count() == 2  # the nearest quantile is 81
