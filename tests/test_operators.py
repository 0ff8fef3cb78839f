"""Golden values and traps of the operators."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.functions import scalars as sc
from pixelframe.grid import Grid
from pixelframe.operators import cluster, filters, joins, metrics, models, raster, sampling, stats, transforms


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_population_moments_and_all_null(spark):
    df = frame(spark, [(1.0, None), (2.0, None), (6.0, None)], "a double, b double")
    s = stats.fit_moments(df, ["a"])["a"]
    assert (s["count"], s["mean"], s["min"]) == (3, 3.0, 1.0) and math.isclose(s["sd"], np.std([1, 2, 6]))
    with pytest.raises(ValueError):
        stats.fit_moments(df, ["b"])


def test_covariance_uses_marginal_means_and_pair_counts(spark):
    a, b = [1.0, 2.0, None, 4.0], [2.0, None, 5.0, 9.0]
    df = frame(spark, list(zip(a, b, strict=True)), "a double, b double")
    x, y = np.array(a, float), np.array(b, float)
    dx, dy = x - np.nanmean(x), y - np.nanmean(y)
    want = np.nansum(dx * dy) / np.count_nonzero(~np.isnan(dx * dy))
    got = {(r["a"], r["b"]): r["cov"] for r in stats.covariance(df, ["a", "b"]).collect()}
    assert math.isclose(got["a", "b"], want)


def test_standardise_drops_constant_columns_and_stays_frozen(spark):
    df = frame(spark, [(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    model = transforms.standardise(df, ["a", "c"])
    assert list(model.exprs) == ["a"]
    other = frame(spark, [(5.0, 1.0)], "a double, c double")
    assert model.apply(other).first().asDict() == {"a": 3.0}


def test_one_hot_values(spark):
    df = frame(spark, [(0,), (1,), (None,)], "v long")
    model = transforms.one_hot(df, ["v"])
    assert [tuple(r) for r in model.apply(df).collect()] == [(0.5, 0.0), (0.0, 0.5), (None, None)]
    assert tuple(model.apply(frame(spark, [(9,)], "v long")).first()) == (0.0, 0.0)
    with pytest.raises(ValueError):
        stats.levels(frame(spark, [(1.5,)], "v double"), "v")


def test_gauss_imputer_matches_matrices(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    rows = [[None if rng.random() < 0.2 else float(v) for v in r] for r in x]
    df = frame(spark, rows, "a double, b double, c double")
    mean, cov = stats.covariance_matrix(df, ["a", "b", "c"])
    got = transforms.impute_gauss(df, ["a", "b", "c"]).apply(df).collect()
    p = np.linalg.pinv(cov)
    for row, out in zip(rows, got, strict=True):
        a = [i for i in range(3) if row[i] is None]
        b = [i for i in range(3) if row[i] is not None]
        want = np.array([row[i] if row[i] is not None else mean[i] for i in range(3)])
        if a and b:
            want[a] = mean[a] - np.linalg.inv(p[np.ix_(a, a)]) @ p[np.ix_(a, b)] @ (want[b] - mean[b])
        assert np.allclose(list(out), want)


def test_nearest_imputer(spark):
    df = frame(spark, [(0.0, 0.0), (1.0, 10.0), (2.0, 20.0), (1.1, None)], "a double, b double")
    got = {r["a"]: r["b"] for r in transforms.NearestImputer(df, ["a", "b"], k=3).apply(df).collect()}
    assert got[1.1] == 10.0
    with pytest.raises(ValueError):
        transforms.NearestImputer(df.limit(2), ["a", "b"], k=3)


def test_whiten_options(spark):
    df = spark.range(50).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.col("id").cast("double").alias("c"))
    assert len(transforms.whiten(df, ["a", "b", "c"], n_components=1).exprs) == 1
    assert len(transforms.whiten(df, ["a", "b", "c"], keep_fraction=0.7).exprs) == 2
    assert len(transforms.whiten(df, ["a", "b", "c"], variation_fraction=0.9).exprs) == 1
    with pytest.raises(ValueError):
        transforms.whiten(df, ["a", "b", "c"], n_components=3)
    with pytest.raises(ValueError):
        transforms.whiten(df, ["a", "b"], n_components=1, keep_fraction=0.5)


def test_unknown_transform(spark):
    with pytest.raises(ValueError):
        transforms.chain(frame(spark, [(1.0,)], "a double"), ["a"], ["nothing"])


@pytest.mark.parametrize("step", [0.1, 0.25, 1.0, 1.5])
@pytest.mark.parametrize("origin", [-3.7, 0.0, 50.0])
def test_pixels_match_edge_search(spark, step, origin):
    n = 20
    edges = origin + np.arange(n + 1) * step
    v = np.concatenate([edges, np.random.default_rng(1).uniform(edges[0], edges[-1], 50)])
    want = np.minimum(np.searchsorted(edges, v, side="right") - 1, n - 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    g = Grid(origin, 0.0, step, 1.0, n, 1)
    inside = (v >= edges[0]) & (v <= origin + step * n)
    got = [r["p"] for r in df.select("i", g.px(F.col("v")).alias("p")).orderBy("i").collect()]
    assert [a for a, k in zip(got, inside, strict=True) if k] == want[inside].tolist()


def test_strict_points(spark):
    df = frame(spark, [(0.5, 0.5), (9.0, 0.5)], "lon double, lat double")
    g = Grid(0, 0, 1, 1, 2, 2)
    assert joins.located(df, g, "lon", "lat").count() == 1
    with pytest.raises(ValueError):
        joins.located(df, g, "lon", "lat", strict=True)


def test_patch_goldens(spark):
    px = spark.createDataFrame([(x, y, x * 4.0 + y + 1) for x in range(4) for y in range(4)], "px long, py long, value double")
    got = {(r["px"], r["py"]): r["patch"] for r in joins.patches(px.select("px", "py"), px, 1, "value").collect()}
    assert sorted(got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got[1, 1] == [1, 2, 3, 5, 6, 7, 9, 10, 11]


def test_within_is_open(spark):
    df = frame(spark, [(0.0, 1.0), (0.5, 0.5), (1.0, 0.5), (1.5, 1.5), (2.0, 2.0)], "x double, y double")
    got = {(r["x"], r["y"]): r["cell"] for r in joins.within_cells(df, "x", "y", (0, 0, 2, 2), 2, 2).collect()}
    assert got == {(0.5, 0.5): 0, (1.5, 1.5): 3}
    assert joins.within_cells(df, "x", "y", (0, 0, 2, 2), 2, 2, closed=True).count() == 5


def test_polygon(spark):
    df = frame(spark, [(0.5, 0.5), (2.0, 0.5)], "x double, y double")
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert [tuple(r) for r in df.where(joins.inside_polygon(F.col("x"), F.col("y"), ring)).collect()] == [(0.5, 0.5)]


def test_value_bins_are_right_closed(spark):
    df = frame(spark, [(0.0,), (1.0,), (1.1,), (2.0,)], "v double")
    assert [r[0] for r in df.select(sampling.value_bin("v", [0.0, 1.0, 2.0])).collect()] == [0, 0, 1, 1]


def test_resample_groups(spark):
    df = spark.range(110).select("id", F.when(F.col("id") < 100, 0).otherwise(1).alias("g"))
    counts = lambda d: {r["g"]: r["count"] for r in d.groupBy("g").count().collect()}
    assert counts(sampling.resample_groups(df, "g", 40, ["id"], True, True, 1)) == {0: 40, 1: 40}
    assert counts(sampling.resample_groups(df, "g", 40, ["id"], False, False, 1)) == {0: 100, 1: 10}


def test_draws_row_by_row(spark):
    """Every draw is the row whose number in key order the hash names; groups that stay keep their rows."""
    df = spark.range(57).select("id", (F.col("id") * 7 % 3).alias("g"), F.lit("x").alias("draw_"))
    big = df.unionByName(spark.range(100, 300).select("id", F.lit(9).cast("long").alias("g"), F.lit("x").alias("draw_")))
    sizes = {0: 19, 1: 19, 2: 19, 9: 200}
    hashes = {(r["g"], r["d"]): r["h"] for r in spark.range(40).select(F.explode(F.array(*[F.lit(g).cast("long") for g in sizes])).alias("g"), F.col("id").cast("int").alias("d")).select("g", "d", F.xxhash64("g", "d", F.lit(3)).alias("h")).collect()}
    members = {g: sorted(r["id"] for r in big.where(F.col("g") == g).collect()) for g in sizes}
    want = sorted((g, members[g][hashes[g, d] % sizes[g]]) for g in (0, 1, 2) for d in range(40))
    got = sampling.resample_groups(big, "g", 40, ["id"], False, True, 3)
    assert got.columns == big.columns
    assert sorted((r["g"], r["id"]) for r in got.where("g < 9").collect()) == want and sorted(r["id"] for r in got.where("g = 9").collect()) == members[9]
    all_drawn = sampling.resample_groups(big, "g", 40, ["id"], True, True, 3)
    assert sorted((r["g"], r["id"]) for r in all_drawn.collect()) == sorted((g, members[g][hashes[g, d] % sizes[g]]) for g in sizes for d in range(40))
    cut = sampling.resample_groups(big, "g", 40, ["id"], True, False, 3)
    order = [r["id"] for r in big.where("g = 9").orderBy(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000_007)), "id").limit(40).collect()]
    assert sorted(r["id"] for r in cut.where("g = 9").collect()) == sorted(order) and cut.where("g < 9").count() == 57


def test_resample_in_space(spark):
    rows = [(i, 0.5 + (i % 2), 0.5) for i in range(30)] + [(100, 0.5, 1.5), (101, 0.0, 0.0), (102, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = sampling.resample_spatially(df, "x", "y", 2, 2, ["id"], total=48)
    counts = {(r[0], r[1]): r[2] for r in got.groupBy(F.floor("x"), F.floor("y")).count().collect()}
    assert counts == {(0, 0): 15, (1, 0): 15, (0, 1): 12} and got.columns == df.columns  # corner points are on edges
    assert sampling.resample_spatially(df, "x", "y", 2, 2, ["id"], total=16, undersample=True).groupBy(F.floor("x"), F.floor("y")).count().where("count <> 4").count() == 0
    assert sampling.resample_spatially(df.where("id < 0"), "x", "y", 2, 2, ["id"]).count() == 0


def test_running_total_by_batches(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("i"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("int").alias("n"), F.struct("id").alias("s"), (F.col("id") / 4).alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        rows = sampling.running_total(df, ["i"], "n", "sum").orderBy("i").collect()
        assert [r["sum"] for r in rows] == np.cumsum([r["n"] or 0 for r in rows]).tolist() and rows[3]["s"]["id"] is not None
        rows = sampling.running_total(df, ["i"], "v", "sum").orderBy("i").collect()
        assert np.allclose([r["sum"] for r in rows], np.cumsum([r["v"] for r in rows]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sampling.running_total(df.where("i < 0"), ["i"], "n", "sum").count() == 0


def test_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 9).alias("g"))
    sizes = sorted(r["count"] for r in sampling.k_folds(df, ["id"], 5).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    whole = sampling.group_folds(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("k"))
    assert whole.where("k <> 1").count() == 0
    a, b = sampling.split_groups(df, "g", 0.4)
    assert a.count() + b.count() == 103 and a.join(b, "g").count() == 0
    with pytest.raises(ValueError):
        sampling.random_rows(df, ["id"], 1000)
    assert sampling.random_rows(df, ["id"], 10).count() == 10


def test_regression_goldens(spark):
    good = metrics.regression(frame(spark, [(1.0, 1.0), (2.0, 2.0)], "y double, p double"), "y", "p").first()
    assert good["r2"] == 1 and good["mse"] == 0
    flat = metrics.regression(frame(spark, [(0.0, 1.0), (2.0, 1.0)], "y double, p double"), "y", "p").first()
    assert flat["r2"] == 0 and flat["mse"] == 1


def test_classification_goldens(spark):
    df = frame(spark, [(0, 0, 1.0, 0.0), (1, 0, 0.5, 0.5)], "y int, e int, p0 double, p1 double")
    assert metrics.classification(df, "y", "e", ["p0", "p1"]).first()["accuracy"] == 0.5
    got = {(r["truth"], r["prediction"]): r["n"] for r in metrics.confusion(df, "y", "e", [0, 1]).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (1, 0): 1, (1, 1): 0}


def test_kmeans_blobs(spark):
    rows = [(1.0, 0.0), (1.0, 0.1), (1.0, -0.1), (10.0, 0.0), (10.0, 0.1), (10.0, -0.1)]
    df = frame(spark, rows, "a double, b double")
    got = cluster.KMeans(2).fit(df, ["a", "b"]).predict(df).collect()
    assert len({r["class"] for r in got if r["a"] == 1.0}) == 1 and len({r["class"] for r in got}) == 2


def test_kmeans_labels_set_centres(spark):
    df = frame(spark, [(1.0, 1), (1.2, None), (10.0, 0), (10.2, None)], "a double, l int")
    got = cluster.KMeans(2).fit(df, ["a"], "l").predict(df).collect()
    assert {r["a"]: r["class"] for r in got} == {1.0: 1, 1.2: 1, 10.0: 0, 10.2: 0}


def test_linear_models(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, 200)
    y = 3 + 2 * x + rng.normal(0, 1e-3, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    for model in (models.ols(df, ["x"], "y"), models.bayes_linear(df, ["x"], "y", iterations=10), models.ard(df, ["x"], "y")):
        assert np.allclose(model.coef, [3, 2], atol=0.01)
    gp = models.ExactGp(df.limit(80), ["x"], "y").predict(df.limit(20)).collect()
    assert all(abs(r["Prediction"] - r["y"]) < 0.3 for r in gp)
    add, m = models.approx_gp(df, ["x"], "y", n_features=10)
    assert metrics.regression(m.predict(add(df)), "y", "Prediction").first()["r2"] > 0.95


def test_rules_sum_and_fit(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i if i < 50 else 300.0 - i) for i in range(100)], "x double, y double")
    both = models.rules([([("x", "<", 60)], 1.0, {}), ([("x", ">", 40)], 2.0, {})])
    assert [r[0] for r in df.where("x in (10, 50, 90)").select(both).collect()] == [1.0, 3.0, 2.0]
    fitted = models.rules(models.fit_rules(df, ["x"], "y", depth=1))
    assert metrics.regression(df.withColumn("p", fitted), "y", "p").first()["r2"] > 0.9


def test_forest_variance_and_mllib(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") > 30).cast("int").alias("c"))
    _, predict = models.forest(df, ["x"], "y", trees=4, depth=3)
    assert all(r["Variance"] >= 0 for r in predict(df).collect())
    assert models.mllib("logistic", df, ["x"], "c").transform(df).where("prediction = c").count() > 50
    with pytest.raises(ValueError):
        models.mllib("nothing", df, ["x"], "y")


def test_target_transforms_round_trip(spark):
    rng = np.random.default_rng(0)
    y = np.concatenate([rng.normal(0, 1, 60), rng.normal(5, 1, 60)]) + 10
    df = spark.createDataFrame([(float(v),) for v in y], "y double")
    for t in (sc.identity(), sc.standardise(df, "y"), sc.sqrt(1.0), sc.log(df, "y"), sc.logistic(0.1), sc.RankGaussian(df, "y"), sc.Kde(df, "y")):
        back = [r[0] for r in df.select(t.inverse(t.forward(F.col("y")))).collect()]
        assert np.allclose(sorted(back), sorted(y), atol=0.05)


def test_interpolation_ends(spark):
    k, v = F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(10.0), F.lit(30.0))
    got = spark.range(1).select(*[sc.interpolate(k, v, x).alias(str(i)) for i, x in enumerate((0, 1, 2, 3, 9))]).first()
    assert list(got) == [10, 10, 20, 30, 30]


def test_kernel_impute_and_mirror(spark):
    px = spark.createDataFrame([(x, y, "b", None if (x, y) == (1, 1) else 2.0) for x in range(4) for y in range(4)], "px int, py int, band string, value double")
    kernel = raster.footprint(1, 1, 1, 2, 0.1)
    got = raster.kernel_impute(px, kernel).where("px = 1 and py = 1").first()["value"]
    assert math.isclose(got, 2.0, rel_tol=1e-6)
    assert raster.mirror(px.select("px", "py", "value"), 4, 4).count() == 49


def test_filters(spark):
    df = frame(spark, [(1, 1.0, None), (2, None, None), (3, float("nan"), 1e39)], "id int, a double, b double")
    assert filters.cull_all_null(df, ["a", "b"]).count() == 2
    assert [r[0] for r in df.select(filters.clean_float(F.col("b"))).collect()] == [None, None, None]
    keep, drop = filters.valid_points(df, ["a"])
    assert (keep.count(), drop.count()) == (1, 2)
    back = filters.apply_complete(df.select("id", "a"), ["id"], ["a"], lambda d: d.select("id", (F.col("a") * 2).alias("b")))
    assert back.count() == 3


def test_shapefile(spark, tmp_path):
    from pixelframe.sources import shapes

    shp, dbf = shapes.write_points([(1.0, 2.0), (3.0, 4.0)], [("v", "N", 8), ("name", "C", 5)], [[1.5, "ab"], [None, "c"]])
    for ext, data in (("shp", shp), ("dbf", dbf)):
        with open(os.path.join(tmp_path, f"p.{ext}"), "wb") as f:
            f.write(data)
    got = shapes.read_points(spark, os.path.join(tmp_path, "p"), "v").collect()
    assert [tuple(r) for r in got] == [(1.0, 2.0, 1.5, "ab"), (3.0, 4.0, None, "c")]
    with pytest.raises(ValueError, match="name"):
        shapes.read_points(spark, os.path.join(tmp_path, "p"), "nothing")


def test_lists_and_targets(spark, tmp_path):
    from pixelframe.sources import files

    path = os.path.join(tmp_path, "l.csv")
    with open(path, "w") as f:
        f.write("# c\nb.tif,x\n\nA.tif\n")
    assert files.read_list(spark, path) == ["b.tif", "A.tif"]
    assert files.feature_names(["x/b.tif", "x/A.tif"]) == ["A", "b"]
    df = frame(spark, [(1.0, 5.0, 3.0), (0.0, 5.0, 4.0), (9.0, 1.0, 2.0)], "lon double, lat double, v double")
    assert [r["y"] for r in files.targets(df, "v", "lon", "lat").collect()] == [2.0, 4.0, 3.0]


def test_pipeline(spark):
    from pixelframe.plans import pipeline

    config = pipeline.Config.parse({"features": ["a"], "target": "y", "position": ["lon", "lat"], "grid": {"x0": 0, "y0": 0, "dx": 1, "dy": 1, "width": 10, "height": 10}, "folds": 3, "key": ["id"]})
    px = spark.createDataFrame([(x, y, float(x + y)) for x in range(10) for y in range(10)], "px long, py long, a double")
    pts = spark.createDataFrame([(i, i % 10 + 0.5, i // 10 + 0.5, 2.0 * (i % 10 + i // 10) + 1) for i in range(100)], "id int, lon double, lat double, y double")
    bundle = pipeline.learn(pts, px, config)
    mask = px.select("px", "py", F.when(F.col("px") < 5, 1).otherwise(0).alias("value"))
    out = pipeline.predict_pixels(bundle, px, mask)
    assert out.count() == 100 and out.where("Prediction is not null").count() == 50
    assert all(r["r2"] > 0.99 for r in pipeline.cross_validate(pts, px, config).collect())
    with pytest.raises(ValueError):
        pipeline.Config.parse({"nonsense": 1})


def test_streaming(spark, tmp_path):
    from pixelframe import streaming

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    events = streaming.read_events(spark, f"{tmp_path}/events")
    got = streaming.run_to_end(streaming.windowed(events), "w_events", "complete")
    total = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert got.agg(F.sum("n")).first()[0] == total


def test_components(spark):
    from pixelframe.operators.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 51: 50, 60: 60}


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.5, (40, 2)), rng.normal(8, 0.5, (30, 2)), [[4.0, 4.0], [20.0, 20.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "k long, x double, y double")
    got = {r["k"]: r["grp"] for r in cluster.dbscan(df, "x", "y", "k", 1.0, 5).collect()}
    near = ((pts[:, None] - pts) ** 2).sum(axis=2) <= 1.0
    core = near.sum(axis=1) >= 5
    label = {i: i for i in range(len(pts)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in label if near[i, j])
            changed |= low < label[i]
            label[i] = low
    want = {i: label[i] if i in label else min([label[j] for j in label if near[i, j]], default=-1) for i in range(len(pts))}
    assert got == want


def test_sampled_shap_of_a_linear_model(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), 2.0 * i - 3.0 * (i % 3)) for i in range(30)], "id int, a double, b double, y double")
    m = models.ols(df, ["a", "b"], "y")
    exact = {r["id"]: r for r in models.linear_shap(df, m).collect()}
    for r in models.sampled_shap(df.where("id < 3"), ["a", "b"], "id", m.predict, df, permutations=2).collect():
        assert math.isclose(r["shap"], exact[r["id"]][f"shap_{r['feature']}"], abs_tol=1e-6)


def test_pca_order(spark):
    df = spark.range(40).select((F.col("id") * 5.0).alias("a"), (F.col("id") % 4).cast("double").alias("b"))
    model = transforms.pca(df, ["a", "b"])
    assert list(model.exprs) == ["pc_1", "pc_2"]
    out = model.apply(df.withColumn("copy", F.col("a")))
    assert abs(out.agg(F.corr("pc_1", "copy")).first()[0]) > 0.99


def test_points_of_deleted_records_are_left_out(spark, tmp_path):
    from pixelframe.sources import shapes

    shp, dbf = shapes.write_points([(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)], [("v", "N", 8)], [[1.5], [2.5], [3.5]])
    head, size = 33 + 32, 9
    dbf = bytearray(dbf)
    dbf[head + size] = 0x2A
    (tmp_path / "d.shp").write_bytes(shp)
    (tmp_path / "d.dbf").write_bytes(bytes(dbf))
    got = sorted(map(tuple, shapes.read_points(spark, str(tmp_path / "d")).collect()))
    assert got == [(1.0, 2.0, 1.5), (5.0, 6.0, 3.5)]


def test_kmeans_gives_empty_classes_different_places(spark):
    df = spark.createDataFrame([(float(i % 3), 0.0) for i in range(30)] + [(50.0 + i, 1.0) for i in range(3)], "a double, b double")
    a, b = (cluster.KMeans(6, iterations=5).fit(df.repartition(n), ["a", "b"]).centres for n in (1, 4))
    assert len({tuple(c) for c in a.tolist()}) == 6 and sorted(map(tuple, a.tolist())) == sorted(map(tuple, b.tolist()))


def test_nearest_rows_against_brute_force(spark):
    rng = np.random.default_rng(8)
    q, r = rng.normal(size=(60, 2)), np.vstack([rng.normal(size=(80, 2)), np.repeat([[0.1, 0.2]], 30, axis=0), [[400.0, -300.0]]])
    q[0] = (1000.0, 1000.0)
    qs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)] + [(99, None, 1.0)], "q long, x double, y double")
    rs = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r)], "r long, u double, v double")
    got = {}
    for x in joins.nearest(qs, rs, ["x", "y"], ["u", "v"], 5, "q", "r").collect():
        got.setdefault(x["q"], []).append((x["rank"], x["r"]))
    for i, p in enumerate(q):
        d = np.sqrt(((r - p) ** 2).sum(axis=1))
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(len(r)), np.round(d, 12)))[:5].tolist()
    assert set(got) == set(range(60))
    assert joins.nearest(qs, rs.where("r < 0"), ["x", "y"], ["u", "v"], 5, "q", "r").count() == 0


def test_running_totals_and_bootstrap(spark):
    df = spark.createDataFrame([(i % 7, i, 1 + i % 3) for i in range(200)], "g int, i int, n int")
    got = {r["i"]: r["s"] for r in sampling.running_total(df, ["i"], "n", "s").collect()}
    assert got == {i: sum(1 + j % 3 for j in range(i + 1)) for i in range(200)}
    draws = sampling.bootstrap_draws(df, "g", ["i"], 40).collect()
    assert len(draws) == 280 and len({(r["g"], r["draw"]) for r in draws}) == 280 and all(r["i"] % 7 == r["g"] for r in draws)
    assert len({r["i"] for r in draws if r["g"] == 0}) < 29  # some twice, some never
    with pytest.raises(KeyError):
        sampling.resample_values(df, "i", 5, 50, ["i"], interval="cubic")


def test_many_rows_on_few_places_are_paired_by_place(spark):
    """40000 rows on four places: 1.6e9 pairs of rows, ten of places."""
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("id") % 7).cast("double").alias("z"))
    near = {(r["x"], r["neighbours"], r["core"]) for r in cluster.core_points(df, "x", "y", "k", 1.0, 25_000).join(df, "k").distinct().collect()}
    assert near == {(0.0, 20_000, False), (1.0, 30_000, True), (2.0, 30_000, True), (3.0, 20_000, False)}
    assert [(r["grp"], r["n"]) for r in cluster.dbscan(df, "x", "y", "k", 1.0, 25_000).groupBy("grp").agg(F.count("*").alias("n")).collect()] == [(1, 40_000)]
    assert {r["grp"] for r in cluster.dbscan(df, "x", "y", "k", 1.0, 35_000).collect()} == {-1}
    x, z = np.arange(40_000) % 4, np.arange(40_000) % 7.0
    for r in models.variogram(df, "x", "y", "z", 1.0, 3).collect():
        pairs = [(a, a + r["bin"]) for a in range(4 - r["bin"])]
        total = sum(10_000 * ((z[x == a] ** 2).sum() + (z[x == b] ** 2).sum()) - 2 * z[x == a].sum() * z[x == b].sum() for a, b in pairs) / (2 if r["bin"] == 0 else 1)
        n = sum(10_000 * 9_999 // 2 if a == b else 10_000**2 for a, b in pairs)
        assert (r["n"], round(r["distance"], 9)) == (n, r["bin"]) and abs(r["gamma"] - total / n / 2) < 1e-9


def test_joins_by_few_keys_deal_their_pairs(spark):
    """Few input bytes and many pairs: tasks are counted by pairs and Spark does not merge them."""
    a = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 3 * 10.0).alias("v"))
    b = spark.range(600).select(F.col("id").alias("b"), (F.col("id") % 3 * 10.0).alias("r_v"))
    want = a.join(b, F.col("v") == F.col("r_v"))
    got = joins.spread_join(a, b.withColumnRenamed("r_v", "v"), ["v"], pairs=10_000)
    assert got.groupBy(F.spark_partition_id()).count().count() > 20
    assert sorted(map(tuple, got.select("a", "b").collect())) == sorted(map(tuple, want.select("a", "b").collect()))
    band = joins.band_join(a, b, "v", 10.0)
    assert band.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert band.count() == sum(1000 * 200 for i in range(3) for j in range(3) if abs(i - j) <= 1)


def test_nearest_rows_are_not_broadcast(spark, monkeypatch):
    plans = []
    kept = joins.materialise
    monkeypatch.setattr(joins, "materialise", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    qs = spark.range(50).select(F.col("id").alias("q"), F.col("id").cast("double").alias("x"))
    rs = spark.range(50).select(F.col("id").alias("r"), (F.col("id") + 0.25).alias("u"))
    out = joins.nearest(qs, rs, ["x"], ["u"], 3, "q", "r")
    assert out.count() == 150 and plans and not any("BroadcastHashJoin" in p for p in [*plans, out._jdf.queryExecution().executedPlan().toString()])


def test_neighbours_meet_in_blocks(spark):
    """Sparse pixels on both sides of block edges against brute force; pixels are not copied for each offset before a shuffle."""
    rng = np.random.default_rng(3)
    cells = {(int(a), int(b)) for a, b in rng.integers(-70, 140, size=(6000, 2))} | {(x, y) for x in range(60, 70) for y in range(-4, 5)}
    value = {c: float(i % 97) if i % 5 else None for i, c in enumerate(sorted(cells))}
    px = spark.createDataFrame([(*c, v) for c, v in value.items()], "px long, py long, value double").repartition(3)
    kernel = {(i, j): 1.0 + i + 2 * j if (i, j) != (-1, -1) else 0.5 for i in (-1, 0, 1) for j in (-1, 0, 1)}
    sums = {c: [sum(w * (f(value[c[0] - i, c[1] - j])) for (i, j), w in kernel.items() if value.get((c[0] - i, c[1] - j)) is not None) for f in (lambda v: v, lambda v: 1.0)] for c in value}
    got = {(r["px"], r["py"]): r["value"] for r in raster.convolve(px, kernel).collect()}
    assert set(got) == {c for c, v in value.items() if v is not None}
    assert all(abs(got[c] - sums[c][0] / max(sums[c][1], 1e-15)) < 1e-9 * max(1.0, abs(got[c])) for c in got)
    got = {(r["px"], r["py"]): r["value"] for r in raster.kernel_impute(px, {k: 1.0 for k in kernel}).collect()}
    assert set(got) == set(value) and all(got[c] == v for c, v in value.items() if v is not None)
    around = lambda c, span: [value[c[0] + i, c[1] + j] for i in span for j in span if (c[0] + i, c[1] + j) in value]
    for c in (c for c, v in value.items() if v is None):
        near = [v for v in around(c, (-1, 0, 1)) if v is not None]
        assert (got[c] is None and not near) or abs(got[c] - sum(near) / len(near)) < 1e-9
    got = {(r["px"], r["py"]): r["patch"] for r in joins.patches(px.select("px", "py"), px, 1, "value").collect()}
    assert got == {c: around(c, (-1, 0, 1)) for c in value if len(around(c, (-1, 0, 1))) == 9} and got
    out = joins.windows(px.select("px", "py", F.col("px").alias("cx"), F.col("py").alias("cy")), px, 4)
    assert out.columns == ["px", "py", "cx", "cy", "ox", "oy", "value"] and out.where("px <> cx - 2 + ox or py <> cy - 2 + oy").count() == 0
    assert {(r["cx"], r["cy"]): r["n"] for r in out.groupBy("cx", "cy").agg(F.count("*").alias("n")).collect()} == {c: len(around(c, (-2, -1, 0, 1))) for c in value}
    plan = raster.convolve(px, kernel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "bx" in plan


def test_sensor_pairs_meet_lists_of_cells(spark, monkeypatch):
    """A place's cells are passed as lists, dealt once by their place; repeated rows, null cells and both zeros count."""
    made, asked = [], []
    monkeypatch.setattr(joins, "spread_join", lambda *a, f=joins.spread_join, **k: (made.append(a), asked.append(f(*a, **k)), asked[-1])[2])
    monkeypatch.setattr(joins, "PACK", 7)
    sensors = [(1, 0.0, 0.0, 5.0), (1, 0.0, 0.0, 5.0), (2, 3.0, 1.0, 5.0), (3, 90.0, 90.0, 5.0), (None, 1.0, 1.0, 5.0)]
    cells = [(i, 1.0, 2.0) for i in range(20)] + [(None, 1.0, 2.0)] * 9 + [(7, 0.0, 0.0), (7, -0.0, 0.0), (8, 50.0, 0.0), (9, None, 0.0)]
    got = joins.sensor_pairs(spark.createDataFrame(sensors, "sensor long, x double, y double, z double"), spark.createDataFrame(cells, "cell long, gx double, gy double"), 4.0, 0.01, 0.02, digits=9)
    want = []
    for s, x, y, z in sensors:
        for c, gx, gy in cells:
            if gx is not None and abs(x - gx) <= 4 and abs(y - gy) <= 4:
                r2 = (x - gx) ** 2 + (y - gy) ** 2 + z * z
                v = math.exp(-0.01 * math.sqrt(r2)) / r2
                want += [(s, c, round(v, 9))] if v > 0.02 else []
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 100
    right = made[0][1]
    assert right.schema["cells"].dataType.simpleString() == "array<bigint>" and right.selectExpr("max(size(cells))").first()[0] <= 7
    plan = asked[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for each side, by the number of pairs
