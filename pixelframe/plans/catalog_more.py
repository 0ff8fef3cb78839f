"""More of the query catalogue: saved models, sinks, resampling, row filters and validation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pixelframe.functions import scalars as sc
from pixelframe.grid import Grid
from pixelframe.operators import attributions, filters, kriging, learners, metrics, models, polygons, raster, rules, sampling, stats, tiles, transforms
from pixelframe.plans.catalog import _CL, _V, COLS, KEY, LI, PX, _classes, _scored, covariates, pixels, query, r6, table
from pixelframe.plans import pipeline, superlearn, tuning
from pixelframe.plans.materialise import materialise, shared_folder
from pixelframe.sources import files, gtiff

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice / (1 + o_custkey), 6) END AS z FROM orders")
def flt_apply_complete(spark, sf_dir):
    """A function of complete rows; the others get nulls."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("q"))
    return r6(filters.apply_complete(o, ["o_orderkey"], ["q", "o_custkey"], lambda x: x.select("o_orderkey", (F.col("q") / (1 + F.col("o_custkey"))).alias("z"))))


@query(f"WITH {LI} SELECT round(avg(q * q), 6) AS q, round(avg(d * d), 6) AS d, round(avg(t * t), 6) AS t FROM li")
def agg_power(spark, sf_dir):
    return r6(covariates(spark, sf_dir).agg(*[F.avg(stats.power(F.col(c), 2)).alias(c) for c in COLS]))


@query("SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY 1")
def agg_class_number(spark, sf_dir):
    """Number of classes of each group."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("n"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def flt_keep_fields(spark, sf_dir):
    return filters.keep_fields(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "s_acctbal", "absent"])


@query(f"WITH {PX}, m AS (SELECT px, py, CASE WHEN (px + py) % 3 = 0 THEN NULL ELSE value END AS dem FROM px) SELECT px.px, px.py, CASE WHEN dem IS NOT NULL THEN round(value, 6) END AS value FROM px JOIN m ON px.px = m.px AND px.py = m.py")
def flt_dem_mask(spark, sf_dir):
    """Values only where an elevation raster has one."""
    px = pixels(spark, sf_dir)
    dem = px.select("px", "py", F.when((F.col("px") + F.col("py")) % 3 != 0, F.col("value")).alias("dem"))
    return r6(filters.dem_mask(px, dem, ["value"]))


@query("SELECT o_orderkey, round(o_totalprice, 6) AS t, round(o_totalprice, 4) AS back FROM orders")
def tt_identity(spark, sf_dir):
    t = sc.identity()
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(t.forward(x), 6).alias("t"), F.round(t.inverse(t.forward(x)), 4).alias("back"))


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT c_custkey)::BIGINT AS different, true AS known FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 100)")
def ord_without_replacement(spark, sf_dir):
    """A hundred different customers (the limit is the operator)."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    got = sampling.random_rows(c, ["c_custkey"], 100)
    return got.agg(F.count("*").alias("rows"), F.count_distinct("c_custkey").alias("different"), F.lit(got.join(c, "c_custkey", "left_anti").count() == 0).alias("known"))


@query("SELECT count(*) AS rows, count(DISTINCT c_nationkey) AS groups, 0::BIGINT AS shared FROM customer")
def ord_group_split(spark, sf_dir):
    """Training and held-out rows together are all rows, and no group is in both."""
    a, b = sampling.split_groups(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 0.4)
    both = a.withColumn("h", F.lit(0)).union(b.withColumn("h", F.lit(1)))
    g = both.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_distinct("h").alias("k"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("groups"), F.count(F.when(F.col("k") > 1, 1)).alias("shared"))


@query("SELECT o_orderpriority, 150::BIGINT AS draws, 0::BIGINT AS strangers FROM orders GROUP BY 1")
def ord_bootstrap(spark, sf_dir):
    """Draws with replacement from each group; each is a row of its group."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    got = sampling.bootstrap_draws(o, "o_orderpriority", ["o_orderkey"], 150)
    known = o.withColumn("known", F.lit(1))
    return got.join(known, o.columns, "left").groupBy("o_orderpriority").agg(F.count("*").alias("draws"), F.count(F.when(F.col("known").isNull(), 1)).alias("strangers"))


@query("SELECT (SELECT count(*) * 2 FROM events WHERE event_type = (SELECT min(event_type) FROM events))::BIGINT AS n, true AS inside")
def ord_smote(spark, sf_dir):
    """Two synthetic rows for each event of one type, within the range of that type."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").cast("double").alias("v"), (F.col("user_id") % 100).cast("double").alias("u"))
    few = ev.where(F.col("event_type") == ev.agg(F.min("event_type")).first()[0])
    low = few.agg(F.min("v"), F.max("v"), F.min("u"), F.max("u")).first()
    made = sampling.smote(ev, ["v", "u"], few, "event_id", 5, 2)
    return made.agg(F.count("*").alias("n"), F.bool_and(F.col("v").between(low[0] - 1e-9, low[1] + 1e-9) & F.col("u").between(low[2] - 1e-9, low[3] + 1e-9)).alias("inside"))


@query(f"WITH {_CL}, l AS (SELECT y, 0 AS c, p0 AS s FROM k UNION ALL SELECT y, 1, p1 FROM k UNION ALL SELECT y, 2, p2 FROM k), g AS (SELECT c, s, sum((y = c)::INT) AS pos, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY c ORDER BY s) - n + (n + 1) / 2.0 AS rk FROM g), a AS (SELECT c, (sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) AS a FROM r GROUP BY 1) SELECT round(avg(a), 6) AS auc FROM a")
def mt_macro_auc(spark, sf_dir):
    return r6(metrics.macro_auc(_classes(spark, sf_dir), "y", ["p0", "p1", "p2"]))


@query(f"WITH {_V}, e AS (SELECT l_returnflag, abs(y - p) AS e FROM v) SELECT l_returnflag, round(median(e), 6) AS median_ae FROM e GROUP BY 1")
def mt_median_error(spark, sf_dir):
    return r6(metrics.median_error(_scored(spark, sf_dir), "y", "p", "l_returnflag"))


@query(f"""WITH {_V}, e AS (SELECT y - p AS e FROM v), b AS (SELECT min(e) AS a, max(e) AS z FROM e)
SELECT CAST(least(floor((e - a) / ((z - a) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM e, b GROUP BY 1""")
def mt_residual_histogram(spark, sf_dir):
    """Twenty bins over the range of the residuals."""
    return metrics.residual_histogram(_scored(spark, sf_dir), "y", "p", 20)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(r.a + r.b * l_quantity, 4) AS p FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) r")
def snk_model_round_trip(spark, sf_dir):
    """A linear model is written, read back and predicts."""
    li = table(spark, sf_dir, "lineitem")
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    models.ols(li, ["l_quantity"], "l_extendedprice").save(li, path)
    return models.Linear.load(li, path).predict(li).select(*KEY, F.round("Prediction", 4).alias("p"))


@query(f"WITH {_V} SELECT 'mse' AS measure, round(avg((y - p) * (y - p)), 6) AS score FROM v UNION ALL SELECT 'mae', round(avg(abs(y - p)), 6) FROM v")
def snk_scores_json(spark, sf_dir):
    """Scores written as JSON and read back."""
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    files.write_scores(metrics.regression(_scored(spark, sf_dir), "y", "p").select("mse", "mae"), path)
    return r6(files.read_scores(spark, path))


@query(f"WITH {LI} SELECT {_ID}, q FROM li WHERE q IS NULL OR q >= 40")
def snk_dropped_targets(spark, sf_dir):
    """Rows that a filter drops, written beside those it keeps."""
    path = f"{shared_folder(spark)}/targets-{uuid.uuid4().hex}"
    files.write_split(covariates(spark, sf_dir).select(*KEY, "q"), F.col("q") < 40, path)
    return spark.read.parquet(f"{path}/dropped")


FINE = "px AS (SELECT CAST(floor(l_partkey / 20.0) AS BIGINT) AS px, CAST(l_suppkey AS BIGINT) AS py, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"
_STRIPS = """b AS (SELECT max(py) + 1 AS h FROM px), k AS (SELECT s, h // 4 AS base, h % 4 AS longer FROM range(4) t(s), b),
st AS (SELECT s, greatest(s * base + least(s, longer) - 2, 0) AS low, (s + 1) * base + least(s + 1, longer) + 2 AS high FROM k)"""


def fine_pixels(spark, sf_dir):
    """Mean prices on finer cells than the catalogue's other raster."""
    cell = [F.floor(F.col("l_partkey") / 20).alias("px"), F.col("l_suppkey").cast("long").alias("py")]
    return table(spark, sf_dir, "lineitem").groupBy(*cell).agg(F.avg("l_extendedprice").alias("value"))


def _fine_shape(spark, sf_dir):
    """(width, height) of the fine raster, from the order lines themselves: nothing is grouped for it."""
    x, y = table(spark, sf_dir, "lineitem").agg(F.max(F.floor(F.col("l_partkey") / 20)), F.max(F.col("l_suppkey").cast("long"))).first()
    return x + 1, y + 1


def _height(px):
    """Rows of the lineitem raster; its suppliers are numbered through."""
    return px.agg(F.max("py")).first()[0] + 1


@query(f"WITH {FINE}, {_STRIPS} SELECT s AS strip, count(*) AS n, min(py) AS first, max(py) AS last, round(sum(value) / 1000, 2) AS total FROM px JOIN st ON py >= low AND py < high GROUP BY 1")
def ras_strips(spark, sf_dir):
    """Four strips of the raster that share two rows with each neighbour."""
    px = fine_pixels(spark, sf_dir)
    out = tiles.strips(px, _height(px), 4, 2).groupBy("strip").agg(F.count("*").alias("n"), F.min("py").alias("first"), F.max("py").alias("last"), F.sum("value").alias("total"))
    return out.withColumn("total", F.round(F.col("total") / 1000, 2))


@query(f"WITH {FINE}, {_STRIPS}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS py FROM supplier) SELECT s AS strip, count(*) AS points FROM p JOIN st ON py >= low AND py < high GROUP BY 1")
def jn_chunk_overlap(spark, sf_dir):
    """Points that each grown strip of the raster holds."""
    points = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("py"))
    return tiles.strips(points, _height(fine_pixels(spark, sf_dir)), 4, 2).groupBy("strip").agg(F.count("*").alias("points"))


#: A raster axis beyond both ends: cells and their mirror image without the last, repeated.
_MIRRORED = """b AS (SELECT max(px) + 1 AS w, max(py) + 1 AS h FROM px),
ex AS (SELECT e, least((e + 20 * (2 * w - 1)) % (2 * w - 1), 2 * w - 2 - (e + 20 * (2 * w - 1)) % (2 * w - 1)) AS px, w FROM b, range(-{halo}, w + {halo}) t(e)),
ey AS (SELECT e, least((e + 20 * (2 * h - 1)) % (2 * h - 1), 2 * h - 2 - (e + 20 * (2 * h - 1)) % (2 * h - 1)) AS py, h FROM b, range(-{halo}, h + {halo}) t(e))"""


@query(f"WITH {FINE}, {_MIRRORED.format(halo=3)}, " + """tx AS (SELECT t AS tx, e - t * 4 + 3 AS ix, px FROM ex, range((w + 3) // 4) t(t) WHERE e >= t * 4 - 3 AND e < t * 4 + 7),
ty AS (SELECT t AS ty, e - t * 4 + 3 AS iy, py FROM ey, range((h + 3) // 4) t(t) WHERE e >= t * 4 - 3 AND e < t * 4 + 7)
SELECT tx, ty, count(*) AS n, round(sum(value), 2) AS total, round(sum(value * (1 + ix + 10 * iy)) / 1000000, 4) AS placed FROM px JOIN tx USING (px) JOIN ty USING (py) GROUP BY 1, 2""")
def ras_tiles(spark, sf_dir):
    """Tiles of 4 by 4 pixels with a halo of three, mirrored at the edges: pixels, their sum and their places."""
    px = materialise(fine_pixels(spark, sf_dir), "pixels")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), px.count() // 100_000 + 1)
    out = tiles.tile_table(px, *_fine_shape(spark, sf_dir), 4, 3, deal=64, tasks=tasks)
    out = out.groupBy("bx", "by", "tx", "ty").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * (1 + F.col("ix") + 10 * F.col("iy"))).alias("placed"))
    return out.drop("bx", "by").withColumns({"total": F.round("total", 2), "placed": F.round(F.col("placed") / 1_000_000, 4)})


@query(f"WITH {FINE} SELECT px, py, 0 AS band, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 2) AS value FROM px WHERE px >= 2 AND px < 8 AND py <= 60")
def snk_raster_round_trip(spark, sf_dir):
    """The raster written as compressed, tiled images and read again through pushed filters."""
    px = fine_pixels(spark, sf_dir)
    grid = Grid(0.0, 0.0, 20.0, 1.0, *_fine_shape(spark, sf_dir))
    path = f"{shared_folder(spark)}/raster-{uuid.uuid4().hex}"
    gtiff.write_raster(px, grid, path, block=64, tile=16)
    out = gtiff.read_raster(spark, path).where("px >= 2 AND px < 8 AND py <= 60 AND value IS NOT NULL")
    return out.withColumn("value", F.round("value", 2))


_PLACES = "p AS (SELECT s_suppkey AS id, s_suppkey % 37 AS x, s_suppkey % 23 AS y, s_acctbal / 1000 AS z FROM supplier)"


def _places(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", (F.col("s_suppkey") % 37).cast("double").alias("x"), (F.col("s_suppkey") % 23).cast("double").alias("y"), (F.col("s_acctbal") / 1000).alias("z"))


@query(f"""WITH {_PLACES}, d AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.z - b.z) * (a.z - b.z) / 2 AS g FROM p a JOIN p b ON a.id < b.id),
e AS (SELECT min(d) AS low, (max(d) - min(d)) / 6 AS step FROM d), k AS (SELECT k, low + k * step AS a, CASE WHEN k = 5 THEN 1e9 ELSE low + (k + 1) * step END AS b FROM e, range(6) t(k))
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS lag, round(avg(d), 5) AS distance, round(avg(g), 5) AS gamma, CAST(count(*) AS BIGINT) AS pairs FROM d JOIN k ON d >= a AND d < b GROUP BY k""")
def md_variogram_lags(spark, sf_dir):
    """Experimental variogram of supplier balances over all pairs; suppliers share at most 851 places, so all pairs are exact."""
    found = kriging.experimental(_places(spark, sf_dir), "x", "y", "z")
    rows = [(i + 1, round(float(d), 5), round(float(g), 5), int(n)) for i, (d, g, n) in enumerate(zip(*found, strict=True))]
    return spark.createDataFrame(rows, "lag int, distance double, gamma double, pairs long")


@query()
def md_krige_universal(spark, sf_dir):
    """Universal kriging with a fitted spherical variogram and a plane onto customer places."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 37).cast("double").alias("x"), (F.col("c_custkey") % 23).cast("double").alias("y"))
    return kriging.krige(_places(spark, sf_dir), c, "x", "y", "z", "spherical", drift=True)


@query()
def md_mlkrige(spark, sf_dir):
    """A Bayesian line over account balances by place, and its kriged out-of-fold residuals, for all suppliers."""
    s = _places(spark, sf_dir).withColumn("n", F.col("s_suppkey") % 7)
    return kriging.ml_krige(s, s, lambda rows: models.bayes_linear(rows, ["n"], "z", iterations=3).predict, "x", "y", "z", ["s_suppkey"]).select("s_suppkey", "Prediction", "Variance", "Residual")


_LINES = ["l_quantity", "l_discount", "l_tax"]
_FIXED = rules.Committee(_LINES, [
    [([("l_quantity", "<=", 25.0)], 1.0, {"l_quantity": 2.0}), ([("l_quantity", ">", 25.0), ("l_tax", "<=", 0.04)], 3.0, {}), ([("l_quantity", ">", 25.0), ("l_tax", ">", 0.04)], 0.0, {"l_tax": 1.0, "l_discount": 2.0})],
    [([], 5.0, {"l_discount": -1.0})],
])


@query("""WITH c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (l_quantity <= 25) AS a, count(*) FILTER (l_quantity > 25 AND l_tax > 0.04) AS b FROM lineitem)
SELECT 'l_quantity' AS feature, round(100 * n / (2 * n), 6) AS conditions, round(100 * a / (2 * n), 6) AS models FROM c
UNION ALL SELECT 'l_discount', 0, round(100 * (b + n) / (2 * n), 6) FROM c UNION ALL SELECT 'l_tax', round(100 * (n - a) / (2 * n), 6), round(100 * b / (2 * n), 6) FROM c""")
def md_rule_usage(spark, sf_dir):
    """How many order lines fall to rules that name a feature."""
    return r6(rules.usage(table(spark, sf_dir, "lineitem"), _FIXED))


@query(f"""WITH p AS (SELECT {_ID}, CASE WHEN l_quantity <= 25 THEN 1 + 2 * l_quantity WHEN l_tax <= 0.04 THEN 3 ELSE l_tax + 2 * l_discount END AS a, 5 - l_discount AS b FROM lineitem)
SELECT {_ID}, round((a + b) / 2, 6) AS p, round((a - b) * (a - b) / 4, 6) AS v FROM p""")
def md_committee(spark, sf_dir):
    """Mean and variance over the members of a committee of rules."""
    out = _FIXED.predict(table(spark, sf_dir, "lineitem"))
    return r6(out.select(*KEY, F.col("Prediction").alias("p"), F.col("Variance").alias("v")))


@query()
def md_cubist(spark, sf_dir):
    """A committee of two members learned from all order lines."""
    li = table(spark, sf_dir, "lineitem")
    return rules.fit(li, _LINES, "l_extendedprice", members=2, depth=3, key=KEY).predict(li).select(*KEY, "Prediction", "Variance")


@query()
def md_svr(spark, sf_dir):
    """Support vector regression of order lines over random features."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 10_000)
    return learners.svr(li, _LINES, "y", n_features=15, iterations=4).predict(li).select(*KEY, "Prediction")


@query("WITH r AS (SELECT regr_slope(2 * l_quantity + l_extendedprice / 10000, l_quantity) AS b, regr_intercept(2 * l_quantity + l_extendedprice / 10000, l_quantity) AS a FROM lineitem) SELECT round(b, 1) AS slope, round(a / 5, 0) AS intercept FROM r")
def md_sgd_bayes(spark, sf_dir):
    """Stochastic variational line over order lines; its mean is the least-squares line's, to the digits shown."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", 2 * F.col("l_quantity") + F.col("l_extendedprice") / 10_000)
    model = learners.sgd_bayes(li, ["l_quantity"], "y", prior=100.0)
    return spark.createDataFrame([(round(float(model.coef[1]), 1), round(float(model.coef[0]) / 5, 0))], "slope double, intercept double")


@query()
def st_super_learner(spark, sf_dir):
    """Out-of-fold predictions of a line, a committee and their meta line for all order lines."""
    li = table(spark, sf_dir, "lineitem").select(*KEY, *_LINES, (F.col("l_extendedprice") / 10_000).alias("y"))
    found = superlearn.learn(li, _LINES, "y", KEY, [{"name": "ols"}, {"name": "cubist", "depth": 1}], folds=3, group="l_linenumber")
    return found.folds.select(*KEY, "fold", "p0", "p1", "meta")


@query()
def sh_forest(spark, sf_dir):
    """Exact attributions of a forest's prediction for all order lines."""
    li = table(spark, sf_dir, "lineitem")
    model, _ = models.forest(li, _LINES, "l_extendedprice", trees=4, depth=3)
    out = attributions.forest_shap(li.select(*KEY, *_LINES), [model], _LINES)
    return out.select(*KEY, *[f"shap_{c}" for c in _LINES], "shap_base")


@query()
def hp_tpe(spark, sf_dir):
    """Twelve trials of the prior and the noise of a Bayesian line, by the mean squared error of its held-out fifth."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINES, (F.col("l_extendedprice") / 10_000).alias("y"))
    train, held = materialise(li.where("l_orderkey % 5 > 0"), "train"), materialise(li.where("l_orderkey % 5 = 0"), "held")

    def loss(p):
        return metrics.regression(models.bayes_linear(train, _LINES, "y", **p).predict(held), "y", "Prediction").first()["mse"]

    space = {"noise": ("log", 0.1, 1e4), "prior": ("log", 1e-6, 10.0)}
    return tuning.search(spark, loss, space, 12, f"{shared_folder(spark)}/trials-{uuid.uuid4().hex}").select("trial", "method", "parameters", "loss")


@query()
def cv_classes(spark, sf_dir):
    """Scores of each fold of a logistic model of the return flag; orders stay together."""
    li = table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_orderkey") % 50)
    return pipeline.cross_validate_classes(li, _LINES, "l_returnflag", "logistic", KEY, folds=3, group="g", maxIter=5)[0]


@query(f"WITH {LI}, m AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM li) SELECT {_ID}, round(a + b * t, 4) AS p FROM li, m")
def snk_bundle_round_trip(spark, sf_dir):
    """A learned pipeline, written and read again, over all order lines."""
    config = pipeline.Config.parse({"features": ["t"], "target": "y", "position": [], "grid": {"x0": 0, "y0": 0, "dx": 1, "dy": 1, "width": 1, "height": 1}, "transforms": ["standardise"]})
    li = covariates(spark, sf_dir)
    path = f"{shared_folder(spark)}/bundle-{uuid.uuid4().hex}"
    pipeline.learn(li, None, config).save(li, path)
    return pipeline.Bundle.load(spark, path).predict(li).select(*KEY, F.round("Prediction", 4).alias("p"))


_SENSOR = (1.0, 1.0, 2.0, 0.1)
_FOOT = ", ".join(f"({i}, {j}, {w!r})" for (i, j), w in raster.footprint(3, *_SENSOR).items())


@query(f"WITH {FINE}, hp AS (SELECT * FROM px WHERE (px + 2 * py) % 9 <> 0), {_MIRRORED.format(halo=3)}, k AS (SELECT * FROM (VALUES {_FOOT}) k(i, j, weight)), " + """
c AS (SELECT x.e AS px, y.e AS py FROM ex x, ey y WHERE x.e >= 0 AND x.e < w AND y.e >= 0 AND y.e < h),
s AS (SELECT c.px, c.py, sum(hp.value * weight) / sum(weight) AS v FROM c, k JOIN ex ON ex.e = c.px + i JOIN ey ON ey.e = c.py + j JOIN hp ON hp.px = ex.px AND hp.py = ey.py GROUP BY 1, 2)
SELECT c.px, c.py, CASE WHEN hp.value IS NOT NULL THEN round(v, 2) END AS value FROM c LEFT JOIN s ON s.px = c.px AND s.py = c.py LEFT JOIN hp ON hp.px = c.px AND hp.py = c.py""")
def ras_gamma_forward(spark, sf_dir):
    """A gamma sensor's footprint over the raster with holes."""
    px = fine_pixels(spark, sf_dir)
    width, height = _fine_shape(spark, sf_dir)
    out = tiles.gamma(px.where((F.col("px") + 2 * F.col("py")) % 9 != 0), width, height, *_SENSOR, size=64, reach=3)
    return out.withColumn("value", F.round("value", 2))


@query()
def ras_deconvolve(spark, sf_dir):
    """The footprint undone: holes are filled by it first and made holes again."""
    px = fine_pixels(spark, sf_dir)
    width, height = _fine_shape(spark, sf_dir)
    out = tiles.gamma(px.where((F.col("px") + 2 * F.col("py")) % 9 != 0), width, height, *_SENSOR, forward=False, noise=0.1, whole=True, size=960)
    return out.withColumn("value", F.round("value", 5))


_SLANTED = """p AS (SELECT n_nationkey AS polygon, 7.0 * (n_nationkey % 5) AS x, 6.0 * (n_nationkey // 5) AS y FROM nation),
r AS (SELECT polygon, [[x, y], [x + 9, y + 2.5], [x + 5, y + 8], [x - 1, y + 4]] AS c FROM p),
e AS (SELECT polygon, c[k][1] AS x1, c[k][2] AS y1, c[k % 4 + 1][1] AS x2, c[k % 4 + 1][2] AS y2 FROM r, range(1, 5) t(k)),
c AS (SELECT c_custkey, c_custkey % 37 + 0.25 AS x, c_custkey % 31 + 0.75 AS y FROM customer),
m AS (SELECT c_custkey, polygon FROM c JOIN e ON (y < y1) <> (y < y2) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def _slanted(spark, sf_dir):
    """(customers with a place, a slanted quadrangle for each nation; they overlap)."""
    n = F.col("n_nationkey")
    x, y = 7.0 * (n % 5), 6.0 * F.floor(n / 5)
    corners = F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0, 0), (9, 2.5), (5, 8), (-1, 4))])
    places = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 37 + 0.25).alias("x"), (F.col("c_custkey") % 31 + 0.75).alias("y"))
    return places, table(spark, sf_dir, "nation").select(n.alias("polygon"), corners.alias("ring"))


@query(f"WITH {_SLANTED} SELECT * FROM m")
def jn_polygon_members(spark, sf_dir):
    """(row, polygon) of every polygon that holds a place."""
    places, rings = _slanted(spark, sf_dir)
    return polygons.members(places, "x", "y", rings).select("c_custkey", "polygon")


@query(f"WITH {_SLANTED} SELECT c.c_custkey, min(polygon) AS polygon FROM c LEFT JOIN m ON m.c_custkey = c.c_custkey GROUP BY 1")
def jn_overlay(spark, sf_dir):
    """Every place with the first polygon that holds it."""
    places, rings = _slanted(spark, sf_dir)
    return polygons.overlay(places, "x", "y", rings).select("c_custkey", "polygon")


@query("SELECT 'l_discount' AS feature, round(avg(abs(r.b * (l_discount - r.m))), 4) AS importance FROM lineitem, (SELECT regr_slope(l_extendedprice, l_discount) AS b, avg(l_discount) AS m FROM lineitem) r")
def sh_mean_absolute(spark, sf_dir):
    """Mean absolute attribution of each feature."""
    li = table(spark, sf_dir, "lineitem")
    out = models.linear_shap(li, models.ols(li, ["l_discount"], "l_extendedprice"))
    return models.mean_absolute_shap(out, ["l_discount"]).withColumn("importance", F.round("importance", 4))


_PQ = f"WITH {LI}, o AS (SELECT {{leave}} AS leave, 1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)) AS r2 FROM (SELECT y, avg(y) OVER () AS m, a + b * {{x}} AS p FROM li, (SELECT regr_slope(y, {{x}}) AS b, regr_intercept(y, {{x}}) AS a FROM li WHERE q IS NOT NULL AND d IS NOT NULL) r WHERE q IS NOT NULL AND d IS NOT NULL))"


@query(_PQ.format(leave="'q'", x="d") + " SELECT leave, round(r2, 6) AS r2 FROM o UNION ALL (" + _PQ.format(leave="'d'", x="q") + " SELECT leave, round(r2, 6) AS r2 FROM o)")
def mt_leave_one_out(spark, sf_dir):
    """r2 of a linear model without each covariate in turn."""
    df = filters.complete(covariates(spark, sf_dir), ["q", "d"])
    found = metrics.leave_one_out(lambda left: metrics.regression(models.ols(df, left, "y").predict(df), "y", "Prediction"), ["q", "d"])
    return r6(spark.createDataFrame(list(found.items()), "leave string, r2 double"))


@query(f"""WITH g AS (SELECT count(*) / 4.0 + 0.5 AS a, sum(l_quantity) / 4.0 AS b, sum(l_quantity * l_quantity) / 4.0 + 0.5 AS d, sum(l_extendedprice / 1000) / 4.0 AS u, sum(l_quantity * l_extendedprice / 1000) / 4.0 AS v FROM lineitem),
c AS (SELECT (d * u - b * v) / (a * d - b * b) AS m0, (a * v - b * u) / (a * d - b * b) AS m1, d / (a * d - b * b) AS c00, -b / (a * d - b * b) AS c01, a / (a * d - b * b) AS c11 FROM g),
p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m0 + m1 * l_quantity AS m, 4.0 + c00 + 2 * c01 * l_quantity + c11 * l_quantity * l_quantity AS s FROM lineitem, c)
SELECT {_ID}, round(m, 4) AS mean, round(s, 4) AS variance, round(m - {1.959963984540054!r} * sqrt(s), 4) AS low, round(m + {1.959963984540054!r} * sqrt(s), 4) AS high FROM p""")
def md_predict_bands(spark, sf_dir):
    """Mean, variance and quantiles of a predictive distribution."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    out = models.bayes_linear(li, ["l_quantity"], "y", noise=4.0, prior=2.0).predict(li)
    named = {"Prediction": "mean", "Variance": "variance", "Lower quantile": "low", "Upper quantile": "high"}
    return out.select(*KEY, *[F.round(F.col(f"`{a}`"), 4).alias(b) for a, b in named.items()])


@query(f"WITH {LI}, {PX}, z AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM px) SELECT px, py, round((value - m) / s, 6) AS value FROM px, z")
def ras_standardised(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return r6(transforms.standardise(px, ["value"]).apply(px))
