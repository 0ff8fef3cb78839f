"""The query catalogue: each query with the SQL that has the same rows.

Covariates are lineitem columns with nulls put in by rule, pixels are cells of (part, supplier)
keys, and every computed double is rounded on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.functions import scalars as sc
from pixelframe.grid import Grid
from pixelframe.operators import cluster, filters, joins, kriging, metrics, models, raster, sampling, stats, transforms
from pixelframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
COLS = ["q", "d", "t"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CELLS = Grid(0.0, 0.0, 100.0, 10.0, 1_000_000, 1_000_000)

#: The masked covariates in SQL.
LI = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice AS y,
  CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS q,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS d, l_tax AS t FROM lineitem)"""
PX = "px AS (SELECT CAST(floor(l_partkey / 100.0) AS BIGINT) AS px, CAST(floor(l_suppkey / 10.0) AS BIGINT) AS py, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)"


def query(sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *KEY, "l_returnflag", F.col("l_extendedprice").alias("y"),
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")).alias("q"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_discount")).alias("d"), F.col("l_tax").alias("t"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cell = [CELLS.px(F.col("l_partkey")).alias("px"), CELLS.py(F.col("l_suppkey")).alias("py")]
    return li.groupBy(*cell).agg(F.avg("l_extendedprice").alias("value"))


def r6(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Round doubles to 6 digits."""
    keep = keep or []
    return df.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes])


# Flagship ------------------------------------------------------------------------------------


@query(f"""WITH {LI}, {PX},
p AS (SELECT li.*, px.value FROM li JOIN px ON CAST(floor(l_partkey / 100.0) AS BIGINT) = px.px AND CAST(floor(l_suppkey / 10.0) AS BIGINT) = px.py),
s AS (SELECT avg(q) AS mq FROM p),
i AS (SELECT p.*, coalesce(q, mq) AS x FROM p, s),
z AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM i),
n AS (SELECT l_orderkey % 5 AS fold, (x - m) / sd AS x, y FROM i, z),
f AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM n GROUP BY fold),
g AS (SELECT a.fold, sum(b.n) AS n, sum(b.sx) AS sx, sum(b.sy) AS sy, sum(b.sxx) AS sxx, sum(b.sxy) AS sxy FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.fold),
c AS (SELECT fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS a FROM g),
v AS (SELECT n.fold, y, a + b * x AS p, avg(y) OVER (PARTITION BY n.fold) AS m FROM n JOIN c ON n.fold = c.fold)
SELECT CAST(fold AS BIGINT) AS fold, round(1 - sum((y - p) * (y - p)) / sum((y - m) * (y - m)), 6) AS r2, count(*) AS n FROM v GROUP BY fold""")
def learn_ols_cv(spark, sf_dir):
    """Points joined to pixels, imputed, standardised; out-of-fold r2 of a linear model."""
    points = joins.located(covariates(spark, sf_dir), CELLS, "l_partkey", "l_suppkey").join(pixels(spark, sf_dir), ["px", "py"])
    fitted = transforms.chain(points, ["q"], ["mean", "standardise"])
    x = transforms.apply_chain(points, fitted).withColumn("fold", F.col("l_orderkey") % 5)
    out = models.crossval_ols(x, ["q"], "y", "fold")
    scores = metrics.regression(out, "y", "prediction", by=["fold"], extra=[F.count("*").alias("n")])
    return r6(scores.select("fold", "r2", "n"))


# Aggregates ----------------------------------------------------------------------------------

_M = ", ".join(f"count({c}) AS {c}_count, round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd, round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(100.0 * (1 - count({c}) / count(*)::DOUBLE), 6) AS {c}_missing" for c in COLS)


@query(f"WITH {LI} SELECT {_M} FROM li")
def agg_masked_moments(spark, sf_dir):
    return r6(stats.moments(covariates(spark, sf_dir), COLS))


_PAIRS = [("q", "q"), ("q", "d"), ("q", "t"), ("d", "d"), ("d", "t"), ("t", "t")]


@query(f"WITH {LI}, m AS (SELECT avg(q) AS mq, avg(d) AS md, avg(t) AS mt FROM li) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n, round(sum(({a} - m{a}) * ({b} - m{b})) / count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END), 6) AS cov FROM li, m" for a, b in _PAIRS))
def agg_pairwise_cov(spark, sf_dir):
    return r6(stats.covariance(covariates(spark, sf_dir), COLS))


@query(f"WITH {LI} SELECT " + ", ".join(f"round(sum(coalesce({a}, 0) * coalesce({b}, 0)), 4) AS {a}_{b}" for a, b in _PAIRS) + " FROM li")
def agg_outer(spark, sf_dir):
    out = stats.outer(covariates(spark, sf_dir), COLS)
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


@query(f"WITH {LI} SELECT " + ", ".join(f"count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS {a}_{b}" for a, b in _PAIRS) + " FROM li")
def agg_pair_counts(spark, sf_dir):
    return stats.pair_counts(covariates(spark, sf_dir), COLS)


@query("SELECT o_orderpriority, true AS all_finite, false AS any_missing, false AS any_large, round(min(o_totalprice), 6) AS min, round(avg(o_totalprice), 6) AS mean, round(median(o_totalprice), 6) AS median, round(max(o_totalprice), 6) AS max, round(stddev_pop(o_totalprice), 6) AS sd, round(3 * (avg(o_totalprice) - median(o_totalprice)) / stddev_pop(o_totalprice), 6) AS skew FROM orders GROUP BY 1")
def agg_quality_profile(spark, sf_dir):
    return r6(stats.quality_profile(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"]))


@query(f"WITH {LI} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM li" for a, b in [("d", "q"), ("d", "t"), ("q", "t")]))
def agg_corr_matrix(spark, sf_dir):
    return r6(stats.correlations(covariates(spark, sf_dir), COLS))


@query("SELECT CAST(floor(l_partkey / 100.0) AS BIGINT) AS px, CAST(floor(l_suppkey / 10.0) AS BIGINT) AS py, round(avg(l_quantity), 6) AS quantity, round(avg(l_discount), 6) AS discount, count(*) AS pixel_count FROM lineitem GROUP BY 1, 2")
def agg_cell_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cell = [CELLS.px(F.col("l_partkey")).alias("px"), CELLS.py(F.col("l_suppkey")).alias("py")]
    return r6(li.groupBy(*cell).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.count("*").alias("pixel_count")))


_LONG = f"{LI}, lg AS (SELECT l_returnflag, l_orderkey % 4 AS part, 'q' AS covariate, q AS v FROM li UNION ALL SELECT l_returnflag, l_orderkey % 4, 'd', d FROM li UNION ALL SELECT l_returnflag, l_orderkey % 4, 't', t FROM li)"


@query(f"WITH {_LONG} SELECT l_returnflag, covariate, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd FROM lg GROUP BY 1, 2")
def agg_cluster_profile(spark, sf_dir):
    return r6(cluster.profile(covariates(spark, sf_dir), ["l_returnflag"], COLS))


@query(f"WITH {_LONG}, p AS (SELECT l_returnflag, part, covariate, count(v) AS n, avg(v) AS m, stddev_pop(v) AS s FROM lg GROUP BY 1, 2, 3) SELECT l_returnflag, covariate, CAST(sum(n) AS BIGINT) AS n, round(sum(n * m) / sum(n), 6) AS mean, round(sqrt(sum(n * s * s) / sum(n)), 6) AS sd_within FROM p GROUP BY 1, 2")
def agg_cluster_merge(spark, sf_dir):
    parts = cluster.profile(covariates(spark, sf_dir).withColumn("part", F.col("l_orderkey") % 4), ["l_returnflag", "part"], COLS)
    return r6(cluster.merge_profiles(parts, ["l_returnflag"]))


@query("""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
k AS (SELECT * FROM r WHERE r > round(n * 0.01) AND r <= n - round(n * 0.01)),
q AS (SELECT o_orderpriority, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM k GROUP BY 1)
SELECT q.o_orderpriority, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS q2, round(any_value(q3), 6) AS q3, any_value(q.n) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high
FROM k JOIN q ON k.o_orderpriority = q.o_orderpriority WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) GROUP BY 1""")
def agg_boxplot(spark, sf_dir):
    return r6(cluster.boxplot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", ["o_orderkey"]))


@query("SELECT l_returnflag, round(sum(l_quantity * (1 + l_linenumber)) / sum(1 + l_linenumber), 6) AS l_quantity, round(sum(l_discount * (1 + l_linenumber)) / sum(1 + l_linenumber), 6) AS l_discount FROM lineitem GROUP BY 1")
def agg_weighted_centroid(spark, sf_dir):
    return r6(stats.weighted_centroid(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"], 1 + F.col("l_linenumber")))


@query("SELECT min(l_partkey) AS min_x, max(l_partkey) AS max_x, min(l_suppkey) AS min_y, max(l_suppkey) AS max_y FROM lineitem")
def agg_bounding_box(spark, sf_dir):
    return stats.bounding_box(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


# Filters -------------------------------------------------------------------------------------

_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"WITH {LI} SELECT {_ID}, q, d FROM li WHERE coalesce(q, d) IS NOT NULL")
def flt_cull(spark, sf_dir):
    return filters.cull_all_null(covariates(spark, sf_dir), ["q", "d"]).select(*KEY, "q", "d")


@query(f"WITH {LI} SELECT {_ID}, q, d, t FROM li WHERE q IS NOT NULL AND d IS NOT NULL AND t IS NOT NULL")
def flt_complete(spark, sf_dir):
    return filters.complete(covariates(spark, sf_dir), COLS).select(*KEY, *COLS)


@query(f"WITH {LI} SELECT {_ID}, CASE WHEN l_returnflag = 'R' THEN q END AS q, CASE WHEN l_returnflag = 'R' THEN d END AS d FROM li")
def flt_mask_retain(spark, sf_dir):
    return filters.mask_retain(covariates(spark, sf_dir), ["q", "d"], F.col("l_returnflag"), "R").select(*KEY, "q", "d")


@query("SELECT event_id, CASE WHEN abs(value * power(10.0, 36 + event_id % 3)) <= 3.4028234663852886e38 THEN round(value, 6) END AS value FROM events")
def flt_clamp32(spark, sf_dir):
    big = F.col("value") * F.pow(F.lit(10.0), 36 + F.col("event_id") % 3)
    return r6(table(spark, sf_dir, "events").select("event_id", F.when(filters.clean_float(big).isNotNull(), F.col("value")).alias("value")))


@query("""WITH p AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events)
SELECT event_id, round(coalesce(greatest(0.0, least(255.0, (value - a) / (b - a) * 255.0)), 0), 6) AS value FROM events, p""")
def flt_stretch(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return r6(ev.select("event_id", filters.stretch(ev, "value").alias("value")))


@query("""WITH b AS (SELECT min(l_partkey) AS x0, max(l_partkey) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem, b WHERE l_partkey BETWEEN x0 - abs(x0) * 0.01 AND x1 + abs(x1) * 0.01 AND l_suppkey BETWEEN y0 - abs(y0) * 0.01 AND y1 + abs(y1) * 0.01""")
def flt_bbox_clip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return filters.clip_to(li, li.where("l_returnflag = 'R' and l_quantity = 1"), "l_partkey", "l_suppkey").select(*KEY)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_tax), 6) AS sd, round(CASE WHEN l_discount = 0 THEN 0 ELSE sqrt(l_tax) / l_discount END, 6) AS uncert FROM lineitem")
def flt_uncert(spark, sf_dir):
    sd, u = filters.uncertainty(F.col("l_discount"), F.col("l_tax"))
    return r6(table(spark, sf_dir, "lineitem").select(*KEY, sd.alias("sd"), u.alias("uncert")))


@query("SELECT p_partkey, CASE WHEN regexp_matches(regexp_replace(p_type || p_brand, '[^0-9a-zA-Z_]', '', 'g'), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(p_type || p_brand, '[^0-9a-zA-Z_]', '', 'g') AS label FROM part")
def flt_identifier(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", filters.identifier(F.concat("p_type", "p_brand")).alias("label"))


@query("SELECT p_partkey, substr(p_name, 1, 8) || row_number() OVER (PARTITION BY substr(p_name, 1, 8) ORDER BY p_partkey) AS short FROM part")
def flt_short_names(spark, sf_dir):
    return filters.short_names(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_partkey", "short")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_acctbal < 5000 AND s_suppkey > 10 AND s_suppkey < 90")
def flt_open_box(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.where(filters.in_open_box(F.col("s_acctbal"), F.col("s_suppkey"), 0, 5000, 10, 90)).select("s_suppkey", "s_acctbal")


@query("WITH r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT event_id, user_id, value FROM r WHERE n % 5 = 1 AND value > 10 AND value < 80")
def flt_decimate(spark, sf_dir):
    out = filters.every_nth_between(table(spark, sf_dir, "events"), ["ts", "event_id"], ["user_id"], 5, F.col("value"), 10, 80)
    return out.select("event_id", "user_id", "value")


@query(f"WITH {LI} SELECT {_ID}, coalesce(q < 10 AND (abs(t - 0.02) <= 2.01e-7 + 1e-8 * 0 OR abs(t - 0.04) <= 4.1e-7), false) AS ok FROM li")
def flt_rule_satisfied(spark, sf_dir):
    ok = filters.satisfied([("q", "<", 10), ("t", "in", [0.02, 0.04])])
    return covariates(spark, sf_dir).select(*KEY, F.coalesce(ok, F.lit(False)).alias("ok"))


# Transforms ----------------------------------------------------------------------------------

_S = f"{LI}, s AS (SELECT " + ", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}, min({c}) AS n{c}" for c in COLS) + " FROM li)"


def _each(fmt: str) -> str:
    return ", ".join(f"round({fmt.format(c=c)}, 6) AS {c}" for c in COLS)


def _fit_apply(name: str):
    def run(spark, sf_dir):
        df = covariates(spark, sf_dir)
        return r6(transforms.STEPS[name](df, COLS).apply(df).select(*KEY, *COLS))

    return run


for _name, _fmt, _step in (("tr_centre", "{c} - m{c}", "centre"), ("tr_standardise", "({c} - m{c}) / s{c}", "standardise"), ("tr_log", "ln({c} - n{c} + 1e-6)", "log"), ("tr_sqrt", "sqrt({c} - n{c} + 1e-6)", "sqrt"), ("tr_impute_mean", "coalesce({c}, m{c})", "mean")):
    QUERIES[_name] = _fit_apply(_step)
    ORACLE_SQL[_name] = f"WITH {_S} SELECT {_ID}, {_each(_fmt)} FROM li, s"


@query(f"""WITH {LI}, m AS (SELECT avg(q) AS mq, avg(d) AS md FROM li),
c AS (SELECT mq, md, sum((q - mq) * (d - md)) / count(CASE WHEN q IS NOT NULL AND d IS NOT NULL THEN 1 END) AS cqd, sum((q - mq) * (q - mq)) / count(q) AS cqq, sum((d - md) * (d - md)) / count(d) AS cdd FROM li, m GROUP BY mq, md)
SELECT {_ID}, round(CASE WHEN q IS NOT NULL THEN q WHEN d IS NULL THEN mq ELSE mq + cqd / cdd * (d - md) END, 6) AS q, round(CASE WHEN d IS NOT NULL THEN d WHEN q IS NULL THEN md ELSE md + cqd / cqq * (q - mq) END, 6) AS d FROM li, c""")
def tr_impute_gauss2d(spark, sf_dir):
    df = covariates(spark, sf_dir)
    return r6(transforms.impute_gauss(df, ["q", "d"]).apply(df).select(*KEY, "q", "d"))


@query(f"WITH {LI}, v AS (SELECT *, CASE WHEN q IS NULL THEN NULL ELSE CAST(q AS BIGINT) % 3 END AS k FROM li) SELECT {_ID}, " + ", ".join(f"CASE WHEN k IS NULL THEN NULL WHEN k = {i} THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS k_{i}" for i in range(3)) + " FROM v")
def tr_one_hot(spark, sf_dir):
    df = covariates(spark, sf_dir).withColumn("k", F.col("q").cast("long") % 3)
    return transforms.one_hot(df, ["k"]).apply(df).select(*KEY, "k_0", "k_1", "k_2")


@query(f"""WITH {LI}, s AS (SELECT avg(q) AS mq, avg(d) AS md FROM li), i AS (SELECT {_ID}, coalesce(q, mq) AS q, coalesce(d, md) AS d FROM li, s),
z AS (SELECT avg(q) AS mq, stddev_pop(q) AS sq, avg(d) AS md, stddev_pop(d) AS sd FROM i) SELECT {_ID}, round((q - mq) / sq, 6) AS q, round((d - md) / sd, 6) AS d FROM i, z""")
def tr_chain(spark, sf_dir):
    df = covariates(spark, sf_dir)
    return r6(transforms.apply_chain(df, transforms.chain(df, ["q", "d"], ["mean", "standardise"])).select(*KEY, "q", "d"))


@query("SELECT CAST(3 AS INTEGER) AS kept, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS var")
def tr_whiten_moments(spark, sf_dir):
    """Whitened columns have mean zero and variance one."""
    df = filters.complete(covariates(spark, sf_dir), COLS)
    model = transforms.whiten(df, COLS)
    out = model.apply(df)
    w = [c for c in out.columns if c in model.exprs]
    row = out.agg(F.array(*[F.avg(c) for c in w]).alias("m"), F.array(*[F.var_pop(c) for c in w]).alias("v"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / len(w)
    return row.select(F.size("m").alias("kept"), F.abs(F.round(mean(F.col("m")), 6)).alias("mean"), F.round(mean(F.col("v")), 6).alias("var"))


# Target transforms and scalars ---------------------------------------------------------------


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS t, round(o_totalprice, 4) AS back FROM orders, s")
def tt_standardise(spark, sf_dir):
    return _target(spark, sf_dir, lambda df: sc.standardise(df, "o_totalprice"))


@query("SELECT o_orderkey, round(sqrt(o_totalprice + 1), 6) AS t, round(o_totalprice, 4) AS back FROM orders")
def tt_sqrt(spark, sf_dir):
    return _target(spark, sf_dir, lambda df: sc.sqrt(1.0))


@query("SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS t, round(o_totalprice, 4) AS back FROM orders")
def tt_log(spark, sf_dir):
    return _target(spark, sf_dir, lambda df: sc.log(df, "o_totalprice", 1.0))


@query("SELECT o_orderkey, round(1 / (1 + exp(-0.00001 * o_totalprice)), 6) AS t, round(o_totalprice, 4) AS back FROM orders")
def tt_logistic(spark, sf_dir):
    return _target(spark, sf_dir, lambda df: sc.logistic(1e-5))


def _target(spark, sf_dir, make) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    t = make(df)
    return df.select("o_orderkey", F.round(t.forward(F.col("o_totalprice")), 6).alias("t"), F.round(t.inverse(t.forward(F.col("o_totalprice"))), 4).alias("back"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity - 1.959963984540054 * sqrt(l_tax + 0.1), 6) AS low, round(l_quantity + 1.959963984540054 * sqrt(l_tax + 0.1), 6) AS high FROM lineitem")
def sc_interval(spark, sf_dir):
    low, high = sc.normal_interval(F.col("l_quantity"), F.col("l_tax") + 0.1, 0.95)
    return r6(table(spark, sf_dir, "lineitem").select(*KEY, low.alias("low"), high.alias("high")))


@query("SELECT event_type, round(sum(CASE WHEN value - 50 < 0 THEN (0.9 - 1) * (value - 50) ELSE 0.9 * (value - 50) END), 4) AS loss FROM events GROUP BY 1")
def sc_pinball(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(sc.pinball(F.col("value") - 50, 0.9)), 4).alias("loss"))


@query("WITH e AS (SELECT event_id, CASE WHEN value / 50 - 1 < 0 THEN 0.9 * (value / 50 - 1) ELSE (1 - 0.9) * (value / 50 - 1) END AS e FROM events) SELECT event_id, round((exp(e) - exp(-e)) / (exp(e) + exp(-e)), 6) AS grad, round(4 / ((exp(e) + exp(-e)) * (exp(e) + exp(-e))), 6) AS hess FROM e")
def sc_logcosh(spark, sf_dir):
    g, h = sc.log_cosh_gradients(F.col("value") / 50, F.lit(1.0), 0.9)
    return r6(table(spark, sf_dir, "events").select("event_id", g.alias("grad"), h.alias("hess")))


_UG = f"""CASE WHEN f > 0 AND y <= f THEN ln(1 / (f + {math.sqrt(math.pi / 2)!r})) WHEN f > 0 AND y > f THEN ln(1 / (f + {math.sqrt(math.pi / 2)!r})) - 0.5 * (y - f) * (y - f) ELSE {math.log(math.sqrt(2 / math.pi))!r} - 0.5 * (y - f) * (y - f) END"""


@query(f"WITH e AS (SELECT event_id, value / 10 AS y, (event_id % 7) - 1.0 AS f FROM events) SELECT event_id, round({_UG}, 6) AS ll FROM e")
def sc_unifgauss(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("y"), (F.col("event_id") % 7 - 1.0).cast("double").alias("f"))
    return r6(ev.select("event_id", sc.unif_gauss_loglike(F.col("y"), F.col("f")).alias("ll")))


@query(f"WITH e AS (SELECT event_id, value / 10 AS y, (event_id % 7) - 1.0 AS f FROM events) SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN -0.5 * (ln({2 * math.pi!r} * 2.0) + (y - f) * (y - f) / 2.0) ELSE {_UG} END, 6) AS ll FROM e")
def sc_switching(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 10).alias("y"), (F.col("event_id") % 7 - 1.0).cast("double").alias("f"))
    return r6(ev.select("event_id", sc.switching_loglike(F.col("y"), F.col("f"), F.lit(2.0), F.col("event_id") % 2 == 0).alias("ll")))


_QN = [(x, g * 3 * math.exp(-0.5 * (3 * x) ** 2) / math.sqrt(2 * math.pi)) for x, g in zip(sc.GAUSS_NODES, sc.GAUSS_WEIGHTS, strict=True)]


@query("WITH e AS (SELECT event_id, " + " + ".join(f"{w!r} * (value + 3 * {x!r} * 2.0) * (value + 3 * {x!r} * 2.0)" for x, w in _QN) + " AS e, value FROM events) SELECT event_id, round(e, 4) AS e FROM e")
def sc_quadrature(spark, sf_dir):
    e, _ = sc.quadrature(F.col("value"), F.lit(2.0), lambda v: v * v)
    return table(spark, sf_dir, "events").select("event_id", F.round(e, 4).alias("e"))


@query("SELECT event_id, round(CASE WHEN event_id % 10 >= 6 THEN value * 3 WHEN event_id % 10 < 2 THEN value ELSE value + (value * 3 - value) * ((event_id % 10) - 2) / 4.0 END, 6) AS v FROM events")
def sc_interp1d(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    at = F.lit(None).cast("double")
    for i in range(10):
        at = F.when(F.col("event_id") % 10 == i, sc.interpolate(F.array(F.lit(2.0), F.lit(6.0)), F.array(F.col("value"), F.col("value") * 3), i)).otherwise(at)
    return r6(ev.select("event_id", at.alias("v")))


_E2 = sc.WGS84_F * (2 - sc.WGS84_F)


@query(f"""WITH g AS (SELECT s_suppkey, radians(130 + s_suppkey % 20) AS lam, radians(-35 + s_suppkey % 17) AS phi, s_acctbal AS h FROM supplier),
n AS (SELECT *, {sc.WGS84_A} / sqrt(1 - {_E2!r} * sin(phi) * sin(phi)) AS n FROM g)
SELECT s_suppkey, round((n + h) * cos(phi) * cos(lam), 3) AS x, round((n + h) * cos(phi) * sin(lam), 3) AS y, round((n * (1 - {_E2!r}) + h) * sin(phi), 3) AS z FROM n""")
def sc_geodetic(spark, sf_dir):
    x, y, z = sc.geodetic_to_ecef(130 + F.col("s_suppkey") % 20, -35 + F.col("s_suppkey") % 17, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("""WITH e AS (SELECT *, value / 100 AS g, 1 + event_id % 3 AS h FROM events), w AS (SELECT event_id, sum(g) OVER c AS gl, sum(h) OVER c AS hl, sum(g) OVER a AS g, sum(h) OVER a AS h FROM e WINDOW c AS (PARTITION BY user_id ORDER BY event_id), a AS (PARTITION BY user_id))
SELECT event_id, round(gl * gl / (hl + 1.0) + (g - gl) * (g - gl) / (h - hl + 1.0) - g * g / (h + 1.0), 6) AS gain FROM w""")
def sc_split_gain(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumns({"g": F.col("value") / 100, "h": 1 + F.col("event_id") % 3})
    return r6(sc.split_gain(ev, ["user_id"], "event_id", "g", "h", 1.0).select("event_id", "gain"))


# Joins ---------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT c_custkey, round(value, 6) AS value FROM customer JOIN px ON CAST(floor((c_custkey % 2000) / 100.0) AS BIGINT) = px AND CAST(floor((c_custkey % 100) / 10.0) AS BIGINT) = py")
def jn_raster_point(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2000).alias("lon"), (F.col("c_custkey") % 100).alias("lat"))
    return r6(joins.intersect(c, pixels(spark, sf_dir), CELLS, "lon", "lat").select("c_custkey", "value"))


@query(f"""WITH {PX}, n AS (SELECT a.px, a.py, count(*) AS k, sum(b.value) AS s FROM px a JOIN px b ON b.px BETWEEN a.px - 1 AND a.px + 1 AND b.py BETWEEN a.py - 1 AND a.py + 1 GROUP BY 1, 2)
SELECT n.px, n.py, round(s, 4) AS total, round(v.value, 6) AS middle FROM n JOIN px v ON n.px = v.px AND n.py = v.py WHERE k = 9""")
def jn_patch3x3(spark, sf_dir):
    px = pixels(spark, sf_dir)
    p = joins.patches(px.select("px", "py"), px, 1, "value")
    return p.select("px", "py", F.round(F.aggregate("patch", F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.round(F.col("patch")[4], 6).alias("middle"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def jn_leaveout_semi(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return joins.leave_out(table(spark, sf_dir, "orders"), groups, "o_custkey")[0].select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def jn_leaveout_anti(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return joins.leave_out(table(spark, sf_dir, "orders"), groups, "o_custkey")[1].select("o_orderkey", "o_custkey")


def _box(spark, sf_dir) -> tuple[float, float, float, float]:
    """Bounding box of all order lines."""
    r = stats.bounding_box(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").first()
    return float(r["min_x"]), float(r["min_y"]), float(r["max_x"]), float(r["max_y"])


_BOX = "bx AS (SELECT min(l_partkey)::DOUBLE AS x0, max(l_partkey)::DOUBLE AS x1, min(l_suppkey)::DOUBLE AS y0, max(l_suppkey)::DOUBLE AS y1 FROM lineitem)"


@query(f"""WITH {_BOX}, b AS (SELECT l_orderkey, l_linenumber, l_partkey AS px, l_suppkey AS py, x0, y0, (x1 - x0) / 4 AS dx, (y1 - y0) / 4 AS dy, CAST(floor((l_partkey - x0) / ((x1 - x0) / 4)) AS BIGINT) AS i, CAST(floor((l_suppkey - y0) / ((y1 - y0) / 4)) AS BIGINT) AS j FROM lineitem, bx)
SELECT l_orderkey, l_linenumber, px AS l_partkey, py AS l_suppkey, i * 4 + j AS cell FROM b WHERE px > x0 + i * dx AND px < x0 + (i + 1) * dx AND py > y0 + j * dy AND py < y0 + (j + 1) * dy AND i >= 0 AND i < 4 AND j >= 0 AND j < 4""")
def jn_within_open(spark, sf_dir):
    return joins.within_cells(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", _box(spark, sf_dir), 4, 4).select(*KEY, "cell")


@query("""WITH s AS (SELECT s_suppkey AS sensor, CAST(s_suppkey % 37 AS DOUBLE) AS x, CAST(s_suppkey % 23 AS DOUBLE) AS y, 5.0 AS z FROM supplier),
g AS (SELECT p_partkey AS cell, CAST(p_partkey % 41 AS DOUBLE) AS gx, CAST(p_partkey % 29 AS DOUBLE) AS gy FROM part),
p AS (SELECT sensor, cell, (x - gx) * (x - gx) + (y - gy) * (y - gy) + z * z AS r2 FROM s, g WHERE abs(x - gx) <= 4 AND abs(y - gy) <= 4)
SELECT sensor, cell, round(exp(-0.01 * sqrt(r2)) / r2, 9) AS value FROM p WHERE exp(-0.01 * sqrt(r2)) / r2 > 0.02""")
def jn_band_sensor(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sensor"), (F.col("s_suppkey") % 37).cast("double").alias("x"), (F.col("s_suppkey") % 23).cast("double").alias("y"), F.lit(5.0).alias("z"))
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell"), (F.col("p_partkey") % 41).cast("double").alias("gx"), (F.col("p_partkey") % 29).cast("double").alias("gy"))
    return joins.sensor_pairs(s, g, 4.0, 0.01, 0.02, digits=9)


@query("SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 6) AS gap FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 25")
def jn_band(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("r_bal"))
    return r6(joins.band_join(a, b, "bal", 25.0).select("c_custkey", "s_suppkey", F.abs(F.col("bal") - F.col("r_bal")).alias("gap")))


@query(f"WITH {PX}, b AS (SELECT CAST(floor(l_partkey / 100.0) AS BIGINT) AS px, CAST(floor(l_suppkey / 10.0) AS BIGINT) AS py, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT px.px, px.py, round(value, 6) AS value, q FROM px JOIN b ON px.px = b.px AND px.py = b.py")
def jn_stack_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    b = li.groupBy(CELLS.px(F.col("l_partkey")).alias("px"), CELLS.py(F.col("l_suppkey")).alias("py")).agg(F.max("l_quantity").alias("q"))
    return r6(joins.stack([pixels(spark, sf_dir), b]))


_D4 = " + ".join(f"(a.embedding[{i}]::DOUBLE - b.embedding[{i}]::DOUBLE) * (a.embedding[{i}]::DOUBLE - b.embedding[{i}]::DOUBLE)" for i in range(1, 5))


@query(f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS ref, b.label AS y, sqrt({_D4}) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, ref) AS r FROM p)
SELECT query, round(sum(y / (d + 0.001)) / sum(1 / (d + 0.001)), 6) AS prediction FROM r WHERE r <= 10 GROUP BY 1""")
def jn_knn_idw(spark, sf_dir):
    """Labels of all vectors from the ten nearest others in the first four components."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda name: [F.col("embedding")[i].cast("double").alias(f"{name}{i}") for i in range(4)]
    q, ref = e.select(F.col("vec_id").alias("query"), *part("q")), e.select(F.col("vec_id").alias("ref"), F.col("label").alias("y"), *part("e"))
    return r6(models.nearest_regression(q, ref, [f"q{i}" for i in range(4)], [f"e{i}" for i in range(4)], "y", "query", "ref"))


# Ordering and sampling -----------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(ntile(23) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS chunk FROM orders")
def ord_chunks(spark, sf_dir):
    return sampling.chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 23).select("o_orderkey", "chunk")


def _bins_sql(edges: str) -> str:
    cases = " ".join(f"WHEN v {'>=' if i == 0 else '>'} e[{i + 1}] AND v <= e[{i + 2}] THEN {i}" for i in range(5))
    return f"WITH e AS (SELECT {edges} AS e FROM orders), b AS (SELECT CASE {cases} END AS bin FROM (SELECT o_totalprice AS v, e FROM orders, e)) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n FROM b GROUP BY 1"


@query(_bins_sql("[" + ", ".join(f"min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * {i} / 5.0" for i in range(6)) + "]"))
def ord_value_bins_linear(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(sampling.value_bin("o_totalprice", sampling.linear_edges(o, "o_totalprice", 5)).alias("bin")).agg(F.count("*").alias("n"))


@query(_bins_sql("[" + ", ".join(f"quantile_cont(o_totalprice, {i / 5})" for i in range(6)) + "]"))
def ord_value_bins_pct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(sampling.value_bin("o_totalprice", sampling.percentile_edges(o, "o_totalprice", 5)).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {_BOX} SELECT CAST(least(floor((l_partkey - x0) / ((x1 - x0) / 4)), 3) * 4 + least(floor((l_suppkey - y0) / ((y1 - y0) / 4)), 3) AS BIGINT) AS cell, count(*) AS n FROM lineitem, bx GROUP BY 1")
def ord_cell_counts(spark, sf_dir):
    cells = joins.within_cells(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", _box(spark, sf_dir), 4, 4, closed=True)
    return cells.groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM customer")
def ord_group_codes(spark, sf_dir):
    return sampling.group_codes(table(spark, sf_dir, "customer"), "c_mktsegment").select("c_custkey", "code")


@query("""WITH s AS (SELECT 'r2' AS measure, event_type AS feature, avg(value) AS score FROM events GROUP BY event_type UNION ALL SELECT 'smse', event_type, avg(value) FROM events GROUP BY event_type)
SELECT measure, feature, round(score, 6) AS score, row_number() OVER (PARTITION BY measure ORDER BY CASE WHEN measure = 'smse' THEN -score ELSE score END, feature) AS rank FROM s""")
def ord_feature_rank(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature")).agg(F.avg("value").alias("score"))
    both = s.select(F.lit("r2").alias("measure"), "feature", "score").union(s.select(F.lit("smse").alias("measure"), "feature", "score"))
    return r6(sampling.feature_ranks(both))


@query("SELECT CAST(bin AS BIGINT) AS bin, CAST(greatest(n, (SELECT count(*) // 7 FROM orders)) AS BIGINT) AS n FROM (SELECT o_custkey % 7 AS bin, count(*) AS n FROM orders GROUP BY 1)")
def ord_resample_counts(spark, sf_dir):
    """Groups below the mean size are repeated up to it, larger ones stay."""
    o = table(spark, sf_dir, "orders").withColumn("bin", F.col("o_custkey") % 7)
    return sampling.resample_groups(o, "bin", o.count() // 7, ["o_orderkey"], False, True, 1).groupBy("bin").agg(F.count("*").alias("n"))


@query("SELECT CAST(n // 5 AS BIGINT) AS low, CAST((n + 4) // 5 AS BIGINT) AS high, 5::BIGINT AS folds FROM (SELECT count(*) AS n FROM orders)")
def ord_kfold_sizes(spark, sf_dir):
    f = sampling.k_folds(table(spark, sf_dir, "orders"), ["o_orderkey"], 5).groupBy("fold").count()
    return f.agg(F.min("count").alias("low"), F.max("count").alias("high"), F.count("*").alias("folds"))


@query("SELECT count(*) AS groups, true AS whole FROM (SELECT DISTINCT c_nationkey FROM customer)")
def ord_group_folds(spark, sf_dir):
    """Every group lies in one fold."""
    f = sampling.group_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 5)
    return f.groupBy("c_nationkey").agg(F.count_distinct("fold").alias("k")).agg(F.count("*").alias("groups"), F.bool_and(F.col("k") == 1).alias("whole"))


# Clustering ----------------------------------------------------------------------------------

_CEN = "c AS (SELECT label, " + ", ".join(f"avg(embedding[{i}]::DOUBLE) AS c{i}" for i in range(1, 5)) + " FROM embeddings GROUP BY label)"
_DC = " + ".join(f"(e.embedding[{i}]::DOUBLE - c{i}) * (e.embedding[{i}]::DOUBLE - c{i})" for i in range(1, 5))
_E4 = [f"e{i}" for i in range(1, 5)]


def _embedded(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i - 1].cast("double").alias(f"e{i}") for i in range(1, 5)])


def _label_centres(e: DataFrame) -> list[list[float]]:
    return [[r[c] for c in _E4] for r in e.groupBy("label").agg(*[F.avg(c).alias(c) for c in _E4]).orderBy("label").collect()]


@query(f"WITH {_CEN}, d AS (SELECT vec_id, c.label, {_DC} AS d FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) SELECT vec_id, CAST(label AS BIGINT) AS class, round(d, 6) AS distance2 FROM r WHERE r = 1")
def cl_assign(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    got = cluster.assign(e, [cluster.squared_distance(_E4, c) for c in _label_centres(e)])
    return r6(got.select("vec_id", "class", "distance2"))


@query(f"WITH {_CEN}, d AS (SELECT vec_id, c.label, {_DC} AS d FROM embeddings e, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r FROM d) SELECT CAST(r.label AS BIGINT) AS class, count(*) AS n, " + ", ".join(f"round(avg(e.embedding[{i}]::DOUBLE), 6) AS e{i}" for i in range(1, 5)) + " FROM r JOIN embeddings e ON r.vec_id = e.vec_id WHERE r = 1 GROUP BY 1")
def cl_step(spark, sf_dir):
    e = _embedded(spark, sf_dir)
    return r6(cluster.centroids(cluster.assign(e, [cluster.squared_distance(_E4, c) for c in _label_centres(e)]), _E4))


@query(f"WITH {_CEN} SELECT a.label AS a, b.label AS b, round(sqrt(" + " + ".join(f"(a.c{i} - b.c{i}) * (a.c{i} - b.c{i})" for i in range(1, 5)) + "), 6) AS distance FROM c a, c b")
def cl_centre_dist(spark, sf_dir):
    centres = _embedded(spark, sf_dir).groupBy("label").agg(*[F.avg(c).alias(c) for c in _E4])
    return r6(cluster.centre_distances(centres, _E4, "label"))


@query()
def cl_kmeans(spark, sf_dir):
    """k-means|| and Lloyd on the first components."""
    e = _embedded(spark, sf_dir)
    return cluster.KMeans(5, iterations=10).fit(e, _E4).predict(e).select("vec_id", "class", "distance2")


@query("""WITH s AS (SELECT c_custkey, CAST(c_custkey % 211 AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer)
SELECT a.c_custkey, count(*) AS neighbours, count(*) >= 10 AS core FROM s a JOIN s b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 36 GROUP BY 1""")
def cl_core_points(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 211).cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    return cluster.core_points(s, "x", "y", "c_custkey", 6.0)


# Models --------------------------------------------------------------------------------------


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem")
def md_ols1d(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = models.ols(li, ["l_quantity"], "l_extendedprice")
    return r6(li.limit(1).select(F.lit(float(m.coef[1])).alias("slope"), F.lit(float(m.coef[0])).alias("intercept")))


@query("""WITH g AS (SELECT count(*) / 4.0 + 0.5 AS a, sum(l_quantity) / 4.0 AS b, sum(l_quantity * l_quantity) / 4.0 + 0.5 AS d, sum(l_extendedprice / 1000) / 4.0 AS u, sum(l_quantity * l_extendedprice / 1000) / 4.0 AS v FROM lineitem)
SELECT round((d * u - b * v) / (a * d - b * b), 6) AS m0, round((a * v - b * u) / (a * d - b * b), 6) AS m1 FROM g""")
def md_bayes_posterior2d(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    m = models.bayes_linear(li, ["l_quantity"], "y", noise=4.0, prior=2.0)
    return r6(li.limit(1).select(F.lit(float(m.coef[0])).alias("m0"), F.lit(float(m.coef[1])).alias("m1")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity <= 25 THEN 1 + 2 * l_quantity ELSE 0 END + CASE WHEN l_quantity > 10 AND l_tax < 0.05 THEN 3 - l_tax ELSE 0 END, 6) AS p FROM lineitem")
def md_rules(spark, sf_dir):
    p = models.rules([([("l_quantity", "<=", 25)], 1.0, {"l_quantity": 2.0}), ([("l_quantity", ">", 10), ("l_tax", "<", 0.05)], 3.0, {"l_tax": -1.0})])
    return r6(table(spark, sf_dir, "lineitem").select(*KEY, p.alias("p")))


@query("""WITH p AS (SELECT c_custkey, s_suppkey, s_nationkey, abs(c_acctbal - s_acctbal) AS d FROM customer, supplier), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r FROM p)
SELECT c_custkey, s_nationkey AS prediction FROM r WHERE r = 1""")
def md_nn(spark, sf_dir):
    return models.nearest_value(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), ["c_acctbal"], ["s_acctbal"], "s_nationkey", "c_custkey", "s_suppkey")


@query("""WITH s AS (SELECT c_custkey AS i, CAST(c_custkey % 211 AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y, c_acctbal AS z FROM customer),
p AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, (a.z - b.z) * (a.z - b.z) AS g FROM s a JOIN s b ON a.i < b.i)
SELECT CAST(floor(d / 3.0) AS BIGINT) AS bin, count(*) AS n, round(avg(d), 6) AS distance, round(avg(g) / 2, 2) AS gamma FROM p WHERE d < 18 GROUP BY 1""")
def md_variogram(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 211).cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), "c_acctbal")
    return models.variogram(s, "x", "y", "c_acctbal", 3.0, 6).select("bin", "n", F.round("distance", 6).alias("distance"), F.round("gamma", 2).alias("gamma"))


@query("""WITH g AS (SELECT count(*) / 4.0 + 0.5 AS a, sum(l_quantity) / 4.0 AS b, sum(l_quantity * l_quantity) / 4.0 + 0.5 AS d FROM lineitem),
c AS (SELECT d / (a * d - b * b) AS c00, -b / (a * d - b * b) AS c01, a / (a * d - b * b) AS c11 FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.5 * (ln(4.0 + c00 + 2 * c01 * l_quantity + c11 * l_quantity * l_quantity) - ln(4.0)), 6) AS entropy FROM lineitem, c""")
def md_mutual_info(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = models.bayes_linear(li, ["l_quantity"], "l_extendedprice", noise=4.0, prior=2.0)
    return r6(li.select(*KEY, m.entropy_reduction().alias("entropy")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(regr.b * (l_quantity - regr.m), 4) AS shap_l_quantity FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem) regr")
def sh_linear(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = models.linear_shap(li, models.ols(li, ["l_quantity"], "l_extendedprice"))
    return out.select(*KEY, F.round("shap_l_quantity", 4).alias("shap_l_quantity"))


@query()
def md_forest(spark, sf_dir):
    """Forest mean and variance over trees for each order line of small orders."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice").cast("double"))
    _, predict = models.forest(li, ["l_quantity", "l_discount", "l_tax"], "y", trees=5, depth=3)
    return predict(li).select(*KEY, "Prediction", "Variance")


@query()
def md_approx_gp(spark, sf_dir):
    """Random-feature Gaussian process over quantity and tax."""
    li = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
    add, m = models.approx_gp(li, ["l_quantity", "l_tax"], "y", n_features=5, length=10.0)
    return m.predict(add(li)).select(*KEY, "Prediction", "Variance")


@query()
def md_krige(spark, sf_dir):
    """Ordinary kriging of supplier balances onto customer places."""
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 37).cast("double").alias("x"), (F.col("s_suppkey") % 23).cast("double").alias("y"), "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 37).cast("double").alias("x"), (F.col("c_custkey") % 23).cast("double").alias("y"))
    return kriging.krige(s, c, "x", "y", "s_acctbal", kriging.Variogram("linear", (1.0, 0.0)))


# Metrics -------------------------------------------------------------------------------------

_V = "v AS (SELECT l_returnflag, l_quantity AS y, l_extendedprice / 2000 AS p, 1.0 + l_linenumber AS w, 1.0 + l_tax AS var FROM lineitem)"


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000).alias("p"), (1.0 + F.col("l_linenumber")).cast("double").alias("w"), (1.0 + F.col("l_tax")).cast("double").alias("var"))


@query(f"""WITH {_V}, m AS (SELECT *, avg(y) OVER () AS my, avg(p) OVER () AS mp FROM v)
SELECT round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2, round(1 - var_pop(y - p) / var_pop(y), 6) AS expvar, round(avg((y - p) * (y - p)), 6) AS mse, round(avg((y - p) * (y - p)) / var_pop(y), 6) AS smse,
round(2 * covar_pop(y, p) / (var_pop(y) + var_pop(p) + (avg(y) - avg(p)) * (avg(y) - avg(p))), 6) AS lins_ccc, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(max(abs(y - p)), 6) AS max_error, round(avg(0.5 * ln({2 * math.pi!r} * var) + (y - p) * (y - p) / (2 * var)), 6) AS mll FROM m""")
def mt_regression(spark, sf_dir):
    return r6(metrics.regression(_scored(spark, sf_dir), "y", "p", var=F.col("var")))


@query(f"""WITH {_V}, m AS (SELECT *, sum(w * y) OVER (PARTITION BY l_returnflag) / sum(w) OVER (PARTITION BY l_returnflag) AS my FROM v)
SELECT l_returnflag, round(1 - sum(w * (y - p) * (y - p)) / sum(w * (y - my) * (y - my)), 6) AS r2, round(sum(w * (y - p) * (y - p)) / sum(w), 6) AS mse FROM m GROUP BY 1""")
def mt_weighted(spark, sf_dir):
    return r6(metrics.regression(_scored(spark, sf_dir), "y", "p", F.col("w"), by=["l_returnflag"]).select("l_returnflag", "r2", "mse"))


_CL = "k AS (SELECT CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS y, l_linenumber % 3 AS p, 0.2 + 0.1 * (l_linenumber % 5) AS p0, 0.3 AS p1, 0.5 - 0.1 * (l_linenumber % 5) AS p2 FROM lineitem)"


def _classes(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    five = (F.col("l_linenumber") % 5).cast("double")
    return li.select(y.alias("y"), (F.col("l_linenumber") % 3).alias("p"), (0.2 + 0.1 * five).alias("p0"), F.lit(0.3).alias("p1"), (0.5 - 0.1 * five).alias("p2"))


@query(f"WITH {_CL} SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-ln(greatest(1e-5, least(1 - 1e-5, CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)))), 6) AS log_loss, count(*) AS n FROM k")
def mt_classification(spark, sf_dir):
    return r6(metrics.classification(_classes(spark, sf_dir), "y", "p", ["p0", "p1", "p2"]))


@query(f"WITH {_CL}, c AS (SELECT a.v AS truth, b.v AS prediction FROM (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v)) SELECT c.truth, c.prediction, count(k.y) AS n, round(count(k.y) / (SELECT count(*) FROM k)::DOUBLE, 6) AS share FROM c LEFT JOIN k ON k.y = c.truth AND k.p = c.prediction GROUP BY 1, 2")
def mt_confusion(spark, sf_dir):
    return r6(metrics.confusion(_classes(spark, sf_dir), "y", "p", [0, 1, 2]))


@query("""WITH s AS (SELECT l_returnflag = 'R' AS t, l_quantity AS s FROM lineitem), g AS (SELECT s, sum(t::INT) AS pos, count(*) AS n FROM s GROUP BY s), r AS (SELECT *, sum(n) OVER (ORDER BY s) - n + (n + 1) / 2.0 AS rk FROM g)
SELECT round((sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))), 6) AS auc FROM r""")
def mt_auc(spark, sf_dir):
    return r6(metrics.auc(table(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_quantity")))


@query(f"WITH {_V} SELECT round(regr_slope(p, y), 6) AS slope, round(regr_intercept(p, y), 6) AS intercept FROM v")
def mt_best_fit(spark, sf_dir):
    return r6(metrics.best_fit(_scored(spark, sf_dir), "y", "p"))


@query(f"WITH {_V} SELECT CAST(floor((y - p) / 5.0) AS BIGINT) AS bin, count(*) AS n FROM v GROUP BY 1")
def mt_residual_bins(spark, sf_dir):
    return metrics.residual_bins(_scored(spark, sf_dir), "y", "p", 5.0)


# Rasters -------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT CAST(floor(px / 3.0) AS BIGINT) AS px, CAST(floor(py / 3.0) AS BIGINT) AS py, round(avg(value), 6) AS value FROM px GROUP BY 1, 2")
def ras_resample(spark, sf_dir):
    return r6(raster.resample(pixels(spark, sf_dir), 3))


@query("""WITH o AS (SELECT i AS ox, j AS oy, sqrt(i * i * 4.0 + j * j * 4.0 + 25.0) AS r FROM (SELECT unnest(range(-3, 4)) AS i), (SELECT unnest(range(-3, 4)) AS j))
SELECT ox, oy, round(exp(-0.02 * r) / (r * r) / (exp(-0.02 * 5.0) / 25.0), 6) AS weight FROM o""")
def ras_footprint(spark, sf_dir):
    return r6(raster.footprint_table(3, 2.0, 2.0, 5.0, 0.02, table(spark, sf_dir, "region")))


_KER = ", ".join(f"({i}, {j}, {w!r})" for (i, j), w in raster.footprint(1, 1.0, 1.0, 2.0, 0.1).items())


@query(f"WITH {PX}, k AS (SELECT * FROM (VALUES {_KER}) k(ox, oy, w)) SELECT a.px, a.py, round(sum(b.value * w) / greatest(sum(w), 1e-15), 6) AS value FROM px a, k, px b WHERE b.px = a.px - ox AND b.py = a.py - oy GROUP BY 1, 2")
def ras_convolve_direct(spark, sf_dir):
    return r6(raster.convolve(pixels(spark, sf_dir), raster.footprint(1, 1.0, 1.0, 2.0, 0.1)))


@query(f"""WITH {PX}, h AS (SELECT px, py, CASE WHEN (px + py) % 5 = 0 THEN NULL ELSE value END AS value FROM px), k AS (SELECT * FROM (VALUES {_KER}) k(ox, oy, w)),
n AS (SELECT a.px, a.py, sum(b.value * w) AS num, sum(w) AS den FROM h a, k, h b WHERE b.px = a.px - ox AND b.py = a.py - oy AND b.value IS NOT NULL GROUP BY 1, 2)
SELECT h.px, h.py, round(coalesce(h.value, num / (den + 1e-15)), 6) AS value FROM h LEFT JOIN n ON h.px = n.px AND h.py = n.py""")
def ras_kernel_impute(spark, sf_dir):
    holes = pixels(spark, sf_dir).withColumn("value", F.when((F.col("px") + F.col("py")) % 5 != 0, F.col("value")))
    return r6(raster.kernel_impute(holes, raster.footprint(1, 1.0, 1.0, 2.0, 0.1)))


@query(f"WITH {PX} SELECT px * 100.0 + 50.0 AS x, py * 10.0 + 5.0 AS y, round(value, 6) AS value FROM px")
def ras_centres(spark, sf_dir):
    return r6(raster.pixel_centres(pixels(spark, sf_dir), CELLS))


# More sources, sinks and joins ---------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS lon, CAST(l_suppkey AS DOUBLE) AS lat, l_extendedprice AS y, 1 AS grp, CASE WHEN l_linenumber % 7 = 0 THEN 1.0 ELSE l_quantity END AS w FROM lineitem")
def src_targets(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("weight", F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")))
    return files.targets(li, "l_extendedprice", "l_partkey", "l_suppkey", weight="weight").select("l_orderkey", "l_linenumber", "lon", "lat", "y", "grp", "w")


@query("SELECT l_quantity AS y_true, l_extendedprice / 2000 AS y_pred, l_orderkey, l_linenumber, round(l_quantity - l_extendedprice / 2000, 6) AS diff FROM lineitem")
def snk_validation_table(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 2000)
    return r6(files.validation_table(li, "l_quantity", "p", ["l_orderkey", "l_linenumber"]), ["y_true", "y_pred"])


@query(f"WITH {PX}, c AS (SELECT px AS cx, py AS cy FROM px) SELECT cx, cy, count(*) AS n, round(sum(value), 4) AS total FROM c JOIN px ON px.px BETWEEN cx - 2 AND cx + 1 AND px.py BETWEEN cy - 2 AND cy + 1 GROUP BY 1, 2")
def jn_windows(spark, sf_dir):
    px = pixels(spark, sf_dir)
    c = px.select("px", "py", F.col("px").alias("cx"), F.col("py").alias("cy"))
    return joins.windows(c, px, 4).groupBy("cx", "cy").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT p_partkey FROM part WHERE (p_size % 10 < 7) AND p_retailprice % 10 < 8 AND p_size > 0")
def jn_polygon(spark, sf_dir):
    """Parts whose (size, price) fall into a rectangle given as a ring, half open as the even-odd rule is."""
    x, y = F.col("p_size") % 10 + 0.5, F.col("p_retailprice") % 10
    ring = [(0.0, -1.0), (7.0, -1.0), (7.0, 8.0), (0.0, 8.0)]
    return table(spark, sf_dir, "part").where(joins.inside_polygon(x, y, ring) & (F.col("p_size") > 0)).select("p_partkey")


@query("""WITH v AS (SELECT ln(l_quantity + 1) AS y, ln(l_extendedprice / 2000 + 1) AS p FROM lineitem), m AS (SELECT *, avg(y) OVER () AS my FROM v)
SELECT round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2_transformed, round(avg((y - p) * (y - p)), 6) AS mse_transformed FROM m""")
def mt_transformed(spark, sf_dir):
    df = _scored(spark, sf_dir)
    return r6(metrics.transformed(df, "y", "p", sc.log(df, "y", 1.0)).select("r2_transformed", "mse_transformed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((a + b + c) / 3, 6) AS mean, round(((a - (a + b + c) / 3) * (a - (a + b + c) / 3) + (b - (a + b + c) / 3) * (b - (a + b + c) / 3) + (c - (a + b + c) / 3) * (c - (a + b + c) / 3)) / 3, 6) AS var FROM (SELECT *, l_quantity * 1.0 AS a, l_quantity * 1.5 + l_tax AS b, l_quantity + l_discount AS c FROM lineitem)")
def md_ensemble(spark, sf_dir):
    q = F.col("l_quantity")
    e = models.ensemble([q * 1.0, q * 1.5 + F.col("l_tax"), q + F.col("l_discount")])
    return r6(table(spark, sf_dir, "lineitem").select(*KEY, e["Prediction"].alias("mean"), e["Variance"].alias("var")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube_profile(spark, sf_dir):
    """Extension: class profiles at all levels of two classes."""
    li = table(spark, sf_dir, "lineitem")
    return r6(li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.grouping_id().cast("long").alias("level")))


@query("SELECT s_suppkey, CAST(130 + s_suppkey % 20 AS DOUBLE) AS lon, CAST(-35 + s_suppkey % 17 AS DOUBLE) AS lat FROM supplier")
def sc_geodetic_round_trip(spark, sf_dir):
    here = (130 + F.col("s_suppkey") % 20, -35 + F.col("s_suppkey") % 17, F.col("s_acctbal"))
    lon, lat, _ = sc.ecef_to_geodetic(*sc.geodetic_to_ecef(*here))
    return r6(table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat")))


@query()
def cl_dbscan(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 211).cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"))
    return cluster.dbscan(s, "x", "y", "c_custkey", 6.0)


@query()
def tr_pca(spark, sf_dir):
    df = filters.complete(covariates(spark, sf_dir), COLS)
    return r6(transforms.pca(df, COLS).apply(df).select(*KEY, "pc_1", "pc_2", "pc_3"))


@query()
def flt_sample_pixels(spark, sf_dir):
    return r6(sampling.sample_pixels(pixels(spark, sf_dir), 0.5))
