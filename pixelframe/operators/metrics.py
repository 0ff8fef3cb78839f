"""Validation metrics as aggregates."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.sampling import running_total

def regression(df: DataFrame, y: str, p: str, weight: Column | None = None, var: Column | None = None, by: list[str] | None = None, extra: list[Column] | None = None) -> DataFrame:
    """r2, expvar, mse (weighted), smse, lins_ccc, mae, rmse, max_error, mll when a variance is given, and ``extra`` aggregates.

    Complete rows only; sums of squares come from moments, so one pass is enough (two with weights).
    """
    by = by or []
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    cols = df.withColumns({"__y": F.col(y).cast("double"), "__p": F.col(p).cast("double"), "__w": w}).na.drop(subset=["__y", "__p"])
    e, z, q = F.col("__y") - F.col("__p"), F.col("__y"), F.col("__p")
    sw = F.sum("__w")
    se, see = F.sum(F.col("__w") * e), F.sum(F.col("__w") * e * e)
    if weight is None:  # variances are kept by their own updates, whatever the mean
        total = F.count("*") * F.var_pop("__y")
    else:  # moments of shifted values keep their digits; one mean close to the data does for all groups
        shifted = z - F.lit(cols.agg(F.avg("__y")).first()[0] or 0.0)
        sz, szz = F.sum(F.col("__w") * shifted), F.sum(F.col("__w") * shifted * shifted)
        total = szz - sz * sz / sw
    aggs = [
        (1 - F.try_divide(see, total)).alias("r2"),
        (1 - F.try_divide(see - se * se / sw, total)).alias("expvar"),
        (see / sw).alias("mse"),
        F.try_divide(F.avg(e * e), F.var_pop("__y")).alias("smse"),
        F.try_divide(2 * F.covar_pop(z, q), F.var_pop(z) + F.var_pop(q) + F.pow(F.avg(z) - F.avg(q), F.lit(2.0))).alias("lins_ccc"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.max(F.abs(e)).alias("max_error"),
    ]
    if var is not None:
        aggs.append(F.avg(F.lit(0.5) * F.ln(F.lit(2 * math.pi) * var) + e * e / (2 * var)).alias("mll"))
    return cols.groupBy(*by).agg(*aggs, *(extra or []))


def classification(df: DataFrame, y: str, p: str, proba: list[str], clip: float = 1e-5) -> DataFrame:
    """accuracy and log loss (clipped) of 0-based classes with a probability column each."""
    own = F.element_at(F.array(*[F.col(c).cast("double") for c in proba]), F.col(y).cast("int") + 1)
    own = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), own))
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"), F.avg(-F.ln(own)).alias("log_loss"), F.count("*").alias("n"))


def confusion(df: DataFrame, y: str, p: str, classes: list[int]) -> DataFrame:
    """(truth, prediction, n, share): zero-filled counts of all pairs of classes."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in classes for b in classes], "truth int, prediction int")
    got = df.groupBy(F.col(y).cast("int").alias("truth"), F.col(p).cast("int").alias("prediction")).agg(F.count("*").alias("n"))
    total = df.count()
    return cells.join(got, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.lit(float(max(total, 1)))).alias("share"))


def auc(df: DataFrame, truth: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC with tied scores sharing a rank, of each group of ``by``.

    Scores are counted first, so the running sum is over distinct scores only; one sum serves all groups.
    """
    by = by or []
    counts = df.select(*by, score.alias("s"), truth.cast("int").alias("t")).groupBy(*by, "s").agg(F.sum("t").alias("pos"), F.count("*").alias("n"))
    counts = running_total(counts, [*by, "s"], "n", "upto").withColumn("below", F.col("upto") - F.col("n"))
    # Ranks count from the group's first row.
    pos, n = F.sum("pos"), F.sum("n")
    ranks = F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2)) - pos * F.min("below")
    return counts.groupBy(*by).agg(F.try_divide(ranks - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def macro_auc(df: DataFrame, y: str, proba: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean one-versus-rest AUC of 0-based classes with a probability column each, of each group of ``by``; classes without both kinds count not."""
    each = [auc(df, F.col(y) == i, F.col(c), by) for i, c in enumerate(proba)]
    return reduce(DataFrame.union, each).groupBy(*(by or [])).agg(F.avg("auc").alias("auc"))


def best_fit(df: DataFrame, y: str, p: str) -> DataFrame:
    """Line of predictions over observations."""
    return df.agg(F.regr_slope(p, y).alias("slope"), F.regr_intercept(p, y).alias("intercept"))


def residual_bins(df: DataFrame, y: str, p: str, width: float) -> DataFrame:
    """(bin, n): residuals by bins of equal width."""
    return df.groupBy(F.floor((F.col(y) - F.col(p)) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def transformed(df: DataFrame, y: str, p: str, transform, var: Column | None = None) -> DataFrame:
    """The regression metrics of target-transformed columns; a variance becomes the square of its transformed root."""
    out = df.withColumns({"__ty": transform.forward(F.col(y)), "__tp": transform.forward(F.col(p))})
    tv = F.pow(transform.forward(F.sqrt(var)), F.lit(2.0)) if var is not None else None
    scores = regression(out, "__ty", "__tp", var=tv)
    return scores.select(*[F.col(c).alias(f"{c}_transformed") for c in scores.columns])


def leave_one_out(cross_validate, features: list[str]) -> dict[str, float]:
    """Mean r2 without each feature; ``cross_validate`` maps a feature list to scores by fold."""
    return {c: cross_validate([f for f in features if f != c]).agg(F.avg("r2")).first()[0] for c in features}


def median_error(df: DataFrame, y: str, p: str, by: str) -> DataFrame:
    """Median absolute error of each group from the ranks of its errors, which range partitions number."""
    e = df.select(by, F.abs(F.col(y) - F.col(p)).alias("e")).na.drop().groupBy(by, "e").agg(F.count("*").alias("n"))
    e = running_total(e, [by, "e"], "n", "upto")
    size = e.groupBy(by).agg(F.sum("n").alias("all"), F.min(F.col("upto") - F.col("n")).alias("before"))
    at = e.join(size, by).withColumn("low", F.col("upto") - F.col("n") - F.col("before")).withColumn("up", F.col("upto") - F.col("before"))
    holds = lambda i: F.max(F.when((F.col("low") <= i) & (i < F.col("up")), F.col("e")))
    return at.groupBy(by).agg(((holds(F.floor((F.col("all") - 1) / 2)) + holds(F.floor(F.col("all") / 2))) / 2).alias("median_ae"))


def residual_histogram(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Counts of residuals in equal bins over their range, the last bin closed."""
    e = df.select((F.col(y) - F.col(p)).alias("e")).na.drop()
    low, high = e.agg(F.min("e"), F.max("e")).first()
    width = ((high - low) / bins if low is not None else 0) or 1.0
    return e.groupBy(F.least(F.floor((F.col("e") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
