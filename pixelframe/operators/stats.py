"""Statistics of nullable columns: null is the only mask, all moments are population moments."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Count, mean, population sd, min, max and percentage missing of each column, in one pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}_count"), F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_sd"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"),
            (F.lit(100.0) * (1 - F.count(x) / F.count(F.lit(1)))).alias(f"{c}_missing"),
        ]
    return df.groupBy(*(by or [])).agg(*aggs)


def fit_moments(df: DataFrame, cols: list[str]) -> dict[str, dict[str, float]]:
    """Moments as numbers on the driver (one row); a column without a value is an error."""
    row = moments(df, cols).first()
    out = {c: {k: row[f"{c}_{k}"] for k in ("count", "mean", "sd", "min", "max", "missing")} for c in cols}
    for c in cols:
        if not out[c]["count"]:
            raise ValueError(f"column {c} has no values")
    return out


def power(x: Column, exponent: float) -> Column:
    """Elementwise power; null stays null."""
    return F.pow(x.cast("double"), F.lit(float(exponent)))


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(cols, 2))


def pair_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: number of rows in which both columns of a pair have values."""
    return df.agg(*[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"{a}_{b}") for a, b in _pairs(cols)])


def outer(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: sums of products, nulls as zero."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    return df.agg(*[F.sum(x[a] * x[b]).alias(f"{a}_{b}") for a, b in _pairs(cols)])


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, cov): products centred by each column's own mean over the number of complete pairs."""
    mean = {c: s["mean"] for c, s in fit_moments(df, cols).items()}
    dev = {c: F.col(c).cast("double") - F.lit(mean[c]) for c in cols}
    aggs = []
    for a, b in _pairs(cols):
        both = F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both.alias("n"), (F.sum(dev[a] * dev[b]) / both).alias("cov")))
    return df.agg(F.array(*aggs).alias("p")).select(F.inline("p"))


def covariance_matrix(df: DataFrame, cols: list[str]):
    """(means, covariance) as NumPy arrays of d and d x d numbers."""
    import numpy as np

    mean = {c: s["mean"] for c, s in fit_moments(df, cols).items()}
    at = {c: i for i, c in enumerate(cols)}
    out = np.zeros((len(cols), len(cols)))
    for r in covariance(df, cols).collect():
        out[at[r["a"]], at[r["b"]]] = out[at[r["b"]], at[r["a"]]] = r["cov"]
    return np.array([mean[c] for c in cols]), out


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of pairwise complete rows."""
    pairs = [(a, b) for a in cols for b in cols if a < b]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def levels(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a categorical column; floats are refused."""
    if dict(df.dtypes)[col] in ("float", "double"):
        raise ValueError("levels of a float column")
    return [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]


def quality_profile(df: DataFrame, col: str, by: list[str] | None = None, large: float = 1e10) -> DataFrame:
    """Finite, missing and large flags, min, mean, median, max, sd and Pearson's second skewness."""
    x = F.col(col).cast("double")
    mean, median, sd = F.avg(x), F.median(x), F.stddev_pop(x)
    return df.groupBy(*(by or [])).agg(
        F.bool_and(F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))).alias("all_finite"),
        F.bool_or(x.isNull() | F.isnan(x)).alias("any_missing"),
        F.coalesce(F.bool_or(F.abs(x) > large), F.lit(False)).alias("any_large"),
        F.min(x).alias("min"), mean.alias("mean"), median.alias("median"), F.max(x).alias("max"), sd.alias("sd"),
        F.try_divide(F.lit(3.0) * (mean - median), sd).alias("skew"),
    )


def weighted_centroid(df: DataFrame, cols: list[str], by: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted mean of each column for each group."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    return df.groupBy(*by).agg(*[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in cols])


def bounding_box(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))
