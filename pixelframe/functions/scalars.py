"""Scalar expressions: target transforms, interval and loss formulas, compound likelihoods."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes and weights of the 5-point Gauss-Legendre rule on [-1, 1].
GAUSS_NODES = (-0.906179845938664, -0.538469310105683, 0.0, 0.538469310105683, 0.906179845938664)
GAUSS_WEIGHTS = (0.236926885056189, 0.478628670499366, 0.568888888888889, 0.478628670499366, 0.236926885056189)
#: WGS84 semi-major axis and flattening.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


class TargetTransform:
    """forward and inverse column expressions with frozen state."""

    def __init__(self, forward, inverse, state: dict | None = None):
        self.forward, self.inverse, self.state = forward, inverse, state or {}


def identity() -> TargetTransform:
    return TargetTransform(lambda y: y, lambda t: t)


def standardise(df: DataFrame, col: str) -> TargetTransform:
    mean, sd = df.agg(F.avg(col), F.stddev_pop(col)).first()
    return TargetTransform(lambda y: (y - mean) / sd, lambda t: t * sd + mean, {"mean": mean, "sd": sd})


def sqrt(offset: float = 0.0) -> TargetTransform:
    return TargetTransform(lambda y: F.sqrt(y + offset), lambda t: t * t - offset)


def log(df: DataFrame, col: str, offset: float = 0.0) -> TargetTransform:
    """ln(y + offset); zeros take a tenth of the smallest positive value."""
    z = F.col(col) + offset
    low = df.where(z > 0).agg(F.min(z)).first()[0]
    return TargetTransform(lambda y: F.ln(F.when(y + offset == 0, F.lit((low or 1.0) / 10)).otherwise(y + offset)), lambda t: F.exp(t) - offset, {"ymin": low})


def logistic(scale: float = 1.0) -> TargetTransform:
    return TargetTransform(lambda y: 1 / (1 + F.exp(-scale * y)), lambda t: F.ln(t / (1 - t)) / scale)


class RankGaussian:
    """Sorted values against the half-normal grid, linear in between, ends clamped.

    The grid is held at ``knots`` evenly spaced ranks, a documented bound of what tasks carry.
    """

    def __init__(self, df: DataFrame, col: str, knots: int = 1001):
        n = df.where(F.col(col).isNotNull()).count()
        k = min(n, knots)
        at = [i / max(k - 1, 1) for i in range(k)]
        self.values = df.agg(F.percentile(F.col(col), F.array(*[F.lit(p) for p in at]))).first()[0]
        step = [(1 + p * (n - 1)) / (n + 1) for p in at]
        self.scores = [NormalDist().inv_cdf((1 + s) / 2) / math.sqrt(2) for s in step]

    def _interp(self, x: list[float], y: list[float]):
        import numpy as np

        @F.pandas_udf("double")
        def interp(v: pd.Series) -> pd.Series:
            return pd.Series(np.where(v.isna(), np.nan, np.interp(v.fillna(0), x, y)))

        return interp

    def forward(self, y: Column) -> Column:
        return F.nanvl(self._interp(self.values, self.scores)(y.cast("double")), F.lit(None))

    def inverse(self, t: Column) -> Column:
        return F.nanvl(self._interp(self.scores, self.values)(t.cast("double")), F.lit(None))


class Kde:
    """Gaussian kernel CDF (Scott's bandwidth) to a normal quantile; inverse by bisection.

    Kernels sit at up to ``points`` quantiles of the data.
    """

    def __init__(self, df: DataFrame, col: str, points: int = 200):
        n, sd = df.agg(F.count(col), F.stddev_samp(col)).first()
        k = min(n, points)
        self.points = df.agg(F.percentile(F.col(col), F.array(*[F.lit((i + 0.5) / k) for i in range(k)]))).first()[0]
        self.h = sd * n ** (-1 / 5)

    def cdf(self, y: float) -> float:
        return sum(0.5 * (1 + math.erf((y - p) / self.h / math.sqrt(2))) for p in self.points) / len(self.points)

    def forward(self, y: Column) -> Column:
        @F.pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            return v.map(lambda x: None if pd.isna(x) else NormalDist().inv_cdf(min(max(self.cdf(x), 1e-12), 1 - 1e-12)))

        return run(y.cast("double"))

    def inverse(self, t: Column) -> Column:
        def solve(x):
            if pd.isna(x):
                return None
            p, low, high = NormalDist().cdf(x), -1e6, 1e6
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if self.cdf(mid) < p else (low, mid)
            return high

        @F.pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            return v.map(solve)

        return run(t.cast("double"))


def normal_interval(mean: Column, var: Column, interval: float) -> tuple[Column, Column]:
    z = NormalDist().inv_cdf(0.5 + interval / 2)
    return mean - z * F.sqrt(var), mean + z * F.sqrt(var)


def quadrature(mean: Column, sd: Column, func) -> tuple[Column, Column]:
    """(expectation, variance) of func(N(mean, sd)) over mean +- 3 sd by the 5-point rule."""
    f = [func(mean + 3 * x * sd) for x in GAUSS_NODES]
    w = [F.lit(g * 3 * math.exp(-0.5 * (3 * x) ** 2) / math.sqrt(2 * math.pi)) for x, g in zip(GAUSS_NODES, GAUSS_WEIGHTS, strict=True)]
    e = sum(a * b for a, b in zip(f, w, strict=True))
    return e, sum((a - e) * (a - e) * b for a, b in zip(f, w, strict=True))


def pinball(residual: Column, alpha: float) -> Column:
    return F.when(residual < 0, (alpha - 1) * residual).otherwise(alpha * residual)


def log_cosh_gradients(y: Column, p: Column, alpha: float) -> tuple[Column, Column]:
    """(gradient, hessian) of the log-cosh quantile loss of y against p."""
    err = y - p
    err = F.when(err < 0, alpha * err).otherwise((1 - alpha) * err)
    return F.tanh(err), 1 / F.pow(F.cosh(err), F.lit(2.0))


def split_gain(df: DataFrame, by: list[str], order: str, gradient: str, hessian: str, l2: float) -> DataFrame:
    """Gain of a split after each row of a group, from cumulative sums."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    a = Window.partitionBy(*by)
    gl, hl, g, h = F.sum(gradient).over(w), F.sum(hessian).over(w), F.sum(gradient).over(a), F.sum(hessian).over(a)
    return df.withColumn("gain", gl * gl / (hl + l2) + (g - gl) * (g - gl) / (h - hl + l2) - g * g / (h + l2))


def unif_gauss_loglike(y: Column, f: Column) -> Column:
    """ln density of: uniform up to f with a Gaussian tail (f > 0), else a half Gaussian around f."""
    half = math.sqrt(2 / math.pi)
    c = F.ln(1 / (f + math.sqrt(math.pi / 2)))
    below = F.when((f > 0) & (y <= f), c)
    above = below.when((f > 0) & (y > f), c - F.lit(0.5) * (y - f) * (y - f))
    return above.otherwise(F.lit(math.log(half)) - F.lit(0.5) * (y - f) * (y - f))


def switching_loglike(y: Column, f: Column, var: Column, hit: Column) -> Column:
    gauss = F.lit(-0.5) * (F.ln(F.lit(2 * math.pi) * var) + (y - f) * (y - f) / var)
    return F.when(hit, gauss).otherwise(unif_gauss_loglike(y, f))


def interpolate(knots: Column, values: Column, at: float) -> Column:
    """Piecewise linear value of ascending (knots, values) arrays, constant beyond the ends."""
    x = F.lit(float(at))
    n = F.size(knots)
    i = F.size(F.filter(knots, lambda k: k <= x))  # knots at or left of x
    left_k, left_v = F.element_at(knots, F.greatest(i, F.lit(1))), F.element_at(values, F.greatest(i, F.lit(1)))
    j = F.least(i + 1, n)
    right_k, right_v = F.element_at(knots, j), F.element_at(values, j)
    return F.when((i == 0) | (i == n), left_v).otherwise(left_v + (right_v - left_v) * F.try_divide(x - left_k, right_k - left_k))


def scientific(x: Column) -> Column:
    """0.ddddE+xx label."""
    e = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))) + 1)
    m = x / F.pow(F.lit(10.0), e)
    return F.concat(F.format_string("%.4f", m), F.lit("E"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))


def geodetic_to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """WGS84 degrees and metres to earth-centred metres."""
    e2 = WGS84_F * (2 - WGS84_F)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi)


def geodetic_to_local(lon: Column, lat: Column, height: Column, origin: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    """(north, east, up) of a frame at ``origin`` (lon, lat, height)."""
    lon0, lat0 = math.radians(origin[0]), math.radians(origin[1])
    here = geodetic_to_ecef(lon, lat, height)
    there = geodetic_to_ecef(*(F.lit(v) for v in origin))
    x, y, z = (a - b for a, b in zip(here, there, strict=True))
    sl, cl, sp, cp = math.sin(lon0), math.cos(lon0), math.sin(lat0), math.cos(lat0)
    north = -sp * cl * x - sp * sl * y + cp * z
    east = -sl * x + cl * y
    up = cp * cl * x + cp * sl * y + sp * z
    return north, east, up


def ecef_to_geodetic(x: Column, y: Column, z: Column, steps: int = 6) -> tuple[Column, Column, Column]:
    """(lon, lat, height) by fixed-point steps on the latitude."""
    e2 = WGS84_F * (2 - WGS84_F)
    p = F.sqrt(x * x + y * y)
    phi = F.atan2(z, p * (1 - e2))
    for _ in range(steps):
        n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
        phi = F.atan2(z + e2 * n * F.sin(phi), p)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    return F.degrees(F.atan2(y, x)), F.degrees(phi), p / F.cos(phi) - n
