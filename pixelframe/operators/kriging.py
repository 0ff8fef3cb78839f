"""Kriging: experimental and fitted variograms, ordinary and universal systems of the closest points, regression kriging.

A variogram is taken from all pairs of points.  Up to ``EXACT`` different places they are exact, formed from the sums of each
place; beyond, points are summed up in at most ``CELLS`` by ``CELLS`` cells (number, sum and sum of squares), whose correlation at all offsets
gives the mean squared differences of all pairs; only the distance of a pair is then rounded to that of its cells.
Neither form pairs rows in a join, and no more than the cells reach the driver.

Predictions solve one small system for each place over its closest points, which are found by an equi-join on
cells; systems are solved in batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.scalars import normal_interval
from pixelframe.operators.joins import nearest
from pixelframe.operators.sampling import k_folds
from pixelframe.plans.materialise import materialise

#: Places up to which pairs are exact; cells of an axis beyond that.
EXACT, CELLS = 2000, 256
#: Mean distance of two points of a unit square.
_WITHIN = 0.5214054331647207


def _spherical(p: tuple, d: np.ndarray) -> np.ndarray:
    r = np.minimum(d / max(p[1], 1e-300), 1.0)
    return p[0] * (1.5 * r - 0.5 * r**3) + p[2]


#: Semivariance by parameters and distance.  Ranges are those at which a model has (nearly) reached its sill.
MODELS: dict[str, Callable[[tuple, np.ndarray], np.ndarray]] = {
    "linear": lambda p, d: p[0] * d + p[1],
    "power": lambda p, d: p[0] * d ** p[1] + p[2],
    "gaussian": lambda p, d: p[0] * (1 - np.exp(-(np.minimum(d * 7 / (4 * max(p[1], 1e-300)), 1e3) ** 2))) + p[2],
    "exponential": lambda p, d: p[0] * (1 - np.exp(-3 * d / max(p[1], 1e-300))) + p[2],
    "spherical": _spherical,
    "hole-effect": lambda p, d: p[0] * (1 - (1 - 3 * d / max(p[1], 1e-300)) * np.exp(-3 * d / max(p[1], 1e-300))) + p[2],
}


@dataclass(frozen=True)
class Variogram:
    """A model with its parameters: (slope, nugget), (scale, exponent, nugget) or (partial sill, range, nugget)."""

    model: str
    parameters: tuple

    def __call__(self, distance: np.ndarray) -> np.ndarray:
        """Semivariance; zero at a point itself."""
        return np.where(distance > 1e-10, MODELS[self.model](self.parameters, distance), 0.0)


def _binned(distance: np.ndarray, square: np.ndarray, pairs: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean distance, semivariance, pairs) of equal bins from the least distance to the largest; bins without a pair go."""
    low, high = distance.min(), distance.max()
    step = (high - low) / lags or 1.0
    at = np.minimum(((distance - low) / step).astype(int), lags - 1)
    # Division may land one bin beside an exact edge; the edge itself decides.
    at = np.where(distance < low + at * step, at - 1, np.where((at < lags - 1) & (distance >= low + (at + 1) * step), at + 1, at))
    n = np.bincount(at, pairs, lags)
    held = n > 0
    return np.bincount(at, distance * pairs, lags)[held] / n[held], np.bincount(at, square, lags)[held] / (2 * n[held]), n[held]


def experimental(points: DataFrame, x: str, y: str, z: str, lags: int = 6, exact: int = EXACT, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean distance, semivariance, pairs) of each lag over all pairs of points."""
    rows = points.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))]).na.drop()
    n, x0, x1, y0, y1, mean = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("z")).first()
    if n < 2:
        raise ValueError("a variogram needs two points")
    # Rows of one place have the same distances, so places are paired, and any number of rows is exact on few places.
    z0 = F.col("z") - mean
    places = rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"), F.sum(z0).alias("s"), F.sum(z0 * z0).alias("q"))
    if n <= exact or places.limit(exact + 1).count() <= exact:
        px, py, m, s, q = np.array(places.collect(), float).T
        a, b = np.triu_indices(len(m), 1)
        same = m > 1
        dx, dy = px[a] - px[b], py[a] - py[b]
        distance = np.append(np.sqrt(dx * dx + dy * dy), np.zeros(same.sum()))
        square = np.append(m[b] * q[a] + m[a] * q[b] - 2 * s[a] * s[b], (m * q - s * s)[same])
        return _binned(distance, np.maximum(square, 0), np.append(m[a] * m[b], (m * (m - 1) / 2)[same]), lags)
    side = max(x1 - x0, y1 - y0) / cells or 1.0
    at = [F.least(F.floor((F.col(c) - low) / side), F.lit(cells - 1)).cast("int").alias(name) for c, low, name in (("x", x0, "i"), ("y", y0, "j"))]
    sums = rows.groupBy(*at).agg(F.count("*").cast("double").alias("n"), F.sum(z0).alias("s"), F.sum(z0 * z0).alias("q")).collect()
    shape = (2 * cells, 2 * cells)
    count, total, squares = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for r in sums:
        count[r["i"], r["j"]], total[r["i"], r["j"]], squares[r["i"], r["j"]] = r["n"], r["s"], r["q"]
    meet = lambda a, b: np.fft.irfft2(np.conj(np.fft.rfft2(a)) * np.fft.rfft2(b), s=shape)
    pairs = np.rint(meet(count, count))
    square = meet(count, squares) + meet(squares, count) - 2 * meet(total, total)
    offset = np.minimum(np.arange(2 * cells), 2 * cells - np.arange(2 * cells)) * side
    distance = np.hypot(offset[:, None], offset[None, :])
    # Within a cell a point is no pair with itself; every pair is seen from both ends.
    distance[0, 0], pairs[0, 0] = _WITHIN * side, pairs[0, 0] - n
    held = pairs > 0
    return _binned(distance[held], np.maximum(square[held], 0) / 2, pairs[held] / 2, lags)


def _bounded_fit(residuals: Callable[[np.ndarray], np.ndarray], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Parameters within bounds that minimise the sum of 2 (sqrt(1 + r^2) - 1), by damped Gauss-Newton steps."""
    cost = lambda r: float((2 * (np.sqrt(1 + r * r) - 1)).sum())
    p, damping = np.clip(start, low, high), 1e-3
    r = residuals(p)
    best = cost(r)
    for _ in range(steps):
        step = 1e-7 * np.maximum(np.abs(p), 1e-4)
        step = np.where(p + step > high, -step, step)
        slope = np.stack([(residuals(p + np.eye(len(p))[k] * step[k]) - r) / step[k] for k in range(len(p))], axis=1)
        weight = 1 / np.sqrt(1 + r * r)
        gradient = slope.T @ (weight * r)
        # A parameter at its bound that wants to go beyond stays there for this step.
        free = ~(((p <= low) & (gradient > 0)) | ((p >= high) & (gradient < 0)))
        if not free.any():
            break
        normal = (slope.T * weight) @ slope
        moved = False
        for _ in range(30):
            some = normal[np.ix_(free, free)] + damping * np.diag(np.maximum(np.diag(normal)[free], 1e-300))
            new = p.copy()
            new[free] -= np.linalg.lstsq(some, gradient[free], rcond=None)[0]
            new = np.clip(new, low, high)
            r_new = residuals(new)
            if cost(r_new) < best:
                moved = True
                break
            damping *= 4
        if not moved:
            break
        gain, p, r, damping = best - cost(r_new), new, r_new, max(damping / 8, 1e-12)
        best = cost(r)
        if gain < 1e-15 * max(best, 1e-300):
            break
    return p, best


def fit_variogram(distance: np.ndarray, gamma: np.ndarray, model: str = "linear", weight: bool = False) -> Variogram:
    """Weighted nonlinear least squares with softened residuals; ``weight`` lets near lags count more (a logistic of the distance)."""
    if model not in MODELS:
        raise ValueError(f"unknown variogram {model!r}, one of {sorted(MODELS)}")
    width, rise = float(np.ptp(distance)), float(np.ptp(gamma))
    slope = rise / width if width else 0.0
    top, far, least = float(gamma.max()), float(distance.max()), float(gamma.min())
    if model == "linear":
        start, low, high = [slope, least], [0, 0], [np.inf, top]
    elif model == "power":
        start, low, high = [slope, 1.1, least], [0, 0.001, 0], [np.inf, 1.999, top]
    else:
        start, low, high = [rise, 0.25 * far, least], [0, 0, 0], [10 * top, far, top]
    w = np.ones_like(distance)
    if weight and width:
        # One half at 0.7 of the way to the farthest lag, one tenth a tenth of the way later.
        w = 1 / (1 + np.exp(np.log(9) / (0.1 * width) * (distance - 0.7 * width - distance.min())))
        w = w / w.sum()
    residuals = lambda p: (MODELS[model](tuple(p), distance) - gamma) * w
    starts = [np.array(start, float)]
    if model not in ("linear", "power"):
        starts += [np.array([rise, share * far, least * part]) for share in (0.1, 0.5, 0.9) for part in (0.0, 1.0)]
    found = min((_bounded_fit(residuals, s, np.array(low, float), np.array(high, float)) for s in starts), key=lambda f: f[1])
    return Variogram(model, tuple(float(v) for v in found[0]))


def solve(places: np.ndarray, near: np.ndarray, variogram: Variogram, drift: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(value, variance) at (b, 2) places from (b, k, 3) points each; ``drift`` adds a plane in x and y."""
    b, k, _ = near.shape
    extra = 3 if drift else 1
    a, r = np.zeros((b, k + extra, k + extra)), np.zeros((b, k + extra))
    xy = near[:, :, :2]
    a[:, :k, :k] = variogram(np.sqrt(((xy[:, :, None] - xy[:, None]) ** 2).sum(axis=3)))
    gone = xy - places[:, None]
    far = np.sqrt((gone**2).sum(axis=2))
    a[:, :k, k] = a[:, k, :k] = 1
    r[:, :k], r[:, k] = variogram(far), 1
    if drift:
        scaled = gone / np.maximum(far.max(axis=1), 1e-300)[:, None, None]  # the plane is 0 at the place itself
        a[:, :k, k + 1 :] = scaled
        a[:, k + 1 :, :k] = scaled.transpose(0, 2, 1)
    # Equal places and collinear points make a system singular; its least-squares solution is taken.
    w = (np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ r[:, :, None])[:, :, 0]
    return (w[:, :k] * near[:, :, 2]).sum(axis=1), (w * r).sum(axis=1)


def krige(points: DataFrame, queries: DataFrame, x: str, y: str, z: str, variogram: Variogram | str = "linear", closest: int = 10, drift: bool = False, lags: int = 6, weight: bool = False) -> DataFrame:
    """``queries`` with Prediction and Variance from the ``closest`` points of each place.

    A variogram given by its model's name is fitted to the points first.  Ties go to the smaller (x, y, z); of one place no more
    than ``closest`` values take part.  Queries without a place get nulls.
    """
    pts = points.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "px"), (y, "py"), (z, "pz"))]).na.drop()
    pts = materialise(pts.withColumn("point", F.struct("px", "py", "pz", F.monotonically_increasing_id())), "points")
    if not pts.limit(1).count():
        raise ValueError("kriging without a point")
    if isinstance(variogram, str):
        distance, gamma, _ = experimental(pts, "px", "py", "pz", lags)
        variogram = fit_variogram(distance, gamma, variogram, weight)
    places = queries.select(F.col(x).cast("double").alias("qx"), F.col(y).cast("double").alias("qy")).na.drop().distinct()
    near = nearest(places.withColumn("place", F.struct("qx", "qy")), pts, ["qx", "qy"], ["px", "py"], closest, "place", "point")
    near = near.groupBy("qx", "qy").agg(F.sort_array(F.collect_list(F.struct("rank", "px", "py", "pz"))).alias("near"))

    def run(frames):
        for pdf in frames:
            value, var = np.zeros(len(pdf)), np.zeros(len(pdf))
            sizes = pdf["near"].map(len).to_numpy()
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                own = np.array([[(r["px"], r["py"], r["pz"]) for r in pdf["near"].iloc[i]] for i in rows], float)
                value[rows], var[rows] = solve(pdf[["qx", "qy"]].to_numpy(float)[rows], own, variogram, drift)
            yield pdf[["qx", "qy"]].assign(Prediction=value, Variance=var)

    solved = near.mapInPandas(run, "qx double, qy double, Prediction double, Variance double")
    on = (F.col(x).cast("double") == F.col("qx")) & (F.col(y).cast("double") == F.col("qy"))
    return queries.join(solved, on, "left").drop("qx", "qy")


def residuals(train: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], x: str, y: str, target: str, key: list[str], folds: int = 5, seed: int = 1) -> DataFrame:
    """(x, y, residual) of every row by a model that has not seen its fold."""
    folded = materialise(k_folds(train, key, folds, seed), "folds")
    held = None
    for k in range(folds):
        part = fit(folded.where(F.col("fold") != k))(folded.where(F.col("fold") == k))
        part = part.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(target).cast("double") - F.col("Prediction")).alias("residual"))
        held = part if held is None else held.unionByName(part)
    return materialise(held, "residuals")


def with_residuals(predicted: DataFrame, held: DataFrame, x: str, y: str, interval: float = 0.95, **options) -> DataFrame:
    """Predictions (and variances) with the kriged residual of their place added; ``options`` as of ``krige``."""
    own = "Variance" in predicted.columns
    out = predicted.withColumnRenamed("Prediction", "__prediction").drop("Lower quantile", "Upper quantile")
    out = out.withColumnRenamed("Variance", "__variance") if own else out
    places = held.select(F.col("x").alias(x), F.col("y").alias(y), F.col("residual").alias("__residual"))
    out = krige(places, out, x, y, "__residual", **options)
    out = out.withColumns({"Residual": F.col("Prediction"), "Prediction": F.col("__prediction") + F.col("Prediction"), "Variance": (F.col("__variance") if own else F.lit(0.0)) + F.col("Variance")})
    low, high = normal_interval(F.col("Prediction"), F.greatest("Variance", F.lit(0.0)), interval)
    return out.withColumns({"Lower quantile": low, "Upper quantile": high}).drop("__prediction", "__variance")


def ml_krige(train: DataFrame, queries: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], x: str, y: str, target: str, key: list[str], folds: int = 5, interval: float = 0.95, seed: int = 1, **options) -> DataFrame:
    """Regression kriging: a model's prediction plus the kriged residual of the place.

    ``fit(rows)`` gives a function that adds Prediction (and Variance).  Residuals are out of fold, as a flexible model has
    none on rows that it has seen.  Variances add up where the model has one.
    """
    held = residuals(train, fit, x, y, target, key, folds, seed)
    return with_residuals(fit(train)(queries), held, x, y, interval, **options)
