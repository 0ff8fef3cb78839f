"""Learners by passes of sums: support vector regression and stochastic variational Bayesian models.

Tasks turn their rows into a matrix of features, add up arrays of a fixed size, and the arrays of all tasks are summed in
a tree of groups of 64, so neither rows nor the arrays of all tasks meet in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.models import Linear, random_features
from pixelframe.plans.materialise import materialise

#: Arrays that one task sums up.
FAN = 64


def task_sums(rows: DataFrame, cols: list[str], run: Callable[[Iterator[np.ndarray]], np.ndarray | None]) -> np.ndarray | None:
    """The sum over tasks of ``run(matrices of cols)``; None without a row."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = run(pdf[cols].to_numpy(float) for pdf in frames if len(pdf))
        if found is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [found.astype("<f8").tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(b, "<f8") for b in pdf["sums"]], axis=0)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "sums": [total.tobytes()]})

    sums = rows.select(cols).mapInPandas(one, "part long, sums binary")
    left = rows.rdd.getNumPartitions()
    while left > FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInPandas(add, "part long, sums binary")
        left = -(-left // FAN)
    found = [np.frombuffer(bytes(r["sums"]), "<f8") for r in sums.collect()]
    return np.sum(found, axis=0) if found else None


@dataclass
class FeatureMap:
    """Rows of columns to rows of features, an intercept first: the columns themselves, or cosines and sines of random directions."""

    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.mean is not None:
            x = (x - self.mean) / self.scale
        if self.weights is None:
            return np.column_stack([np.ones(len(x)), x])
        angle = x @ self.weights.T
        return np.column_stack([np.ones(len(x)), np.cos(angle) / math.sqrt(len(self.weights)), np.sin(angle) / math.sqrt(len(self.weights))])


@dataclass
class Machine:
    """A linear model over a feature map."""

    cols: list[str]
    features: FeatureMap
    coef: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with Prediction; null where a column is null."""
        features, coef = self.features, self.coef

        @F.pandas_udf("double")
        def value(*x: pd.Series) -> pd.Series:
            m = np.column_stack([v.to_numpy(float) for v in x])
            out = features(m) @ coef
            return pd.Series(out).where(~np.isnan(m).any(axis=1))

        return df.withColumn("Prediction", value(*[F.col(c).cast("double") for c in self.cols]))

    def state(self) -> dict:
        part = lambda a: None if a is None else np.asarray(a).tolist()
        return {"cols": self.cols, "weights": part(self.features.weights), "mean": part(self.features.mean), "scale": part(self.features.scale), "coef": part(self.coef)}

    @classmethod
    def of_state(cls, state: dict) -> Machine:
        part = lambda a: None if a is None else np.array(a, float)
        return cls(state["cols"], FeatureMap(part(state["weights"]), part(state["mean"]), part(state["scale"])), np.array(state["coef"], float))


def svr(df: DataFrame, cols: list[str], y: str, C: float = 1.0, epsilon: float = 0.1, kernel: str = "rbf", gamma: float | str = "scale", n_features: int = 100, iterations: int = 40, tolerance: float = 1e-6, seed: int = 0) -> Machine:
    """Support vector regression: the least |w|^2 / 2 + C sum max(0, |y - f(x)| - epsilon); linear, or rbf by random features.

    Each step solves the least squares that touch the loss at the present residuals (rows inside the tube have no weight), and
    goes the best of several lengths towards it; both are a pass of sums over the rows.  ``gamma`` "scale" is one by the
    number of columns and the variance of all their values.
    """
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"unknown kernel {kernel!r}, one of linear, rbf")
    rows = materialise(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).na.drop(), "rows")
    names = rows.columns
    stats = rows.agg(F.count("*"), F.avg("y"), *[F.sum(n) for n in names[:-1]], *[F.sum(F.col(n) * F.col(n)) for n in names[:-1]]).first()
    if not stats[0]:
        raise ValueError("no complete rows")
    d, n = len(cols), stats[0]
    weights = None
    if kernel == "rbf":
        if gamma == "scale":
            whole = sum(stats[2 : 2 + d]) / (n * d)
            gamma = 1 / (d * max(sum(stats[2 + d :]) / (n * d) - whole * whole, 1e-12))
        weights = np.random.default_rng(seed).normal(size=(n_features, d)) * math.sqrt(2 * gamma)
    features = FeatureMap(weights)
    size = len(features(np.zeros((1, d)))[0])
    ridge = np.diag([0.0, *[1.0] * (size - 1)])  # the intercept is free
    floor = 1e-4 * max(epsilon, 1e-3)

    def system(coef: np.ndarray) -> Callable[[Iterator[np.ndarray]], np.ndarray]:
        def run(parts: Iterator[np.ndarray]) -> np.ndarray:
            out = np.zeros((size, size + 1))
            for m in parts:
                phi, t = features(m[:, :-1]), m[:, -1]
                r = t - phi @ coef
                w = np.where(np.abs(r) > epsilon, C / np.maximum(np.abs(r) - epsilon, floor), 0.0)
                weighted = phi * w[:, None]
                out[:, :-1] += phi.T @ weighted
                out[:, -1] += weighted.T @ (t - epsilon * np.sign(r))
            return out.ravel()

        return run

    def losses(coefs: np.ndarray) -> Callable[[Iterator[np.ndarray]], np.ndarray]:
        return lambda parts: np.sum([np.maximum(np.abs(m[:, -1:] - features(m[:, :-1]) @ coefs.T) - epsilon, 0).sum(axis=0) for m in parts] or [np.zeros(len(coefs))], axis=0)

    coef = np.zeros(size)
    coef[0] = stats[1]
    cost = math.inf
    lengths = np.array([0.0, *(0.5 ** np.arange(10))])
    for _ in range(iterations):
        found = task_sums(rows, names, system(coef)).reshape(size, size + 1)
        aim = np.linalg.lstsq(found[:, :-1] + ridge + 1e-10 * np.eye(size), found[:, -1], rcond=None)[0]
        tried = coef + lengths[:, None] * (aim - coef)
        costs = C * task_sums(rows, names, losses(tried)) + 0.5 * (tried[:, 1:] ** 2).sum(axis=1)
        best = int(np.argmin(costs))
        cost = costs[0] if cost is math.inf else cost
        if cost - costs[best] <= tolerance * max(abs(cost), 1e-12) and best == 0:
            break
        gain, cost, coef = cost - costs[best], costs[best], tried[best]
        if gain <= tolerance * max(abs(cost), 1e-12) and _ > 0:
            break
    return Machine(cols, features, coef)


def svr_cost(df: DataFrame, model: Machine, y: str, C: float, epsilon: float) -> float:
    """The value that ``svr`` makes small."""
    over = F.greatest(F.abs(F.col(y).cast("double") - F.col("Prediction")) - epsilon, F.lit(0.0))
    return C * (model.predict(df).agg(F.sum(over)).first()[0] or 0.0) + 0.5 * float((model.coef[1:] ** 2).sum())


def sgd_bayes(df: DataFrame, cols: list[str], y: str, noise: float = 1.0, prior: float = 1.0, epochs: int = 8, batch: int = 256, fit_noise: bool = True, seed: int = 0) -> Linear:
    """Bayesian linear regression by stochastic variational inference.

    The posterior is a Gaussian in its natural form (precision, precision times mean).  A task walks its rows in
    mini-batches; each moves the form towards what the batch, taken for the whole table, says.  The step is that share
    of the squared moves that does not cancel out over the batches, so it is long at first and shrinks as moves become
    noise.  After an epoch the tasks' averages over their batches are averaged by their rows, and noise and prior are set to
    their most likely values.  A task's rows are shuffled within each Arrow batch.
    """
    rows = materialise(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).na.drop(), "rows")
    names = rows.columns
    n, square = rows.agg(F.count("*"), F.sum(F.col("y") * F.col("y"))).first()
    if not n:
        raise ValueError("no complete rows")
    size = len(cols) + 1
    precision, pull = np.eye(size) / prior, np.zeros(size)
    for epoch in range(epochs):
        start = np.column_stack([precision, pull])

        def run(parts: Iterator[np.ndarray], start=start, noise=noise, prior=prior, epoch=epoch) -> np.ndarray | None:
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            state, mean, seen = start.copy(), np.zeros_like(start), 0
            drift, power, memory = np.zeros_like(start), 0.0, 1.0
            for m in parts:
                m = m[rng.permutation(len(m))]
                for at in range(0, len(m), batch):
                    some = m[at : at + batch]
                    phi = np.column_stack([np.ones(len(some)), some[:, :-1]])
                    said = phi.T @ np.column_stack([phi, some[:, -1]]) * (n / len(some) / noise)
                    said[:, :-1] += np.eye(size) / prior
                    move = said - state
                    drift += (move - drift) / memory
                    power += ((move * move).sum() - power) / memory
                    step = min(max((drift * drift).sum() / max(power, 1e-300), 1.0 / (memory + 1)), 1.0)
                    memory = memory * (1 - step) + 1
                    state = state + step * move
                    mean += len(some) * state
                    seen += len(some)
            return None if not seen else np.append(mean.ravel(), seen)

        found = task_sums(rows, names, run)
        average = (found[:-1] / found[-1]).reshape(size, size + 1)
        precision, pull = (average[:, :-1] + average[:, :-1].T) / 2, average[:, -1]
        cov = np.linalg.inv(precision)
        m = cov @ pull
        if fit_noise and epoch < epochs - 1:
            g, b = noise * (precision - np.eye(size) / prior), noise * pull
            used = size - np.trace(cov) / prior
            new_prior = float(m @ m / max(used, 1e-9))
            new_noise = float(max((square - 2 * m @ b + m @ g @ m) / max(n - used, 1e-9), 1e-9))
            # The same sums under the new noise and prior.
            precision, pull = g / new_noise + np.eye(size) / new_prior, b / new_noise
            noise, prior = new_noise, new_prior
    return Linear(cols, m, cov, noise)


def sgd_approx_gp(df: DataFrame, cols: list[str], y: str, n_features: int = 20, kernel: str = "rbf", length: float = 1.0, seed: int = 0, **options):
    """(function adding random features, ``sgd_bayes`` over them and the columns)."""
    features = random_features(cols, n_features, length, kernel, seed)
    add = lambda frame: frame.withColumns(features)
    return add, sgd_bayes(add(df), [*cols, *features], y, seed=seed, **options)
