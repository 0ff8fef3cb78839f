"""Hyper-parameter search over a persisted table of trials.

A space maps names to ("uniform", low, high), ("log", low, high), ("int", low, high) or ("choice", [values]).  Proposals:

* random: draws from the space.
* tpe: for each parameter two densities over the trials so far, one of the best (as many as the root of the trials)
  and one of the rest; of many draws from the first the one with the largest ratio is proposed.
* bayes: a Gaussian process over the trials; of many draws from the space the one with the largest expected improvement.
* anneal: around one of the best trials, ever closer.

Trials run in parallel, each with its own Spark jobs.  Every finished round is appended to a table in the shared
folder, and a search that is started on a table goes on from it.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Random trials before a model of them is used, draws for a proposal, best trials as a share of the root of their number.
FIRST, DRAWS, BEST = 8, 24, 1.0
SCHEMA = "trial int, method string, parameters string, loss double, seconds double"
METHODS = ("random", "tpe", "bayes", "anneal")

Space = dict[str, tuple]


def draw(space: Space, rng: np.random.Generator) -> dict:
    """A point of the unit cube: numbers in [0, 1], or the index of a choice."""
    return {k: int(rng.integers(len(v[1]))) if v[0] == "choice" else float(rng.random()) for k, v in space.items()}


def value(space: Space, unit: dict) -> dict:
    """The parameters of a point."""
    out = {}
    for k, v in space.items():
        if v[0] == "choice":
            out[k] = v[1][unit[k]]
        elif v[0] == "log":
            out[k] = float(math.exp(math.log(v[1]) + unit[k] * (math.log(v[2]) - math.log(v[1]))))
        elif v[0] == "int":
            out[k] = int(min(v[1] + math.floor(unit[k] * (v[2] - v[1] + 1)), v[2]))
        elif v[0] == "uniform":
            out[k] = float(v[1] + unit[k] * (v[2] - v[1]))
        else:
            raise ValueError(f"unknown kind {v[0]!r} of {k}")
    return out


def unit_of(space: Space, parameters: dict) -> dict:
    """The point of parameters, back from a table."""
    out = {}
    for k, v in space.items():
        x = parameters[k]
        if v[0] == "choice":
            out[k] = v[1].index(x)
        elif v[0] == "log":
            out[k] = (math.log(x) - math.log(v[1])) / (math.log(v[2]) - math.log(v[1]))
        elif v[0] == "int":
            out[k] = (x - v[1] + 0.5) / (v[2] - v[1] + 1)
        else:
            out[k] = (x - v[1]) / (v[2] - v[1])
    return out


def _near(x: float, width: float, rng: np.random.Generator) -> float:
    """A normal draw around x that is reflected into [0, 1]."""
    y = (x + width * rng.normal()) % 2
    return float(2 - y if y > 1 else y)


class _Density:
    """Of one parameter: bells around the values, as wide as the gap to their neighbours, and a wide one in the middle; or smoothed shares."""

    def __init__(self, kind: tuple, values: list):
        self.choices = len(kind[1]) if kind[0] == "choice" else 0
        if self.choices:
            n = np.bincount(np.array(values, int), minlength=self.choices) + 1.0
            self.share = n / n.sum()
            return
        x = np.sort(np.append(values, 0.5))
        gaps = np.diff(np.concatenate([[0.0], x, [1.0]]))
        self.middle, self.width = x, np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, 1 + len(x)), 1.0)
        self.width[int(np.searchsorted(x, 0.5))] = 1.0

    def draw(self, rng: np.random.Generator):
        if self.choices:
            return int(rng.choice(self.choices, p=self.share))
        i = rng.integers(len(self.middle))
        return _near(float(self.middle[i]), float(self.width[i]), rng)

    def log(self, at) -> float:
        if self.choices:
            return math.log(self.share[at])
        # A bell that is reflected at both ends, as its draws are.
        total = sum(np.exp(-0.5 * ((mirror - self.middle) / self.width) ** 2) / self.width for mirror in (at, -at, 2 - at))
        return math.log(total.mean() + 1e-300)


def _tpe(space: Space, points: list[dict], losses: np.ndarray, rng: np.random.Generator) -> dict:
    order = np.argsort(losses, kind="stable")
    cut = max(2, math.ceil(BEST * math.sqrt(len(points))))
    out = {}
    for k, kind in space.items():  # parameter by parameter
        good, bad = (_Density(kind, [points[i][k] for i in some]) for some in (order[:cut], order[cut:]))
        out[k] = max((good.draw(rng) for _ in range(DRAWS)), key=lambda at: good.log(at) - bad.log(at))  # noqa: B023
    return out


def _matrix(space: Space, points: list[dict]) -> np.ndarray:
    columns = []
    for k, v in space.items():
        x = np.array([p[k] for p in points], float)
        columns += [(x == i).astype(float) / math.sqrt(2) for i in range(len(v[1]))] if v[0] == "choice" else [x]
    return np.stack(columns, axis=1)


def _bayes(space: Space, points: list[dict], losses: np.ndarray, rng: np.random.Generator) -> dict:
    x, y = _matrix(space, points), (losses - losses.mean()) / (losses.std() or 1.0)
    square = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    best = None
    for length in (0.1, 0.2, 0.4, 0.8):  # the length of the largest marginal likelihood
        for noise in (1e-4, 1e-2):
            factor = np.linalg.cholesky(np.exp(-0.5 * square / length**2) + noise * np.eye(len(x)))
            alpha = np.linalg.solve(factor.T, np.linalg.solve(factor, y))
            score = -0.5 * y @ alpha - np.log(np.diag(factor)).sum()
            if best is None or score > best[0]:
                best = score, length, factor, alpha
    _, length, factor, alpha = best
    top = points[int(np.argmin(losses))]
    tried = [draw(space, rng) for _ in range(20 * DRAWS)]
    tried += [{k: top[k] if v[0] == "choice" else _near(top[k], 0.05, rng) for k, v in space.items()} for _ in range(5 * DRAWS)]
    k = np.exp(-0.5 * ((_matrix(space, tried)[:, None] - x[None]) ** 2).sum(axis=2) / length**2)
    mean = k @ alpha
    sd = np.sqrt(np.maximum(1 - (np.linalg.solve(factor, k.T) ** 2).sum(axis=0), 1e-12))
    z = (y.min() - mean) / sd
    below = 0.5 * (1 + np.array([math.erf(v / math.sqrt(2)) for v in z]))
    gain = (y.min() - mean) * below + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return tried[int(np.argmax(gain))]


def _anneal(space: Space, points: list[dict], losses: np.ndarray, rng: np.random.Generator) -> dict:
    order = np.argsort(losses, kind="stable")
    around = points[order[min(int(rng.geometric(0.5)) - 1, len(order) - 1)]]
    width = 0.5 / (1 + 0.1 * len(points))
    stay = 1 - 1 / (1 + 0.1 * len(points))
    return {k: (around[k] if rng.random() < stay else int(rng.integers(len(v[1])))) if v[0] == "choice" else _near(around[k], width, rng) for k, v in space.items()}


def propose(space: Space, history: list[tuple[dict, float]], method: str, rng: np.random.Generator) -> dict:
    """The next point from (point, loss) of the trials so far; trials without a finite loss count as worse than all."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, one of {METHODS}")
    finite = [loss for _, loss in history if math.isfinite(loss)]
    if method == "random" or len(history) < FIRST or not finite:
        return draw(space, rng)
    worst = max(finite)
    points, losses = [p for p, _ in history], np.array([loss if math.isfinite(loss) else worst for _, loss in history])
    return {"tpe": _tpe, "bayes": _bayes, "anneal": _anneal}[method](space, points, losses, rng)


def search(spark: SparkSession, objective: Callable[[dict], float], space: Space, trials: int, path: str, method: str = "tpe", parallel: int = 4, seed: int = 1) -> DataFrame:
    """The table of ``trials`` trials below ``path``; those that it holds already are not run again.

    ``objective`` maps parameters to a loss; one that fails has no loss.
    """
    try:
        rows = [r for r in spark.read.schema(SCHEMA).parquet(path).collect()] if _exists(spark, path) else []
    except Exception as error:
        raise ValueError(f"{path} holds no table of trials") from error
    rows.sort(key=lambda r: r["trial"])
    history = [(unit_of(space, json.loads(r["parameters"])), r["loss"] if r["loss"] is not None else math.inf) for r in rows]

    def run(parameters: dict) -> tuple[float | None, float]:
        start = time.time()
        try:
            loss = float(objective(parameters))
        except Exception:  # a trial that cannot be run has no loss, the search goes on
            loss = math.nan
        return loss if math.isfinite(loss) else None, time.time() - start

    while len(history) < trials:
        n = min(parallel, trials - len(history))
        rng = np.random.default_rng([seed, len(history)])
        batch, pending = [], list(history)
        typical = float(np.median([loss for _, loss in history if math.isfinite(loss)] or [0.0]))
        for _ in range(n):  # a proposal of the same round counts as an ordinary trial, so the others keep away from it
            unit = propose(space, pending, method, rng)
            batch.append(unit)
            pending.append((unit, typical))
        with ThreadPoolExecutor(n) as pool:
            found = list(pool.map(run, [value(space, u) for u in batch]))
        new = [(len(history) + i, method, json.dumps(value(space, u)), loss, seconds) for i, (u, (loss, seconds)) in enumerate(zip(batch, found, strict=True))]
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        history += [(u, loss if loss is not None else math.inf) for u, (loss, _) in zip(batch, found, strict=True)]
    return spark.read.schema(SCHEMA).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        return False
    return True


def best(history: DataFrame) -> dict:
    """Parameters of the least loss; ties go to the earlier trial."""
    row = history.where("loss IS NOT NULL").orderBy("loss", "trial").first()
    if row is None:
        raise ValueError("no trial has a loss")
    return json.loads(row["parameters"])


def improvement(history: DataFrame) -> DataFrame:
    """(trial, loss, best): the least loss up to each trial (trials are few)."""
    from pyspark.sql import Window

    upto = Window.orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return history.select("trial", "loss", F.min("loss").over(upto).alias("best"))
