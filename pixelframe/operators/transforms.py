"""Feature transforms: fitted once on a frame, frozen, then applied to any frame.

``fit`` returns a model with plain numbers as state (``state`` is JSON-ready); ``apply`` adds
no shuffle: it is a projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.operators import stats


@dataclass
class Columns:
    """A frozen map from column names to expressions; columns not named are dropped from ``cols``.

    ``kind`` names the rule in ``BUILD`` that makes the expressions from the state, so a saved state is enough.
    """

    cols: list[str]
    exprs: dict[str, Column]
    state: dict = field(default_factory=dict)
    kind: str = ""

    @property
    def names(self) -> list[str]:
        return list(self.exprs)

    def apply(self, df: DataFrame) -> DataFrame:
        gone = [c for c in self.cols if c not in self.exprs]
        return df.withColumns(self.exprs).drop(*gone)

    def saved(self) -> dict:
        return {"kind": self.kind, "cols": self.cols, "state": self.state}


def frozen(kind: str, cols: list[str], state: dict):
    """A transform from its kind, its columns and its state."""
    if kind in FITTED:
        return FITTED[kind].of_state(cols, state)
    return Columns(cols, BUILD[kind](cols, state), state, kind)


def load_chain(saved: list[dict]) -> list:
    return [frozen(**s) for s in saved]


def _x(c: str) -> Column:
    return F.col(c).cast("double")


def _moments(df: DataFrame, cols: list[str]) -> dict:
    return {c: {k: float(v) for k, v in m.items() if k in ("mean", "sd", "min")} for c, m in stats.fit_moments(df, cols).items()}


def centre(df: DataFrame, cols: list[str]) -> Columns:
    return frozen("centre", cols, _moments(df, cols))


def standardise(df: DataFrame, cols: list[str]) -> Columns:
    """(x - mean) / sd; columns without variance are dropped, so the width depends on the data."""
    return frozen("standardise", cols, _moments(df, cols))


def positive(df: DataFrame, cols: list[str]) -> Columns:
    """x - min and a millionth."""
    return frozen("positive", cols, _moments(df, cols))


def log(df: DataFrame, cols: list[str]) -> Columns:
    return frozen("log", cols, _moments(df, cols))


def sqrt(df: DataFrame, cols: list[str]) -> Columns:
    return frozen("sqrt", cols, _moments(df, cols))


def whiten(df: DataFrame, cols: list[str], keep_fraction: float | None = None, n_components: int | None = None, variation_fraction: float | None = None) -> Columns:
    """Projection on the last eigenvectors of the covariance, scaled to unit variance (ascending eigenvalues)."""
    if sum(v is not None for v in (keep_fraction, n_components, variation_fraction)) > 1:
        raise ValueError("only one of keep_fraction, n_components, variation_fraction")
    mean, cov = stats.covariance_matrix(df, cols)
    values, vectors = np.linalg.eigh(cov)
    d = len(cols)
    if n_components is not None:
        if n_components >= d:
            raise ValueError("n_components must be below the number of columns")
        k = n_components
    elif variation_fraction is not None:
        share = np.cumsum(values[::-1]) / values.sum()
        k = int(np.argmax(share > variation_fraction - 1e-15)) + 1
    else:
        k = min(max(1, int(d * keep_fraction)), d) if keep_fraction is not None else d
    values, vectors = values[-k:], vectors[:, -k:]
    return frozen("whiten", cols, {"mean": mean.tolist(), "eigenvalues": values.tolist(), "vectors": vectors.tolist()})


def _components(cols: list[str], state: dict) -> dict[str, Column]:
    exprs = {}
    vectors = np.array(state["vectors"])
    for j, value in enumerate(state["eigenvalues"]):
        weights = vectors[:, j] / math.sqrt(value)
        exprs[f"w{j}"] = sum((_x(c) - float(m)) * float(w) for c, m, w in zip(cols, state["mean"], weights, strict=True))
    return exprs


def one_hot(df: DataFrame, cols: list[str], hot: float = 0.5) -> Columns:
    """An indicator of ``hot`` or 0 for each level; null gives nulls, an unseen value zeros."""
    whole = df.select(*[F.col(c).cast("long").alias(c) for c in cols])
    return frozen("onehot", cols, {"hot": hot, "levels": {c: [int(v) for v in stats.levels(whole, c)] for c in cols}})


def _indicators(cols: list[str], state: dict) -> dict[str, Column]:
    exprs = {}
    for c in cols:
        x = F.col(c).cast("long")
        for i, v in enumerate(state["levels"][c]):
            exprs[f"{c}_{i}"] = F.when(x.isNull(), None).when(x == v, F.lit(state["hot"])).otherwise(F.lit(0.0))
    return exprs


def random_hot(df: DataFrame, cols: list[str], n_features: int = 10, seed: int = 0) -> Columns:
    """Each level becomes a seeded Gaussian row of ``n_features`` numbers."""
    whole = df.select(*[F.col(c).cast("long").alias(c) for c in cols])
    return frozen("randomhot", cols, {"n": n_features, "seed": seed, "levels": {c: [int(v) for v in stats.levels(whole, c)] for c in cols}})


def _gaussian_rows(cols: list[str], state: dict) -> dict[str, Column]:
    rng, exprs = np.random.default_rng(state["seed"]), {}
    for c in cols:
        levels = state["levels"][c]
        table = rng.normal(size=(len(levels), state["n"]))
        for j in range(state["n"]):
            values = F.map_from_arrays(F.array(*[F.lit(v) for v in levels]).cast("array<long>"), F.array(*[F.lit(float(t)) for t in table[:, j]]).cast("array<double>"))
            exprs[f"{c}_{j}"] = F.try_element_at(values, F.col(c).cast("long"))
    return exprs


def impute_mean(df: DataFrame, cols: list[str]) -> Columns:
    return frozen("mean", cols, _moments(df, cols))


#: Columns up to which the Gaussian imputer is spelled out as an expression (2 ** d - 1 patterns).
SPELLED = 8


def impute_gauss(df: DataFrame, cols: list[str]):
    """Conditional Gaussian mean of the missing given the observed columns; the mean if all are missing.

    Up to ``SPELLED`` columns the regression of every missing pattern is an expression; beyond, those of the patterns that a batch of
    rows shows are worked out where they are met.
    """
    mean, cov = stats.covariance_matrix(df, cols)
    return frozen("gaus" if len(cols) <= SPELLED else "gaus_rows", cols, {"mean": mean.tolist(), "cov": cov.tolist()})


def _patterns(cols: list[str], state: dict) -> dict[str, Column]:
    mean, precision = np.array(state["mean"]), np.linalg.pinv(np.array(state["cov"]))
    d = len(cols)
    pattern = sum(F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols))
    exprs: dict[str, Column] = {}
    for i, c in enumerate(cols):
        out = _x(c)
        for mask in range(1, 1 << d):
            if not mask >> i & 1:
                continue
            a = [j for j in range(d) if mask >> j & 1]
            b = [j for j in range(d) if not mask >> j & 1]
            value = F.lit(float(mean[i]))
            if b:
                w = -np.linalg.solve(precision[np.ix_(a, a)], precision[np.ix_(a, b)])[a.index(i)]
                value = value + sum((_x(cols[j]) - float(mean[j])) * float(v) for j, v in zip(b, w, strict=True))
            out = F.when(pattern == mask, value).otherwise(out)
        exprs[c] = out
    return exprs


class _Batches:
    """A transform that changes the rows of a batch with NumPy, one missing pattern after another."""

    kind = ""

    def __init__(self, cols: list[str], state: dict):
        self.cols, self.names, self.state = cols, cols, state

    @classmethod
    def of_state(cls, cols: list[str], state: dict):
        out = cls.__new__(cls)
        _Batches.__init__(out, cols, state)
        return out

    def saved(self) -> dict:
        return {"kind": self.kind, "cols": self.cols, "state": self.state}

    def filler(self):
        """A function of (known columns of some rows, mask of the missing ones) that gives the missing columns."""
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        cols, make = self.cols, self.filler

        def run(frames):
            fill = make()
            for pdf in frames:
                x = pdf[cols].to_numpy(float, na_value=np.nan)
                gone = np.isnan(x)
                patterns, which = np.unique(gone, axis=0, return_inverse=True)
                for i, missing in enumerate(patterns):
                    if missing.any():
                        rows = np.flatnonzero(which.ravel() == i)
                        x[np.ix_(rows, missing)] = fill(x[np.ix_(rows, ~missing)], missing)
                yield pd.concat([pdf.drop(columns=cols), pd.DataFrame(x, columns=cols, index=pdf.index)], axis=1)

        rest = [c for c in df.columns if c not in cols]
        out = df.select(*rest, *[_x(c).alias(c) for c in cols])
        return out.mapInPandas(run, out.schema)


class GaussImputer(_Batches):
    """Conditional means for any number of columns."""

    kind = "gaus_rows"

    def filler(self):
        mean, precision = np.array(self.state["mean"]), np.linalg.pinv(np.array(self.state["cov"]))
        known: dict[bytes, np.ndarray] = {}

        def fill(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
            w = known.get(missing.tobytes())
            if w is None:
                w = known[missing.tobytes()] = -np.linalg.lstsq(precision[np.ix_(missing, missing)], precision[np.ix_(missing, ~missing)], rcond=None)[0]
            return mean[missing] + (x - mean[~missing]) @ w.T

        return fill


class NearestImputer(_Batches):
    """Null cells become the mean of the k nearest reference rows over the observed columns; with none observed, of the first k.

    The reference is at most ``nodes`` random complete rows, the documented bound of what is shipped to tasks.
    """

    kind = "nearest"

    def __init__(self, df: DataFrame, cols: list[str], nodes: int = 500, k: int = 3, seed: int = 1):
        rows = df.select(*[_x(c).alias(c) for c in cols]).na.drop().orderBy(F.xxhash64(*cols, F.lit(seed))).limit(nodes).collect()
        if len(rows) < k:
            raise ValueError("fewer complete rows than neighbours")
        super().__init__(cols, {"k": k, "reference": np.array(rows, float).tolist()})

    def filler(self):
        k, ref = self.state["k"], np.array(self.state["reference"])

        def fill(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
            near = ref[:, ~missing]
            out = np.empty((len(x), int(missing.sum())))
            for at in range(0, len(x), 1024):  # at most 1024 x reference distances at once
                d = ((x[at : at + 1024, None, :] - near[None]) ** 2).sum(axis=2)
                out[at : at + 1024] = ref[np.argsort(d, axis=1, kind="stable")[:, :k]][:, :, missing].mean(axis=1)
            return out

        return fill


BUILD = {
    "centre": lambda cols, s: {c: _x(c) - s[c]["mean"] for c in cols},
    "standardise": lambda cols, s: {c: (_x(c) - s[c]["mean"]) / s[c]["sd"] for c in cols if s[c]["sd"] > 0},
    "positive": lambda cols, s: {c: _x(c) - s[c]["min"] + 1e-6 for c in cols},
    "log": lambda cols, s: {c: F.ln(_x(c) - s[c]["min"] + 1e-6) for c in cols},
    "sqrt": lambda cols, s: {c: F.sqrt(_x(c) - s[c]["min"] + 1e-6) for c in cols},
    "mean": lambda cols, s: {c: F.coalesce(_x(c), F.lit(s[c]["mean"])) for c in cols},
    "whiten": _components, "onehot": _indicators, "randomhot": _gaussian_rows, "gaus": _patterns,
}
FITTED = {"gaus_rows": GaussImputer, "nearest": NearestImputer}
STEPS = {"centre": centre, "standardise": standardise, "log": log, "sqrt": sqrt, "whiten": whiten, "onehot": one_hot, "mean": impute_mean, "gaus": impute_gauss, "nearest": NearestImputer, "randomhot": random_hot}


def chain(df: DataFrame, cols: list[str], steps: list[str]) -> list[Columns]:
    """Fit named steps one after another, each on the output of the one before; unknown names are an error."""
    fitted = []
    for name in steps:
        if name not in STEPS:
            raise ValueError(f"unknown transform {name!r}, one of {sorted(STEPS)}")
        model = STEPS[name](df, cols)
        df, cols = model.apply(df), model.names
        fitted.append(model)
    return fitted


def apply_chain(df: DataFrame, fitted: list[Columns]) -> DataFrame:
    for model in fitted:
        df = model.apply(df)
    return df


def pca(df: DataFrame, cols: list[str], n: int | None = None) -> Columns:
    """Whitened components as pc_1, pc_2, ... with the largest eigenvalue first."""
    model = whiten(df, cols)
    keep = list(model.exprs)[::-1][: n or len(cols)]
    return Columns(cols, {f"pc_{i + 1}": model.exprs[w] for i, w in enumerate(keep)}, model.state)
