"""Super learner: base models' out-of-fold predictions, a meta model over them, and both fitted on all rows.

Each base model is fitted once for each fold, and once on all rows when the learner is first asked to predict.  A fold's rows get the predictions of all base models one
column after another, so nothing is joined, and the table of out-of-fold predictions is written once.  The meta model's
own score is out of fold as well: for each fold it is fitted on the out-of-fold rows of the other folds.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.operators import metrics, models, sampling
from pixelframe.plans.materialise import materialise
from pixelframe.plans.pipeline import Model, fit_model


@dataclass
class SuperLearner:
    cols: list[str]
    specs: list[dict]
    meta_spec: dict
    folds: DataFrame  # key, fold, target, p0, p1, ... and meta, all out of fold
    target: str
    passed: list[str]
    rows: DataFrame  # written: all rows, and those with out-of-fold predictions of all bases
    whole: DataFrame

    @cached_property
    def bases(self) -> list[Model]:
        """The base models of all rows."""
        return [fit_model(self.rows, self.cols, self.target, spec) for spec in self.specs]

    @cached_property
    def meta(self) -> Model:
        """The meta model of all out-of-fold predictions."""
        return _fit_meta(self.whole, [*[f"p{i}" for i in range(len(self.specs))], *self.passed], self.target, self.meta_spec)

    def features(self, df: DataFrame) -> DataFrame:
        """``df`` with p0, p1, ... of the base models that were fitted on all rows."""
        return _predict(df, self.bases)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the meta model's Prediction; rows of which a base model has no prediction have none."""
        out = self.meta(self.features(df))
        return out.select(*df.columns, *[c for c in ("Prediction", "Variance", "Lower quantile", "Upper quantile") if c in out.columns])

    def scores(self) -> DataFrame:
        """(learner, r2, mse) of every base model and of the meta model, out of fold."""
        out = None
        for i, spec in enumerate(self.specs):
            one = metrics.regression(self.folds, self.target, f"p{i}").select(F.lit(f"p{i} {spec['name']}").alias("learner"), "r2", "mse")
            out = one if out is None else out.unionByName(one)
        return out.unionByName(metrics.regression(self.folds, self.target, "meta").select(F.lit(f"meta {self.meta_spec['name']}").alias("learner"), "r2", "mse"))


def _predict(df: DataFrame, bases: list[Model]) -> DataFrame:
    keep = list(df.columns)
    for i, model in enumerate(bases):
        keep.append(f"p{i}")
        df = model(df).withColumn(f"p{i}", F.col("Prediction").cast("double")).select(keep)
    return df


def positive_weights(df: DataFrame, cols: list[str], y: str) -> models.Linear:
    """Weights of no less than zero that make the least squares, without an intercept; from one pass of sums."""
    g, b, _, _ = models.gram(df, cols, y)
    g, b = g[1:, 1:], b[1:]
    w, active = np.zeros(len(b)), []
    for _ in range(10 * len(b)):
        gradient = b - g @ w
        inactive = [i for i in range(len(b)) if i not in active]
        if not inactive or max(gradient[i] for i in inactive) <= 1e-10 * max(np.abs(b).max(), 1e-300):
            break
        active.append(max(inactive, key=lambda i: gradient[i]))
        while True:
            s = np.zeros(len(b))
            s[active] = np.linalg.lstsq(g[np.ix_(active, active)], b[active], rcond=None)[0]
            if min(s[active]) > 0:
                w = s
                break
            # Go as far as weights stay positive, and leave out those that reach zero.
            step = min(w[i] / (w[i] - s[i]) for i in active if s[i] <= 0)
            w = w + step * (s - w)
            active = [i for i in active if w[i] > 1e-12]
            if not active:
                break
    return models.Linear(cols, np.concatenate([[0.0], w]))


def _fit_meta(rows: DataFrame, cols: list[str], y: str, spec: dict) -> Model:
    """``weights``: positive weights; ``mean``: the plain mean; else any model of the pipeline."""
    if spec["name"] == "weights":
        return Model("weights", {"linear": positive_weights(rows, cols, y).to_state()})
    if spec["name"] == "mean":
        return Model("mean", {"linear": models.Linear(cols, np.array([0.0, *[1 / len(cols)] * len(cols)])).to_state()})
    return fit_model(rows, cols, y, spec)


def learn(df: DataFrame, cols: list[str], y: str, key: list[str], bases: list[dict], meta: dict | None = None, folds: int = 5, group: str | None = None, passed: list[str] | None = None, seed: int = 1) -> SuperLearner:
    """Fit base models and the meta model (``ols`` by default); ``passed`` columns are inputs of the meta model beside the predictions.

    Rows with a null feature or target take no part.  A base model that has no prediction for a row of its fold leaves the row out of the meta model.
    """
    meta, passed = meta or {"name": "ols"}, passed or []
    taken = {*[f"p{i}" for i in range(len(bases))], "fold", "meta"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are named like the learner's own; rename them")
    rows = df.na.drop(subset=[*cols, y]).withColumn(y, F.col(y).cast("double"))
    folded = sampling.group_folds(rows, group, folds) if group else sampling.k_folds(rows, key, folds, seed)
    folded = materialise(folded, "folds")
    held = None
    for k in range(folds):
        rest = folded.where(F.col("fold") != k)
        part = _predict(folded.where(F.col("fold") == k), [fit_model(rest, cols, y, spec) for spec in bases])
        held = part if held is None else held.unionByName(part)
    held = materialise(held, "out-of-fold")
    inputs = [*[f"p{i}" for i in range(len(bases))], *passed]
    whole = held.na.drop(subset=inputs)
    scored = None
    for k in range(folds):
        own = _fit_meta(whole.where(F.col("fold") != k), inputs, y, meta)(whole.where(F.col("fold") == k))
        own = own.withColumn("meta", F.col("Prediction").cast("double")).select(*held.columns, "meta")
        scored = own if scored is None else scored.unionByName(own)
    return SuperLearner(cols, bases, meta, materialise(scored, "meta"), y, passed, folded, whole)
