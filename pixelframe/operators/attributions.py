"""Exact attributions of forests, weighted by how many training rows went each way at a split.

A leaf is a box: for each feature on its way an interval, and the share of training rows that its splits on the feature would have
kept.  For a row, a feature is present (the row lies in the interval: 1 or 0) or absent (the share).  The
leaf's part in the value of a set of present features is a product over its features, so the average over
all orders needs no enumeration of sets: it is read off the coefficients of the product of (share + present t).

The leaves of a model are a table of the model's size and go to the tasks with it; rows are worked on in batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    value: float
    features: list[int]
    low: np.ndarray  # a row is inside where low < x <= high
    high: np.ndarray
    share: np.ndarray


def leaves_of(tree) -> list[Leaf]:
    """The leaves of an MLlib regression tree of continuous features."""
    out = []

    def walk(node, box: dict[int, tuple[float, float, float]]) -> None:
        if node.numDescendants() == 0:
            f = sorted(box)
            out.append(Leaf(float(node.prediction()), f, *[np.array([box[i][k] for i in f], float) for k in range(3)]))
            return
        split, n = node.split(), node.impurityStats().count()
        i, at = split.featureIndex(), split.threshold()
        low, high, share = box.get(i, (-math.inf, math.inf, 1.0))
        left, right = node.leftChild(), node.rightChild()
        walk(left, {**box, i: (low, min(high, at), share * left.impurityStats().count() / n)})
        walk(right, {**box, i: (max(low, at), high, share * right.impurityStats().count() / n)})

    walk(tree._call_java("rootNode"), {})
    return out


def attribute(x: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """(rows, features + 1): attributions of one tree's prediction, and its mean over the training rows last."""
    n, d = x.shape
    out = np.zeros((n, d + 1))
    for leaf in leaves:
        m = len(leaf.features)
        out[:, d] += leaf.value * leaf.share.prod()
        if not m:
            continue
        own = x[:, leaf.features]
        present = ((own > leaf.low) & (own <= leaf.high)).astype(float)
        weight = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
        for i in range(m):
            # Coefficients of the product over the other features.
            poly = np.zeros((n, m))
            poly[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    poly[:, 1:] = poly[:, 1:] * leaf.share[j] + poly[:, :-1] * present[:, j : j + 1]
                    poly[:, 0] *= leaf.share[j]
            out[:, leaf.features[i]] += leaf.value * (present[:, i] - leaf.share[i]) * (poly @ weight)
    return out


def forest_shap(df: DataFrame, forests: list, cols: list[str]) -> DataFrame:
    """``df`` with ``shap_<column>`` and ``shap_base``, which add up to the mean prediction of all trees; null where a column is null."""
    trees = [leaves_of(tree) for model in forests for tree in model.trees]
    names = [*[f"shap_{c}" for c in cols], "shap_base"]
    rest = df.withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(cols)})
    inputs = [f"__x{i}" for i in range(len(cols))]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def run(*x: pd.Series) -> pd.DataFrame:
        m = np.column_stack([v.to_numpy(float) for v in x])
        gone = np.isnan(m).any(axis=1)  # pandas hands nulls on as NaN; they go back as nulls
        total = sum((attribute(m, leaves) for leaves in trees), np.zeros((len(m), len(cols) + 1))) / len(trees)
        total[gone] = np.nan
        return pd.DataFrame(total, columns=names)

    found = rest.withColumn("__shap", run(*[F.col(c) for c in inputs]))
    return found.select(*df.columns, *[F.col("__shap")[n].alias(n) for n in names])
