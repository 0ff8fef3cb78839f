"""Rule learner: committees of model trees, written as disjoint rules with linear models.

A tree is grown level by level.  Values are replaced by bins between quantiles once; each level is one aggregate of
(node, feature, bin) over the rows, and the split that lowers the standard deviation most is taken for each node.  Sums of
squares and products of the leaves, added up towards the root, then give the linear model of every node, its error
(raised for small nodes with many terms), the terms that are dropped and the subtrees that are replaced by a model.
Leaves are smoothed by the models above them.  The next member of a committee is trained on the target less the last one's
error, 2 y - prediction, and predictions are means over members.

What reaches the driver is bounded by nodes x features x bins, never by rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.functions.scalars import normal_interval
from pixelframe.operators import filters
from pixelframe.operators.joins import nearest
from pixelframe.operators.models import rules as rule_sum
from pixelframe.plans.materialise import materialise

#: Bins of a feature, levels of a tree, smallest leaf, weight of the model above in smoothing.
BINS, DEPTH, LEAST, SMOOTH = 32, 5, 4, 15.0

Rule = tuple[list[tuple], float, dict[str, float]]


@dataclass
class _Node:
    path: tuple = ()
    n: float = 0.0
    sums: np.ndarray | None = None  # of products of (1, features, target)
    split: tuple | None = None  # (feature, bin)
    left: _Node | None = None
    right: _Node | None = None
    model: np.ndarray = field(default_factory=lambda: np.zeros(0))
    error: float = 0.0

    def leaves(self) -> list[_Node]:
        return [self] if self.split is None else self.left.leaves() + self.right.leaves()


def _cuts(df: DataFrame, cols: list[str], bins: int) -> list[list[float]]:
    """Distinct inner quantiles of each feature."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(q or [])) for q in row]


def bin_of(value: Column, cuts: list[float], first: int = 0) -> Column:
    """The number of ``cuts`` (ascending) below the value, found by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value <= F.lit(float(cuts[half])), bin_of(value, cuts[:half], first)).otherwise(bin_of(value, cuts[half + 1 :], first + half + 1))


def _place(tree: _Node, ids: dict[int, int]) -> Column:
    """The number of the leaf that a row of bins falls to."""
    if tree.split is None:
        return F.lit(ids[id(tree)])
    feature, at = tree.split
    return F.when(F.get("__bins", F.lit(feature)) <= at, _place(tree.left, ids)).otherwise(_place(tree.right, ids))


def _grow(binned: DataFrame, d: int, depth: int, least: float) -> _Node:
    root = _Node()
    open_ = [root]
    for _ in range(depth):
        ids = {id(leaf): i for i, leaf in enumerate(root.leaves())}
        wanted = {ids[id(leaf)]: leaf for leaf in open_}
        long = binned.select(_place(root, ids).alias("node"), "__y", F.posexplode("__bins").alias("f", "b")).where(F.col("node").isin(list(wanted)))
        found = long.groupBy("node", "f", "b").agg(F.count("*").alias("n"), F.sum("__y").alias("s"), F.sum(F.col("__y") * F.col("__y")).alias("q")).collect()
        size = max((r["b"] for r in found), default=0) + 1
        table = np.zeros((len(ids), d, size, 3))
        for r in found:
            table[r["node"], r["f"], r["b"]] = r["n"], r["s"], r["q"]
        open_ = []
        for node, leaf in wanted.items():
            low = np.cumsum(table[node], axis=1)
            whole = low[0, -1]
            high = whole - low
            spread = lambda m: np.sqrt(np.maximum(m[..., 2] * m[..., 0] - m[..., 1] ** 2, 0))  # n times the deviation
            fits = (low[..., 0] >= least) & (high[..., 0] >= least)
            gain = np.where(fits, spread(whole) - spread(low) - spread(high), -np.inf)
            f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if not gain[f, b] > 1e-9 * max(spread(whole), 1e-300):
                continue
            leaf.split = (int(f), int(b))
            leaf.left, leaf.right = _Node((*leaf.path, (int(f), "<=", int(b)))), _Node((*leaf.path, (int(f), ">", int(b))))
            open_ += [leaf.left, leaf.right]
        if not open_:
            break
    return root


def _sum_up(node: _Node) -> None:
    if node.split is not None:
        _sum_up(node.left)
        _sum_up(node.right)
        node.sums = node.left.sums + node.right.sums
    node.n = float(node.sums[0, 0])


def _fit(sums: np.ndarray, allowed: list[int]) -> tuple[np.ndarray, float]:
    """Coefficients of (1, features) with terms dropped while that lowers the error, and that error."""
    n, k = sums[0, 0], len(sums) - 1

    def solve(terms: list[int]) -> tuple[np.ndarray, float]:
        at = [0, *terms]
        g, b = sums[np.ix_(at, at)], sums[at, k]
        coef = np.linalg.lstsq(g + 1e-9 * np.diag(np.diag(g)), b, rcond=1e-10)[0]
        rest = max(sums[k, k] - 2 * coef @ b + coef @ g @ coef, 0.0)
        out = np.zeros(k)
        out[at] = coef
        used = len(at)
        return out, math.sqrt(rest / n) * ((n + used) / (n - used) if n > used else 10.0)

    terms = [t for t in allowed if sums[t, t] > 0]
    best, error = solve(terms)
    while terms:
        tried = [(*solve([t for t in terms if t != gone]), gone) for gone in terms]
        coef, e, gone = min(tried, key=lambda t: t[1])
        if e > error * (1 + 1e-12):
            break
        best, error = coef, e
        terms.remove(gone)
    return best, error


def _prune(node: _Node, allowed: list[int]) -> float:
    """Fit every node; a subtree that is no better than the node's own model becomes a leaf.  Returns the error that is left."""
    node.model, node.error = _fit(node.sums, allowed)
    if node.split is None:
        return node.error
    below = (node.left.n * _prune(node.left, allowed) + node.right.n * _prune(node.right, allowed)) / node.n
    if node.error <= below:
        node.split = node.left = node.right = None
        return node.error
    return below


def _limit(root: _Node, most: int) -> None:
    """Merge the pair of leaves whose parent's model loses least until there are ``most`` leaves."""
    while len(root.leaves()) > most:
        parents = []
        stack = [root]
        while stack:
            node = stack.pop()
            if node.split is not None:
                stack += [node.left, node.right]
                if node.left.split is None and node.right.split is None:
                    parents.append((node.n * node.error - node.left.n * node.left.error - node.right.n * node.right.error, len(parents), node))
        node = min(parents)[2]
        node.split = node.left = node.right = None


def _rules(root: _Node, cuts: list[list[float]], cols: list[str], mean: np.ndarray, scale: np.ndarray, smooth: float) -> list[Rule]:
    out = []

    def walk(node: _Node, above: list[_Node]) -> None:
        if node.split is not None:
            walk(node.left, [*above, node])
            walk(node.right, [*above, node])
            return
        coef, n = node.model.copy(), node.n
        for parent in reversed(above):
            coef = (n * coef + smooth * parent.model) / (n + smooth)
            n = parent.n
        # Smoothed models keep the mean of their own rows.
        means = node.sums[0, :-1] / node.n
        coef[0] += node.sums[0, -1] / node.n - coef @ means
        slope = coef[1:] / scale
        limits: dict[tuple, float] = {}
        for f, op, b in node.path:  # of several limits on one side the tightest holds
            at = cuts[f][b]
            limits[f, op] = at if (f, op) not in limits else min(limits[f, op], at) if op == "<=" else max(limits[f, op], at)
        conditions = [(cols[f], op, at) for (f, op), at in limits.items()]
        out.append((conditions, float(coef[0] - slope @ mean), {c: float(s) for c, s in zip(cols, slope, strict=True) if s}))

    walk(root, [])
    return out


@dataclass
class Committee:
    """Members of disjoint rules; ``limits`` bound predictions."""

    cols: list[str]
    members: list[list[Rule]]
    limits: tuple[float, float] | None = None

    def values(self) -> list[Column]:
        bound = (lambda v: F.greatest(F.least(v, F.lit(self.limits[1])), F.lit(self.limits[0]))) if self.limits else (lambda v: v)
        return [bound(rule_sum(m)) for m in self.members]

    def predict(self, df: DataFrame, interval: float = 0.95) -> DataFrame:
        """``df`` with the members' mean as Prediction, their variance and an interval; null where a feature is null."""
        whole = F.lit(True)
        for c in self.cols:
            whole = whole & F.col(c).isNotNull()
        # Members are worked out once; mean and variance are taken from their array.
        of = F.when(whole, F.array(*self.values()))
        k = len(self.members)
        out = df.withColumn("__members", of)
        out = out.withColumn("Prediction", F.aggregate("__members", F.lit(0.0), lambda a, m: a + m) / k)
        apart = F.aggregate("__members", F.lit(0.0), lambda a, m: a + (m - F.col("Prediction")) * (m - F.col("Prediction"))) / k
        out = out.withColumn("Variance", apart)
        low, high = normal_interval(F.col("Prediction"), F.col("Variance"), interval)
        return out.withColumns({"Lower quantile": low, "Upper quantile": high}).drop("__members")

    def state(self) -> dict:
        return {"cols": self.cols, "members": self.members, "limits": self.limits}

    @classmethod
    def of_state(cls, state: dict) -> Committee:
        members = [[([tuple(c) for c in conditions], intercept, coef) for conditions, intercept, coef in m] for m in state["members"]]
        return cls(state["cols"], members, tuple(state["limits"]) if state["limits"] else None)


def fit(
    df: DataFrame, cols: list[str], y: str, members: int = 1, sampling: float | None = None, seed: int = 0, key: list[str] | None = None, bins: int = BINS, depth: int = DEPTH, least: int = LEAST,
    max_rules: int | None = None, smooth: float = SMOOTH, extrapolation: float | None = None,
) -> Committee:
    """A committee from the complete rows of ``df``.

    ``sampling`` is a percentage of rows that are drawn by a hash (of ``key``, or of the features and the target);
    ``extrapolation`` the percentage of the target's range by which predictions may leave it.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias("__target"), F.xxhash64(*(key or [*cols, y]), F.lit(seed)).alias("__h")).na.drop()
    if sampling is not None:
        rows = rows.where(F.pmod("__h", F.lit(1_000_003)) < sampling / 100 * 1_000_003)
    rows = materialise(rows.drop("__h"), "rules")
    stats = rows.agg(F.count("*"), F.min("__target"), F.max("__target"), F.avg("__target"), *[f(c) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    if not stats[0]:
        raise ValueError("rules need complete rows")
    mean, scale = np.array(stats[4::2], float), np.array(stats[5::2], float)
    scale = np.where(scale > 0, scale, 1.0)
    cuts = _cuts(rows, cols, bins)
    scaled = [((F.col(c) - float(m)) / float(s)) for c, m, s in zip(cols, mean, scale, strict=True)]
    binned = rows.select("*", F.array(*[bin_of(F.col(c), q) for c, q in zip(cols, cuts, strict=True)]).alias("__bins"))
    if members * depth > 1:  # a single split reads the bins too seldom to write them
        binned = materialise(binned, "bins")
    low, high = stats[1], stats[2]
    limits = None if extrapolation is None else (low - extrapolation / 100 * (high - low), high + extrapolation / 100 * (high - low))
    made: list[list[Rule]] = []
    # Without the mean of the target, sums of squares keep their digits.
    centre = stats[3]
    for _ in range(members):
        # 2 y less the last member's prediction; that one's own target does not matter.
        target = F.col("__target") if not made else 2 * F.col("__target") - rule_sum(made[-1])
        one = binned.withColumn("__y", target - float(centre))
        if made:
            one = materialise(one, "bins")
        root = _grow(one, len(cols), depth, least)
        leaves = root.leaves()
        ids = {id(leaf): i for i, leaf in enumerate(leaves)}
        terms = [F.lit(1.0), *scaled, F.col("__y")]
        products = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
        for r in one.groupBy(_place(root, ids).alias("node")).agg(*products).collect():
            sums = np.zeros((len(terms), len(terms)))
            sums[np.triu_indices(len(terms))] = list(r)[1:]
            leaves[r["node"]].sums = sums + np.triu(sums, 1).T
        _sum_up(root)
        _prune(root, list(range(1, len(cols) + 1)))
        if max_rules:
            _limit(root, max_rules)
        made.append([(conditions, intercept + float(centre), coef) for conditions, intercept, coef in _rules(root, cuts, cols, mean, scale, smooth)])
    return Committee(cols, made, limits)


def fit_many(df: DataFrame, cols: list[str], y: str, trees: int = 10, sampling: float = 70, seed: int = 0, **options) -> Committee:
    """Several committees, each from its own sample; their members are one committee."""
    parts = [fit(df, cols, y, sampling=sampling, seed=seed + 7919 * t, **options) for t in range(trees)]
    limits = [p.limits for p in parts if p.limits]
    return Committee(cols, [m for p in parts for m in p.members], (min(a for a, _ in limits), max(b for _, b in limits)) if limits else None)


def composite(queries: DataFrame, train: DataFrame, committee: Committee, y: str, query_id: str, train_id: str, k: int = 5) -> DataFrame:
    """Rules with neighbours: the mean over the k nearest training rows of their target plus the difference of both rows' predictions.

    Distances are over features divided by their spread in ``train``.
    """
    cols = committee.cols
    spread = train.agg(*[F.stddev_pop(c).alias(c) for c in cols]).first()
    # A feature of one value tells no rows apart.
    scale = {c: float(spread[c] or 0.0) or 1.0 for c in cols}
    at = lambda df, side: committee.predict(df).withColumns({f"__{side}{i}": F.col(c).cast("double") / scale[c] for i, c in enumerate(cols)})
    asked = at(queries, "q").select(F.col(query_id).alias("__qid"), F.col("Prediction").alias("__p"), *[f"__q{i}" for i in range(len(cols))])
    known = at(train, "r").select(F.col(train_id).alias("__rid"), (F.col(y).cast("double") - F.col("Prediction")).alias("__rest"), *[f"__r{i}" for i in range(len(cols))]).na.drop()
    near = nearest(asked, known, [f"__q{i}" for i in range(len(cols))], [f"__r{i}" for i in range(len(cols))], k, "__qid", "__rid")
    mean = near.groupBy("__qid").agg(F.avg(F.col("__p") + F.col("__rest")).alias("Prediction"))
    return queries.join(mean.withColumnRenamed("__qid", query_id), query_id, "left")


def usage(df: DataFrame, committee: Committee) -> DataFrame:
    """(feature, conditions, models): the percentage of (row, member) pairs whose rule names the feature in a condition or in its model."""
    every = [rule for m in committee.members for rule in m]
    counts = df.agg(*[F.count(F.when(filters.satisfied(conditions), 1)).alias(f"r{i}") for i, (conditions, _, _) in enumerate(every)])
    per_rule = F.array(*[
        F.struct(F.col(f"r{i}").alias("n"), F.array(*[F.lit(c) for c in sorted({c for c, *_ in conditions})]).cast("array<string>").alias("c"), F.array(*[F.lit(c) for c in sorted(coef)]).cast("array<string>").alias("m"))
        for i, (conditions, _, coef) in enumerate(every)
    ])
    rows = counts.select(F.explode(per_rule).alias("r")).select("r.*")
    share = lambda held: F.coalesce(100 * F.try_divide(F.sum(F.when(F.array_contains(held, F.col("feature")), F.col("n"))), F.sum("n")), F.lit(0.0))
    named = rows.withColumn("feature", F.explode(F.array(*[F.lit(c) for c in committee.cols])))
    return named.groupBy("feature").agg(share("c").alias("conditions"), share("m").alias("models"))
