"""Models: closed forms from one aggregation, rules, neighbours, and MLlib where it fits."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.operators import filters
from pixelframe.operators.joins import nearest
from pixelframe.plans.materialise import materialise


#: Most terms of a linear model whose quadratic form is spelled out as one sum.
SPELLED = 12


def gram(df: DataFrame, cols: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'X, X'y, y'y, n) with an intercept column first; complete rows, one pass, d x d numbers on the driver."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in cols]]
    t = F.col(y).cast("double")
    d = len(x)
    aggs = [F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)] + [F.sum(v * t) for v in x] + [F.sum(t * t), F.count("*")]
    row = list(df.na.drop(subset=[*cols, y]).agg(*aggs).first())
    g = np.zeros((d, d))
    k = 0
    for i in range(d):
        for j in range(i, d):
            g[i, j] = g[j, i] = row[k] or 0.0
            k += 1
    return g, np.array(row[k : k + d], float), float(row[-2] or 0.0), int(row[-1])


class Linear:
    """Linear model with optional posterior covariance; ``predict`` is a projection."""

    def __init__(self, cols: list[str], coef: np.ndarray, cov: np.ndarray | None = None, noise: float = 0.0):
        self.cols, self.coef, self.cov, self.noise = cols, coef, cov, noise

    def mean(self) -> Column:
        return F.lit(float(self.coef[0])) + sum((F.col(c).cast("double") * float(b) for c, b in zip(self.cols, self.coef[1:], strict=True)), F.lit(0.0))

    def quadratic(self) -> Column:
        """x' C x of the posterior covariance."""
        x = [F.lit(1.0), *[F.col(c).cast("double") for c in self.cols]]
        if len(x) <= SPELLED:
            return sum((x[i] * x[j] * float(self.cov[i, j]) for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
        # A sum of so many terms is no expression any more: rows of C meet the array of x.
        whole = F.array(*x)
        add = lambda a, v: a + v
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in self.cov])
        dot = lambda row, v: v * F.aggregate(F.zip_with(row, whole, lambda c, w: c * w), F.lit(0.0), add)
        return F.aggregate(F.zip_with(rows, whole, dot), F.lit(0.0), add)

    def predict(self, df: DataFrame, interval: float = 0.95) -> DataFrame:
        out = df.withColumn("Prediction", self.mean())
        if self.cov is not None:
            from pixelframe.functions.scalars import normal_interval

            out = out.withColumn("Variance", F.lit(self.noise) + self.quadratic())
            low, high = normal_interval(F.col("Prediction"), F.col("Variance"), interval)
            out = out.withColumns({"Lower quantile": low, "Upper quantile": high, "Expected reduction in entropy": self.entropy_reduction()})
        return out

    def to_state(self) -> dict:
        return {"cols": self.cols, "coef": np.asarray(self.coef).tolist(), "cov": None if self.cov is None else np.asarray(self.cov).tolist(), "noise": self.noise}

    @classmethod
    def of_state(cls, state: dict) -> Linear:
        return cls(state["cols"], np.array(state["coef"]), None if state["cov"] is None else np.array(state["cov"]), state["noise"])

    def save(self, df: DataFrame, path: str) -> None:
        """Write the model as one JSON line through Spark (``df`` gives the session)."""
        df.sparkSession.createDataFrame([(json.dumps(self.to_state()),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, df: DataFrame, path: str) -> Linear:
        return cls.of_state(json.loads(df.sparkSession.read.text(path).first()["value"]))

    def entropy_reduction(self) -> Column:
        return F.lit(0.5) * (F.ln(F.lit(self.noise) + self.quadratic()) - F.lit(math.log(self.noise)))


def ols(df: DataFrame, cols: list[str], y: str) -> Linear:
    g, b, _, _ = gram(df, cols, y)
    return Linear(cols, np.linalg.pinv(g) @ b)


def bayes_linear(df: DataFrame, cols: list[str], y: str, noise: float = 1.0, prior: float = 1.0, iterations: int = 0) -> Linear:
    """Posterior of N(0, prior) weights under N(0, noise) errors; ``iterations`` of evidence maximisation."""
    g, b, yy, n = gram(df, cols, y)
    for step in range(iterations + 1):
        cov = np.linalg.inv(g / noise + np.eye(len(g)) / prior)
        m = cov @ b / noise
        if step < iterations:
            used = len(m) - np.trace(cov) / prior
            prior = float(m @ m / max(used, 1e-9))
            noise = float((yy - 2 * m @ b + m @ g @ m) / max(n - used, 1e-9))
    return Linear(cols, m, cov, noise)


def ard(df: DataFrame, cols: list[str], y: str, iterations: int = 50) -> Linear:
    """Automatic relevance determination: a prior for each weight, by fixed-point steps on the Gram matrix."""
    g, b, yy, n = gram(df, cols, y)
    alpha, noise = np.ones(len(g)), max(yy / max(n, 1), 1e-9)
    for _ in range(iterations):
        cov = np.linalg.inv(g / noise + np.diag(alpha))
        m = cov @ b / noise
        used = 1 - alpha * np.diag(cov)
        alpha = np.clip(used / np.maximum(m * m, 1e-12), 1e-9, 1e9)
        noise = max((yy - 2 * m @ b + m @ g @ m) / max(n - used.sum(), 1e-9), 1e-12)
    return Linear(cols, m, cov, float(noise))


def random_features(cols: list[str], n: int, length: float = 1.0, kernel: str = "rbf", seed: int = 0) -> dict[str, Column]:
    """cos and sin columns of a shift-invariant kernel: rbf, laplace, cauchy, matern32 or matern52."""
    rng = np.random.default_rng(seed)
    d = len(cols)
    w = rng.normal(size=(n, d))
    freedom = {"matern32": 3, "matern52": 5}
    if kernel == "laplace":
        w = rng.standard_cauchy((n, d))
    elif kernel == "cauchy":
        w = rng.laplace(size=(n, d))
    elif kernel in freedom:
        w /= np.sqrt(rng.chisquare(freedom[kernel], (n, 1)) / freedom[kernel])
    elif kernel != "rbf":
        raise ValueError(f"unknown kernel {kernel!r}")
    out = {}
    for i, row in enumerate(w / length):
        angle = sum((F.col(c).cast("double") * float(v) for c, v in zip(cols, row, strict=True)), F.lit(0.0))
        out[f"cos{i}"], out[f"sin{i}"] = F.cos(angle) / math.sqrt(n), F.sin(angle) / math.sqrt(n)
    return out


def approx_gp(df: DataFrame, cols: list[str], y: str, n_features: int = 20, kernel: str = "rbf", length: float = 1.0, noise: float = 1.0, prior: float = 1.0, seed: int = 0):
    """(function adding the features, Bayesian linear model over them)."""
    features = random_features(cols, n_features, length, kernel, seed)
    add = lambda frame: frame.withColumns(features)
    return add, bayes_linear(add(df), [*cols, *features], y, noise, prior)


class ExactGp:
    """Exact Gaussian process for up to ``limit`` training rows (a documented bound); Cholesky on the driver."""

    def __init__(self, df: DataFrame, cols: list[str], y: str, length: float = 1.0, noise: float = 0.1, limit: int = 2000):
        rows = np.array(df.na.drop(subset=[*cols, y]).select(*[F.col(c).cast("double") for c in [*cols, y]]).limit(limit + 1).collect(), float)
        if len(rows) > limit:
            raise ValueError("too many rows for an exact process, use approx_gp")
        self.cols, self.length = cols, length
        self.x, self.mean = rows[:, :-1], rows[:, -1].mean()
        k = self._kernel(self.x) + noise * np.eye(len(self.x))
        self.factor = np.linalg.cholesky(k)
        self.alpha = np.linalg.solve(self.factor.T, np.linalg.solve(self.factor, rows[:, -1] - self.mean))

    def _kernel(self, a: np.ndarray) -> np.ndarray:
        return np.exp(-0.5 * ((a[:, None, :] - self.x) ** 2).sum(axis=2) / self.length**2)

    def predict(self, df: DataFrame) -> DataFrame:
        def run(frames):
            for pdf in frames:
                k = self._kernel(pdf[self.cols].to_numpy(float))
                v = np.linalg.solve(self.factor, k.T)
                yield pdf.assign(Prediction=self.mean + k @ self.alpha, Variance=1 - (v * v).sum(axis=0))

        schema = df.withColumns({"Prediction": F.lit(0.0), "Variance": F.lit(0.0)}).schema
        return df.mapInPandas(run, schema)


def rules(rule_list: list[tuple[list[tuple], float, dict[str, float]]]) -> Column:
    """Sum of the linear models (intercept, coefficients) of all rules whose conditions hold."""
    parts = []
    for conditions, intercept, coef in rule_list:
        value = F.lit(float(intercept)) + sum((F.col(c).cast("double") * float(b) for c, b in coef.items()), F.lit(0.0))
        parts.append(F.when(filters.satisfied(conditions), value).otherwise(F.lit(0.0)))
    return sum(parts, F.lit(0.0))


def fit_rules(df: DataFrame, cols: list[str], y: str, depth: int = 2) -> list[tuple[list[tuple], float, dict[str, float]]]:
    """A model tree as rules: MLlib finds the splits, a linear model is fitted in every leaf."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    clean = df.na.drop(subset=[*cols, y]).withColumn("__y", F.col(y).cast("double"))
    tree = DecisionTreeRegressor(featuresCol="__x", labelCol="__y", maxDepth=depth, seed=1).fit(VectorAssembler(inputCols=cols, outputCol="__x").transform(clean))
    found: list[list[tuple]] = []

    def walk(node, path):
        if node.numDescendants() == 0:
            found.append(path)
            return
        split = node.split()
        col, at = cols[split.featureIndex()], split.threshold()
        walk(node.leftChild(), [*path, (col, "<=", at)])
        walk(node.rightChild(), [*path, (col, ">", at)])

    walk(tree._call_java("rootNode"), [])
    out = []
    for path in found:
        model = ols(clean.where(filters.satisfied(path)), cols, y)
        out.append((path, float(model.coef[0]), {c: float(b) for c, b in zip(cols, model.coef[1:], strict=True)}))
    return out


def nearest_regression(queries: DataFrame, train: DataFrame, q_cols: list[str], r_cols: list[str], y: str, query_id: str, train_id: str, k: int = 10, min_distance: float = 1e-3) -> DataFrame:
    """Mean of the k nearest targets with weights 1 / (distance + min_distance); a row's own id is no neighbour."""
    w = 1 / (F.col("distance") + min_distance)
    near = nearest(queries, train, q_cols, r_cols, k + 1, query_id, train_id).where(F.col(query_id) != F.col(train_id))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy("distance", train_id))).where(F.col("rank") <= k)
    return near.groupBy(query_id).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("prediction"))


def forest(df: DataFrame, cols: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 1):
    """MLlib forest; ``(model, predict)`` where predict adds the mean over trees and their population variance."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.na.drop(subset=[*cols, y]).withColumn("__y", F.col(y).cast("double"))
    model = RandomForestRegressor(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=cols, outputCol="__x").transform(rows))
    return model, lambda frame: predict_forest([model], cols, frame)


def predict_forest(forests: list, cols: list[str], frame: DataFrame) -> DataFrame:
    """``frame`` with the mean over the trees of all forests, their population variance and its interval; null where a column is null."""
    from pyspark.ml.feature import VectorAssembler

    from pixelframe.functions.scalars import normal_interval

    names = frame.columns
    frame = VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="keep").transform(frame)
    trees = [tree for model in forests for tree in model.trees]
    for i, tree in enumerate(trees):
        frame = tree.setFeaturesCol("__x").setPredictionCol(f"__t{i}").transform(frame)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    out = frame.withColumn("__t", F.when(whole, F.array(*[F.col(f"__t{i}") for i in range(len(trees))])))
    out = out.withColumn("Prediction", F.aggregate("__t", F.lit(0.0), lambda a, b: a + b) / len(trees))
    out = out.withColumn("Variance", F.aggregate("__t", F.lit(0.0), lambda a, b: a + (b - F.col("Prediction")) * (b - F.col("Prediction"))) / len(trees))
    low, high = normal_interval(F.col("Prediction"), F.col("Variance"), 0.95)
    return out.withColumns({"Lower quantile": low, "Upper quantile": high}).select(*names, "Prediction", "Variance", "Lower quantile", "Upper quantile")


def mllib(name: str, df: DataFrame, cols: list[str], y: str, **options):
    """A fitted MLlib pipeline by name: elasticnet, huber, gradientboost, decisiontree, logistic, forestclassifier, boostedtrees, svc."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression

    common = {"featuresCol": "features", "labelCol": y}
    made = {
        "elasticnet": lambda: LinearRegression(elasticNetParam=options.pop("elasticNetParam", 0.5), regParam=options.pop("regParam", 0.1), **common, **options),
        "huber": lambda: LinearRegression(loss="huber", **common, **options),
        "gradientboost": lambda: GBTRegressor(**common, **options),
        "decisiontree": lambda: DecisionTreeRegressor(**common, **options),
        "logistic": lambda: LogisticRegression(**common, **options),
        "forestclassifier": lambda: RandomForestClassifier(**common, **options),
        "boostedtrees": lambda: OneVsRest(classifier=GBTClassifier(**options), **common),
        "svc": lambda: OneVsRest(classifier=LinearSVC(**options), **common),
    }
    if name not in made:
        raise ValueError(f"unknown model {name!r}, one of {sorted(made)}")
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), made[name]()]).fit(df.na.drop(subset=[*cols, y]))


def variogram(points: DataFrame, x: str, y: str, z: str, lag: float, lags: int) -> DataFrame:
    """(bin, n, distance, gamma): half mean squared differences of pairs by lag; pairs meet through bins of the range.

    Rows of one place are summed up (number, sum and sum of squares) first, so pairs are formed of places and not of rows.
    """
    reach = lag * lags
    rows = points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).cast("double").alias("z"))
    v = F.col("z") - F.lit(float(rows.agg(F.avg("z")).first()[0] or 0.0))
    sums = [F.count("*").alias("n"), F.count("z").cast("double").alias("m"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q")]
    a = materialise(rows.where("x is not null and y is not null").groupBy("x", "y").agg(*sums), "places")
    b = a.select(*[F.col(c).alias(f"{c}2") for c in a.columns]).withColumns({"bx": F.floor(F.col("x2") / reach), "by": F.floor(F.col("y2") / reach)})
    near = F.array(*[F.struct((F.floor(F.col("x") / reach) + i).alias("bx"), (F.floor(F.col("y") / reach) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    pairs = a.withColumn("b", F.explode(near)).select(*a.columns, "b.bx", "b.by").join(b, ["bx", "by"]).where("x < x2 or (x = x2 and y <= y2)")
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y") - F.col("y2"), F.lit(2.0)))
    one = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))
    n = F.when(one, (F.col("n") * (F.col("n") - 1) / 2).cast("long")).otherwise(F.col("n") * F.col("n2"))
    valid = F.when(one, F.col("m") * (F.col("m") - 1) / 2).otherwise(F.col("m") * F.col("m2"))
    square = F.when(one, F.col("m") * F.col("q") - F.col("s") * F.col("s")).otherwise(F.col("m2") * F.col("q") + F.col("m") * F.col("q2") - 2 * F.col("s") * F.col("s2"))
    pairs = pairs.select(d.alias("d"), n.alias("n"), valid.alias("v"), square.alias("g")).where((F.col("d") < reach) & (F.col("n") > 0))
    mean = [F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("distance"), F.try_divide(F.sum("g"), 2 * F.sum("v")).alias("gamma")]
    return pairs.groupBy(F.floor(F.col("d") / lag).cast("long").alias("bin")).agg(*mean)


def nearest_value(queries: DataFrame, points: DataFrame, q_cols: list[str], r_cols: list[str], value: str, query_id: str, point_id: str) -> DataFrame:
    """Nearest-point interpolation."""
    return nearest(queries, points, q_cols, r_cols, 1, query_id, point_id).select(query_id, F.col(value).alias("prediction"))


def crossval_ols(df: DataFrame, cols: list[str], y: str, fold: str) -> DataFrame:
    """Out-of-fold predictions of linear models in one plan for one covariate: fold sums leave the fold's own out."""
    (x,) = cols
    clean = df.na.drop(subset=[x, y])
    v, t = F.col(x).cast("double"), F.col(y).cast("double")
    own = clean.groupBy(fold).agg(F.count("*").alias("n"), F.sum(v).alias("sx"), F.sum(t).alias("sy"), F.sum(v * v).alias("sxx"), F.sum(v * t).alias("sxy"))
    every = Window.partitionBy(F.lit(1))  # a row for each fold
    rest = own.select(fold, *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    model = rest.select(fold, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))
    return clean.join(F.broadcast(model), fold).withColumn("prediction", F.col("intercept") + F.col("slope") * v)


def linear_shap(df: DataFrame, model: Linear, background: DataFrame | None = None) -> DataFrame:
    """Exact SHAP values of a linear model: coefficient times distance from the background mean."""
    base = (background or df).agg(*[F.avg(c).alias(c) for c in model.cols]).first()
    return df.withColumns({f"shap_{c}": (F.col(c).cast("double") - base[c]) * float(b) for c, b in zip(model.cols, model.coef[1:], strict=True)})


def ensemble(members: list[Column], interval: float = 0.95) -> dict[str, Column]:
    """Mean, population variance and normal interval over the predictions of several models."""
    from pixelframe.functions.scalars import normal_interval

    k = len(members)
    mean = sum(members[1:], members[0]) / k
    var = sum(((m - mean) * (m - mean) for m in members), F.lit(0.0)) / k
    low, high = normal_interval(mean, var, interval)
    return {"Prediction": mean, "Variance": var, "Lower quantile": low, "Upper quantile": high}


def sampled_shap(df: DataFrame, cols: list[str], key: str, predict, background: DataFrame, permutations: int = 4, limit: int = 50, seed: int = 1) -> DataFrame:
    """Permutation SHAP values: features join a background row one by one in random orders.

    The background is at most ``limit`` rows; every (row, background row, order) is a path of
    predictions whose steps are averaged.
    """
    rows = background.select(*cols).limit(limit).collect()
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(len(cols)).tolist() for _ in range(permutations)]
    steps = []
    for base in rows:
        for order in orders:
            for n in range(len(cols) + 1):
                on = order[:n]
                mixed = [F.col(c).cast("double") if i in on else F.lit(float(base[c])) for i, c in enumerate(cols)]
                added = cols[order[n - 1]] if n else None
                removed = cols[order[n]] if n < len(cols) else None
                steps.append(F.struct(*[m.alias(c) for m, c in zip(mixed, cols, strict=True)], F.lit(added).cast("string").alias("added"), F.lit(removed).cast("string").alias("removed")))
    long = df.select(key, F.explode(F.array(*steps)).alias("s")).select(key, "s.*")
    scored = predict(long).select(key, "added", "removed", "Prediction")
    plus = scored.where("added is not null").select(key, F.col("added").alias("feature"), F.col("Prediction").alias("v"))
    minus = scored.where("removed is not null").select(key, F.col("removed").alias("feature"), (-F.col("Prediction")).alias("v"))
    return plus.union(minus).groupBy(key, "feature").agg((F.sum("v") / (len(rows) * permutations)).alias("shap"))


def permutation_importance(df: DataFrame, cols: list[str], y: str, predict, key: list[str], repeats: int = 10, seed: int = 1) -> DataFrame:
    """(feature, repeat, loss): rise of the mean squared error when a column is shuffled by a hash order."""
    from pixelframe.operators.sampling import chunks

    base = predict(df).agg(F.avg(F.pow(F.col(y) - F.col("Prediction"), F.lit(2.0)))).first()[0]
    n = df.count()
    rows = []
    for c in cols:
        for r in range(repeats):
            a = chunks(df, key, max(n, 1)).withColumnRenamed("chunk", "__i").drop(c)
            b = chunks(df.withColumn("__h", F.xxhash64(*key, F.lit(seed + r))).select("__h", *key, c), ["__h", *key], max(n, 1)).select(F.col("chunk").alias("__i"), c)
            mse = predict(a.join(b, "__i")).agg(F.avg(F.pow(F.col(y) - F.col("Prediction"), F.lit(2.0)))).first()[0]
            rows.append((c, r, float(mse - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, repeat int, loss double")


def mean_absolute_shap(attributions: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, importance): mean absolute value of the columns ``shap_<feature>``."""
    row = attributions.agg(*[F.avg(F.abs(F.col(f"shap_{c}"))).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in cols])).alias("r")).select("r.*")
