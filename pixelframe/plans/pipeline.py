"""A learning or prediction pipeline from a configuration: one lazy plan from points and pixels to scores.

The configuration is a mapping (from YAML or JSON):

    features: [q, d]            # columns of the pixel table, or of the points if intersected
    target: y
    position: [lon, lat]
    grid: {x0: 0, y0: 0, dx: 1, dy: 1, width: 10, height: 10}
    transforms: [mean, standardise]
    model: {name: ols}          # ols, bayesreg, ardregression, approxgp or an MLlib name
    folds: 5
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.grid import Grid
from pixelframe.operators import classifiers, filters, joins, kriging, learners, metrics, models, rules, sampling, transforms

from pixelframe.plans.materialise import materialise


@dataclass
class Config:
    features: list[str]
    target: str
    position: list[str]
    grid: Grid
    transforms: list[str] = field(default_factory=lambda: ["mean", "standardise"])
    model: dict = field(default_factory=lambda: {"name": "ols"})
    folds: int = 5
    key: list[str] = field(default_factory=list)
    seed: int = 1

    @classmethod
    def parse(cls, raw: dict) -> Config:
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown configuration keys {sorted(unknown)}")
        return cls(**{**raw, "grid": Grid(**raw["grid"])})

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.parse(yaml.safe_load(f))


class Model:
    """A fitted model by name: called on a frame it adds Prediction (and Variance where it has one).

    ``state`` is plain JSON; ``stages`` are MLlib models and ``frames`` tables that belong to it.  Those are all that ``save`` writes.
    """

    def __init__(self, name: str, state: dict, stages: list | None = None, frames: dict[str, DataFrame] | None = None, base: Model | None = None):
        self.name, self.state, self.stages, self.frames, self.base = name, state, stages or [], frames or {}, base

    def __call__(self, df: DataFrame) -> DataFrame:
        s = self.state
        if "linear" in s:
            f = s.get("features")
            df = df.withColumns(models.random_features(f["cols"], f["n"], f["length"], f["kernel"], f["seed"])) if f else df
            return models.Linear.of_state(s["linear"]).predict(df)
        if "committee" in s:
            return rules.Committee.of_state(s["committee"]).predict(df)
        if "machine" in s:
            return learners.Machine.of_state(s["machine"]).predict(df)
        if "forest" in s:
            return models.predict_forest(self.stages, s["forest"]["cols"], df)
        if "krige" in s:
            k = s["krige"]
            return kriging.krige(self.frames["points"], df, *k["cols"], "__z", kriging.Variogram(k["model"], tuple(k["parameters"])), **k["options"])
        if "mlkrige" in s:
            k = s["mlkrige"]
            return kriging.with_residuals(self.base(df), self.frames["residuals"], k["x"], k["y"], **k["options"])
        return self.stages[0].transform(df).withColumnRenamed("prediction", "Prediction").drop("features")

    def save(self, df: DataFrame, path: str) -> None:
        """Write the model below ``path``, which must hold none (``df`` gives the session)."""
        for i, stage in enumerate(self.stages):
            stage.write().save(f"{path}/stage{i}")
        for name, frame in self.frames.items():
            frame.write.parquet(f"{path}/{name}")
        if self.base is not None:
            self.base.save(df, f"{path}/base")
        text = json.dumps({"name": self.name, "state": self.state, "stages": [type(s).__name__ for s in self.stages], "frames": sorted(self.frames), "base": self.base is not None})
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        from pyspark.ml import PipelineModel
        from pyspark.ml.regression import RandomForestRegressionModel

        kinds = {c.__name__: c for c in (PipelineModel, RandomForestRegressionModel)}
        saved = json.loads(spark.read.text(f"{path}/state").first()["value"])
        stages = [kinds[k].load(f"{path}/stage{i}") for i, k in enumerate(saved["stages"])]
        frames = {name: spark.read.parquet(f"{path}/{name}") for name in saved["frames"]}
        return cls(saved["name"], saved["state"], stages, frames, cls.load(spark, f"{path}/base") if saved["base"] else None)


@dataclass
class Bundle:
    """A fitted pipeline: frozen transforms and a model."""

    config: Config
    fitted: list
    cols: list[str]
    model: Model

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with predictions where all features have values, null elsewhere."""
        clean = df.withColumns({c: filters.clean_float(F.col(c).cast("double")) for c in self.config.features})
        return self.model(transforms.apply_chain(clean, self.fitted))

    def save(self, df: DataFrame, path: str) -> None:
        """Write configuration, transforms and model below ``path`` (``df`` gives the session)."""
        text = json.dumps({"config": asdict(self.config), "transforms": [t.saved() for t in self.fitted], "cols": self.cols})
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/bundle")
        self.model.save(df, f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        saved = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
        return cls(Config.parse(saved["config"]), transforms.load_chain(saved["transforms"]), saved["cols"], Model.load(spark, f"{path}/model"))


def fit_model(df: DataFrame, cols: list[str], y: str, spec: dict) -> Model:
    """The model of a specification (its name and options) on complete rows."""
    options = {k: v for k, v in spec.items() if k != "name"}
    name = spec["name"]
    closed = {"ols": models.ols, "bayesreg": models.bayes_linear, "ardregression": models.ard, "sgdbayesreg": learners.sgd_bayes}
    if name in closed:
        return Model(name, {"linear": closed[name](df, cols, y, **options).to_state()})
    if name in ("approxgp", "sgdapproxgp"):
        make = models.approx_gp if name == "approxgp" else learners.sgd_approx_gp
        features = {"cols": cols, "n": options.get("n_features", 20), "length": options.get("length", 1.0), "kernel": options.get("kernel", "rbf"), "seed": options.get("seed", 0)}
        return Model(name, {"features": features, "linear": make(df, cols, y, **options)[1].to_state()})
    if name == "svr":
        return Model(name, {"machine": learners.svr(df, cols, y, **options).state()})
    if name in ("cubist", "multicubist"):
        return Model(name, {"committee": (rules.fit if name == "cubist" else rules.fit_many)(df, cols, y, **options).state()})
    if name == "randomforest":
        return Model(name, {"forest": {"cols": cols}}, [models.forest(df, cols, y, **options)[0]])
    if name == "multirandomforest":
        forests, seed = options.pop("forests", 10), options.pop("seed", 1)
        return Model(name, {"forest": {"cols": cols}}, [models.forest(df, cols, y, seed=seed + i, **options)[0] for i in range(forests)])
    if name == "krige":
        points = materialise(df.select(*cols, F.col(y).alias("__z")), "points")
        distance, gamma, _ = kriging.experimental(points, *cols, "__z", options.pop("lags", 6))
        v = kriging.fit_variogram(distance, gamma, options.pop("variogram", "linear"), options.pop("weight", False))
        return Model(name, {"krige": {"cols": cols, "model": v.model, "parameters": list(v.parameters), "options": options}}, frames={"points": points})
    if name == "mlkrige":
        base, at = options.pop("base", {"name": "randomforest"}), [options.pop("x"), options.pop("y")]
        held = kriging.residuals(df, lambda rows: fit_model(rows, cols, y, base), *at, y, options.pop("key", at), options.pop("folds", 5))
        return Model(name, {"mlkrige": {"x": at[0], "y": at[1], "options": options}}, frames={"residuals": held}, base=fit_model(df, cols, y, base))
    return Model(name, {}, [models.mllib(name, df, cols, y, **options)])


def learn(points: DataFrame, pixels: DataFrame | None, config: Config) -> Bundle:
    """Join points to pixels (unless intersected already), drop rows without any feature, fit transforms and model."""
    x = joins.intersect(points, pixels, config.grid, *config.position) if pixels is not None else points
    x = filters.cull_all_null(x, config.features)
    fitted = transforms.chain(x, config.features, config.transforms)
    x = transforms.apply_chain(x, fitted)
    cols = fitted[-1].names if fitted else config.features
    return Bundle(config, fitted, cols, fit_model(filters.complete(x, cols), cols, config.target, config.model))


def _folds(points: DataFrame, config: Config, group: str | None) -> DataFrame:
    """Fold numbers, of whole groups where a group column is named; written, so every model sees the same ones."""
    folded = sampling.group_folds(points, group, config.folds) if group else sampling.k_folds(points, config.key, config.folds, config.seed)
    return materialise(folded, "folds")


def out_of_fold(points: DataFrame, pixels: DataFrame | None, config: Config, group: str | None = None) -> DataFrame:
    """The points with the Prediction of the model that has not seen their fold."""
    folded, out = _folds(points, config, group), None
    for k in range(config.folds):
        bundle = learn(folded.where(F.col("fold") != k), pixels, config)
        held = folded.where(F.col("fold") == k)
        held = joins.intersect(held, pixels, config.grid, *config.position) if pixels is not None else held
        keep = [*points.columns, "fold", "Prediction"]
        part = bundle.predict(held)
        part = part.select(*[c for c in keep if c in part.columns], *[c for c in ("Variance",) if c in part.columns])
        out = part if out is None else out.unionByName(part)
    return materialise(out, "out-of-fold")


def cross_validate(points: DataFrame, pixels: DataFrame | None, config: Config, group: str | None = None, weight: str | None = None) -> DataFrame:
    """Scores of each fold; the caller averages them without weights.

    ``group`` keeps its rows in one fold, ``weight`` counts rows in the scores.
    """
    found = out_of_fold(points, pixels, config, group)
    var = F.col("Variance") if "Variance" in found.columns else None
    return metrics.regression(found, config.target, "Prediction", F.col(weight) if weight else None, var, by=["fold"])


def cross_validate_classes(points: DataFrame, cols: list[str], label: str, name: str, key: list[str], folds: int = 5, group: str | None = None, weight: str | None = None, seed: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """(scores, predictions) of a classifier: accuracy, log loss, mean one-versus-rest AUC and rows of each fold.

    Classes are those of all points; one that a fold's model has not seen has probability zero there.
    """
    config = Config(cols, label, [], Grid(0, 0, 1, 1, 1, 1), folds=folds, key=key, seed=seed)
    used = dict.fromkeys([*key, *cols, label, *[c for c in (group, weight) if c]])  # no other column is written
    folded, out = _folds(points.select(*used), config, group), None
    classes = sorted(r[0] for r in folded.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(classifiers.CLASSES + 1).collect())
    for k in range(folds):
        model = classifiers.fit(name, folded.where(F.col("fold") != k), cols, label, weight, **options)
        part = model.predict(folded.where(F.col("fold") == k))
        own = {c: f"p{i}" for i, c in enumerate(model.classes)}
        probabilities = [(F.col(own[c]) if c in own else F.lit(0.0)).alias(f"q{i}") for i, c in enumerate(classes)]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        part = part.select(*key, "fold", F.col(label).cast("string").alias("truth"), "Prediction", w.alias("w"), classifiers.encoded(label, classes).cast("int").alias("y"), *probabilities)
        out = part if out is None else out.unionByName(part)
    out = materialise(out, "classes")
    own = F.get(F.array(*[F.col(f"q{i}") for i in range(len(classes))]), F.col("y"))
    loss = -F.ln(F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), own)))
    hit = (F.col("truth") == F.col("Prediction")).cast("double")
    scores = out.groupBy("fold").agg((F.sum(hit * F.col("w")) / F.sum("w")).alias("accuracy"), (F.sum(loss * F.col("w")) / F.sum("w")).alias("log_loss"), F.count("*").alias("n"))
    area = metrics.macro_auc(out, "y", [f"q{i}" for i in range(len(classes))], by=["fold"])
    return scores.join(area, "fold"), out


def export_cross_validation(scores: DataFrame, predictions: DataFrame, path: str) -> None:
    """Scores as JSON lines and predictions as Parquet below ``path``."""
    scores.coalesce(1).write.json(f"{path}/scores")
    predictions.write.parquet(f"{path}/predictions")


def validate(bundle: Bundle, points: DataFrame, pixels: DataFrame | None, path: str | None = None) -> DataFrame:
    """Scores of a learned pipeline on points it has not seen; with ``path`` the table of truth and prediction and the scores are written."""
    config = bundle.config
    held = joins.intersect(points, pixels, config.grid, *config.position) if pixels is not None else points
    found = materialise(bundle.predict(held), "validation")
    scores = metrics.regression(found, config.target, "Prediction", var=F.col("Variance") if "Variance" in found.columns else None)
    if path:
        keep = [c for c in [*config.key, *config.position, config.target, "Prediction", "Variance"] if c in found.columns]
        found.select(*keep).write.option("header", True).csv(f"{path}/points")
        scores.coalesce(1).write.json(f"{path}/scores")
    return scores


def predict_pixels(bundle: Bundle, pixels: DataFrame, mask: DataFrame | None = None, retain=1) -> DataFrame:
    """Predictions for all pixels; with a mask raster only where it has the retained value, null elsewhere."""
    if mask is not None:
        pixels = pixels.join(mask.select("px", "py", F.col("value").alias("__mask")), ["px", "py"], "left")
        pixels = filters.mask_retain(pixels, bundle.config.features, F.col("__mask"), retain).drop("__mask")
        out = bundle.predict(pixels.where(F.coalesce(*bundle.config.features).isNotNull()))
        return pixels.select("px", "py").join(out, ["px", "py"], "left")
    return bundle.predict(pixels)


def stack(base: list[DataFrame], on: list[str], y: str, spec: dict):
    """Out-of-fold predictions of base learners joined on a key, and a meta learner fitted to them."""
    joined = base[0].withColumnRenamed("Prediction", "p0")
    for i, df in enumerate(base[1:], 1):
        joined = joined.join(df.select(*on, F.col("Prediction").alias(f"p{i}")), on)
    cols = [f"p{i}" for i in range(len(base))]
    return joined, fit_model(filters.complete(joined, cols), cols, y, spec)


def search(points: DataFrame, pixels: DataFrame | None, config: Config, grid: list[dict]) -> DataFrame:
    """Cross-validated r2 of each model specification, best first."""
    rows = []
    for i, spec in enumerate(grid):
        config_i = Config(**{**config.__dict__, "model": {**config.model, **spec}})
        score = cross_validate(points, pixels, config_i).agg(F.avg("r2")).first()[0]
        rows.append((i, str(spec), float(score)))
    return points.sparkSession.createDataFrame(rows, "trial int, spec string, score double").orderBy(F.desc("score"))
