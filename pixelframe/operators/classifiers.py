"""Classifiers over any labels: encoded by frequency order of their text, with a probability for every class."""

from __future__ import annotations

import json
import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.models import random_features

#: Most classes; their list is kept by the model.
CLASSES = 1000


def encoded(label: str, classes: list[str]) -> Column:
    """The number of a label among the classes; null for others."""
    table = F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*[F.lit(float(i)) for i in range(len(classes))]))
    return F.try_element_at(table, F.col(label).cast("string"))


class Classifier:
    """A fitted classifier: ``predict`` adds Prediction (a label as text), ``class`` (its number) and ``p0``, ``p1``, ... (one for each class)."""

    def __init__(self, name: str, cols: list[str], classes: list[str], features: dict | None, model: PipelineModel):
        self.name, self.cols, self.classes, self.features, self.model = name, cols, classes, features, model

    def _inputs(self, df: DataFrame) -> DataFrame:
        return df.withColumns(random_features(self.cols, **self.features)) if self.features else df

    def predict(self, df: DataFrame) -> DataFrame:
        whole = F.lit(True)
        for c in self.cols:
            whole = whole & F.col(c).isNotNull()
        out = self.model.transform(self._inputs(df.where(whole)))
        if "probability" in out.columns:
            p = vector_to_array("probability")
        else:  # margins of one-versus-rest models: a logistic each, scaled to sum one
            each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-m)))
            p = F.transform(each, lambda v: F.try_divide(v, F.aggregate(each, F.lit(0.0), lambda a, b: a + b)))
        out = out.withColumn("__p", p)
        best = F.array_position("__p", F.array_max("__p")).cast("int") - 1
        probabilities = {f"p{i}": F.get("__p", F.lit(i)) for i in range(len(self.classes))}
        names = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumns({**probabilities, "class": best, "Prediction": F.get(names, best)}).select(*df.columns, "Prediction", "class", *probabilities)

    def save(self, df: DataFrame, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        state = json.dumps({"name": self.name, "cols": self.cols, "classes": self.classes, "features": self.features})
        df.sparkSession.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, df: DataFrame, path: str) -> Classifier:
        s = json.loads(df.sparkSession.read.text(f"{path}/state").first()["value"])
        return cls(s["name"], s["cols"], s["classes"], s["features"], PipelineModel.load(f"{path}/model"))


def fit(name: str, df: DataFrame, cols: list[str], label: str, weight: str | None = None, n_features: int = 50, gamma: float | None = None, seed: int = 1, **options) -> Classifier:
    """logistic, logisticrbf (over random features; gamma is one by the number of columns), forestclassifier, boostedtrees or svc; complete rows only."""
    makers = {
        "logistic": lambda: LogisticRegression(**options), "logisticrbf": lambda: LogisticRegression(**options), "forestclassifier": lambda: RandomForestClassifier(seed=seed, **options),
        "boostedtrees": lambda: OneVsRest(classifier=GBTClassifier(seed=seed, **options)), "svc": lambda: OneVsRest(classifier=LinearSVC(**options)),
    }
    if name not in makers:
        raise ValueError(f"unknown classifier {name!r}, one of {sorted(makers)}")
    rows = df.na.drop(subset=[*cols, label])
    found = rows.select(F.col(label).cast("string").alias("c")).distinct().limit(CLASSES + 1).collect()
    if len(found) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    classes = sorted(r["c"] for r in found)
    if not classes:
        raise ValueError("no labelled complete rows")
    features, inputs = None, cols
    if name == "logisticrbf":
        features = {"n": n_features, "length": 1 / math.sqrt(2 * (gamma or 1 / len(cols))), "seed": seed}
        inputs = list(random_features(cols, **features))
    rows = rows.withColumn("__label", encoded(label, classes))
    rows = rows.withColumns(random_features(cols, **features)) if features else rows
    assemble = VectorAssembler(inputCols=inputs, outputCol="__features")
    made = makers[name]().setFeaturesCol("__features").setLabelCol("__label")
    made = made.setWeightCol(weight) if weight else made
    model = made.fit(assemble.transform(rows))
    return Classifier(name, cols, classes, features, PipelineModel(stages=[assemble, model]))
