"""Clustering: k-means with k-means|| starts, cluster profiles, density groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.operators.sampling import running_total
from pixelframe.plans.materialise import materialise


def squared_distance(cols: list[str], centre: list[float]) -> Column:
    return sum((F.pow(F.col(c).cast("double") - float(v), F.lit(2.0)) for c, v in zip(cols, centre, strict=True)), F.lit(0.0))


def array_distance(vector: Column, centre: list[float]) -> Column:
    """Squared distance of an array column to a fixed centre."""
    pairs = F.zip_with(vector, F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def assign(df: DataFrame, distances: list[Column], label: Column | None = None) -> DataFrame:
    """class (lowest index on ties) and distance2 to it; a non-null label wins."""
    d = F.array(*distances)
    out = df.withColumn("__d", d).withColumn("class", (F.array_position("__d", F.array_min("__d")) - 1).cast("long")).withColumn("distance2", F.array_min("__d")).drop("__d")
    return out.withColumn("class", F.coalesce(label.cast("long"), F.col("class"))) if label is not None else out


def centroids(df: DataFrame, cols: list[str], by: str = "class", weight: str | None = None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return df.groupBy(by).agg(F.count("*").alias("n"), *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in cols])


def centre_distances(centres: DataFrame, cols: list[str], by: str = "class") -> DataFrame:
    """(a, b, distance) of all pairs of a few centres."""
    a = centres.select(F.col(by).alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = centres.select(F.col(by).alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    total = sum((F.pow(F.col(f"{c}_a") - F.col(f"{c}_b"), F.lit(2.0)) for c in cols), F.lit(0.0))
    return a.crossJoin(b).select("a", "b", F.sqrt(total).alias("distance"))


class KMeans:
    """k-means|| candidates, weighted Lloyd over them, then Lloyd over the rows.

    ``labelled`` rows (a nullable column) override their centres and are forced to them in the
    first assignment.  Only candidates (about l * ln(cost) rows) and centres reach the driver.
    """

    def __init__(self, k: int, oversample: float = 2.0, iterations: int = 50, seed: int = 1):
        self.k, self.l, self.iterations, self.seed = k, oversample * k, iterations, seed

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> KMeans:
        self.cols = cols
        rows = df.na.drop(subset=cols).select(*[F.col(c).cast("double").alias(c) for c in cols], *([label] if label else []))
        chance = F.pmod(F.xxhash64(*cols, F.lit(self.seed)), F.lit(1_000_003)) / 1_000_003.0
        first = rows.orderBy(chance, *cols).first()
        if first is None:
            raise ValueError("no complete rows")
        found = [[first[c] for c in cols]]
        cost = self._cost(rows, found)
        for r in range(max(1, round(math.log(cost))) if cost > 1 else 0):
            d = F.array_min(F.array(*[squared_distance(cols, c) for c in found])) if len(found) > 1 else squared_distance(cols, found[0])
            draw = F.pmod(F.xxhash64(*cols, F.lit(self.seed + 1 + r)), F.lit(1_000_003)) / 1_000_003.0
            new = rows.where(draw < self.l * d / max(cost, 1e-300)).select(*cols).distinct().orderBy(*cols).collect()  # about l places
            found += [list(x) for x in new]
            cost = self._cost(rows, found)
        weight = {x["class"]: x["count"] for x in assign(rows, [squared_distance(cols, c) for c in found]).groupBy("class").count().collect()} if len(found) > 1 else {0: 1}
        centres = self._weighted(np.array(found), np.array([weight.get(i, 0) for i in range(len(found))], float))
        if label:
            for x in rows.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(c).alias(c) for c in cols]).collect():
                centres[int(x[label])] = [x[c] for c in cols]
        last = None
        for i in range(self.iterations):
            got = assign(rows, [squared_distance(cols, c) for c in centres.tolist()], F.col(label) if label and i == 0 else None)
            new = centres.copy()
            seen = set()
            for x in centroids(got, cols).collect():
                new[int(x["class"])] = [x[c] for c in cols]
                seen.add(int(x["class"]))
            empty = sorted(set(range(self.k)) - seen)
            if empty:  # the places farthest from their centres, a different one for each
                far = got.select("distance2", *cols).distinct().orderBy(F.desc("distance2"), *cols).limit(len(empty)).collect()
                for j, x in zip(empty, far, strict=False):
                    new[j] = [x[c] for c in cols]
            if last is not None and np.array_equal(new, centres):
                break
            last, centres = centres, new
        self.centres = centres
        return self

    def _cost(self, rows: DataFrame, centres: list) -> float:
        d = [squared_distance(self.cols, c) for c in centres]
        return rows.agg(F.sum(F.array_min(F.array(*d)) if len(d) > 1 else d[0])).first()[0] or 0.0

    def _weighted(self, points: np.ndarray, weight: np.ndarray) -> np.ndarray:
        while len(points) < self.k:
            points, weight = np.vstack([points, points[:1]]), np.append(weight, 0.0)
        # Heaviest candidate first, then always the one of largest weighted distance to those taken.
        taken = [int(weight.argmax())]
        while len(taken) < self.k:
            far = ((points[:, None] - points[taken]) ** 2).sum(axis=2).min(axis=1) * (weight + 1e-9)
            taken.append(int(far.argmax()))
        centres = points[taken].astype(float)
        for _ in range(100):
            own = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([np.average(points[own == j], axis=0, weights=weight[own == j] + 1e-9) if (own == j).any() else centres[j] for j in range(self.k)])
            if np.allclose(new, centres):
                break
            centres = new
        return centres

    def predict(self, df: DataFrame) -> DataFrame:
        return assign(df, [squared_distance(self.cols, c) for c in self.centres.tolist()])


def profile(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Long form (by, covariate, n, mean, sd) of each covariate in each class."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(*by, F.inline(cells))
    return long.groupBy(*by, "covariate").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def merge_profiles(parts: DataFrame, by: list[str]) -> DataFrame:
    """Partition profiles to one: weighted means and pooled within-partition deviations (``sd_within``)."""
    n = F.sum("n")
    return parts.groupBy(*by, "covariate").agg(n.alias("n"), (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"), F.sqrt(F.sum(F.col("n") * F.col("sd") * F.col("sd")) / n).alias("sd_within"))


def boxplot(df: DataFrame, by: str, col: str, key: list[str], trim: float = 0.01) -> DataFrame:
    """Quartiles and 1.5 IQR whiskers of each class after cutting round(trim * n) rows from both tails."""
    full = df.where(F.col(col).isNotNull() & F.col(by).isNotNull()).select(by, F.col(col).cast("double").alias("__v"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)])
    ranked = running_total(full.withColumn("__one", F.lit(1)), [by, "__v", *[f"__k{i}" for i in range(len(key))]], "__one", "__r")
    ranked = materialise(ranked.select(by, "__v", "__r"), "ranked")
    sizes = ranked.groupBy(by).agg(F.count("*").alias("__n"), (F.min("__r") - 1).alias("__before")).withColumn("__cut", F.round(F.col("__n") * trim).cast("long"))
    rank = F.col("__r") - F.col("__before")
    kept = ranked.join(F.broadcast(sizes) if sizes.count() <= 50_000 else sizes, by).where((rank > F.col("__cut")) & (rank <= F.col("__n") - F.col("__cut")))

    def quantile(p: float) -> Column:
        """Between the two ranks around the place p of the rows that are kept."""
        place = (F.col("__n") - 2 * F.col("__cut") - 1) * F.lit(p)
        low = F.floor(place)
        share = F.first(place - low)
        at = lambda i: F.max(F.when(rank - F.col("__cut") - 1 == low + i, F.col("__v")))
        return at(0) + F.when(share > 0, share * (at(1) - at(0))).otherwise(0.0)

    q = kept.groupBy(by).agg(quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"), F.count("*").alias("n"))
    q = materialise(q, "quartiles")
    col = "__v"
    inside = kept.join(q, by).where((F.col(col) >= F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) & (F.col(col) <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))))
    return q.join(inside.groupBy(by).agg(F.min(col).alias("low"), F.max(col).alias("high")), by)


def _places(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(__x, __y, __n, __k): rows and smallest key of every place."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__n"), F.min(key).alias("__k"))


def _close(places: DataFrame, others: DataFrame, eps: float) -> DataFrame:
    """Pairs of ``places`` and ``others`` (with a 2 behind their names) within eps, through eps bins."""
    near = F.array(*[F.struct((F.floor(F.col("__x") / eps) + i).alias("bx"), (F.floor(F.col("__y") / eps) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = places.withColumn("__b", F.explode(near)).select(*places.columns, "__b.bx", "__b.by")
    b = others.withColumns({"bx": F.floor(F.col("__x") / eps), "by": F.floor(F.col("__y") / eps)})
    b = b.withColumnsRenamed({c: f"{c}2" for c in others.columns})
    square = F.pow(F.col("__x") - F.col("__x2"), F.lit(2.0)) + F.pow(F.col("__y") - F.col("__y2"), F.lit(2.0))
    return a.join(b, ["bx", "by"]).where(square <= eps * eps).drop("bx", "by")


def _counted(places: DataFrame, eps: float) -> DataFrame:
    """The places with their ``neighbours``; rows of one place share them, so pairs are formed of places and not of rows."""
    return _close(places, places.select("__x", "__y", "__n"), eps).groupBy("__x", "__y", "__n", "__k").agg(F.sum("__n2").alias("neighbours"))


def core_points(df: DataFrame, x: str, y: str, key: str, eps: float, min_samples: int = 10) -> DataFrame:
    """(key, neighbours, core): points within eps, itself included."""
    counted = _counted(materialise(_places(df, x, y, key), "places"), eps).select(F.col("__x").alias(x), F.col("__y").alias(y), "neighbours")
    return df.select(key, x, y).join(counted, [x, y]).select(key, "neighbours", (F.col("neighbours") >= min_samples).alias("core"))


def dbscan(df: DataFrame, x: str, y: str, key: str, eps: float, min_samples: int = 10) -> DataFrame:
    """(key, grp): density groups named by their smallest core key; border points join their smallest
    neighbouring group, and points without a core neighbour get -1.  Rows of one place are one node."""
    from pixelframe.operators.graph import components

    counted = _counted(materialise(_places(df, x, y, key), "places"), eps)
    places = materialise(counted.select("__x", "__y", F.col("__k").cast("long").alias("__k"), (F.col("neighbours") >= min_samples).alias("__core")), "places")
    hits = _close(places, places.where("__core").select("__x", "__y", "__k"), eps).select("__x", "__y", "__k", "__core", "__k2")
    groups = components(hits.where("__core").select(F.col("__k").alias("a"), F.col("__k2").alias("b")))
    named = hits.join(groups.select(F.col("node").alias("__k2"), "component"), "__k2").groupBy(F.col("__x").alias(x), F.col("__y").alias(y)).agg(F.min("component").alias("grp"))
    return df.select(key, x, y).join(named, [x, y], "left").select(key, F.coalesce("grp", F.lit(-1)).cast("long").alias("grp"))
