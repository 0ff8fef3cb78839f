"""File lists, feature sets and result sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_list(spark: SparkSession, path: str) -> list[str]:
    """File names of a list, first column only; blank lines and lines after # are skipped."""
    lines = spark.read.text(path).select(F.trim(F.split("value", ",")[0]).alias("f"))
    return [r["f"] for r in lines.where((F.col("f") != "") & ~F.col("f").startswith("#")).collect()]


def sorted_files(paths: list[str]) -> list[str]:
    """The order of the columns of a feature set: case-insensitive by path."""
    return sorted(paths, key=str.lower)


def feature_names(paths: list[str]) -> list[str]:
    return [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in sorted_files(paths)]


def targets(df: DataFrame, y: str, lon: str, lat: str, group: str | None = None, weight: str | None = None) -> DataFrame:
    """lon, lat, y, grp (1 without a group column) and w (1 without a weight column), ordered by latitude, then longitude."""
    grp = F.col(group) if group else F.lit(1)
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rest = [c for c in df.columns if c not in (lon, lat, y)]
    out = df.select(F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"), F.col(y).cast("double").alias("y"), grp.alias("grp"), w.alias("w"), *rest)
    return out.orderBy("lat", "lon")


def write_intersected(df: DataFrame, cols: list[str], path: str) -> None:
    """Covariates as CSV and a parallel table of 0/1 masks."""
    df.select(*cols).write.csv(f"{path}/values", header=True)
    df.select(*[F.col(c).isNull().cast("int").alias(c) for c in cols]).write.csv(f"{path}/mask", header=True)


def validation_table(df: DataFrame, y: str, p: str, extra: list[str]) -> DataFrame:
    """Observed and predicted values with their difference."""
    return df.select(F.col(y).alias("y_true"), F.col(p).alias("y_pred"), *extra, (F.col(y) - F.col(p)).alias("diff"))


def write_class_values(df: DataFrame, feature: str, cluster: str, value: str, path: str) -> None:
    """Valid values of each (feature, class) as CSV folders."""
    df.where(F.col(value).isNotNull()).select(feature, cluster, value).write.partitionBy(feature, cluster).csv(path, header=True)


def fill(value: Column, nodata: float = -1e20) -> Column:
    """The single-precision value that a raster holds."""
    return F.coalesce(value, F.lit(nodata)).cast("float")


def numbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def write_scores(scores: DataFrame, path: str) -> None:
    """One row of scores as a JSON line."""
    scores.coalesce(1).write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(measure, score) of written scores."""
    row = spark.read.json(path)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("score")) for c in row.columns])).alias("r")).select("r.*")


def write_split(df: DataFrame, keep: Column, path: str) -> None:
    """Rows that fulfil ``keep`` under ``kept``, all others (nulls included) under ``dropped``."""
    fine = F.coalesce(keep, F.lit(False))
    df.where(fine).write.mode("overwrite").parquet(f"{path}/kept")
    df.where(~fine).write.mode("overwrite").parquet(f"{path}/dropped")
