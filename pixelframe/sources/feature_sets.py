"""Feature sets: named groups of images, given by path, folder, pattern or list file, read as one table of covariates.

All images of a set are unioned as (pixel, name, value) and brought into columns by one grouping on the pixel, so the number
of images adds no join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.grid import Grid
from pixelframe.sources import files, gtiff


@dataclass(frozen=True)
class FeatureSet:
    name: str
    kind: str  # ordinal or categorical
    files: tuple[str, ...]

    def features(self) -> list[str]:
        return files.feature_names(list(self.files))


def _found(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Files of a folder by a glob pattern, listed by Spark's own reader; their contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    return [r["path"] for r in listed.collect()]


def expand(spark: SparkSession, spec: dict) -> FeatureSet:
    """A set from its configuration: name, type and files, a list of {path}, {directory} (all *.tif), {glob} (folder/pattern) or {list} (a list file).

    Unknown types and kinds of files are errors, as is a set without a file.  Files are ordered without regard to case; repeated ones count once.
    """
    if spec["type"] not in ("ordinal", "categorical"):
        raise ValueError(f"type {spec['type']!r} of {spec['name']} is neither ordinal nor categorical")
    found: list[str] = []
    for source in spec["files"]:
        ((kind, where),) = source.items()
        if kind == "path":
            found.append(where)
        elif kind == "directory":
            found += _found(spark, where, "*.tif")
        elif kind == "glob":
            folder, _, pattern = where.rpartition("/")
            found += _found(spark, folder, pattern)
        elif kind == "list":
            found += files.read_list(spark, where)
        else:
            raise ValueError(f"files of {spec['name']} are given by path, directory, glob or list, not by {kind!r}")
    found = files.sorted_files(list(dict.fromkeys(found)))
    if not found:
        raise ValueError(f"{spec['name']} has no file")
    names = files.feature_names(found)
    if len(set(names)) < len(names):
        raise ValueError(f"{spec['name']} has files of one name in several folders")
    return FeatureSet(spec["name"], spec["type"], tuple(found))


def resolutions(sets: list[FeatureSet]) -> dict[str, tuple[int, int, int]]:
    """(columns, rows, bands) of every image by its path; only headers are read."""
    out = {}
    for s in sets:
        for path in s.files:
            h = gtiff.read_header(path)
            out[path] = (h.grid.width, h.grid.height, h.bands)
    return out


def covariates(spark: SparkSession, sets: list[FeatureSet]) -> tuple[DataFrame, Grid, list[str]]:
    """(pixels, grid, columns): a row (px, py, feature columns) for every cell; bands beyond the first get their number behind the name.

    All images have one grid; others are an error (resample or cut them first).
    """
    long, grid, columns = None, None, []
    for s in sets:
        for path, name in zip(s.files, s.features(), strict=True):
            h = gtiff.read_header(path)
            if grid is not None and h.grid != grid:
                raise ValueError(f"{path} has another grid than the images before it")
            grid = h.grid
            columns += [name if b == 0 else f"{name}_{b}" for b in range(h.bands)]
            one = gtiff.read_raster(spark, path).select("px", "py", F.when(F.col("band") == 0, F.lit(name)).otherwise(F.concat(F.lit(f"{name}_"), F.col("band"))).alias("name"), "value")
            long = one if long is None else long.unionByName(one)
    if len(set(columns)) < len(columns):
        raise ValueError("two features have one name")
    wide = long.groupBy("px", "py").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])
    return wide, grid, columns


def missing(pixels: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, pixels, missing): valid pixels and the percentage that is missing of each column, from one pass."""
    row = pixels.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("pixels"), (100.0 * (1 - F.try_divide(F.col(f"`{c}`"), F.col("__n")))).alias("missing")) for c in columns])
    return row.select(F.explode(each).alias("r")).select("r.*")
