"""Ordering, chunking, sampling and folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pixelframe.plans.materialise import materialise


def chunks(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """Contiguous chunks 0..k-1 in the order of columns, the first n mod k one row longer.

    Rows are numbered within range partitions whose sizes are added up, so no task sees all rows.
    """
    numbered = running_total(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__i").drop("__one")
    total = numbered.agg(F.max("__i")).first()[0]
    if not total:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    i = F.col("__i") - 1
    q, r = divmod(total, k)
    chunk = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / max(q, 1)))
    return numbered.withColumn("chunk", chunk.cast("long")).drop("__i")


def linear_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    low, high = df.agg(F.min(col), F.max(col)).first()
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def percentile_edges(df: DataFrame, col: str, bins: int) -> list[float]:
    """Linearly interpolated quantiles; edges may repeat."""
    return df.agg(F.percentile(col, F.array(*[F.lit(i / bins) for i in range(bins + 1)]))).first()[0]


def value_bin(col: str, edges: list[float]):
    """Bins (a, b] with the lowest value in the first; 0-based."""
    x = F.col(col)
    out = F.lit(None).cast("long")
    for i in range(len(edges) - 2, -1, -1):
        low = x >= edges[i] if i == 0 else x > edges[i]
        out = F.when(low & (x <= edges[i + 1]), F.lit(i).cast("long")).otherwise(out)
    return out


def resample_values(df: DataFrame, col: str, bins: int, total: int, key: list[str], interval: str = "linear", undersample: bool = False, bootstrap: bool = True, seed: int = 1) -> DataFrame:
    """``total // bins`` rows of each value bin: small bins are repeated, large ones cut only if ``undersample``.

    An unknown interval name is an error.
    """
    edges = {"percentile": percentile_edges, "linear": linear_edges}[interval](df, col, bins)
    return resample_groups(df.withColumn("bin", value_bin(col, edges)).where("bin is not null"), "bin", total // bins, key, undersample, bootstrap, seed)


def resample_groups(df: DataFrame, group: str, quota: int, key: list[str], undersample: bool, bootstrap: bool, seed: int) -> DataFrame:
    """Groups brought to ``quota`` rows each.

    With ``bootstrap`` a group below the quota (``undersample``: every group) is drawn from with replacement; without it groups above
    the quota are cut to their first rows in hash order if ``undersample``.  Other groups stay as they are.
    """
    n = df.groupBy(group).agg(F.count("*").alias("__n"))
    rows = df.join(n, group)
    few = F.col("__n") < quota
    if bootstrap:
        chosen = rows if undersample else rows.where(few)
        drawn = bootstrap_draws(chosen.drop("__n"), group, key, quota, seed).drop("draw").select(df.columns)
        return drawn if undersample else rows.where(~few).select(df.columns).unionByName(drawn)
    if not undersample:
        return df
    # A group is sampled at a rate first, so that it is cut before it is ordered; its rows are numbered by ranges.
    h = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1_000_000_007))
    many = rows.where(~few).withColumn("__h", h).where(F.col("__h") <= F.lit(1_000_000_007.0) * F.least(F.lit(1.0), F.lit(2.0 * quota + 100) / F.col("__n")))
    many = running_total(many.withColumn("__one", F.lit(1).cast("long")), [group, "__h", *key], "__one", "__r")
    first = many.groupBy(group).agg(F.min("__r").alias("__f"))
    kept = many.join(first, group).where(F.col("__r") - F.col("__f") < quota)
    return rows.where(few).select(df.columns).unionByName(kept.select(df.columns))


def resample_spatially(df: DataFrame, x: str, y: str, rows: int, cols: int, key: list[str], total: int | None = None, undersample: bool = False, bootstrap: bool = True, seed: int = 1) -> DataFrame:
    """``resample_groups`` by the cells of a ``rows`` by ``cols`` grid over the bounding box; ``total`` rows (those of ``df`` if None) over all cells.

    Points on edges lie in no cell and go, as do cells without a point.
    """
    from pixelframe.operators.joins import within_cells

    x0, y0, x1, y1, n = df.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count("*")).first()
    if not n:
        return df
    cells = within_cells(df, x, y, (x0, y0, x1, y1), cols, rows).where("cell IS NOT NULL")
    return resample_groups(cells, "cell", (n if total is None else total) // (rows * cols), key, undersample, bootstrap, seed).drop("cell")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each in ``order`` (rows that it does not tell apart come in any order).

    Rows are dealt by ranges of the order and summed up where they lie; only the sums of the ranges meet.
    """
    whole = df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "long" if whole else "double"
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__running_value", F.col(value).cast(kind))

    def run(batches):
        so_far = 0
        for b in batches:
            v = b.column(b.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
            sums = so_far + np.cumsum(v)
            so_far = sums[-1] if len(sums) else so_far
            yield b.set_column(b.num_columns - 1, name, pa.array(sums))

    schema = StructType([*df.schema.fields, StructField(name, LongType() if whole else DoubleType())])
    parts = materialise(sorted_.mapInArrow(run, schema).withColumn("__p", F.spark_partition_id()), "ranges")
    # One row for each range.
    before = parts.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = before.withColumn("__s", F.coalesce(F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(kind))
    return parts.join(F.broadcast(before), "__p").withColumn(name, F.col(name) + F.col("__s")).drop("__p", "__s")


def group_codes(df: DataFrame, col: str) -> DataFrame:
    """Dense codes 0..k-1 of the sorted distinct values (a table of levels is joined, rows are not ordered)."""
    codes = df.where(F.col(col).isNotNull()).select(col).distinct()
    codes = running_total(codes.withColumn("__one", F.lit(1)), [col], "__one", "code").select(col, (F.col("code") - 1).cast("long").alias("code"))
    return df.join(codes, col, "left")


def k_folds(df: DataFrame, key: list[str], k: int, seed: int = 1) -> DataFrame:
    """Folds of nearly equal size in the order of a hash of the key."""
    return chunks(df.withColumn("__h", F.xxhash64(*key, F.lit(seed))), ["__h", *key], k).withColumnRenamed("chunk", "fold").drop("__h")


def bootstrap_draws(df: DataFrame, group: str, key: list[str], quota: int, seed: int = 1) -> DataFrame:
    """``quota`` draws with replacement from the rows of each group, as column ``draw`` beside the drawn rows.

    A draw is a row number by a hash; numbers come from range partitions and an equi-join, so a group of any size is spread.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("__n"))
    ranked = running_total(df.where(F.col(group).isNotNull()).withColumn("__one", F.lit(1)), [group, *key], "__one", "__r")
    first = ranked.groupBy(group).agg(F.min("__r").alias("__f"))
    ranked = ranked.join(first, group).withColumn("__r", F.col("__r") - F.col("__f")).drop("__one", "__f")
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(quota - 1))))
    draws = draws.select(group, "draw", F.pmod(F.xxhash64(group, "draw", F.lit(seed)), F.col("__n")).alias("__r"))
    return draws.join(ranked, [group, "__r"]).drop("__r")


def smote(df: DataFrame, cols: list[str], minority: DataFrame, key: str, k: int, times: int, seed: int = 1) -> DataFrame:
    """``times`` synthetic rows for each row of ``minority``: points between it and one of its ``k`` nearest minority rows.

    Columns ``key`` (of the origin), ``draw`` and ``cols``.
    """
    from pixelframe.operators.joins import nearest

    rest = minority.na.drop(subset=cols)
    near = nearest(rest.select(F.col(key).alias("__q"), *cols), rest.select(F.col(key).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in cols]), cols, [f"r_{c}" for c in cols], k + 1, "__q", "__r")
    near = near.where("__q <> __r").withColumn("rank", F.row_number().over(Window.partitionBy("__q").orderBy("distance", "__r"))).where(F.col("rank") <= k)
    each = near.groupBy("__q").agg(F.array_sort(F.collect_list(F.struct("rank", *cols, *[f"r_{c}" for c in cols]))).alias("n"))
    each = each.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    pick = F.col("n")[F.pmod(F.xxhash64("__q", "draw", F.lit(seed)), F.size("n")).cast("int")]
    gap = F.pmod(F.xxhash64("__q", "draw", F.lit(seed + 1)), F.lit(1_000_003)) / 1_000_003.0
    return each.select(F.col("__q").alias(key), "draw", *[(pick[c] + gap * (pick[f"r_{c}"] - pick[c])).alias(c) for c in cols])


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Groups by falling size to the lightest fold; group sizes are the only rows on the driver."""
    sizes = df.groupBy(group).count().orderBy(F.desc("count"), group).collect()
    load, fold = [0] * k, {}
    for r in sizes:
        i = load.index(min(load))
        load[i] += r["count"]
        fold[r[group]] = i
    table = df.sparkSession.createDataFrame(list(fold.items()), df.select(group, F.lit(0).alias("fold")).schema)
    return df.join(table, group)


def random_rows(df: DataFrame, key: list[str], n: int, seed: int = 1) -> DataFrame:
    """n rows in hash order; fewer rows than n is an error."""
    if df.count() < n:
        raise ValueError("more rows asked for than there are")
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def split_groups(df: DataFrame, group: str, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(training, held out) by whole groups: about ``share`` of the groups are held out."""
    held = F.pmod(F.xxhash64(F.col(group).cast("string"), F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003
    return df.where(~held), df.where(held)


def feature_ranks(scores: DataFrame, lower_is_better: tuple[str, ...] = ("mll", "msll", "smse", "log_loss")) -> DataFrame:
    """rank of each (measure, feature, score): ascending score, reversed for the measures where low is good."""
    sign = F.when(F.col("measure").isin(*lower_is_better), -F.col("score")).otherwise(F.col("score"))
    w = Window.partitionBy("measure").orderBy(sign, "feature")
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def sample_pixels(pixels: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Bernoulli sample by pixel: the same pixels of every raster, all of them from a share of one on."""
    draw = F.pmod(F.xxhash64("px", "py", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    return pixels if share >= 1 else pixels.where(draw < share)


def semi_supervised(targets: DataFrame, pixels: DataFrame, share: float, label: str, seed: int = 1) -> DataFrame:
    """Labelled target rows and a sample of pixels with a null label."""
    return targets.unionByName(sample_pixels(pixels, share, seed), allowMissingColumns=True) if label in targets.columns else sample_pixels(pixels, share, seed)
