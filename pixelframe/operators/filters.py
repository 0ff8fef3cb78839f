"""Row filters and masking expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest finite single-precision number.
FLOAT32_MAX = 3.4028234663852886e38


def cull_all_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a value in at least one column."""
    return df.where(F.coalesce(*[F.col(c) for c in cols]).isNotNull())


def complete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop("any", subset=cols)


def apply_complete(df: DataFrame, id_cols: list[str], cols: list[str], func) -> DataFrame:
    """Apply ``func`` (frame to frame with the ids, which tell rows apart) to complete rows; other rows get nulls."""
    return df.select(*id_cols).join(func(complete(df, cols)), id_cols, "left")


def mask_retain(df: DataFrame, cols: list[str], mask: Column, retain) -> DataFrame:
    """Null all ``cols`` where the mask differs from ``retain``."""
    return df.withColumns({c: F.when(mask == retain, F.col(c)) for c in cols})


def clean_float(x: Column) -> Column:
    """NaN and values beyond single precision become null."""
    return F.when(~F.isnan(x) & (F.abs(x) <= FLOAT32_MAX), x)


def valid_points(df: DataFrame, cols: list[str], large: float = 1e10) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns are all finite and small, the rest)."""
    fine = F.coalesce(reduce(and_, [~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < large) for c in cols]), F.lit(False))
    return df.where(fine), df.where(~fine)


def every_nth_between(df: DataFrame, order: list[str], by: list[str], n: int, value: Column, low: float, high: float) -> DataFrame:
    """Every n-th row of each line, then the open interval (low, high)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where((F.col("__n") % n == 1 % n) & (value > low) & (value < high)).drop("__n")


def in_open_box(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return (x > x0) & (x < x1) & (y > y0) & (y < y1)


def clip_to(df: DataFrame, points: DataFrame, x: str, y: str, margin: float = 0.01) -> DataFrame:
    """Rows in the bounding box of ``points`` grown by a share of each coordinate's size."""
    b = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if b[0] is None:
        return df.where(F.lit(False))
    x0, x1, y0, y1 = (v + s * abs(v) * margin for v, s in zip(b, (-1, 1, -1, 1), strict=True))
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def stretch(df: DataFrame, col: str, low: float = 0.05, high: float = 0.95) -> Column:
    """Linear stretch of a percentile range to 0..255; null becomes 0."""
    a, b = df.agg(F.percentile(col, F.array(F.lit(low), F.lit(high)))).first()[0]
    x = F.col(col).cast("double")
    return F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - a) * 255.0)), F.lit(1.0)) if b == a else F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - a) / (b - a) * 255.0)), F.lit(0.0))


def uncertainty(pred: Column, var: Column) -> tuple[Column, Column]:
    """(standard deviation, standard deviation over prediction; zero where not finite)."""
    sd = F.sqrt(var)
    return sd, div0(sd, pred)


def div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where that has no value."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def identifier(label: Column) -> Column:
    """Letters, digits and underscores only; a leading digit gets an underscore."""
    clean = F.regexp_replace(label, r"[^0-9a-zA-Z_]", "")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def short_names(df: DataFrame, name: str, order: str, size: int = 8) -> DataFrame:
    """A prefix of ``name`` with a running number: names of limited length."""
    prefix = F.substring(name, 1, size)
    return df.withColumn("short", F.concat(prefix, F.row_number().over(Window.partitionBy(prefix).orderBy(order)).cast("string")))


def satisfied(conditions: list[tuple]) -> Column:
    """Conjunction of (column, operator, value); ``in`` means close to any of the values."""
    ops = {"<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__, "=": Column.__eq__}
    parts = []
    for col, op, value in conditions:
        x = F.col(col).cast("double")
        parts.append(reduce(lambda a, b: a | b, [F.abs(x - F.lit(float(v))) <= 1e-8 + 1e-5 * abs(v) for v in value]) if op == "in" else ops[op](x, F.lit(float(value))))
    return reduce(and_, parts, F.lit(True))


def keep_fields(df: DataFrame, cols: list[str]) -> DataFrame:
    """The named columns that there are, in the order given."""
    return df.select(*[F.col(f"`{c}`") for c in cols if c in df.columns])


def dem_mask(pixels: DataFrame, dem: DataFrame, cols: list[str]) -> DataFrame:
    """Null ``cols`` where the elevation raster (px, py, dem) has no value."""
    here = pixels.join(dem.select("px", "py", "dem"), ["px", "py"], "left")
    return here.withColumns({c: F.when(F.col("dem").isNotNull(), F.col(c)) for c in cols}).drop("dem")
