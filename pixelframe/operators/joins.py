"""Spatial joins, all reduced to equi-joins on pixel or bin keys."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.grid import Grid
from pixelframe.operators import blocks
from pixelframe.plans.materialise import materialise

#: Rows of a side that may be broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side of counted size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def located(points: DataFrame, grid: Grid, lon: str, lat: str, strict: bool = False) -> DataFrame:
    """Points with px, py; points outside are dropped, or an error in strict mode."""
    inside = grid.contains(F.col(lon), F.col(lat))
    if strict and points.where(~inside).limit(1).count():
        raise ValueError("points outside the grid")
    return points.where(inside).withColumns({"px": grid.px(F.col(lon)), "py": grid.py(F.col(lat))})


def intersect(points: DataFrame, pixels: DataFrame, grid: Grid, lon: str, lat: str, how: str = "inner", strict: bool = False) -> DataFrame:
    """Covariates of the pixel of each point."""
    return located(points, grid, lon, lat, strict).join(pixels, ["px", "py"], how)


def _around(centres: DataFrame, pixels: DataFrame, values: list[str], halo: int) -> DataFrame:
    """Centres (``c``, in their own block) and pixels (``p``, also in the blocks around) dealt to blocks."""
    a = blocks.dealt(centres.select("px", "py", F.struct(*[f"`{c}`" for c in centres.columns]).alias("c")))
    b = blocks.dealt(pixels.select("px", "py", F.struct(*[f"`{c}`" for c in values]).alias("p")), halo)
    return a.unionByName(b, allowMissingColumns=True)


def _sides(table: pa.Table, block: np.ndarray, halo: int):
    """(centres' rows and places, the lookup of pixels, their rows in its order)."""
    px, py = blocks.numbers(table, "px"), blocks.numbers(table, "py")
    centre = table.column("c").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    at, pixel = np.flatnonzero(centre), np.flatnonzero(~centre)
    known = blocks.Places(block[pixel], px[pixel], py[pixel], halo)
    return at, px[at], py[at], known, pixel[known.order]


def patches(centres: DataFrame, pixels: DataFrame, size: int, value: str) -> DataFrame:
    """(2 size + 1)^2 neighbourhood of each (px, py) centre as an array by row of x offset, then y offset."""
    kind = pixels.schema[value].dataType.simpleString()
    side = (2 * size + 1) ** 2

    def run(table: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, x, y, known, pixel = _sides(table, block, size)
        found = [known.find(block[at], x + i, y + j) for i in range(-size, size + 1) for j in range(-size, size + 1)]
        whole = np.logical_and.reduce([end - first == 1 for first, end in found])  # the valid region only
        places = np.stack([first[whole] for first, _ in found], axis=1).ravel()
        values = table.column("p").combine_chunks().field(value).take(pa.array(pixel[places]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(whole.sum() + 1, dtype=np.int32) * side), values)
        yield pa.RecordBatch.from_arrays([table.column("c").combine_chunks().take(pa.array(at[whole])), lists], names=["c", "patch"])

    out = blocks.over_blocks(_around(centres, pixels, [value], size), run, f"c {centres.select(F.struct(*centres.columns).alias('c')).schema[0].dataType.simpleString()}, patch array<{kind}>")
    return out.select("c.*", "patch")


def windows(centres: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Pixels of the size x size window of each centre (ox, oy from 0), which starts size // 2 cells before it."""
    carried, values = [c for c in centres.columns if c not in ("px", "py")], pixels.columns
    kinds = [df.select(F.struct(*[f"`{c}`" for c in names]).alias("s")).schema[0].dataType.simpleString() for df, names in ((centres, centres.columns), (pixels, values))]

    def run(table: pa.Table, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, x, y, known, pixel = _sides(table, block, size)
        c, p = table.column("c").combine_chunks(), table.column("p").combine_chunks()
        for ox in range(size):
            for oy in range(size):
                first, end = known.find(block[at], x - size // 2 + ox, y - size // 2 + oy)
                n = end - first
                mine = np.repeat(np.arange(len(at)), n)
                other = pixel[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]
                k = len(mine)
                yield pa.RecordBatch.from_arrays([c.take(pa.array(at[mine])), p.take(pa.array(other)), pa.array(np.full(k, ox, np.int32)), pa.array(np.full(k, oy, np.int32))], names=["c", "p", "ox", "oy"])

    out = blocks.over_blocks(_around(centres, pixels, values, size), run, f"c {kinds[0]}, p {kinds[1]}, ox int, oy int")
    return out.select("p.px", "p.py", *[F.col("c")[c].alias(c) for c in carried], "ox", "oy", *[F.col("p")[v].alias(v) for v in values if v not in ("px", "py")])


def stack(rasters: list[DataFrame]) -> DataFrame:
    """Co-registered pixel tables joined on (px, py)."""
    return reduce(lambda a, b: a.join(b, ["px", "py"]), rasters)


def within_cells(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], rows: int, cols: int, closed: bool = False) -> DataFrame:
    """Cell number i = x index * rows + y index; points on any cell edge vanish unless ``closed``."""
    x0, y0, x1, y1 = box
    dx, dy = (x1 - x0) / cols, (y1 - y0) / rows
    i, j = F.floor((F.col(x) - x0) / dx), F.floor((F.col(y) - y0) / dy)
    if closed:
        i, j = F.least(i, F.lit(cols - 1)), F.least(j, F.lit(rows - 1))
        inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    else:
        inside = (F.col(x) > x0 + i * dx) & (F.col(x) < x0 + (i + 1) * dx) & (F.col(y) > y0 + j * dy) & (F.col(y) < y0 + (j + 1) * dy)
        inside &= (i >= 0) & (i < cols) & (j >= 0) & (j < rows)
    return df.where(inside).withColumn("cell", (i * rows + j).cast("long"))


def leave_out(df: DataFrame, groups: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the groups, all other rows)."""
    return df.join(groups.select(on), on, "left_semi"), df.join(groups.select(on), on, "left_anti")


#: Pairs of rows that a task of a join by few keys forms.
PAIRS = 4_000_000
#: Rows of a key that are packed into one, and pairs that a task forms of packed rows.
PACK, PACKED_PAIRS = 1024, 32_000_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], pairs: int = PAIRS, stands_for: Column | None = None) -> DataFrame:
    """Inner join on a few keys with very many rows on both sides: the pairs of a key are counted and dealt to tasks.

    The left rows of a key with many pairs are dealt to parts by their hash, and its right rows go to every part.
    A right row counts as ``stands_for`` rows.
    """
    floats = [c for c in on if any(df.schema[c].dataType in (T.DoubleType(), T.FloatType()) for df in (left, right))]
    if floats:
        # Spark joins numbers with a point by their normal form, for which rows that were dealt by the number itself are dealt again, and merged by their bytes.
        texts = {f"__t{i}": F.when(F.col(c) == 0, "0").otherwise(F.col(c).cast("double").cast("string")) for i, c in enumerate(floats)}
        return spread_join(left.withColumns(texts), right.withColumns(texts).drop(*floats), [*texts, *[c for c in on if c not in floats]], pairs, stands_for).drop(*texts)
    right_rows = F.count("*") if stands_for is None else F.sum(stands_for)
    sizes = left.groupBy(*on).agg(F.count("*").alias("__l")).join(right.groupBy(*on).agg(right_rows.alias("__r")), on)
    work = F.col("__l").cast("double") * F.col("__r")
    sizes = materialise(sizes.select(*on, work.alias("__w"), F.ceil(work / pairs).cast("int").alias("__p")), "sizes")
    total, hot = sizes.agg(F.sum("__w"), F.count(F.when(F.col("__p") > 1, 1))).first()
    parts = F.coalesce("__p", F.lit(1))
    split = small(sizes.where("__p > 1").select(*on, "__p"), hot)
    a = left.withColumn("__h", F.xxhash64(*[f"`{c}`" for c in left.columns])).join(split, on, "left").withColumn("__s", F.pmod("__h", parts).cast("int"))
    b = right.join(split, on, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), parts - 1)))
    # A number of partitions of its own: rows are few and pairs are many, so partitions must not be merged by their bytes.
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((total or 0) // pairs) + 1)
    return a.drop("__h", "__p").repartition(n, *on, "__s").join(b.drop("__p").repartition(n, *on, "__s"), [*on, "__s"]).drop("__s")


def band_join(left: DataFrame, right: DataFrame, x: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs with |left.x - right.x| <= radius: bins of that width, each left row also in the bins beside it."""
    by = by or []
    a = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(x) / radius) + k for k in (-1, 0, 1)])))
    b = right.withColumn("__b", F.floor(F.col(f"r_{x}") / radius))
    return spread_join(a, b, ["__b", *by]).where(F.abs(F.col(x) - F.col(f"r_{x}")) <= radius).drop("__b")


def packed(rows: DataFrame, on: list[str], value: str, name: str) -> DataFrame:
    """(on, name): the values of a key as lists of at most PACK, so that a join passes a key's rows by lists."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*on, value)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, new = batch.num_rows, np.arange(batch.num_rows) % PACK == 0
            for c in on:
                v = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= v[1:] != v[:-1]
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, n).astype(np.int32)), batch.column(value))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in on), lists], names=[*on, name])

    some = rows.select(*on, value).repartition(*on).sortWithinPartitions(*on)
    return some.mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in on) + f", {name} array<{kinds[value]}>")


def sensor_pairs(sensors: DataFrame, ground: DataFrame, reach: float, mu: float, tol: float, digits: int | None = None) -> DataFrame:
    """(sensor, cell, value): exp(-mu r) / r^2 of cells within the box of a sensor, where above ``tol``; rounded to ``digits``.

    sensors: sensor, x, y, z; ground: cell, gx, gy.  Weights are worked out (and rounded) once for the places of sensors and cells,
    and the cells of a place meet them as lists.
    """
    near = F.array(*[F.struct((F.floor(F.col("x") / reach) + i).alias("bx"), (F.floor(F.col("y") / reach) + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = sensors.select("x", "y", "z").distinct().withColumn("b", F.explode(near)).select("x", "y", "z", "b.bx", "b.by")
    g = ground.select("gx", "gy").distinct().withColumns({"bx": F.floor(F.col("gx") / reach), "by": F.floor(F.col("gy") / reach)})
    pairs = a.join(g, ["bx", "by"]).where((F.abs(F.col("x") - F.col("gx")) <= reach) & (F.abs(F.col("y") - F.col("gy")) <= reach))
    r2 = F.pow(F.col("x") - F.col("gx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("gy"), F.lit(2.0)) + F.pow("z", F.lit(2.0))
    pairs = pairs.select("x", "y", "z", "gx", "gy", F.try_divide(F.exp(-mu * F.sqrt(r2)), r2).alias("value")).where(F.col("value") > tol)
    if digits is not None:
        pairs = pairs.withColumn("value", F.round("value", digits))
    weights = materialise(sensors.select("sensor", "x", "y", "z").join(pairs, ["x", "y", "z"]).select("sensor", "gx", "gy", "value"), "weights")
    cells = materialise(packed(ground, ["gx", "gy"], "cell", "cells"), "cells")
    met = spread_join(weights, cells, ["gx", "gy"], PACKED_PAIRS, F.size("cells"))
    return met.select("sensor", F.explode("cells").alias("cell"), "value")


#: Most rows of a cell for each wanted neighbour before cells are halved, and most halvings.
DENSE, HALVINGS = 64, 20


def nearest(queries: DataFrame, reference: DataFrame, q_cols: list[str], r_cols: list[str], k: int, query_id: str, ref_id: str) -> DataFrame:
    """The k nearest reference rows (``distance``, ``rank``) of each query row by Euclidean distance, ties to the smaller id.

    Exact: queries meet the reference rows of their own and the neighbouring cells of a grid; those whose
    k-th distance is beyond the cell width go on with cells twice as wide.  Of equal places
    only the first k ids can be among the nearest.  Rows without a place are left out.
    """
    ref = reference.na.drop(subset=r_cols)
    ref = ref.withColumn("__n", F.row_number().over(Window.partitionBy(*r_cols).orderBy(ref_id))).where(F.col("__n") <= k).drop("__n")
    ref = materialise(ref, "reference")
    left = materialise(queries.na.drop(subset=q_cols), "queries")
    span = ref.agg(F.count("*"), *[f(c) for c in r_cols for f in (F.min, F.max)]).first()
    reach = left.agg(*[f(c) for c in q_cols for f in (F.min, F.max)]).first()
    n = span[0]
    if not n or reach[0] is None:
        k = 0
    k = min(k, n)
    sides = [float(b - a) for a, b in zip(span[1::2], span[2::2], strict=True)] if n else []
    width = max([s * (k / n) ** (1 / len(q_cols)) for s in sides], default=1.0) or 1.0
    far = max([max(float(b), float(d)) - min(float(a), float(c)) for a, b, c, d in zip(span[1::2], span[2::2], reach[::2], reach[1::2], strict=True)], default=0.0) if k else 0.0
    # Clustered rows: cells are halved until the densest holds few rows, so queries beside it settle among few.
    for _ in range(HALVINGS if k else 0):
        densest = ref.groupBy(*[F.floor(F.col(c) / width).alias(f"__c{i}") for i, c in enumerate(r_cols)]).count().agg(F.max("count")).first()[0]
        if densest <= DENSE * k:
            break
        width /= 2
    square = sum(((F.col(a).cast("double") - F.col(b)) * (F.col(a).cast("double") - F.col(b)) for a, b in zip(q_cols, r_cols, strict=True)), F.lit(0.0))
    best = Window.partitionBy(query_id).orderBy("distance", ref_id)
    done = []
    while True:
        names = [f"__c{i}" for i in range(len(q_cols))]
        around = left
        for c, name in zip(q_cols, names, strict=True):
            around = around.withColumn(name, F.explode(F.array(*[F.floor(F.col(c) / width) + o for o in (-1, 0, 1)])))
        cells = ref.withColumns({name: F.floor(F.col(c) / width) for c, name in zip(r_cols, names, strict=True)})
        # Tables of any size meet in shuffles: what Spark would broadcast by its size on disk goes through the driver.
        got = around.join(cells.hint("merge"), names).drop(*names).withColumn("distance", F.sqrt(square))
        got = got.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        got = materialise(got, "near")
        settled = got.where((F.col("rank") == k) & (F.col("distance") <= width)).select(query_id).hint("merge")
        if width > far:
            return reduce(DataFrame.unionByName, [*done, got])
        done.append(got.join(settled, query_id, "left_semi"))
        left = materialise(left.join(settled, query_id, "left_anti"), "queries")
        width *= 2
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def inside_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule for the points of a closed ring."""
    hits = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = ((y < y1) != (y < y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            hits.append(crosses.cast("int"))
    return sum(hits, F.lit(0)) % 2 == 1
