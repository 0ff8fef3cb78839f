"""Points in many polygons: an equi-join on grid cells, edges tested only where a polygon's edge passes a point's cell.

Polygons are a table of rings (``polygon``, ``ring``: an array of structs with x and y); rings of one polygon are taken together by
the even-odd rule, so holes are rings as well.  A polygon's cells are those that its edges pass and, row by row of the
grid, those between the crossings of the row's middle line.  A point in a cell of the second kind is inside; one in a
cell of the first kind is tested against the edges of the polygon that meet the cell's row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.plans.materialise import materialise

#: Cells of a polygon, on the average; rows of cells up to which they are broadcast.
CELLS, BROADCAST = 256, 100_000


def edges(polygons: DataFrame, polygon: str = "polygon", ring: str = "ring") -> DataFrame:
    """(polygon, x1, y1, x2, y2) of every edge; a ring is closed whether or not its last point repeats the first."""
    points = polygons.where(F.size(ring) >= 3).select(polygon, F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("r"))
    turned = F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", F.lit(1), F.lit(1)))
    pairs = points.select(polygon, F.explode(F.arrays_zip("r", turned.alias("s"))).alias("e"))
    e = pairs.select(polygon, F.col("e.r.x").alias("x1"), F.col("e.r.y").alias("y1"), F.col("e.s.x").alias("x2"), F.col("e.s.y").alias("y2"))
    return e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _side(sides: DataFrame, polygon: str, cells: int) -> float:
    """The width of a cell: as many cells as asked for over the average polygon's bounding box."""
    box = sides.groupBy(polygon).agg((F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"), (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"))
    area, width = box.agg(F.avg(F.col("w") * F.col("h")), F.max(F.greatest("w", "h"))).first()
    return math.sqrt(area / cells) if area else (width or 1.0)


def cover(sides: DataFrame, side: float, polygon: str = "polygon") -> DataFrame:
    """(polygon, __cx, __cy, __edge): cells of each polygon; ``__edge`` where an edge passes the cell."""
    low, high = F.floor(F.least("y1", "y2") / side), F.floor(F.greatest("y1", "y2") / side)
    row = sides.withColumn("__cy", F.explode(F.sequence(low, high)))
    # The part of an edge in a row of cells spans these columns.
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    at = lambda y: F.coalesce(F.col("x1") + slope * (F.greatest(F.least(y, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")), F.col("x1"))
    one, two = at(F.col("__cy") * side), at((F.col("__cy") + 1) * side)
    flat = F.col("y1") == F.col("y2")
    left, right = F.when(flat, F.least("x1", "x2")).otherwise(F.least(one, two)), F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(one, two))
    # A little wider: rounding must not miss a cell that an edge touches.
    slack = 1e-9 * (F.abs("x1") + F.abs("x2") + side)
    passed = row.withColumn("__cx", F.explode(F.sequence(F.floor((left - slack) / side), F.floor((right + slack) / side))))
    passed = passed.select(polygon, "__cx", "__cy").distinct()
    middle = (F.col("__cy") + 0.5) * side
    crossing = row.where(~flat & ((middle < F.col("y1")) != (middle < F.col("y2")))).select(polygon, "__cy", (F.col("x1") + slope * (middle - F.col("y1"))).alias("x"))
    lines = crossing.groupBy(polygon, "__cy").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = lines.select(polygon, "__cy", "xs", F.explode(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1)).alias("k")).select(polygon, "__cy", F.get("xs", 2 * F.col("k")).alias("a"), F.get("xs", 2 * F.col("k") + 1).alias("b"))
    first, last = F.floor(F.col("a") / side) + 1, F.floor(F.col("b") / side) - 1
    inner = spans.where(first <= last).select(polygon, "__cy", F.explode(F.sequence(first, last)).alias("__cx")).distinct()
    inner = inner.join(passed, [polygon, "__cx", "__cy"], "left_anti")
    return passed.withColumn("__edge", F.lit(True)).unionByName(inner.withColumn("__edge", F.lit(False)))


def _inside(x: Column, y: Column, own: Column) -> Column:
    """Even-odd rule over an array of edges."""
    crossed = F.filter(own, lambda e: ((y < e["y1"]) != (y < e["y2"])) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def members(points: DataFrame, x: str, y: str, polygons: DataFrame, polygon: str = "polygon", ring: str = "ring", cells: int = CELLS) -> DataFrame:
    """A row of ``points`` with ``polygon`` for each polygon that holds it.

    A point on an edge belongs to the polygon on its right or above, as the even-odd rule has it.  Points without a place and rings of less than
    three points hold nothing.
    """
    sides = materialise(edges(polygons, polygon, ring), "edges")
    side = _side(sides, polygon, cells)
    found = materialise(cover(sides, side, polygon), "cover")
    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": F.col(x).cast("double"), "__y": F.col(y).cast("double")})
    placed = placed.withColumns({"__cx": F.floor(F.col("__x") / side), "__cy": F.floor(F.col("__y") / side)})
    small = found.count() <= BROADCAST
    met = placed.join(F.broadcast(found) if small else found, ["__cx", "__cy"])
    whole = met.where(~F.col("__edge"))
    # Edges by the rows of cells that they meet; a level edge crosses no ray.
    tall = sides.where("y1 <> y2")
    rows = tall.withColumn("__cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / side), F.floor(F.greatest("y1", "y2") / side))))
    rows = rows.groupBy(polygon, "__cy").agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("__own"))
    tested = met.where("__edge").join(F.broadcast(rows) if small else rows, [polygon, "__cy"]).where(_inside(F.col("__x"), F.col("__y"), F.col("__own")))
    keep = [*points.columns, polygon]
    return whole.select(keep).unionByName(tested.select(keep))


def overlay(points: DataFrame, x: str, y: str, polygons: DataFrame, polygon: str = "polygon", ring: str = "ring", cells: int = CELLS) -> DataFrame:
    """All ``points`` with the smallest ``polygon`` that holds each; null where none does."""
    key = points.withColumn("__row", F.monotonically_increasing_id())
    key = materialise(key, "points")
    first = members(key, x, y, polygons, polygon, ring, cells).groupBy("__row").agg(F.min(polygon).alias(polygon))
    return key.join(first, "__row", "left").drop("__row")
