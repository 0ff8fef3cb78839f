"""Many polygons against the even-odd rule edge by edge."""

import numpy as np
import pytest

from pixelframe.operators import polygons


def brute(x, y, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y < y1) != (y < y2) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


def _table(spark, shapes):
    rows = [(p, [(float(a), float(b)) for a, b in ring]) for p, rings in shapes.items() for ring in rings]
    return spark.createDataFrame(rows, "polygon long, ring array<struct<x:double,y:double>>")


def _check(spark, points, shapes, **options):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id long, x double, y double")
    got = sorted((r["id"], r["polygon"]) for r in polygons.members(df, "x", "y", _table(spark, shapes), **options).collect())
    assert got == sorted((i, p) for i, (a, b) in enumerate(points) for p, rings in shapes.items() if brute(a, b, rings))
    return got


@pytest.mark.parametrize("cells", [1, 16, 900])
def test_stars_and_holes(spark, cells):
    rng = np.random.default_rng(1)
    shapes = {}
    for p in range(12):
        n, centre = int(rng.integers(3, 12)), rng.uniform(-20, 20, 2)
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        far = rng.uniform(0.5, 8, n)
        shapes[p] = [list(zip((centre[0] + far * np.cos(angle)).tolist(), (centre[1] + far * np.sin(angle)).tolist(), strict=True))]
    shapes[50] = [[(-9, -9), (9, -9), (9, 9), (-9, 9)], [(-3, -3), (3, -4), (4, 3), (-3, 3)]]  # a slanted hole
    shapes[51] = [[(0, 0), (10, 10), (0, 10), (10, 0)]]  # crosses itself
    shapes[52] = [[(-1000, -1000), (1000, -1000), (0, 1500)]]  # holds all others
    got = _check(spark, rng.uniform(-30, 30, (1500, 2)).tolist(), shapes, cells=cells)
    assert len({p for _, p in got}) > 10


def test_points_on_edges_corners_and_cell_lines(spark):
    shapes = {1: [[(0, 0), (4, 0), (4, 4), (0, 4)]], 2: [[(4, 0), (8, 0), (8, 4), (4, 4)]], 3: [[(0, 0), (8, 4), (0, 8), (0, 0)]]}
    points = [(0.5 * i, 0.5 * j) for i in range(-1, 18) for j in range(-1, 18)]
    got = _check(spark, points, shapes, cells=64)
    # Neighbours share no point of their common edge.
    both = {i for i, p in got if p == 1} & {i for i, p in got if p == 2}
    assert not both


def test_odd_rows_and_overlay(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 9.0, 9.0), (1, 1.0, 1.0)], "id long, x double, y double").selectExpr("*", "'q' as cx", "1 as edge")
    shapes = {7: [[(0, 0), (2, 0), (2, 2), (0, 2)]], 5: [[(0, 0), (3, 0), (1, 3)]], 9: [[(0, 0), (1, 1)]]}
    table = _table(spark, shapes)
    out = polygons.overlay(df, "x", "y", table)
    assert sorted((r["id"], r["polygon"] or 0) for r in out.collect()) == [(1, 5), (1, 5), (2, 0), (3, 0)]
    assert polygons.members(df.where("id > 5"), "x", "y", table).count() == 0
    assert polygons.members(df, "x", "y", table.where("polygon > 50")).count() == 0
    line = _table(spark, {1: [[(0, 1), (5, 1), (3, 1)]]})
    assert polygons.members(df, "x", "y", line).count() == 0
