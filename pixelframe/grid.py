"""Grids: the contract between coordinates and pixels, as column expressions.

A cell is closed on the left and open on the right; the last cell of an axis is closed on
both sides.  Pixel coordinates map back to the lower left corner.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int

    def _index(self, v: Column, start: float, step: float, n: int) -> Column:
        i = F.floor((v - F.lit(start)) / F.lit(step))
        # Division may land one cell beside an exact edge; the edge itself decides.
        i = F.when(v < F.lit(start) + i * F.lit(step), i - 1).when(v >= F.lit(start) + (i + 1) * F.lit(step), i + 1).otherwise(i)
        return F.least(i, F.lit(n - 1)).cast("long")

    def px(self, lon: Column) -> Column:
        return self._index(lon.cast("double"), self.x0, self.dx, self.width)

    def py(self, lat: Column) -> Column:
        return self._index(lat.cast("double"), self.y0, self.dy, self.height)

    def contains(self, lon: Column, lat: Column) -> Column:
        """Inside the closed bounding box; other points have no pixel."""
        x1, y1 = self.x0 + self.dx * self.width, self.y0 + self.dy * self.height
        return (lon >= self.x0) & (lon <= x1) & (lat >= self.y0) & (lat <= y1)

    def lon(self, px: Column) -> Column:
        return F.lit(self.x0) + px * F.lit(self.dx)

    def lat(self, py: Column) -> Column:
        return F.lit(self.y0) + py * F.lit(self.dy)

    def affine(self) -> tuple[float, float, float, float, float, float]:
        """(x step, 0, left, 0, -y step, top) of a north-up image."""
        return (self.dx, 0.0, self.x0, 0.0, -self.dy, self.y0 + self.dy * self.height)

    def patched(self, size: int) -> Grid:
        """The grid of cells with a whole neighbourhood of ``size`` cells on each side."""
        return Grid(self.x0 + size * self.dx, self.y0 + size * self.dy, self.dx, self.dy, self.width - 2 * size, self.height - 2 * size)
