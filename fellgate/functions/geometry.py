"""Cells of the grid and boxes, as columns and as plain numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fellgate.lang.syntax import Bbox

CELL = 0.1


def cell(coordinate: Column, width: float = CELL) -> Column:
    """Cell number; cuts toward zero."""
    return (coordinate / F.lit(width)).cast("int")


def cell_number(coordinate: float, width: float = CELL) -> int:
    return int(coordinate / width)


@dataclass(frozen=True)
class Extent:
    """Rectangle of cells, both ends inside."""

    min_x: int
    min_y: int
    max_x: int
    max_y: int

    @classmethod
    def around(cls, box: Bbox, width: float = CELL) -> Extent:
        return cls(*(cell_number(v, width) for v in (box.min_lon, box.min_lat, box.max_lon, box.max_lat)))

    def contains(self, x: Column, y: Column) -> Column:
        return x.between(self.min_x, self.max_x) & y.between(self.min_y, self.max_y)

    def has(self, x: int, y: int) -> bool:
        return self.min_x <= x <= self.max_x and self.min_y <= y <= self.max_y

    def has_lon_lat(self, lon: float, lat: float, width: float = CELL) -> bool:
        return self.has(cell_number(lon, width), cell_number(lat, width))

    def has_any(self, cells: Column) -> Column:
        """cells: array of (x, y)."""
        return F.exists(cells, lambda c: self.contains(c["x"], c["y"]))

    def expanded(self, x: int, y: int) -> Extent:
        return Extent(min(self.min_x, x), min(self.min_y, y), max(self.max_x, x), max(self.max_y, y))

    def cells(self) -> list[tuple[int, int]]:
        return [(x, y) for x in range(self.min_x, self.max_x + 1) for y in range(self.min_y, self.max_y + 1)]

    def polygon(self, width: float = CELL) -> list[tuple[float, float]]:
        """Closed ring of its corners."""
        a, b, c, d = self.min_x * width, self.min_y * width, (self.max_x + 1) * width, (self.max_y + 1) * width
        return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def bounds(df_lon: Column, df_lat: Column) -> list[Column]:
    """Aggregates of a box around points."""
    return [F.min(df_lon).alias("min_lon"), F.min(df_lat).alias("min_lat"), F.max(df_lon).alias("max_lon"), F.max(df_lat).alias("max_lat")]


def intersects(box: Bbox) -> Column:
    """Bound (min_lon .. max_lat) and box share a point; borders count."""
    return (F.col("min_lon") <= box.max_lon) & (F.col("max_lon") >= box.min_lon) & (F.col("min_lat") <= box.max_lat) & (F.col("max_lat") >= box.min_lat)
