"""Rectangles as four columns: pure expressions that stay inside generated code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Rect:
        return Rect(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))

    @staticmethod
    def item(box: Column) -> Rect:
        return Rect(box["x0"], box["y0"], box["x1"], box["y1"])

    def area(self) -> Column:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def intersection(self, other: Rect) -> Column:
        """Area of the overlap, 0 if there is none."""
        w = F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))
        h = F.greatest(F.lit(0.0), F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0))
        return w * h

    def union(self, other: Rect) -> Rect:
        return Rect(F.least(self.x0, other.x0), F.least(self.y0, other.y0), F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1))

    def meets(self, other: Rect) -> Column:
        """Open rectangles with a common point; an empty one meets nothing."""
        full = (self.x0 < self.x1) & (self.y0 < self.y1) & (other.x0 < other.x1) & (other.y0 < other.y1)
        return full & (self.x0 < other.x1) & (other.x0 < self.x1) & (self.y0 < other.y1) & (other.y0 < self.y1)

    def grown(self, left: float, top: float, right: float, bottom: float) -> Rect:
        return Rect(self.x0 - left, self.y0 - top, self.x1 + right, self.y1 + bottom)

    def holds(self, x: Column, y: Column) -> Column:
        """Closed on all sides."""
        return (x >= self.x0) & (x <= self.x1) & (y >= self.y0) & (y <= self.y1)

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}") for c, n in zip(self, ("x0", "y0", "x1", "y1"), strict=True)]

    def struct(self) -> Column:
        return F.struct(*self.named())

    def array(self) -> Column:
        return F.array(*self)
