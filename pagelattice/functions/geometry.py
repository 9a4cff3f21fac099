"""Box algebra as Column functions.

A box is four double columns left, top, right, bottom in points, y growing downward. `Box` only
names them; every function builds built-in expressions, so a plan stays inside code generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON_RATIO = 0.01


def _d(x) -> Column:
    return F.lit(float(x)) if isinstance(x, int | float) else x


class Box(NamedTuple):
    left: Column
    top: Column
    right: Column
    bottom: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "", names=("left", "top", "right", "bottom")) -> Box:
        return Box(*(F.col(f"{prefix}{n}{suffix}") for n in names))

    @property
    def width(self) -> Column:
        return self.right - self.left

    @property
    def height(self) -> Column:
        return self.bottom - self.top

    @property
    def center_x(self) -> Column:
        return (self.left + self.right) / _d(2)

    @property
    def center_y(self) -> Column:
        return (self.top + self.bottom) / _d(2)

    def struct(self) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(self, self._fields, strict=True)))

    def padded(self, by: float) -> Box:
        return Box(self.left - _d(by), self.top - _d(by), self.right + _d(by), self.bottom + _d(by))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def ordered(b: Box) -> Box:
    """Edges put in order; degenerate boxes stay."""
    return Box(F.least(b.left, b.right), F.least(b.top, b.bottom), F.greatest(b.left, b.right), F.greatest(b.top, b.bottom))


def is_solid(b: Box) -> Column:
    """Finite on all sides and of positive area once its edges are in order."""
    all_finite = finite(b.left) & finite(b.top) & finite(b.right) & finite(b.bottom)
    return F.coalesce(all_finite & (b.left != b.right) & (b.top != b.bottom), F.lit(False))


def normalized(b: Box) -> Box:
    """Ordered edges, or null on every side for boxes that aren't solid."""
    o, ok = ordered(b), is_solid(b)
    return Box(*(F.when(ok, c) for c in o))


def intersection(a: Box, b: Box) -> Box:
    """Null on every side where the boxes are apart or only touch."""
    left, top = F.greatest(a.left, b.left), F.greatest(a.top, b.top)
    right, bottom = F.least(a.right, b.right), F.least(a.bottom, b.bottom)
    some = (right > left) & (bottom > top)
    return Box(*(F.when(some, c) for c in (left, top, right, bottom)))


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.right, b.right) - F.greatest(a.left, b.left), _d(0))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.bottom, b.bottom) - F.greatest(a.top, b.top), _d(0))


def intersection_area(a: Box, b: Box) -> Column:
    return F.coalesce(overlap_x(a, b) * overlap_y(a, b), _d(0))


def area(b: Box) -> Column:
    n = normalized(b)
    return F.coalesce(n.width * n.height, _d(0))


def clamp_ratio(c: Column) -> Column:
    return F.least(F.greatest(c, _d(0)), _d(1))


def gap_x(a: Box, b: Box) -> Column:
    return F.greatest(b.left - a.right, a.left - b.right, _d(0))


def gap_y(a: Box, b: Box) -> Column:
    return F.greatest(b.top - a.bottom, a.top - b.bottom, _d(0))


def touches(a: Box, b: Box) -> Column:
    """Closed-interval overlap."""
    return (a.right >= b.left) & (b.right >= a.left) & (a.bottom >= b.top) & (b.bottom >= a.top)


def near(a: Box, b: Box, margin: float) -> Column:
    return (gap_x(a, b) <= _d(margin)) & (gap_y(a, b) <= _d(margin))


def distance(a: Box, b: Box) -> Column:
    x, y = gap_x(a, b), gap_y(a, b)
    return F.sqrt(x * x + y * y)


def strongly_overlaps(a: Box, b: Box, axis_ratio: float = 0.20, area_ratio: float = 0.15) -> Column:
    """A real intersection that covers enough of the smaller box on both axes or in area."""
    ox, oy = overlap_x(a, b), overlap_y(a, b)
    per_axis = (ox / F.greatest(F.least(a.width, b.width), _d(EPSILON_RATIO)) >= _d(axis_ratio)) & (oy / F.greatest(F.least(a.height, b.height), _d(EPSILON_RATIO)) >= _d(axis_ratio))
    by_area = ox * oy / F.greatest(F.least(a.width * a.height, b.width * b.height), _d(EPSILON_RATIO)) >= _d(area_ratio)
    return (ox > _d(0)) & (oy > _d(0)) & (per_axis | by_area)


def vertical_overlap_ratio(a: Box, b: Box) -> Column:
    return overlap_y(a, b) / F.greatest(F.least(a.height, b.height), _d(EPSILON_RATIO))


def coverage_of(subject: Box, container: Box) -> Column:
    """Part of the subject inside the container; areas below 1 count as 1."""
    return intersection_area(subject, container) / F.greatest(subject.width * subject.height, _d(1))


def contains_center(container: Box, subject: Box, tolerance: float = 0.0) -> Column:
    x, y, t = subject.center_x, subject.center_y, _d(tolerance)
    return (x >= container.left - t) & (x <= container.right + t) & (y >= container.top - t) & (y <= container.bottom + t)
