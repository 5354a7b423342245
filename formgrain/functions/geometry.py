"""Scalar geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c * x - s * y, s * x + c * y


def half_extents(length: float, width: float, degrees: Column) -> tuple[Column, Column]:
    """Half sizes of the upright box around a rectangle at an angle."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    return c * (length / 2) + s * (width / 2), s * (length / 2) + c * (width / 2)


def heading(dx: Column, dy: Column) -> Column:
    """Direction in degrees, 0 up to 360."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def overlap_share(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    shared = side(0) * side(1)
    return F.try_divide(shared, area(a) + area(b) - shared)


def to_pixels(points: Column, dpi: int = 200) -> Column:
    """PDF points to pixels, halves to even."""
    return F.bround(points * (dpi / 72)).cast("int")
