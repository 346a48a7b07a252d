"""Square cells, hexagons and rectangles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUZZ1


def resolution(n_rows: int) -> int:
    """Cells along one side of a grid for so many rows."""
    return int(max(2 * math.log2(n_rows), 10)) if n_rows > 0 else 10


def _bucket(v: Column, n: int) -> Column:
    return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))).cast("int")


def grid_cell(x: Column, n: int) -> Column:
    """Cell of a value in [0, 1], as grids count it (shrunk, so that 1 is inside the last cell)."""
    return _bucket(F.lit(FUZZ1) * x * n, n)


def occupancy_cell(x: Column, n: int) -> Column:
    """Cell of a value in [0, 1], as occupancy checks count it."""
    return _bucket(x * n, n)


def cell_centre(i: Column, n: int) -> Column:
    return (i + F.lit(0.5)) / F.lit(float(n))


def marker_size(count: Column, largest: Column, biggest: float) -> Column:
    return F.when(largest > 0, F.lit(biggest) * F.sqrt(count) / F.sqrt(largest)).otherwise(F.lit(0.0))


def hex_size(rings: int) -> float:
    """Radius of a hexagon for which 2 * rings + 1 fit a unit square."""
    width = 2 * rings + 1
    return min(1 / (1.5 * width), 1 / (math.sqrt(3) * width))


def to_axial(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Fractional axial coordinates of a point (flat-topped hexagons)."""
    return F.lit(2.0 / 3.0) * x / F.lit(size), (F.lit(-1.0 / 3.0) * x + F.lit(math.sqrt(3) / 3.0) * y) / F.lit(size)


def to_cartesian(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    """Centre of a hexagon."""
    return F.lit(size) * F.lit(1.5) * q, F.lit(size) * (F.lit(math.sqrt(3) / 2) * q + F.lit(math.sqrt(3)) * r)


def hex_round(q: Column, r: Column) -> tuple[Column, Column]:
    """Nearest hexagon: the three cube coordinates are rounded half to even and the one with the largest error recomputed."""
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    out_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    out_r = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return out_q.cast("int"), out_r.cast("int")


def hex_distance(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    dq, dr = q1 - q2, r1 - r2
    return ((F.abs(dq) + F.abs(dq + dr) + F.abs(dr)) / 2).cast("int")


def in_rect(x: Column, y: Column, left, bottom, width, height) -> Column:
    """Whether a point is in the half-open rectangle."""
    left, bottom, width, height = (F.lit(v) for v in (left, bottom, width, height))
    return (x >= left) & (x < left + width) & (y >= bottom) & (y < bottom + height)


def rect_distance(x: Column, y: Column, left, bottom, width, height) -> Column:
    """Chebyshev distance of a point from a rectangle, 0 inside."""
    left, bottom, width, height = (F.lit(v) for v in (left, bottom, width, height))
    return F.greatest(left - x, x - (left + width), bottom - y, y - (bottom + height), F.lit(0.0))


def centre_distance(x: Column, y: Column, left, bottom, width, height) -> Column:
    """Chebyshev distance of a point from a rectangle's centre."""
    left, bottom, width, height = (F.lit(v) for v in (left, bottom, width, height))
    return F.greatest(F.abs(x - (left + width / 2)), F.abs(y - (bottom + height / 2)))
