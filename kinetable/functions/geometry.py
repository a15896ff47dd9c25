"""Planar geometry as Column expressions (image coordinates, y grows downwards).

Points are ``(x, y)`` pairs of Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
DEGENERATE = 1e-9
MIN_TORSO = 1e-6


def point(struct: Column) -> Point:
    return struct.getField("x"), struct.getField("y")


def dist(a: Point, b: Point) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def mid(a: Point, b: Point) -> Point:
    return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2


def angle_deg(a: Point, vertex: Point, c: Point) -> Column:
    """Angle at ``vertex`` in degrees; null when a ray has no length."""
    ux, uy = a[0] - vertex[0], a[1] - vertex[1]
    vx, vy = c[0] - vertex[0], c[1] - vertex[1]
    nu, nv = F.hypot(ux, uy), F.hypot(vx, vy)
    cosine = (ux * vx + uy * vy) / (nu * nv)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return F.when((nu >= DEGENERATE) & (nv >= DEGENERATE), F.degrees(F.acos(clamped)))


def lean_deg(shoulder: Point, hip: Point) -> Column:
    """Signed lean of the hip-to-shoulder line from vertical."""
    dx, up = shoulder[0] - hip[0], hip[1] - shoulder[1]
    return F.when(F.hypot(dx, up) >= DEGENERATE, F.degrees(F.atan2(dx, up)))


def torso_len(shoulder: Point, hip: Point) -> Column:
    return dist(shoulder, hip)


def normalize(value: Column, length: Column) -> Column:
    return F.when(length >= MIN_TORSO, value / length)


def vvel(y0: Column, y1: Column, dt: Column) -> Column:
    return F.when(dt > 0, (y1 - y0) / dt)


def lerp(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return v0 + (t - t0) / (t1 - t0) * (v1 - v0)


def box_center(x1: Column, y1: Column, x2: Column, y2: Column) -> Point:
    return (x1 + x2) / 2, (y1 + y2) / 2


def box_radius(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, y2 - y1) / 2
