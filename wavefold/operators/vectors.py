"""Vectors in space as triples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def add(a: Vector, b: Vector, times: Column | float = 1.0) -> Vector:
    return tuple(x + y * times for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Of length one; the null vector stays."""
    long = norm(a)
    return tuple(F.when(long > 0, x / long).otherwise(0.0) for x in a)


def project(a: Vector, b: Vector) -> Vector:
    """The part of a along b; none along the null vector."""
    square = dot(b, b)
    share = F.when(square > 0, dot(a, b) / square).otherwise(0.0)
    return tuple(x * share for x in b)


def rotate(a: Vector, normal: Vector, degrees: Column) -> Vector:
    """a turned by an angle about a normal of any length, counterclockwise seen from its tip."""
    n, angle = unit(normal), F.radians(degrees)
    across, along = cross(n, a), dot(n, a)
    return tuple(x * F.cos(angle) + c * F.sin(angle) + m * along * (1 - F.cos(angle)) for x, c, m in zip(a, across, n, strict=True))


def azimuth(a: Vector, whole: bool) -> Column:
    """Degrees from the first axis in the horizontal plane: 0 to 360, or to a line of either sense, 0 to 180."""
    return F.pmod(F.degrees(F.atan2(a[1], a[0])), F.lit(360.0 if whole else 180.0))


def dip(a: Vector) -> Column:
    """Degrees from the third axis."""
    return F.degrees(F.acos(a[2] / norm(a)))
