"""Geometry on columns; everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(coordinate: Column, size: float) -> Column:
    """Index of the grid cell, by true floor (so negative coordinates bin as well)."""
    return F.floor(coordinate / F.lit(size)).cast("bigint")


def clamp(value: Column) -> Column:
    """Into [-1, 1], for acos."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def eigenvalues(a: str, b: str, c: str, d: str, e: str, f: str) -> dict[str, str]:
    """SQL steps to the eigenvalues l0 >= l1 >= l2 of the symmetric matrix [[a, d, e], [d, b, f], [e, f, c]].

    Each step may use those before it.
    """
    return {
        "q": f"({a} + {b} + {c}) / 3",
        "p": f"sqrt((({a} - q) * ({a} - q) + ({b} - q) * ({b} - q) + ({c} - q) * ({c} - q) + 2 * ({d} * {d} + {e} * {e} + {f} * {f})) / 6)",
        "det": f"({a} - q) * (({b} - q) * ({c} - q) - {f} * {f}) - {d} * ({d} * ({c} - q) - {f} * {e}) + {e} * ({d} * {f} - ({b} - q) * {e})",
        "phi": "acos(greatest(-1.0, least(1.0, coalesce(det / nullif(2 * p * p * p, 0), 1.0)))) / 3",
        "l0": "q + 2 * p * cos(phi)",
        "l2": f"q + 2 * p * cos(phi + {2 * math.pi / 3!r})",
        "l1": "3 * q - l0 - l2",
    }


def acute_angle(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Acute angle between two lines in degrees; 90 if a direction has no length."""
    norm = F.sqrt((a1 * a1 + b1 * b1) * (a2 * a2 + b2 * b2))
    cosine = F.coalesce(F.try_divide(a1 * a2 + b1 * b2, F.nullif(norm, F.lit(0.0))), F.lit(0.0))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(cosine))))


def yaw_matrix(yaw: Column, x: Column, y: Column, z: Column) -> Column:
    """Row-major 4x4 transform of a turn about z and a shift."""
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(F.cos(yaw), -F.sin(yaw), zero, x, F.sin(yaw), F.cos(yaw), zero, y, zero, zero, one, z, zero, zero, zero, one)


def rotation_error(a: Column, b: Column) -> Column:
    """Angle in degrees between the rotations of two row-major 4x4 transforms."""
    trace = sum((a[i] * b[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)), F.lit(0.0))
    return F.degrees(F.acos(clamp((trace - 1) / 2)))


def translation_error(a: Column, b: Column) -> Column:
    """Distance between the shifts of two row-major 4x4 transforms."""
    return F.sqrt(sum(((a[i] - b[i]) * (a[i] - b[i]) for i in (3, 7, 11)), F.lit(0.0)))


def moved(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point under a row-major 4x4 transform."""
    return tuple(m[4 * k] * x + m[4 * k + 1] * y + m[4 * k + 2] * z + m[4 * k + 3] for k in range(3))


def _dot(a: Column, b: Column) -> Column:
    return sum((a[k] * b[k] for k in range(3)), F.lit(0.0))


def normal_angle(a: Column, b: Column) -> Column:
    """Acute angle in degrees between two unit normals, given as arrays of three."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(_dot(a, b)))))


def plane_distance(c1: Column, n1: Column, c2: Column, n2: Column) -> Column:
    """Mean distance of each of two planes' centres from the other plane."""
    gap = F.zip_with(c2, c1, lambda x, y: x - y)
    return (F.abs(_dot(n1, gap)) + F.abs(_dot(n2, gap))) / 2


def turned(normal: tuple[Column, Column, Column], yaw: Column) -> tuple[Column, Column, Column]:
    """A direction turned about z."""
    x, y, z = normal
    return F.cos(yaw) * x - F.sin(yaw) * y, F.sin(yaw) * x + F.cos(yaw) * y, z
