"""Geometry as column expressions, so that all of it stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def wrap(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    return F.pmod(a + PI, F.lit(2 * PI)) - PI


def turn_between(a: Column, b: Column) -> Column:
    """The turn from angle a to b in [-pi, pi), half a turn being -pi whatever the rounding of a and b."""
    turn = wrap(b - a)
    return F.when(F.abs(turn) > PI - 1e-9, F.lit(-PI)).otherwise(turn)


def yaw_from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Heading of the body's x axis in the plane, z up."""
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def rotation_from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Row-major 3 x 3 rotation."""
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def to_frame(x0: Column, y0: Column, yaw0: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point of the plane seen from a pose: x forward, y to the left."""
    dx, dy = x - x0, y - y0
    return F.cos(yaw0) * dx + F.sin(yaw0) * dy, F.cos(yaw0) * dy - F.sin(yaw0) * dx


def from_frame(x0: Column, y0: Column, yaw0: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse of to_frame."""
    return x0 + F.cos(yaw0) * x - F.sin(yaw0) * y, y0 + F.sin(yaw0) * x + F.cos(yaw0) * y


def transform_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point through a row-major 4 x 4 rigid transform in an array of 16."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))


def rigid_inverse(m: Column) -> Column:
    """Inverse of a rigid 4 x 4 transform: rotation transposed, translation rotated back."""
    rows = []
    for r in range(3):
        rows += [m[r], m[4 + r], m[8 + r], -(m[r] * m[3] + m[4 + r] * m[7] + m[8 + r] * m[11])]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def matmul(a: Column, b: Column) -> Column:
    """Product of two row-major 4 x 4 matrices."""
    return F.array(*(sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4)))


def level(m: Column) -> Column:
    """A rotation (array of 9) without roll and pitch: only its yaw stays."""
    yaw = F.atan2(m[3], m[0])
    return F.array(F.cos(yaw), -F.sin(yaw), F.lit(0.0), F.sin(yaw), F.cos(yaw), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def upright(nx: Column, ny: Column, nz: Column) -> Column:
    """The smallest rotation (array of 9) that takes a unit normal to +z; the identity for one that is upright already."""
    k = 1 / (1 + nz)
    return F.when(nx * nx + ny * ny < 1e-18, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))).otherwise(
        F.array(1 - nx * nx * k, -nx * ny * k, -nx, -nx * ny * k, 1 - ny * ny * k, -ny, nx, ny, nz)
    )


def box_distance(px: Column, py: Column, cx: Column, cy: Column, heading: Column, length: Column, width: Column) -> Column:
    """Distance from a point to an oriented rectangle, 0 inside."""
    lx, ly = to_frame(cx, cy, heading, px, py)
    zero = F.lit(0.0)
    return F.hypot(F.greatest(F.abs(lx) - length / 2, zero), F.greatest(F.abs(ly) - width / 2, zero))


def map_row_col(x: Column, y: Column, size: int = 400, resolution: float = 0.1) -> tuple[Column, Column]:
    """Row and column of a point in an ego-centred map: rows fall with x, columns with y."""
    half = (size - 1) / 2
    return half - x / resolution, half - y / resolution


def project(x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column, nearest: float = 0.3) -> tuple[Column, Column]:
    """Pixel of a point in an x-forward, y-left, z-up camera frame; null behind or too near."""
    ahead = F.when(x > nearest, x)
    return cx - fx * y / ahead, cy - fy * z / ahead


def field_of_view(width: Column, fx: Column) -> Column:
    return 2 * F.degrees(F.atan(width / (2 * fx)))


def axis_change(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A y-up point in z-up axes."""
    return x, -z, y


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def uniform(*keys: Column) -> Column:
    """A reproducible number in [0, 1) from keys; md5, so that other engines can compute it too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("double") / 4294967296.0


def around(c: Column, n: int = 1) -> Column:
    """One row for each cell index from c - n to c + n."""
    return F.explode(F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: c + k))


def rounded(c: Column, places: int) -> Column:
    """F.round of a double, which goes by way of its decimal digits, as a quotient where that is sure to be the same."""
    scaled = c * 10.0**places
    sure = (scaled >= 0) & (scaled < 1e8) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    return F.when(sure, F.floor(scaled + 0.5) / 10.0**places).otherwise(F.round(c, places))
