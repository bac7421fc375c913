"""Vector, quaternion and camera algebra as column expressions.

A vector is a tuple of three columns, a rotation a tuple of nine (row by row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

# Camera axes are right-up-back, points use right-down-forward.
AXIS_SIGNS = (1.0, -1.0, -1.0)
DEPTH_STEPS = 65535.0


def vector(prefix: str, names: str = "xyz") -> Vector:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def rotation(w: Column, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """Rotation of a quaternion of any length; a zero or non-finite one is an error."""
    size = w * w + x * x + y * y + z * z
    s = 2.0 / F.when((size > 0) & (size < float("inf")), size).otherwise(F.raise_error(F.lit("invalid quaternion")).cast("double"))
    return (
        1 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
        s * (x * y + z * w), 1 - s * (x * x + z * z), s * (y * z - x * w),
        s * (x * z - y * w), s * (y * z + x * w), 1 - s * (x * x + y * y),
    )


def transpose(r: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(r[3 * j + i] for i in range(3) for j in range(3))


def multiply(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3))


def rotate(r: tuple[Column, ...], v: Vector) -> Vector:
    return tuple(r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3))


def flip(v: Vector) -> Vector:
    return tuple(c * s for c, s in zip(v, AXIS_SIGNS))


def camera_to_world(point: Vector, position: Vector, r: tuple[Column, ...]) -> Vector:
    return add(position, rotate(r, flip(point)))


def world_to_camera(point: Vector, position: Vector, r: tuple[Column, ...]) -> Vector:
    return flip(rotate(transpose(r), subtract(point, position)))


def angle_degrees(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Angle of the rotation that takes ``a`` to ``b``."""
    trace = sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def orthonormality_error(r: tuple[Column, ...]) -> Column:
    product = multiply(transpose(r), r)
    return F.greatest(*[F.abs(product[3 * i + j] - (1.0 if i == j else 0.0)) for i in range(3) for j in range(3)])


def decode_depth(raw: Column, low: Column, high: Column) -> Column:
    return raw / DEPTH_STEPS * (high - low) + low


def back_project(row: Column, col: Column, depth: Column, fx, fy, width, height) -> Vector:
    """Radial depth along the ray through the pixel centre."""
    x, y = (col + 0.5 - width / 2) / fx, (row + 0.5 - height / 2) / fy
    scale = depth / F.sqrt(x * x + y * y + 1)
    return x * scale, y * scale, scale


def project(point: Vector, fx, fy, width, height) -> tuple[Column, Column]:
    """Pixel (row, col); a point that is not in front of the camera is an error."""
    z = F.when(point[2] > 0, point[2]).otherwise(F.raise_error(F.lit("point behind camera")).cast("double"))
    return fy * point[1] / z + height / 2 - 0.5, fx * point[0] / z + width / 2 - 0.5


def axis_angle(axis: Vector, angle: Column, algebra=F) -> tuple[Column, ...]:
    """Rotation by ``angle`` (radians) about a unit axis; of arrays if ``algebra`` is NumPy."""
    x, y, z = axis
    s, c = algebra.sin(angle), 1 - algebra.cos(angle)
    return (
        1 - c * (y * y + z * z), c * x * y - s * z, c * x * z + s * y,
        c * x * y + s * z, 1 - c * (x * x + z * z), c * y * z - s * x,
        c * x * z - s * y, c * y * z + s * x, 1 - c * (x * x + y * y),
    )
