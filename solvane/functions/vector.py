"""Vectors, boxes, rays and affine transforms as column expressions.

A vector is a tuple of three DOUBLE columns; nothing here leaves whole-stage
code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

#: Relative size of a determinant from which on a triangle counts as parallel to a ray.
PARALLEL = 1e-14
#: Direction components up to this size are parallel to a box's faces.
FLAT = 1e-18


def vec(prefix: str, suffix: str = "") -> Vec:
    """The columns prefix + x, y, z."""
    return F.col(f"{prefix}x{suffix}"), F.col(f"{prefix}y{suffix}"), F.col(f"{prefix}z{suffix}")


def const(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, k: Column | float) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """a with length 1; null for zero, NaN and infinite vectors."""
    n = norm(a)
    ok = (n > 0) & (n < float("inf"))
    return tuple(F.when(ok, c / n) for c in a)  # type: ignore[return-value]


def named(a: Vec, prefix: str) -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(a, "xyz", strict=True)]


def ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num / den, or another value where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise))


def tangents(n: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors that stand on n and on each other; the helper axis is Z, or X where n is steep."""
    steep = F.abs(n[2]) >= 0.9
    helper = F.when(steep, 1.0).otherwise(0.0), F.lit(0.0), F.when(steep, 0.0).otherwise(1.0)
    t = unit(cross(helper, n))
    return t, cross(n, t)


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def solid_angle(a: Vec, b: Vec, c: Vec) -> Column:
    """Solid angle of a triangle seen from the origin, always positive."""
    la, lb, lc = norm(a), norm(b), norm(c)
    num = F.abs(dot(a, cross(b, c)))
    den = la * lb * lc + dot(a, b) * lc + dot(a, c) * lb + dot(b, c) * la
    return 2 * F.atan2(num, den)


def field_of_view(horizontal: Column | float, vertical: Column | float) -> Column:
    """Solid angle of a rectangular view; half angles' tangents are given."""
    h, v = (x if isinstance(x, Column) else F.lit(float(x)) for x in (horizontal, vertical))
    return 4 * F.atan2(h * v, F.sqrt(1 + h * h + v * v))


def in_field(forward: Vec, up: Vec, to: Vec, horizontal: Column | float, vertical: Column | float) -> Column:
    """Whether a direction lies in a rectangular view with these half angles' tangents."""
    right = unit(cross(forward, up))
    above = cross(right, forward)
    depth = dot(to, forward)
    return (depth > 0) & (F.abs(dot(to, right)) <= depth * horizontal) & (F.abs(dot(to, above)) <= depth * vertical)


def intersect(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec, absolute: float | None = None) -> dict[str, Column]:
    """Ray and triangle: det, u, v, t, and accept without regard to the ray's range; null where parallel.

    A determinant counts as 0 by its size against the edges; with ``absolute``, by
    its own size, as a plain reference kernel does (1e-12 there).
    """
    e1, e2 = sub(b, a), sub(c, a)
    p = cross(d, e2)
    det = dot(e1, p)
    crossing = F.abs(det) > (PARALLEL * norm(e1) * norm(e2) if absolute is None else F.lit(absolute))
    inv = F.when(crossing, 1.0 / det)
    s = sub(o, a)
    u = dot(s, p) * inv
    q = cross(s, e1)
    v = dot(d, q) * inv
    t = dot(e2, q) * inv
    return {"det": det, "u": u, "v": v, "t": t, "accept": (u >= 0) & (u <= 1) & (v >= 0) & (u + v <= 1)}


def box_entry(o: Vec, d: Vec, lo: Vec, hi: Vec, t_min: Column, t_max: Column) -> tuple[Column, Column]:
    """The part of a ray inside a box, (first, last); first > last or null: it misses."""
    first, last = [t_min], [t_max]
    for k in range(3):
        flat = F.abs(d[k]) <= FLAT
        inside = (o[k] >= lo[k]) & (o[k] <= hi[k])
        x, y = (lo[k] - o[k]) / F.when(~flat, d[k]), (hi[k] - o[k]) / F.when(~flat, d[k])
        first.append(F.when(flat, F.when(inside, t_min).otherwise(F.lit(float("inf")))).otherwise(F.least(x, y)))
        last.append(F.when(flat, F.when(inside, t_max).otherwise(F.lit(float("-inf")))).otherwise(F.greatest(x, y)))
    return F.greatest(*first), F.least(*last)


def box_area(lo: Vec, hi: Vec) -> Column:
    x, y, z = sub(hi, lo)
    return 2 * (x * y + y * z + z * x)


# Affine transforms: ARRAY<DOUBLE> of 16, row after row.

IDENTITY = [1.0 if k % 5 == 0 else 0.0 for k in range(16)]


def _at(m: Column, r: int, c: int) -> Column:
    return F.element_at(m, 4 * r + c + 1)


def transform_direction(m: Column, d: Vec) -> Vec:
    return tuple(_at(m, r, 0) * d[0] + _at(m, r, 1) * d[1] + _at(m, r, 2) * d[2] for r in range(3))  # type: ignore[return-value]


def transform_point(m: Column, p: Vec) -> Vec:
    return tuple(x + _at(m, r, 3) for r, x in enumerate(transform_direction(m, p)))  # type: ignore[return-value]


def determinant(m: Column) -> Column:
    a = [[_at(m, r, c) for c in range(3)] for r in range(3)]
    return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])


def valid_transform(m: Column) -> Column:
    """Finite, with the bottom row 0 0 0 1 and a determinant that is not 0."""
    finite = F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bottom = (F.abs(_at(m, 3, 0)) <= 1e-15) & (F.abs(_at(m, 3, 1)) <= 1e-15) & (F.abs(_at(m, 3, 2)) <= 1e-15) & (F.abs(_at(m, 3, 3) - 1) <= 1e-15)
    return (F.size(m) == 16) & finite & bottom & (F.abs(determinant(m)) > 1e-15)


def inverse(m: Column) -> Column:
    """The inverse transform; null if the determinant is 0."""
    a = [[_at(m, r, c) for c in range(3)] for r in range(3)]
    det = F.when(F.abs(determinant(m)) > 1e-15, determinant(m))
    minor = lambda r, c: a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3] - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
    inv = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    move = [_at(m, r, 3) for r in range(3)]
    rows: list[Column] = []
    for r in range(3):
        rows += [*inv[r], -(inv[r][0] * move[0] + inv[r][1] * move[1] + inv[r][2] * move[2])]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def photopic(rgb: Column) -> Column:
    """Luminance weight of a linear RGB triple."""
    weights = (0.265, 0.670, 0.065)  # fixed values
    return sum((F.element_at(rgb, k + 1) * w for k, w in enumerate(weights[1:], 1)), F.element_at(rgb, 1) * weights[0])


def columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]
