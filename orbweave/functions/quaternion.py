"""Rotations as column expressions. A quaternion is four columns, scalar first, of unit length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Quat = tuple[Column, Column, Column, Column]


def quat(prefix: str = "") -> Quat:
    return tuple(F.col(prefix + n) for n in "wxyz")


def rotation_matrix(q: Quat) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def product(second: Quat, first: Quat) -> Quat:
    """The rotation by ``first`` and then by ``second``."""
    a, b, c, d = second
    e, f, g, h = first
    return (a * e - b * f - c * g - d * h, a * f + b * e + c * h - d * g, a * g - b * h + c * e + d * f, a * h + b * g - c * f + d * e)


def axis_angle(axis: tuple[Column, Column, Column], angle: Column) -> Quat:
    norm = F.sqrt(sum((a * a for a in axis), F.lit(0.0)))
    return (F.cos(angle / 2), *[F.sin(angle / 2) * a / norm for a in axis])


def from_matrix(m: list[list[Column]]) -> Quat:
    """The unit quaternion of a rotation matrix, by its largest component, which is positive."""
    t = m[0][0] + m[1][1] + m[2][2]
    own = [t, m[0][0], m[1][1], m[2][2]]
    top = F.greatest(*own)

    def root(x: Column) -> Column:
        return F.sqrt(F.greatest(x, F.lit(0.0))) / 2

    big = [root(1 + t)] + [root(1 + 2 * m[i][i] - t) for i in range(3)]
    low = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    both = {(1, 2): m[0][1] + m[1][0], (1, 3): m[0][2] + m[2][0], (2, 3): m[1][2] + m[2][1]}
    out = []
    for i in range(4):
        pick = None
        for j in range(4):
            if i == j:
                x = big[i]
            elif 0 in (i, j):
                x = low[max(i, j) - 1] / (4 * big[j])
            else:
                x = both[min(i, j), max(i, j)] / (4 * big[j])
            pick = F.when(own[j] == top, x) if pick is None else pick.when(own[j] == top, x)
        out.append(pick)
    return tuple(out)


def inverse_rotate(q: Quat, v: tuple[Column, Column, Column]) -> list[Column]:
    """The vector turned by the inverse of a unit quaternion's rotation: its matrix's transpose."""
    m = rotation_matrix(q)
    return [m[0][i] * v[0] + m[1][i] * v[1] + m[2][i] * v[2] for i in range(3)]


def uniform(u: tuple[Column, Column, Column]) -> Quat:
    """A uniformly distributed rotation from three uniform numbers (Shoemake's subgroup method)."""
    import math

    a, b, c = u
    lo, hi = F.sqrt(1 - a), F.sqrt(a)
    return (hi * F.cos(2 * math.pi * c), lo * F.sin(2 * math.pi * b), lo * F.cos(2 * math.pi * b), hi * F.sin(2 * math.pi * c))


def near(base: Quat, axis: tuple[Column, Column, Column], angle: Column) -> Quat:
    """A rotation about ``axis`` by ``angle`` after ``base``: with normal draws for both, rotations scattered around it."""
    return product(axis_angle(axis, angle), base)
