"""Reversible integer lifts: pair, quad and octant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.arith import _col, halve

#: Values of a substrate and of its details that a lift accepts.
SUBSTRATE_BOUND = (1 << 29) - 1
DETAIL_BOUND = 2 * SUBSTRATE_BOUND

DETAILS = ("g0", "b0", "t0", "g1", "b1", "t1", "dz")


def lift_pair(x, y) -> tuple[Column, Column]:
    """(low, high) = (y + floor((x - y) / 2), x - y)."""
    x, y = _col(x), _col(y)
    return y + halve(x - y), x - y


def unlift_pair(low, high) -> tuple[Column, Column]:
    low, high = _col(low), _col(high)
    y = low - halve(high)
    return y + high, y


def lift_quad(a, b, c, d) -> tuple[Column, Column, Column, Column]:
    """(dc, g, b, t) of a 2x2 block: rows first, then the two low and the two high bands."""
    l0, h0 = lift_pair(a, b)
    l1, h1 = lift_pair(c, d)
    dc, g = lift_pair(l0, l1)
    blue, t = lift_pair(h0, h1)
    return dc, g, blue, t


def unlift_quad(dc, g, blue, t) -> tuple[Column, Column, Column, Column]:
    l0, l1 = unlift_pair(dc, g)
    h0, h1 = unlift_pair(blue, t)
    return (*unlift_pair(l0, h0), *unlift_pair(l1, h1))


def lift_octant(v) -> tuple[Column, ...]:
    """(coarse, g0, b0, t0, g1, b1, t1, dz) of eight voxels, near face first."""
    near, far = lift_quad(*v[:4]), lift_quad(*v[4:])
    coarse, dz = lift_pair(near[0], far[0])
    return (coarse, *near[1:], *far[1:], dz)


def unlift_octant(bands) -> tuple[Column, ...]:
    coarse, g0, b0, t0, g1, b1, t1, dz = bands
    near, far = unlift_pair(coarse, dz)
    return (*unlift_quad(near, g0, b0, t0), *unlift_quad(far, g1, b1, t1))


def in_bound(x, bound: int = SUBSTRATE_BOUND) -> Column:
    return F.abs(_col(x)) <= bound


def inverse3(xx, xy, xz, yy, yz, zz):
    """Determinant and the six entries of the adjugate of a symmetric 3x3 matrix."""
    a, b, c = yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy
    d, e, f = xx * zz - xz * xz, xy * xz - xx * yz, xx * yy - xy * xy
    return xx * a + xy * b + xz * c, (a, b, c, d, e, f)
