"""Exact integer arithmetic on BIGINT columns.

Every rounding rule has one name: floor, truncation, half up, half to even.
All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Q16 = 65536


def _col(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def trunc_div(x, n) -> Column:
    """Quotient rounded towards zero."""
    return F.call_function("div", _col(x), _col(n))


def floor_div(x, n) -> Column:
    """Quotient rounded down, for n > 0."""
    x, n = _col(x), _col(n)
    return trunc_div(x - F.pmod(x, n), n)


def half_up_div(x, n) -> Column:
    """Quotient of x >= 0 and n > 0 rounded half up."""
    x, n = _col(x), _col(n)
    return trunc_div(x + trunc_div(n, 2), n)


def halve(x) -> Column:
    """Floor of x / 2 as an arithmetic shift."""
    return F.shiftright(_col(x), 1)


def to_q16(x) -> Column:
    """Float to 16.16 fixed point, half to even."""
    return F.rint(_col(x) * float(Q16)).cast("long")


def mass_q16(count, total) -> Column:
    """count / total in Q16, rounded half up; 0 where the total is not positive."""
    count, total = _col(count), _col(total)
    return F.when(total > 0, half_up_div(count * Q16, F.greatest(total, F.lit(1)))).otherwise(F.lit(0)).cast("long")


def isqrt(x) -> Column:
    """Largest r with r * r <= x, for 0 <= x < 2**53."""
    x = _col(x)
    r = F.floor(F.sqrt(x.cast("double"))).cast("long")
    return F.when(r * r > x, r - 1).when((r + 1) * (r + 1) <= x, r + 1).otherwise(r)


def icbrt_q16(x) -> Column:
    """Largest m with m**3 <= x * 2**32, for 0 <= x <= 131072."""
    n = _col(x) * (1 << 32)
    m = F.floor(F.cbrt(n.cast("double"))).cast("long")
    return F.when(m * m * m > n, m - 1).when((m + 1) * (m + 1) * (m + 1) <= n, m + 1).otherwise(m)


def zigzag(n) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 ... to 0, 1, 2, 3 ..."""
    n = _col(n)
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n) -> Column:
    n = _col(n)
    return F.shiftright(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))


def morton3(x, y, z, bits: int = 6) -> Column:
    """Bit-interleaved key of three coordinates; x is the lowest bit."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for lane, c in enumerate((x, y, z)):
            out = out + F.shiftleft(F.shiftright(_col(c).cast("long"), b).bitwiseAND(F.lit(1)), 3 * b + lane)
    return out
