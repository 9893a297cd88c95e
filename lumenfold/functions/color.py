"""Colour transforms in exact integers (Q16) and in floats.

The matrices are those of the public OKLab definition and of the sRGB
standard, scaled by 65536 and rounded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.arith import _col, floor_div, icbrt_q16, trunc_div

#: OKLab matrices (linear sRGB to LMS, and roots of LMS to Lab).
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
#: Their inverses.
ROOTS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))

#: Bins an axis of the colour grid.
AXIS_BINS = 16
ONE = 65536


def _q16(m):
    return [[round(x * ONE) for x in row] for row in m]


def _rows(m, v, scale: bool) -> list[Column]:
    out = []
    for row in m:
        total = v[0] * row[0] + v[1] * row[1] + v[2] * row[2]
        out.append(trunc_div(total, ONE) if scale else total)
    return out


def linear_to_oklab_q16(r, g, b) -> tuple[Column, Column, Column]:
    """Linear sRGB in Q16 to OKLab in Q16: negative inputs clamp to 0; products truncate; roots are exact."""
    v = [F.greatest(F.lit(0), _col(c)) for c in (r, g, b)]
    lms = [icbrt_q16(F.least(F.lit(2 * ONE), F.greatest(F.lit(0), x))) for x in _rows(_q16(LMS), v, True)]
    return tuple(_rows(_q16(LAB), lms, True))


def linear_to_oklab(r, g, b) -> tuple[Column, Column, Column]:
    v = [_col(c) for c in (r, g, b)]
    return tuple(_rows(LAB, [F.cbrt(x) for x in _rows(LMS, v, False)], False))


def oklab_to_linear(lum, a, b) -> tuple[Column, Column, Column]:
    roots = _rows(ROOTS, [_col(c) for c in (lum, a, b)], False)
    return tuple(_rows(RGB, [x * x * x for x in roots], False))


def srgb_to_linear(c) -> Column:
    c = _col(c)
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c) -> Column:
    c = _col(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def bin_index(lum, a, b) -> Column:
    """Cell of a 16**3 grid: L over [0, 1], a and b over [-1/2, 1/2], in Q16; edges clamp."""
    axis = lambda x: F.least(F.lit(AXIS_BINS - 1), F.greatest(F.lit(0), floor_div(x, ONE // AXIS_BINS)))
    return (axis(lum) * AXIS_BINS + axis(_col(a) + ONE // 2)) * AXIS_BINS + axis(_col(b) + ONE // 2)


def in_gamut(lum, a, b) -> Column:
    half = ONE // 2
    return _col(lum).between(0, ONE) & _col(a).between(-half, half) & _col(b).between(-half, half)


def clamp_gamut(lum, a, b) -> tuple[Column, Column, Column]:
    half = ONE // 2
    fit = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), _col(x)))
    return fit(lum, 0, ONE), fit(a, -half, half), fit(b, -half, half)


def opponents(r, g, b) -> dict[str, Column]:
    """Eight integer functionals of a colour."""
    r, g, b = _col(r), _col(g), _col(b)
    return {"r": r, "g": g, "b": b, "sum": r + g + b, "r_g": r - g, "rg_2b": r + g - 2 * b, "r_b": r - b, "g_b": g - b}


def blend(x, y, k: int) -> Column:
    """((4 - k) x + k y) / 4, rounded down."""
    return F.shiftright(_col(x) * (4 - k) + _col(y) * k, 2)


def srgb8_to_q16(byte) -> Column:
    """Linear light of a byte in Q16, half to even."""
    return F.rint(srgb_to_linear(_col(byte).cast("double") / 255.0) * float(ONE)).cast("long")


def srgb8_to_oklab_q16(r, g, b) -> tuple[Column, Column, Column]:
    return linear_to_oklab_q16(*[srgb8_to_q16(c) for c in (r, g, b)])


def q16_to_srgb8(x) -> Column:
    """Byte of linear light in Q16: clamped to [0, 1], rounded half up."""
    fit = F.least(F.lit(ONE), F.greatest(F.lit(0), _col(x)))
    return F.floor(linear_to_srgb(fit.cast("double") / float(ONE)) * 255.0 + 0.5).cast("int")


def oklab_q16_to_srgb8(lum, a, b) -> tuple[Column, Column, Column]:
    """OKLab in Q16 to bytes: products and cubes truncate towards zero."""
    roots = _rows(_q16(ROOTS), [_col(c) for c in (lum, a, b)], True)
    return tuple(q16_to_srgb8(x) for x in _rows(_q16(RGB), [trunc_div(v * v * v, 1 << 32) for v in roots], True))


def closest_lattice_point(luma, ca, cb) -> Column:
    """struct<cost, dl, norm, k, luma, ca, cb>: the nearest point of the lattice luma = ca + cb (mod 3).

    Candidates move luma by up to two or chroma by one unit; the least by
    (squared distance, change of luma, size of chroma, order of candidates).
    """
    moves = [(dl, 0, 0) for dl in range(-2, 3)] + [(0, x, y) for x, y in HEX_UNITS]
    found = []
    for k, (dl, x, y) in enumerate(moves):
        p, q, s = _col(luma) + dl, _col(ca) + x, _col(cb) + y
        point = F.struct(F.lit(dl * dl + x * x - x * y + y * y).alias("cost"), F.lit(abs(dl)).alias("dl"), (F.abs(q) + F.abs(s)).alias("norm"), F.lit(k).alias("k"), p.alias("luma"), q.alias("ca"), s.alias("cb"))
        found.append(F.when(F.pmod(p - q - s, F.lit(3)) == 0, point))
    return F.array_min(F.array_compact(F.array(*found)))


#: The six units of the hexagonal lattice.
HEX_UNITS = ((1, 0), (0, 1), (-1, -1), (-1, 0), (0, -1), (1, 1))
