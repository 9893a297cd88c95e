"""Exact block sums of pixels in several encodings, at the same bins in each.

All of them give one row a bin (frame, bin_y, bin_x) with 64-bit sums ``r``, ``g``,
``b`` and the number of pixels ``n``; sums of sums are the sums of the coarser
bins, whatever the encoding. Light is measured by turning each code into linear
light *before* it is summed; the other order darkens mixed bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.functions.kernels import Refused

#: Full scale of linear light, and of 10-bit codes (fixed values).
FULL, HLG_CODES = 65_535, 1_023
#: Constants of the hybrid log-gamma curve of BT.2100 (fixed values).
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.55991073
#: Refusal code of a frame that holds a code out of range (fixed value).
OUT_OF_RANGE = -3


def _scaled(light: Column) -> Column:
    return F.least(F.lit(FULL), F.floor(light * FULL + 0.5)).cast("long")


def srgb8_to_linear16(code: Column) -> Column:
    """Linear light, 0 to 65535, of an 8-bit sRGB code."""
    c = code / 255.0
    return _scaled(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))))


def hlg10_to_linear16(code: Column) -> Column:
    """Linear light, 0 to 65535, of a full-range 10-bit code of the hybrid log-gamma curve."""
    e = code / float(HLG_CODES)
    return _scaled(F.when(e <= 0.5, e * e / 3.0).otherwise((F.exp((e - HLG_C) / HLG_A) + HLG_B) / 12.0))


#: Encodings: the largest code, and what a code counts.
ENCODINGS = {"srgb8": (255, lambda c: c.cast("long")), "linear_srgb8": (255, srgb8_to_linear16), "linear_hlg10": (HLG_CODES, hlg10_to_linear16)}


def pool_sums(pixels: DataFrame, side: int, out_side: int, encoding: str = "srgb8", window: tuple[int, int] = (0, 0)) -> DataFrame:
    """pixels: frame, y, x, r, g, b. Bins of the square window at ``window`` (x0, y0) of that side; what lies outside is not read.

    A frame with a code out of range inside its window, or a null one, gives no
    bins (:func:`refused_frames` lists it): there is no partial output. Sides
    that do not divide are refused. One shuffle sums the bins; whether a frame
    is refused is decided on its bins.
    """
    if side <= 0 or not 0 < out_side <= side or side % out_side or min(window) < 0:
        raise Refused(f"{side} at {window} does not divide into {out_side}")
    return _pooled(pixels, side, side // out_side, encoding, window).filter("NOT _refused").drop("_refused")


def refused_frames(pixels: DataFrame, side: int, encoding: str = "srgb8", window: tuple[int, int] = (0, 0)) -> DataFrame:
    """frame and code of the frames that :func:`pool_sums` leaves out."""
    return _pooled(pixels, side, side, encoding, window).filter("_refused").select("frame", F.lit(OUT_OF_RANGE).alias("code"))


def _pooled(pixels: DataFrame, side: int, q: int, encoding: str, window: tuple[int, int]) -> DataFrame:
    most, light = ENCODINGS[encoding]
    x, y = F.col("x") - window[0], F.col("y") - window[1]
    inside = pixels.filter(x.between(0, side - 1) & y.between(0, side - 1))
    ok = F.lit(True)
    for c in "rgb":
        ok = ok & F.coalesce(F.col(c).between(0, most), F.lit(False))
    sums = [F.sum(light(F.col(c))).alias(c) for c in "rgb"]
    bins = inside.groupBy("frame", trunc_div(y, q).alias("bin_y"), trunc_div(x, q).alias("bin_x")).agg(*sums, F.count("*").alias("n"), F.max(~ok).alias("_bad"))
    return bins.withColumn("_refused", F.max("_bad").over(Window.partitionBy("frame"))).drop("_bad")


def bgra_pixels(rows: DataFrame, stride: int, window: tuple[int, int], side: int) -> DataFrame:
    """frame, y, x, r, g, b of packed rows (frame, y, row: ``stride`` bytes of B, G, R, A), only those of a square window.

    A window that does not fit a row is refused; rows that end before the window does give no pixels there.
    """
    x0, y0 = window
    if stride <= 0 or min(window) < 0 or side <= 0 or (x0 + side) * 4 > stride:
        raise Refused(f"a window of {side} at {window} does not fit rows of {stride} bytes")
    byte = lambda k: F.conv(F.hex(F.substring("row", F.col("x") * 4 + k, F.lit(1))), 16, 10).cast("long")
    inside = rows.filter(F.col("y").between(y0, y0 + side - 1))
    px = inside.select("frame", "y", "row", F.explode(F.sequence(F.lit(x0), F.lit(x0 + side - 1))).alias("x")).filter(F.octet_length("row") >= F.col("x") * 4 + 4)
    return px.select("frame", "y", "x", byte(3).alias("r"), byte(2).alias("g"), byte(1).alias("b"))


def linear16_to_srgb8(light: Column) -> Column:
    """The 8-bit code of linear light: the largest whose lower boundary, halfway between two codes, is not above it.

    It undoes :func:`srgb8_to_linear16` exactly. Boundaries are rounded as light is.
    """
    edge = lambda v: F.when(v <= 0, F.lit(-1)).otherwise(srgb8_to_linear16(v - 0.5))
    c = light / float(FULL)
    near = F.round(255.0 * F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)).cast("int")
    near = F.least(F.lit(255), F.greatest(F.lit(0), near))
    up, down = F.least(near + 1, F.lit(255)), near - 1
    return F.when(edge(up) <= light, up).when(edge(near) <= light, near).otherwise(down)
