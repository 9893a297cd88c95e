"""From pixels to a picture in one call, and from pictures back to loops and colour tokens.

Per frame: a palette, a slot for every pixel (nearest, or dithered), poor slots
filled, colours as bytes; then one animation a capture. Frames of a capture are
independent until they are assembled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import color
from lumenfold.functions.arith import trunc_div
from lumenfold.functions.kernels import Refused
from lumenfold.operators.clusters import quantize_large
from lumenfold.operators.frames import dither_frames, quantize_frames
from lumenfold.sources.readers import assemble_gifs, decode_gifs, gif_pixels

DITHERS = ("none", "floyd-steinberg", "atkinson", "threshold")
#: Why a picture is no loop.
KEPT, DECIMATED, WRONG_SIDE, WRONG_COLOURS = "kept", "decimated", "wrong_side", "wrong_colours"


def encode_bursts(pixels: DataFrame, side: int, k: int, delay_cs: int, dither: str = "none", least: int = 0, large: bool = False) -> DataFrame:
    """pixels: capture, t, idx (0 to side * side - 1), l, a, b. capture and its animation (gif) of side x side.

    Colours of slots that a frame does not use stay black, so every frame has k
    entries. A frame that lacks or repeats a pixel is an error of its own. large: palettes
    by rounds over the table instead of a frame a task (only without dithering and filling).
    """
    if dither not in DITHERS or not 0 < k <= 256 or side <= 0 or k > side * side:
        raise Refused(f"{k} colours of {side} x {side}, {dither}")
    if large and (least or dither != "none"):
        raise Refused("large palettes go with the nearest slot")
    kind = pixels.schema["capture"].dataType.simpleString()
    named = pixels.withColumn("frame", F.concat_ws("/", F.col("capture").cast("string"), F.col("t").cast("string")))
    px = named.select("frame", "idx", "l", "a", "b")
    slots = quantize_large(px, k) if large else quantize_frames(px, k, least=least)
    colours = slots.groupBy("frame", "slot").agg(*[F.first(f"c{c}").alias(c) for c in "lab"])
    if dither != "none":
        slots = dither_frames(px, k, side, dither)
    rgb = F.array(*[F.coalesce(v, F.lit(0)).cast("int") for v in color.oklab_q16_to_srgb8(F.col("l"), F.col("a"), F.col("b"))])
    entries = colours.groupBy("frame").agg(F.map_from_entries(F.collect_list(F.struct("slot", rgb))).alias("_map"))
    black = F.array(*[F.lit(0)] * 3)
    palette = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.coalesce(F.element_at("_map", s), black))
    planes = slots.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("idx", "slot"))).alias("_px"))
    whole = (F.size("_px") == side * side) & (F.element_at("_px", 1)["idx"] == 0) & (F.element_at("_px", -1)["idx"] == side * side - 1)
    places = F.when(whole, F.transform("_px", lambda p: p["slot"])).otherwise(F.raise_error(F.concat(F.lit("not a whole frame: "), "frame")))
    frames = named.select("frame", "capture", "t").distinct().join(entries, "frame").join(planes, "frame")
    frames = frames.select(F.col("capture").cast(kind).alias("capture"), F.col("t").cast("int").alias("t"), palette.alias("palette"), places.alias("indices"))
    return assemble_gifs(frames, side, delay_cs)


def ingest_loops(gifs: DataFrame, full: int = 256, factor: int = 4, colours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """gifs: stem, content. The loops' pixels (stem, t, y, x, slot), and what became of each picture (stem, outcome).

    A picture of side ``full`` is decimated to the top left pixel of each block
    of ``factor``; others are kept as they are. With ``colours`` only pictures of that side and
    of so many colours in every frame are loops; the others have their outcome and no pixels.
    """
    if factor <= 0 or full % factor:
        raise Refused(f"{full} by {factor}")
    frames = decode_gifs(gifs)
    about = frames.groupBy("stem").agg(F.min("width").alias("w"), F.max(F.greatest("width", "height")).alias("most"), F.min(F.size("palette")).alias("low"), F.max(F.size("palette")).alias("high"))
    square = (F.col("w") == full) & (F.col("most") == full)
    outcome = F.when(square, DECIMATED).otherwise(KEPT)
    if colours is not None:
        outcome = F.when(~square, WRONG_SIDE).when((F.col("low") != colours) | (F.col("high") != colours), WRONG_COLOURS).otherwise(DECIMATED)
    outcomes = about.select("stem", outcome.alias("outcome"))
    px = gif_pixels(frames).join(outcomes.filter(F.col("outcome").isin(KEPT, DECIMATED)), "stem")
    thin = F.col("outcome") == DECIMATED
    px = px.filter(~thin | ((F.col("y") % factor == 0) & (F.col("x") % factor == 0)))
    place = lambda c: F.when(thin, trunc_div(c, factor)).otherwise(F.col(c)).cast("int").alias(c)
    return px.select("stem", "t", place("y"), place("x"), "slot"), outcomes


def picture_tokens(gifs: DataFrame) -> DataFrame:
    """gifs: stem, content. One Gaussian token (stem, t, slot, m_l, m_a, m_b, weight) for each palette entry of each frame.

    The mean is the entry's colour, there is no spread in a picture, and weights
    are the share of all the picture's pixels, so they add up to 1.
    """
    frames = decode_gifs(gifs)
    counts = frames.select("stem", "t", F.explode("indices").alias("slot")).groupBy("stem", "t", "slot").agg(F.count("*").alias("n"))
    entries = frames.select("stem", "t", F.posexplode("palette").alias("slot", "c"))
    lab = color.srgb8_to_oklab_q16(*[F.col("c")[i] for i in range(3)])
    tokens = entries.select("stem", "t", "slot", *[(v / 65536.0).alias(f"m_{c}") for c, v in zip("lab", lab)]).join(counts, ["stem", "t", "slot"], "left")
    total = F.sum("n").over(Window.partitionBy("stem"))
    return tokens.select("stem", "t", "slot", "m_l", "m_a", "m_b", (F.coalesce("n", F.lit(0)) / total).alias("weight"))
