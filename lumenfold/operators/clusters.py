"""Palettes of frames of any size: farthest-point seeds and Lloyd steps as aggregations.

The same palette as one frame at a time in a task would give: the first seed is
the pixel farthest from the integer mean, each further one the pixel farthest
from its nearest seed, ties to the lowest index; then means truncated towards
zero, an empty slot keeps its colour. All frames go through their rounds
together. A round is one pass over the pixels with a map-side maximum (or sum),
so what is shuffled is a row for each frame and task, and no task holds a frame.

A pixel's distance to its nearest seed is kept in a stored table that is brought
up to date every ``REFRESH`` rounds; between, only the seeds since then are
compared. Seeds travel as one array a frame, broadcast while they fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.functions.kernels import Refused
from lumenfold.operators.assign import LANES, dist2, nearest
from lumenfold.storage import Scratch, small

REFRESH = 8
#: Bytes of one seed in a frame's array.
SEED_BYTES = 32


def _colour() -> Column:
    return F.struct(*LANES)


def farthest_seeds(pixels: DataFrame, k: int, scratch: Scratch, key: str = "frame") -> DataFrame:
    """key and seeds, an array of k colours in the order they were chosen, fewer for a frame of fewer pixels."""
    if not 0 < k <= 256:
        raise Refused(f"{k} colours")
    px = pixels.select(key, "idx", *LANES)
    means = px.groupBy(key).agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in LANES])
    means = scratch.write(means.select(key, "_n", F.struct(*[trunc_div(c, "_n").alias(c) for c in LANES]).alias("mean")))
    many = means.count()
    hint = lambda df, n: F.broadcast(df) if small(many, 16 + n * SEED_BYTES) else df
    pick = lambda df, d: df.groupBy(key).agg(F.max(F.struct(d.alias("d"), (-F.col("idx")).alias("i"), _colour().alias("c")))["c"].alias("c"))
    first = pick(px.join(hint(means, 1), key), dist2(_colour(), F.col("mean")))
    seeds = scratch.write(first.select(key, F.array("c").alias("seeds")))
    near, done = px.withColumn("near", F.lit((1 << 63) - 1)), 0
    for n in range(1, k):
        fresh = seeds.select(key, F.slice("seeds", done + 1, n).alias("seeds"))  # none for a frame whose pixels are used up
        d = F.least("near", F.array_min(F.transform("seeds", lambda s: dist2(_colour(), s))))
        compared = near.join(hint(fresh, n), key).select(key, "idx", *LANES, d.alias("near"))
        grown = seeds.join(pick(compared, F.col("near")), key).join(means.select(key, "_n"), key)
        seeds = scratch.write(grown.select(key, F.when(F.col("_n") > n, F.concat("seeds", F.array("c"))).otherwise(F.col("seeds")).alias("seeds")))
        if n % REFRESH == 0:
            near, done = scratch.write(compared), n
    return seeds


def quantize_large(pixels: DataFrame, k: int, lloyd: int = 0, key: str = "frame") -> DataFrame:
    """Each pixel's slot and the colour of the slot (cl, ca, cb), as ``quantize_frames`` gives them, for frames of any size.

    pixels: ``key``, idx (unique in a frame), l, a, b; other columns stay.
    """
    with Scratch(pixels.sparkSession, "palettes") as scratch:
        seeds = farthest_seeds(pixels, k, scratch, key)
        palette = scratch.write(seeds.select(key, F.posexplode("seeds").alias("slot", "c")).select(key, "slot", "c.*"))
        for _ in range(lloyd):
            means = nearest(pixels.select(key, *LANES), palette, (key,)).groupBy(key, "slot").agg(*[trunc_div(F.sum(c), F.count("*")).alias(f"_{c}") for c in LANES])
            moved = palette.join(means, [key, "slot"], "left").select(key, "slot", *[F.coalesce(f"_{c}", c).alias(c) for c in LANES])
            palette = scratch.write(moved)
        slots = nearest(pixels, palette, (key,)).drop("d2")
        colours = palette.select(key, "slot", *[F.col(c).alias(f"c{c}") for c in LANES])
        return scratch.result(slots.join(colours, [key, "slot"]).select(*pixels.columns, "slot", "cl", "ca", "cb"))
