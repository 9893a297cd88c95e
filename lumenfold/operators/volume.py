"""Operators over volumes (t, y, x, v): selections, pyramids, lifts by level and prefix cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.functions.lift import lift_pair, lift_quad, unlift_pair, unlift_quad

AXES = ("t", "y", "x")


def render_select(volumes: DataFrame, depth: DataFrame, block: int = 4) -> DataFrame:
    """Per voxel of the finest grid the volume that its region's depth names.

    volumes: scale, t, y, x, v, where scale s has cells of 2**s voxels.
    depth: t, y, x (regions of ``block`` voxels), scale. One equi-join on
    (scale, cell) after each region lists its voxels.
    """
    fine = depth
    for a in AXES:
        fine = fine.withColumn(a, F.explode(F.sequence(F.col(a) * block, F.col(a) * block + block - 1)))
    cell = [F.call_function("shiftright", F.col(a), F.col("scale")).alias(f"_{a}") for a in AXES]
    keyed = fine.select(*AXES, "scale", *cell)
    source = volumes.select("scale", *[F.col(a).alias(f"_{a}") for a in AXES], "v")
    return keyed.join(source, ["scale", *[f"_{a}" for a in AXES]]).select(*AXES, "scale", "v")


def owner_integrate(photons: DataFrame, owners: list[int], limit: int = 1023) -> DataFrame:
    """Clamped samples summed per (scale, cell) by the owner of their sub-exposure; owners is a fixed schedule."""
    scale = F.element_at(F.array(*[F.lit(o) for o in owners]), F.col("s") + 1)
    return photons.groupBy(scale.alias("scale"), "cell").agg(F.sum(F.least(F.lit(limit), F.greatest(F.lit(0), "v"))).alias("total"))


def prefix_cube(cells: DataFrame, keys, axes, values) -> DataFrame:
    """Sums over all cells at or below each cell, by one running window per axis."""
    out = cells
    for axis in axes:
        rest = [*keys, *[a for a in axes if a != axis]]
        w = Window.partitionBy(*rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        for v in values:
            out = out.withColumn(v, F.sum(v).over(w))
    return out


def lift_level(plane: DataFrame, keys, value: str) -> DataFrame:
    """One 2x2 level of a plane (y, x): dc, g, b, t per cell; incomplete cells are left out."""
    lane = F.col("y") % 2 * 2 + F.col("x") % 2
    lanes = [F.max(F.when(lane == k, F.col(value))).alias(f"_{k}") for k in range(4)]
    cells = plane.groupBy(*keys, trunc_div("y", 2).alias("y"), trunc_div("x", 2).alias("x")).agg(F.count("*").alias("_n"), *lanes).filter("_n = 4")
    return cells.select(*keys, "y", "x", *[b.alias(n) for b, n in zip(lift_quad(*[F.col(f"_{k}") for k in range(4)]), ("dc", "g", "b", "t"))])


def haar_levels(rows: DataFrame, keys, index: str, value: str, levels: int) -> DataFrame:
    """Pyramid of pair lifts: level, node, low, high; each level is made of the lows of the one before."""
    now, out = rows.select(*keys, F.col(index).cast("long").alias("node"), F.col(value).alias("low")), None
    for level in range(levels):
        pair = now.groupBy(*keys, trunc_div("node", 2).alias("node")).agg(F.max(F.when(F.col("node") % 2 == 0, F.col("low"))).alias("_x"), F.max(F.when(F.col("node") % 2 == 1, F.col("low"))).alias("_y"))
        low, high = lift_pair("_x", "_y")
        here = pair.select(*keys, F.lit(level).alias("level"), "node", F.coalesce(low, "_x").alias("low"), high.alias("high"))
        out = here if out is None else out.unionByName(here)
        now = here.select(*keys, "node", "low")
    return out


def neighbourhood(plane: DataFrame, keys, value: str, radius: int) -> DataFrame:
    """Zero-padded windows of (2r+1)**2 values around each cell, row by row, as one array.

    Every cell sends its value to the cells around it: one grouping instead of a join per offset.
    """
    n = 2 * radius + 1
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    sent = F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit((dy + radius) * n + dx + radius).alias("k"), F.col(value).alias("v")) for dy, dx in offsets])
    got = plane.select(*keys, F.explode(sent).alias("s")).select(*keys, "s.y", "s.x", "s.k", "s.v")
    lanes = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("v"))), F.lit(0)) for k in range(n * n)]
    return got.groupBy(*keys, "y", "x").agg(F.array(*lanes).alias("window"), F.max(F.when(F.col("k") == n * n // 2, 1)).alias("_own")).filter("_own = 1").drop("_own")


def voxel_reduce(cube: DataFrame, levels: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cube: t, y, x, v. Substrate (t, y, x, v), spatial bands and temporal bands of so many reversible levels.

    Every frame is lifted in 2 x 2 blocks first, level by level; then each place
    of what is left is lifted in pairs along time, an odd last frame being
    carried. Spatial bands: level, f, y, x, g, b, t (f is the frame); temporal
    bands: level, node, y, x, high.
    """
    low, spatial = cube.select(F.col("t").alias("f"), "y", "x", "v"), None
    for level in range(levels):
        lifted = lift_level(low, ["f"], "v")
        own = lifted.select(F.lit(level).alias("level"), "f", "y", "x", "g", "b", "t")
        spatial = own if spatial is None else spatial.unionByName(own)
        low = lifted.select("f", "y", "x", F.col("dc").alias("v"))
    along = haar_levels(low, ["y", "x"], "f", "v", levels)
    last = along.filter(F.col("level") == levels - 1).select(F.col("node").alias("t"), "y", "x", F.col("low").alias("v"))
    return last, spatial, along.filter("high IS NOT NULL").select("level", "node", "y", "x", "high")


def voxel_expand(substrate: DataFrame, spatial: DataFrame, temporal: DataFrame, levels: int) -> DataFrame:
    """The cube (t, y, x, v) that :func:`voxel_reduce` reduced."""
    low = substrate.select(F.col("t").alias("node"), "y", "x", "v")
    for level in reversed(range(levels)):
        pair = low.join(temporal.filter(F.col("level") == level).drop("level"), ["node", "y", "x"], "left")
        first, second = unlift_pair("v", "high")
        two = F.when(F.col("high").isNull(), F.array("v")).otherwise(F.array(first, second))  # a carried frame stands alone
        low = pair.select(F.posexplode(two).alias("k", "v"), "node", "y", "x").select((F.col("node") * 2 + F.col("k")).alias("node"), "y", "x", "v")
    low = low.withColumnRenamed("node", "f")
    for level in reversed(range(levels)):
        cells = low.join(spatial.filter(F.col("level") == level).drop("level"), ["f", "y", "x"])
        four = F.array(*unlift_quad("v", "g", "b", "t"))
        low = cells.select("f", "y", "x", F.posexplode(four).alias("k", "v")).select("f", (F.col("y") * 2 + F.shiftright("k", 1)).alias("y"), (F.col("x") * 2 + F.col("k") % 2).alias("x"), "v")
    return low.select(F.col("f").alias("t"), "y", "x", "v")
