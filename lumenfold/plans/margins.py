"""Queries on exact inverses, reversible reduction, fitted cells and margins over the floor."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.operators import pools, volume
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PIXELS_SQL, pixels, table

LIGHT_SQL = "CASE WHEN {v} / 255.0::DOUBLE <= 0.04045 THEN {v} / 255.0::DOUBLE / 12.92 ELSE pow(({v} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"


@query("transfer_inverse", f"WITH e AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE floor(({LIGHT_SQL.format(v='(v - 0.5)')}) * 65535 + 0.5) END AS edge FROM generate_series(0, 255) g(v)), p AS (SELECT p_partkey AS id, (p_partkey * 7919 + p_size * 104729) % 65536 AS light FROM part) SELECT id, light, max(v)::INTEGER AS code FROM p JOIN e ON edge <= light GROUP BY id, light")
def transfer_inverse(spark, d):
    """Linear light to 8-bit codes, by boundaries halfway between codes."""
    light = (F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 65536
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), light.alias("light"), pools.linear16_to_srgb8(light).cast("int").alias("code"))


#: A cube of 8 x 8 x 8 for every 512 parts; parts that lack count 0.
CUBE_SQL = "k AS (SELECT DISTINCT p_partkey // 512 AS c FROM part), cube AS (SELECT c * 8 + i // 64 AS t, i // 8 % 8 AS y, i % 8 AS x, coalesce((p_partkey * 37 + p_size * 11) % 256, 0)::BIGINT AS v FROM k CROSS JOIN generate_series(0, 511) g(i) LEFT JOIN part ON p_partkey = c * 512 + i)"
LOW = "({y} + (({x} - {y}) >> 1))"
QUAD = LOW.format(x=LOW.format(x="max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 0)", y="max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 1)"), y=LOW.format(x="max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 0)", y="max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 1)"))
PAIR = LOW.format(x="max(v) FILTER (WHERE t % 2 = 0)", y="max(v) FILTER (WHERE t % 2 = 1)")


@query("voxel_reduce", f"WITH {CUBE_SQL}, s1 AS (SELECT t, y // 2 AS y, x // 2 AS x, {QUAD} AS v FROM cube GROUP BY t, cube.y // 2, cube.x // 2), s2 AS (SELECT t, y // 2 AS y, x // 2 AS x, {QUAD} AS v FROM s1 GROUP BY t, s1.y // 2, s1.x // 2), t1 AS (SELECT t // 2 AS t, y, x, {PAIR} AS v FROM s2 GROUP BY s2.t // 2, y, x) SELECT t // 2 AS t, y, x, {PAIR}::BIGINT AS v FROM t1 GROUP BY t1.t // 2, y, x")
def voxel_reduce(spark, d):
    """Cubes of the parts at a quarter of each side: the substrate that the bands expand again."""
    p = F.col("p_partkey")
    part = table(spark, d, "part").select(trunc_div(p, 512).alias("c"), (p % 512).alias("i"), ((p * 37 + F.col("p_size") * 11) % 256).cast("long").alias("v"))
    grid = part.select("c").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(511)).cast("array<bigint>")))
    cube = grid.join(part, ["c", "i"], "left").select((F.col("c") * 8 + trunc_div("i", 64)).alias("t"), (trunc_div("i", 8) % 8).alias("y"), (F.col("i") % 8).alias("x"), F.coalesce("v", F.lit(0)).alias("v"))
    return volume.voxel_reduce(cube, 2)[0].select("t", "y", "x", "v")


#: Cells of a frame: a floor, a target, and a basis that a budget scales.
CELLS_SQL = f"WITH {PIXELS_SQL}, c AS (SELECT frame, idx, l AS floor, (idx % 4) * (1 + idx % 3) AS basis, l + 3 * (idx % 4) * (1 + idx % 3) + a // 64 AS target FROM pixels), f AS (SELECT frame, coalesce(sum((target - floor) * basis)::DOUBLE / nullif(sum(basis * basis), 0), 0) AS theta FROM c GROUP BY frame), n AS (SELECT c.*, theta, floor + round_even(theta * basis, 0)::BIGINT AS cell FROM c JOIN f USING (frame))"


def _cells(spark, d):
    """frame, idx, floor, basis, target, theta and cell: the floor moved by the fitted multiple of its basis."""
    i = F.col("idx")
    basis = (i % 4) * (1 + i % 3)
    c = pixels(spark, d).select("frame", "idx", F.col("l").alias("floor"), basis.alias("basis"), (F.col("l") + 3 * basis + trunc_div("a", 64)).alias("target"))
    squares = F.sum(F.col("basis") * F.col("basis"))
    theta = F.when(squares > 0, F.sum((F.col("target") - F.col("floor")) * F.col("basis")).cast("double") / squares).otherwise(0.0)
    fitted = c.groupBy("frame").agg(theta.alias("theta"))
    return c.join(fitted, "frame").withColumn("cell", F.col("floor") + F.rint(F.col("theta") * F.col("basis")).cast("long"))


@query("conditioned_fit", f"{CELLS_SQL} SELECT frame, round(any_value(theta), 6) AS theta, sum(cell)::BIGINT AS cells, count(*) FILTER (WHERE basis = 0 AND cell <> floor) AS moved FROM n GROUP BY frame")
def conditioned_fit(spark, d):
    """The multiple of its basis that brings each frame's cells nearest to their targets, and the moved cells; no budget moves nothing."""
    return _cells(spark, d).groupBy("frame").agg(F.round(F.first("theta"), 6).alias("theta"), F.sum("cell").alias("cells"), F.count_if((F.col("basis") == 0) & (F.col("cell") != F.col("floor"))).alias("moved"))


@query("floor_margins", f"{CELLS_SQL}, m AS (SELECT frame, sum((cell - target) * (cell - target))::BIGINT AS held, sum((floor - target) * (floor - target))::BIGINT AS base, avg(CASE WHEN round_even(theta * basis / 1024.0, 0) <> 0 THEN 1.0 ELSE 0.0 END) AS share FROM n GROUP BY frame) SELECT frame, held, base, base - held AS margin, held < 0.98 * base AS beats, round(share, 6) AS surviving FROM m")
def floor_margins(spark, d):
    """Losses of the fitted cells and of the floor, whether two hundredths are won, and the share of details that rounding leaves."""
    c = _cells(spark, d)
    square = lambda x: (F.col(x) - F.col("target")) * (F.col(x) - F.col("target"))
    stays = F.rint(F.col("theta") * F.col("basis") / 1024.0) != 0
    m = c.groupBy("frame").agg(F.sum(square("cell")).alias("held"), F.sum(square("floor")).alias("base"), F.avg(F.when(stays, 1.0).otherwise(0.0)).alias("share"))
    return m.select("frame", "held", "base", (F.col("base") - F.col("held")).alias("margin"), (F.col("held") < 0.98 * F.col("base")).alias("beats"), F.round("share", 6).alias("surviving"))
