"""Nearest-colour joins, palettes and palette statistics.

The palette of a frame is at most 256 rows, so it travels as one array per
frame and is searched inside the row: pixels are joined by an equi-join on the
frame and never multiplied by the palette.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import _col, isqrt, trunc_div

LANES = ("l", "a", "b")
MAX_SLOTS = 256


def dist2(p, q) -> Column:
    """Squared distance of two (l, a, b) structs."""
    return sum((p[c] - q[c]) * (p[c] - q[c]) for c in LANES)


def palette_arrays(palette: DataFrame, keys=("frame",)) -> DataFrame:
    """One row per key: its palette as an array of (slot, l, a, b) by slot."""
    return palette.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", *LANES))).alias("palette"))


def _ranked(palette: Column, pixel: Column, penalty=None) -> Column:
    def score(p):
        d = dist2(p, pixel)
        return F.struct((d if penalty is None else d - penalty(p)).alias("d"), p["slot"].alias("slot"))

    return F.transform(palette, score)


def nearest(pixels: DataFrame, palette: DataFrame, keys=("frame",), penalty=None) -> DataFrame:
    """Add slot and d2 of the nearest colour; ties go to the lowest slot.

    penalty: a function of a palette entry that is taken off its distance.
    """
    p = pixels.join(palette_arrays(palette, keys), list(keys))
    best = F.array_min(_ranked(F.col("palette"), F.struct(*LANES), penalty))
    return p.withColumn("_m", best).withColumn("slot", F.col("_m.slot")).withColumn("d2", F.col("_m.d")).drop("_m", "palette")


def two_nearest(pixels: DataFrame, palette: DataFrame, keys=("frame",)) -> DataFrame:
    """Add the two nearest slots, first and second; a palette of one colour gives it twice."""
    p = pixels.join(palette_arrays(palette, keys), list(keys))
    s = F.array_sort(_ranked(F.col("palette"), F.struct(*LANES)))
    p = p.withColumn("_s", s)
    return p.withColumn("first", F.element_at("_s", 1)["slot"]).withColumn("second", F.element_at("_s", F.least(F.lit(2), F.size("_s")))["slot"]).drop("_s", "palette")


def within_tolerance(pixels: DataFrame, palette: DataFrame, tolerance, keys=("frame",)) -> DataFrame:
    """The lowest slot whose distance is within ``tolerance`` of the least."""
    p = pixels.join(palette_arrays(palette, keys), list(keys)).withColumn("_r", _ranked(F.col("palette"), F.struct(*LANES)))
    least = F.array_min(F.transform("_r", lambda x: x["d"]))
    p = p.withColumn("_least", least)
    return p.withColumn("slot", F.array_min(F.transform(F.filter("_r", lambda x: x["d"] <= F.col("_least") + tolerance), lambda x: x["slot"]))).drop("_r", "_least", "palette")


def look_up(indices: DataFrame, palette: DataFrame, keys=("frame",)) -> DataFrame:
    """palette[slot] of each index; a frame with an index that its palette lacks is refused whole."""
    bad = indices.join(palette.select(*keys, "slot"), [*keys, "slot"], "left_anti").select(*keys).distinct()
    return indices.join(palette, [*keys, "slot"]).join(bad, list(keys), "left_anti")


def value_delta(now: DataFrame, later: DataFrame, keys) -> DataFrame:
    """Differences of colours by key, a missing side counting as 0."""
    a, b = now.select(*keys, *[F.col(c).alias(f"_{c}") for c in LANES]), later.select(*keys, *LANES)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, list(keys), "full").select(*keys, *[(zero(c) - zero(f"_{c}")).alias(f"d{c}") for c in LANES])


def policy_delta(now: DataFrame, later: DataFrame, keys, value: str = "slot") -> DataFrame:
    """Positions whose value changes: old and new."""
    j = now.select(*keys, F.col(value).alias("old")).join(later.select(*keys, F.col(value).alias("new")), list(keys))
    return j.filter("old <> new")


def policy_apply(now: DataFrame, delta: DataFrame, keys, value: str = "slot") -> DataFrame:
    """The value of every position after a delta (``keys``, new): positions without one keep theirs."""
    return now.join(delta.select(*keys, "new"), list(keys), "left").select(*keys, F.coalesce("new", value).alias(value))


def cluster_stats(assigned: DataFrame, keys) -> DataFrame:
    """Per slot: count, truncated mean and integer standard deviation of each lane, in two passes."""
    means = assigned.groupBy(*keys).agg(F.count("*").alias("n"), *[trunc_div(F.sum(c), F.count("*")).alias(f"mean_{c}") for c in LANES])
    j = assigned.join(means, list(keys))
    spread = j.groupBy(*keys).agg(*[isqrt(trunc_div(F.sum((F.col(c) - F.col(f"mean_{c}")) * (F.col(c) - F.col(f"mean_{c}"))), F.count("*"))).alias(f"std_{c}") for c in LANES])
    return means.join(spread, list(keys))


def covariance(df: DataFrame, keys, weight=None) -> DataFrame:
    """Weighted mean and covariance (population) of three lanes."""
    w = _col(1.0 if weight is None else weight).cast("double")
    lanes = [F.col(c).cast("double") for c in LANES]
    sums = [F.sum(w).alias("w"), *[F.sum(w * x).alias(f"m_{c}") for c, x in zip(LANES, lanes)]]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums += [F.sum(w * lanes[i] * lanes[j]).alias(f"s_{LANES[i]}{LANES[j]}") for i, j in pairs]
    g = df.groupBy(*keys).agg(*sums)
    means = [(F.col(f"m_{c}") / F.col("w")).alias(f"m_{c}") for c in LANES]
    covs = [(F.col(f"s_{LANES[i]}{LANES[j]}") / F.col("w") - F.col(f"m_{LANES[i]}") * F.col(f"m_{LANES[j]}") / (F.col("w") * F.col("w"))).alias(f"c_{LANES[i]}{LANES[j]}") for i, j in pairs]
    return g.select(*keys, "w", *means, *covs)


def grid_layout(colors: DataFrame, x, y, side: int, keys=()) -> DataFrame:
    """Place side * side colours, of each group of ``keys``: chunks by x (ties: idx), each ordered by y (ties: idx). Adds col and row."""
    by_x = Window.partitionBy(*keys).orderBy(x, "idx")
    c = colors.withColumn("col", trunc_div(F.row_number().over(by_x) - 1, side).cast("int"))
    return c.withColumn("row", (F.row_number().over(Window.partitionBy(*keys, "col").orderBy(y, "idx")) - 1).cast("int"))


def pool_blocks(pixels: DataFrame, keys, block: int, values) -> DataFrame:
    """Sums over block x block cells of (x, y): sums compose, so pyramids pool the sums again."""
    return pixels.groupBy(*keys, trunc_div("x", block).alias("x"), trunc_div("y", block).alias("y")).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
