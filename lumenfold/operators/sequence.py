"""Ordered operators: deltas, pooling by count, lifts, runs, as-of holds, differences.

``keys`` are the columns of a sequence, ``order`` gives its total order. Work is
partitioned by the keys and never needs more than one window a call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.functions.lift import DETAILS, lift_octant, lift_pair


def _window(keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


def numbered(df: DataFrame, keys, order, name: str = "i") -> DataFrame:
    """Add the position in its sequence, from 0."""
    return df.withColumn(name, F.row_number().over(_window(keys, order)) - 1)


def deltas(df: DataFrame, keys, order, value: str, name: str = "delta") -> DataFrame:
    """Differences to the row before; the first row of a sequence has none and is left out."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(_window(keys, order))).filter(F.col(name).isNotNull())


def pool_by_count(df: DataFrame, keys, order, value: str, block: int) -> DataFrame:
    """Sums of ``block`` rows after one another; an incomplete last block is dropped."""
    n = numbered(df, keys, order)
    return n.groupBy(*keys, trunc_div("i", block).alias("pool")).agg(F.sum(value).alias("total"), F.count("*").alias("_n")).filter(F.col("_n") == block).drop("_n")


def lift_pairs(df: DataFrame, keys, order, value: str) -> DataFrame:
    """One lift level: rows 2k and 2k+1 give (low, high); an odd last row is carried with high null."""
    n = numbered(df, keys, order)
    pair = n.groupBy(*keys, trunc_div("i", 2).alias("pair")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col(value))).alias("_x"), F.max(F.when(F.col("i") % 2 == 1, F.col(value))).alias("_y"))
    low, high = lift_pair("_x", "_y")
    return pair.select(*keys, "pair", F.coalesce(low, F.col("_x")).alias("low"), high.alias("high"))


def lift_octants(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Eight rows after one another as a 2x2x2 cell: coarse and seven details."""
    n = numbered(df, keys, order)
    lanes = [F.max(F.when(F.col("i") % 8 == k, F.col(value))).alias(f"_v{k}") for k in range(8)]
    cell = n.groupBy(*keys, trunc_div("i", 8).alias("cell")).agg(F.count("*").alias("_n"), *lanes).filter("_n = 8")
    bands = lift_octant([F.col(f"_v{k}") for k in range(8)])
    return cell.select(*keys, "cell", *[b.alias(c) for b, c in zip(bands, ("coarse", *DETAILS))])


def runs(df: DataFrame, keys, order, value: str) -> DataFrame:
    """Maximal runs of equal values: run number from 0, value, length."""
    w = _window(keys, order)
    new = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"))


def hold_last(df: DataFrame, keys, order, value: str, owned: Column, name: str = "held") -> DataFrame:
    """The value of the last owned row up to each row; 0 before the first."""
    w = _window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(F.when(owned, F.col(value)), ignorenulls=True).over(w), F.lit(0)))


def history(df: DataFrame, keys, order, value: str, n: int, name: str = "history") -> DataFrame:
    """The last ``n`` values up to each row, oldest first."""
    return df.withColumn(name, F.collect_list(value).over(_window(keys, order).rowsBetween(1 - n, 0)))


def keep_last(df: DataFrame, keys, order_desc, n: int) -> DataFrame:
    """The last ``n`` rows of each sequence (``order_desc``: newest first)."""
    return df.withColumn("_r", F.row_number().over(_window(keys, order_desc))).filter(F.col("_r") <= n).drop("_r")


def finite_differences(df: DataFrame, keys, order, value: str, depth: int) -> DataFrame:
    """Columns d1..d{depth}: repeated differences, null where a sequence is too short before a row."""
    w = _window(keys, order)
    terms = [F.lag(value, k).over(w) if k else F.col(value) for k in range(depth + 1)]
    for d in range(1, depth + 1):
        total, coefficient = F.lit(0), 1
        for k in range(d + 1):
            total = total + terms[k] * coefficient
            coefficient = -coefficient * (d - k) // (k + 1)
        df = df.withColumn(f"d{d}", total)
    return df


def certified_order(df: DataFrame, keys, order, value: str, cap: int) -> DataFrame:
    """Smallest k < cap whose (k+1)-th differences are all zero, else null; refused under cap + 2 rows."""
    d = finite_differences(df, keys, order, value, cap)
    zero = [F.coalesce(F.max(F.abs(f"d{k + 1}")), F.lit(0)) == 0 for k in range(cap)]
    found = F.coalesce(*[F.when(z, F.lit(k)) for k, z in enumerate(zero)])
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), found.alias("_k"))
    return out.select(*keys, "n", (F.col("n") < cap + 2).alias("refused"), F.when(F.col("n") >= cap + 2, F.col("_k")).alias("k"))


def timing(df: DataFrame, keys, order, ts_us: str, target_us: int) -> DataFrame:
    """Count, duration and intervals of each burst; zeros with fewer than two rows."""
    w = _window(keys, order)
    d = df.withColumn("_t", F.col(ts_us)).withColumn("_d", F.col("_t") - F.lag("_t").over(w))
    agg = d.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.max("_t") - F.min("_t")).alias("_duration"), F.avg("_d").alias("_mean"), F.stddev_pop("_d").alias("_std"),
        F.min("_d").alias("_low"), F.max("_d").alias("_high"), F.max(F.abs(F.col("_d") - target_us)).alias("_worst"))
    zero = lambda c, kind: F.when(F.col("n") >= 2, F.col(c)).otherwise(0).cast(kind).alias(c[1:])
    return agg.select(*keys, "n", *[zero(c, k) for c, k in (("_duration", "long"), ("_mean", "double"), ("_std", "double"), ("_low", "long"), ("_high", "long"), ("_worst", "long"))])


def comovement(df: DataFrame, keys, order, a: str, b: str) -> DataFrame:
    """Permille of consecutive steps on which both series move the same way; 1000 without a step."""
    w = _window(keys, order)
    step = lambda c: F.signum((F.col(c) - F.lag(c).over(w)).cast("double"))
    d = df.withColumn("_a", step(a)).withColumn("_b", step(b))
    agree, total = F.count_if(F.col("_a") == F.col("_b")), F.count("_a")
    return d.groupBy(*keys).agg(F.when(total > 0, trunc_div(agree * 1000, F.greatest(total, F.lit(1)))).otherwise(1000).cast("long").alias("permille"))


def box_histogram(voxels: DataFrame, nt: int, ny: int, nx: int, dt: int, dy: int, dx: int, levels: int) -> DataFrame:
    """t, y, x, ch, level, n: how often each coarse voxel and channel of (t, y, x, ch, v) holds each level.

    The sides must divide; a level out of range is an error.
    """
    if nt % dt or ny % dy or nx % dx or not 0 < levels <= 256:
        raise ValueError(f"{nt} x {ny} x {nx} cannot be cut by {dt} x {dy} x {dx} with {levels} levels")
    level = F.when((F.col("v") >= 0) & (F.col("v") < levels), F.col("v")).otherwise(F.raise_error(F.lit("a level is out of range")).cast("int"))
    cell = [trunc_div(c, n).alias(c) for c, n in (("t", dt), ("y", dy), ("x", dx))]
    return voxels.groupBy(*cell, "ch", level.alias("level")).agg(F.count("*").alias("n"))
