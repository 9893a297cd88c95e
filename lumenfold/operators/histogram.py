"""Histograms and their one-dimensional transport.

A histogram is long: key columns, ``level`` and a count ``n``; curves have
``levels`` levels. Running sums are taken on a dense grid of levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import floor_div, mass_q16


def histogram(df: DataFrame, keys, level: str = "level") -> DataFrame:
    return df.groupBy(*keys, F.col(level).alias("level")).agg(F.count("*").alias("n"))


def dense(hist: DataFrame, keys, levels: int) -> DataFrame:
    """Every level of every curve, 0 where the histogram has none."""
    grid = hist.select(*keys).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    return grid.join(hist, [*keys, "level"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cdf(hist: DataFrame, keys, levels: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return dense(hist, keys, levels).withColumn("cum", F.sum("n").over(w))


def masses(hist: DataFrame, keys) -> DataFrame:
    """Counts as Q16 shares of their curve, one half-up rounding each."""
    return hist.withColumn("mass", mass_q16("n", F.sum("n").over(Window.partitionBy(*keys))))


def soft_histogram(df: DataFrame, keys, value: str, width: int) -> DataFrame:
    """Each value splits a weight of ``width`` between its level and the next one."""
    low, frac = floor_div(value, width), F.pmod(F.col(value), F.lit(width))
    parts = F.array(F.struct(low.alias("level"), (width - frac).alias("n")), F.struct((low + 1).alias("level"), frac.alias("n")))
    return df.select(*keys, F.explode(parts).alias("p")).filter("p.n > 0").groupBy(*keys, F.col("p.level").alias("level")).agg(F.sum("p.n").alias("n"))


def distances(a: DataFrame, b: DataFrame, keys, levels: int) -> DataFrame:
    """Per key: total variation sum |n1 - n2| and W1 = sum |running difference|."""
    both = a.withColumn("_s", F.col("n")).unionByName(b.withColumn("_s", -F.col("n"))).groupBy(*keys, "level").agg(F.sum("_s").alias("n"))
    return cdf(both, keys, levels).groupBy(*keys).agg(F.sum(F.abs("n")).alias("tv"), F.sum(F.abs("cum")).alias("w1"))


def quantiles(hist: DataFrame, keys) -> DataFrame:
    """One row per unit of mass: its rank and its level. Ranks come from running sums, rows from one explode."""
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    start = hist.filter("n > 0").withColumn("_to", F.sum("n").over(w))
    return start.select(*keys, F.explode(F.sequence(F.col("_to") - F.col("n"), F.col("_to") - 1)).alias("rank"), F.col("level").alias("q"))


def transport(source: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Displacement of each rank. Pairs of unequal mass are refused: they give no rows."""
    mass = lambda h, name: h.groupBy(*keys).agg(F.sum("n").alias(name))
    equal = mass(source, "_a").join(mass(target, "_b"), keys).filter("_a = _b").select(*keys)
    s, t = quantiles(source, keys).withColumnRenamed("q", "qs"), quantiles(target, keys).withColumnRenamed("q", "qt")
    return s.join(t, [*keys, "rank"]).join(equal, keys, "left_semi").withColumn("d", F.col("qt") - F.col("qs"))


def pushforward(source: DataFrame, moves: DataFrame, keys, levels: int) -> DataFrame:
    """The histogram of source quantiles moved by ``d``; levels outside are dropped."""
    moved = quantiles(source, keys).join(moves.select(*keys, "rank", "d"), [*keys, "rank"]).withColumn("level", F.col("q") + F.col("d"))
    return histogram(moved.filter(F.col("level").between(0, levels - 1)), keys)


def barycenter(hist: DataFrame, group, member: str) -> DataFrame:
    """Per rank the floor mean of the members' quantiles, binned again."""
    q = quantiles(hist, [*group, member])
    mean = q.groupBy(*group, "rank").agg(F.sum("q").cast("long").alias("_s"), F.count("*").alias("_n")).withColumn("level", floor_div("_s", F.col("_n")))
    return histogram(mean, list(group))


def modes(hist: DataFrame, keys) -> DataFrame:
    """The most frequent level, the lowest on ties, and the disagreement: mass minus its count."""
    return hist.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("e"), "level"))["level"].alias("mode"), (F.sum("n") - F.max("n")).alias("disagreement"))


def entropies(hist: DataFrame, keys) -> DataFrame:
    """Plug-in entropy in bits and nats, and with the Miller-Madow correction."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    p = hist.filter("n > 0").withColumn("_t", total).withColumn("_p", F.col("n") / F.col("_t"))
    out = p.groupBy(*keys).agg(F.sum(-F.col("_p") * F.log2("_p")).alias("bits"), F.sum(-F.col("_p") * F.log("_p")).alias("nats"), F.count("*").alias("_k"), F.max("_t").alias("total"))
    return out.withColumn("corrected", F.col("nats") + (F.col("_k") - 1) / (2.0 * F.col("total"))).drop("_k")


def moments(hist: DataFrame, keys) -> DataFrame:
    """Standard deviation, span of occupied levels and tanh of the skewness."""
    m = hist.filter("n > 0").groupBy(*keys).agg(
        *[F.sum(F.col("n") * F.pow(F.col("level").cast("double"), F.lit(k))).alias(f"_{k}") for k in range(4)], (F.max("level") - F.min("level")).alias("span"))
    mean = F.col("_1") / F.col("_0")
    var = F.greatest(F.lit(0.0), F.col("_2") / F.col("_0") - mean * mean)
    third = F.col("_3") / F.col("_0") - 3 * mean * F.col("_2") / F.col("_0") + 2 * mean * mean * mean
    return m.select(*keys, F.sqrt(var).alias("std"), "span", F.when(var > 0, F.tanh(third / F.pow(var, 1.5))).otherwise(0.0).alias("skew"))


def apportion(df: DataFrame, keys, order, weight: str, total: str) -> DataFrame:
    """Largest-remainder shares of ``total`` by weight; ties to the first; an even split without weight."""
    w, every = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_i", F.row_number().over(every) - 1).withColumn("_w", F.sum(weight).over(w)).withColumn("_c", F.count("*").over(w))
    product = F.col(total) * F.col(weight)
    base = F.when(F.col("_w") > 0, F.call_function("div", product, F.greatest("_w", F.lit(1)))).otherwise(F.call_function("div", F.col(total), F.col("_c")))
    rem = F.when(F.col("_w") > 0, product % F.greatest("_w", F.lit(1))).otherwise(F.lit(0))
    d = d.withColumn("_b", base).withColumn("_r", rem).withColumn("_left", F.col(total) - F.sum("_b").over(w))
    d = d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_r"), "_i")))
    return d.withColumn("share", F.col("_b") + (F.col("_k") <= F.col("_left")).cast("int")).drop("_i", "_w", "_c", "_b", "_r", "_left", "_k")
