"""Entropies, spectra and dimensions of point sets, as aggregations and joins.

Pairwise distances are taken of at most ``limit`` points a group, every (n div
limit)-th one by id, which is what these estimators are defined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def subsample(points: DataFrame, keys, idx: str, limit: int = 1000) -> DataFrame:
    """Every (n div ``limit``)-th point of each group by id."""
    every = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.call_function("div", F.col("_n"), F.lit(limit)))
    p = points.withColumn("_r", F.row_number().over(every.orderBy(idx)) - 1).withColumn("_n", F.count("*").over(every))
    return p.filter(F.col("_r") % step == 0).drop("_r", "_n")


def euclid(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def sorted_distances(points: DataFrame, keys, idx: str, vector: str, limit: int = 1000) -> DataFrame:
    """keys, idx and ``near``: the sorted distances to all other points of the subsample."""
    s = subsample(points.select(*keys, F.col(idx).alias("_i"), F.col(vector).cast("array<double>").alias("_v")), keys, "_i", limit)
    everyone = s.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_v")).alias("_all"))  # limit points a group, twice that at most
    others = F.filter("_all", lambda q: q["_i"] != F.col("_i"))
    return s.join(everyone, list(keys)).select(*keys, F.col("_i").alias(idx), F.array_sort(F.transform(others, lambda q: euclid(F.col("_v"), q["_v"]))).alias("near"))


def likelihood_dimension(near: DataFrame, keys, k: int) -> DataFrame:
    """Levina and Bickel: (k - 1) over the summed logs of the k-th distance to the nearer ones, averaged over points."""
    edge = F.element_at("near", k)
    terms = F.aggregate(F.filter(F.slice("near", 1, k - 1), lambda r: r > 1e-12), F.lit(0.0), lambda s, r: s + F.log(edge / r))
    points = near.filter(F.size("near") >= k).select(*keys, F.when(terms > 0, (k - 1) / terms).alias("_d"))
    return points.groupBy(*keys).agg(F.avg("_d").alias("dimension"))


#: Halvings of the largest distance at which pairs are counted, and the share of pairs that counts as scaling.
RADII = tuple(0.5 * i for i in range(1, 13))
SCALING = (0.02, 0.8)


def correlation_dimension(near: DataFrame, keys) -> DataFrame:
    """Grassberger and Procaccia: slope of the log share of pairs within r over log r, in the scaling region."""
    most = near.groupBy(*keys).agg(F.max(F.array_max("near")).alias("_m"))
    radii = F.array(*[F.col("_m") * 2.0**-e for e in RADII])
    counted = near.join(most, list(keys)).select(*keys, F.explode(F.transform(radii, lambda r: F.struct(r.alias("r"), F.size(F.filter("near", lambda d: d < r)).alias("n")))).alias("c"), F.size("near").alias("all"))
    share = counted.groupBy(*keys, F.col("c.r").alias("r")).agg((F.sum("c.n") / F.sum("all")).alias("c"))
    inside = share.filter((F.col("c") > SCALING[0]) & (F.col("c") < SCALING[1]))
    return inside.groupBy(*keys).agg(F.when(F.count("*") >= 2, F.regr_slope(F.log("c"), F.log("r"))).alias("dimension"))


def participation(points: DataFrame, keys, vector: str, width: int) -> DataFrame:
    """Participation ratio of the principal components of the standardised vectors.

    The squared trace over the squared norm of the correlation matrix, which is
    that ratio of its eigenvalues.
    """
    x = [F.col(vector)[i].cast("double") for i in range(width)]
    corr = [F.coalesce(F.corr(x[i], x[j]), F.lit(0.0)) for i in range(width) for j in range(i)]
    active = sum((F.stddev_pop(c) > 1e-9).cast("int") for c in x)
    g = points.groupBy(*keys).agg(active.alias("_a"), sum(c * c for c in corr).alias("_c"))
    return g.select(*keys, F.when(F.col("_a") > 0, F.col("_a") * F.col("_a") / (F.col("_a") + 2 * F.col("_c"))).otherwise(0.0).alias("ratio"))


def mean_spacing(near: DataFrame, keys) -> DataFrame:
    """Mean distance to the nearest other point; 0 for a single point."""
    return near.groupBy(*keys).agg(F.avg(F.coalesce(F.get("near", 0), F.lit(0.0))).alias("spacing"))


def dft_power(values: Column) -> Column:
    """Power of every frequency of an array, by the definition of the transform."""
    n = F.size(values)
    turn = lambda k, i: k * i * (-2.0 * 3.141592653589793) / n

    def part(k, wave):
        return F.aggregate(F.transform(values, lambda x, i: x * wave(turn(k, i))), F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.pow(part(k, F.cos), F.lit(2)) + F.pow(part(k, F.sin), F.lit(2)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def spectral_entropy(power: Column) -> Column:
    """Entropy of the share of each frequency but 0; 0 without any power."""
    ac = F.slice(power, 2, F.greatest(F.size(power) - 1, F.lit(0)))
    total = _sum(ac)
    return F.when(total > 1e-12, -_sum(F.transform(ac, lambda a: F.when(a > 0, a / total * F.log(a / total)).otherwise(0.0)))).otherwise(0.0)


def entropy_rate(power: Column) -> Column:
    """Half of ln(2 pi e) plus half the mean log power of the frequencies but 0; 0 without any power."""
    ac = F.slice(power, 2, F.greatest(F.size(power) - 1, F.lit(0)))
    return F.when(_sum(ac) > 1e-12, 0.5 * F.log(F.lit(2 * 3.141592653589793 * 2.718281828459045)) + _sum(F.transform(ac, lambda a: F.log(F.greatest(a, F.lit(1e-12))))) / (2 * F.size(ac))).otherwise(0.0)


def eigenvalues3(xx, xy, xz, yy, yz, zz) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix, largest first, by the cosine formula."""
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    spread = F.sqrt(((xx - mean) * (xx - mean) + (yy - mean) * (yy - mean) + (zz - mean) * (zz - mean) + 2 * off) / 6)
    a, b, c, p = xx - mean, yy - mean, zz - mean, F.greatest(spread, F.lit(1e-300))
    det = (a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (p * p * p)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), det / 2))) / 3
    third = 2 * 3.141592653589793 / 3
    one, three = mean + 2 * spread * F.cos(angle), mean + 2 * spread * F.cos(angle + third)
    return one, 3 * mean - one - three, three
