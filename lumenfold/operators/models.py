"""Small models: linear fits from aggregates, federated averaging, resampling, measures.

Fits are normal equations whose sums Spark aggregates, so data never gathers:
a fit of d features moves d * d numbers per group and task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import kernels


def linear_fit(rows: DataFrame, keys, features: list[str], target: str, ridge: float = 1e-6) -> DataFrame:
    """Ridge least squares with intercept per group: keys, weights (intercept first), n, loss, floor.

    floor is the mean squared error of predicting zero, which a fit must beat.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(target).cast("double")
    d = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"_{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(x[i] * y).alias(f"_y{i}") for i in range(d)]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y * y).alias("_yy"), *sums)

    def solve(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                a = np.array([[r[f"_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
                b = np.array([r[f"_y{i}"] for i in range(d)])
                w = np.linalg.solve(a + ridge * np.eye(d), b)
                loss = (r["_yy"] - 2 * w @ b + w @ a @ w) / r["n"]
                out.append((*[r[k] for k in keys], w.tolist(), r["n"], float(loss), r["_yy"] / r["n"]))
            yield pd.DataFrame(out, columns=[*keys, "weights", "n", "loss", "floor"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return g.mapInPandas(solve, f"{kinds}, weights array<double>, n long, loss double, floor double")


def federated_rounds(pairs: DataFrame, dim: int, rounds: int, steps: int = 4, rate: float = 0.5) -> list[float]:
    """Federated averaging of Bradley-Terry weights. pairs: user, yd (array<double>: label times feature difference).

    Each round every user takes ``steps`` local steps from the common weights,
    and the mean of their results (``dim`` numbers) is the next start.
    """
    spark = pairs.sparkSession
    theta = np.zeros(dim)
    users = pairs.groupBy("user").agg(F.collect_list("yd").alias("yd"))
    for _ in range(rounds):
        start = spark.sparkContext.broadcast(theta)

        def local(batches, start=start):
            for pdf in batches:
                out = []
                for rows in pdf["yd"]:
                    yd, w = np.stack([np.asarray(r, float) for r in rows]), start.value.copy()
                    for _ in range(steps):
                        w += rate * (yd / (1 + np.exp(yd @ w))[:, None]).mean(0)
                    out.append(w.tolist())
                yield pd.DataFrame({"w": out})

        w = users.mapInPandas(local, "w array<double>").select(F.posexplode("w").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("v")).orderBy("i").collect()
        theta = np.array([r["v"] for r in w])
    return theta.tolist()


def bootstrap_mean(rows: DataFrame, keys, value: str, row_id: str, resamples: int = 200) -> DataFrame:
    """Mean and its 2.5 and 97.5 percentiles by the Poisson bootstrap.

    Every row draws its multiplicity in each resample from a hash of its id,
    so resamples are plain sums and any partitioning gives the same.
    """
    r = rows.withColumn("_h", F.xxhash64(*keys, row_id)).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64("_h", "_b"), F.lit(1 << 30)) / float(1 << 30)
    count = sum((u > c).cast("int") for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
    m = r.withColumn("_k", count).groupBy(*keys, "_b").agg((F.sum(F.col("_k") * F.col(value)) / F.sum("_k")).alias("_m"))
    ends = m.groupBy(*keys).agg(F.percentile("_m", 0.025).alias("low"), F.percentile("_m", 0.975).alias("high"))
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean")).join(ends, list(keys))


def sample_triplets(plane: DataFrame, keys, seed: str) -> DataFrame:
    """anchor, positive (the right or lower neighbour) and a random negative of the frame for every cell.

    The negative is the cell whose rank by hash the anchor's own hash picks: one window and one join.
    """
    w = Window.partitionBy(*keys)
    p = plane.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), "y", "x"), "y", "x")) - 1)
    down = F.pmod(F.xxhash64(F.lit(seed), "x", "y"), F.lit(2))
    a = p.select(*keys, "y", "x", F.col("v").alias("anchor"), (F.col("y") + down).alias("_y"), (F.col("x") + 1 - down).alias("_x"), F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.col("_n")).cast("int").alias("_pick"))
    near = plane.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("positive"))
    far = p.select(*keys, F.col("_r").alias("_pick"), F.col("v").alias("negative"))
    return a.join(near, [*keys, "_y", "_x"]).join(far, [*keys, "_pick"]).select(*keys, "y", "x", "anchor", "positive", "negative")


def holonomy(maps: DataFrame, key: str, order: str, matrix: str, k: int) -> DataFrame:
    """(k - trace of the ordered product of k x k matrices) / k per loop."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        product = np.eye(k)
        for m in pdf.sort_values(order)[matrix]:
            product = product @ np.asarray(m, float).reshape(k, k)
        return pd.DataFrame({key: [keys[0]], "defect": [(k - float(np.trace(product))) / k]})

    return maps.groupBy(key).applyInPandas(run, f"{key} {maps.schema[key].dataType.simpleString()}, defect double")


def genome_dimension(genes: DataFrame, keys, vector: str) -> DataFrame:
    """tr(S)^2 / tr(S^2) of each group's centred vectors; 1 with fewer than two, or without spread."""
    g = genes.groupBy(*keys).agg(F.collect_list(vector).alias("_v"))

    @F.pandas_udf("double")
    def dimension(v: pd.Series) -> pd.Series:
        out = []
        for rows in v:
            x = np.stack([np.asarray(r, float) for r in rows])
            c = (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
            square = float((c * c).sum())
            out.append(1.0 if len(x) < 2 or square <= 1e-12 else float(np.trace(c)) ** 2 / square)
        return pd.Series(out)

    return g.select(*keys, dimension("_v").alias("dimension"))


def anchors(palette: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The palette with each wanted colour put, in order, in the nearest slot not yet taken."""
    out, free = palette.copy(), np.ones(len(palette), bool)
    for w in wanted[: len(palette)]:
        d = ((palette - w) ** 2).sum(1).astype(float)
        d[~free] = np.inf
        slot = int(d.argmin())
        out[slot], free[slot] = w, False
    return out


def gaussian_barycenter(covariances: list[np.ndarray], steps: int = 30) -> np.ndarray:
    """Covariance whose Bures distances to all are least: fixed-point steps from their mean."""

    def root(m, inverse=False):
        w, v = np.linalg.eigh(m)
        w = np.sqrt(np.maximum(w, 1e-12))
        return (v * (1 / w if inverse else w)) @ v.T

    s = sum(covariances) / len(covariances)
    for _ in range(steps):
        r, ri = root(s), root(s, True)
        t = sum(root(r @ c @ r) for c in covariances) / len(covariances)
        s = ri @ t @ t @ ri
    return s


def barycenters(frames: DataFrame, key: str, covariance: str, d: int) -> DataFrame:
    """Barycentre of each group's d x d covariances, flat; and its mean squared Bures distance to them."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = [np.asarray(c, float).reshape(d, d) for c in pdf[covariance]]
        s, zero = gaussian_barycenter(all_), np.zeros(d)
        far = float(np.mean([kernels.bures_squared(zero, s, zero, c) for c in all_]))
        return pd.DataFrame({key: [keys[0]], "barycenter": [s.ravel().tolist()], "spread": [far]})

    return frames.groupBy(key).applyInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, barycenter array<double>, spread double")


def octant_budget(weights: DataFrame, levels: int, budget: int) -> DataFrame:
    """weights: t, y, x (0 .. 2**levels - 1), w. Cells per voxel by splitting a budget among octants, level by level.

    Each pass is one largest-remainder apportionment of every open octant's
    cells among its eight children in Morton order.
    """
    from lumenfold.functions.arith import morton3
    from lumenfold.operators.histogram import apportion

    leaf = weights.select(morton3("x", "y", "t", levels).alias("m"), "w")
    share = leaf.sparkSession.range(1).select(F.col("id").alias("m"), F.lit(budget).cast("long").alias("cells"))
    for level in range(1, levels + 1):
        children = leaf.groupBy(F.shiftright("m", 3 * (levels - level)).alias("m")).agg(F.sum("w").alias("w"))
        open_ = share.filter("cells > 0").select(F.col("m").alias("parent"), "cells")
        j = children.withColumn("parent", F.shiftright("m", 3)).join(open_, "parent")
        share = apportion(j, ["parent"], ["m"], "w", "cells").select("m", F.col("share").cast("long").alias("cells"))
    return share.filter("cells > 0")
