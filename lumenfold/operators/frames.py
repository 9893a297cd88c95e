"""Frame kernels as grouped operators: one group is one frame of a few thousand pixels.

For a point set larger than a task holds, ``cluster_large`` runs the same
assignment and mean steps as aggregations over the whole table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import kernels
from lumenfold.functions.arith import trunc_div
from lumenfold.operators.assign import LANES, nearest


def _points(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[list(LANES)].to_numpy(np.int64)


def quantize_frames(pixels: DataFrame, k: int, lloyd: int = 0, least: int = 0, key: str = "frame") -> DataFrame:
    """Per frame a palette of ``k`` (fewer for smaller frames) and each pixel's slot; ``least`` fills poor slots.

    Adds slot and the colour of the slot (cl, ca, cb).
    """

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        px = _points(pdf)
        c, slot = kernels.quantize(px, min(k, len(px)), lloyd)
        if least:
            slot = kernels.fill(px, c, slot, min(least, len(px) // len(c)))
        return pdf.assign(slot=slot.astype(np.int32), cl=c[slot, 0], ca=c[slot, 1], cb=c[slot, 2])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pixels.schema)
    return pixels.groupBy(key).applyInPandas(run, f"{kinds}, slot int, cl long, ca long, cb long")


def dither_frames(pixels: DataFrame, k: int, side: int, mode: str = "floyd-steinberg", key: str = "frame") -> DataFrame:
    """frame, idx, slot of every pixel; a frame has rows of ``side`` pixels, as many as it needs, the last may be short.

    mode: floyd-steinberg, atkinson, or threshold (a tile of blue noise).
    """
    noise = kernels.blue_noise(16) if mode == "threshold" else None

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        px = _points(pdf)
        c, _ = kernels.quantize(px, min(k, len(px)))
        if mode == "threshold":
            i = np.arange(len(px))
            mask = noise[i // side % len(noise), i % side % len(noise)]
            slot = kernels.threshold_dither(px, c, mask)
        else:
            slot = kernels.diffuse_rows(px, c, side, kernels.FLOYD_STEINBERG if mode == "floyd-steinberg" else kernels.ATKINSON)
        return pdf[[key, "idx"]].assign(slot=slot.astype(np.int32))

    return pixels.groupBy(key).applyInPandas(run, f"{key} {pixels.schema[key].dataType.simpleString()}, idx long, slot int")


def median_cut_frames(pixels: DataFrame, levels: int, key: str = "frame") -> DataFrame:
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        return pdf[[key, "idx"]].assign(leaf=kernels.median_cut(_points(pdf), levels).astype(np.int32))

    return pixels.groupBy(key).applyInPandas(run, f"{key} {pixels.schema[key].dataType.simpleString()}, idx long, leaf int")


def cluster_large(pixels: DataFrame, seeds: DataFrame, rounds: int, weight: str | None = None) -> DataFrame:
    """Lloyd steps over a table of any size. seeds: slot, l, a, b (at most 256). Truncated (weighted) means; an empty slot stays."""
    w = F.lit(1) if weight is None else F.col(weight)
    spark = pixels.sparkSession
    points = pixels.withColumn("g", F.lit(0))
    c = [tuple(r) for r in seeds.select("slot", *LANES).orderBy("slot").collect()]  # at most 256 rows
    for _ in range(rounds):
        table = spark.createDataFrame([(0, *r) for r in c], "g int, slot int, l long, a long, b long")
        means = nearest(points, table, ("g",)).groupBy("slot").agg(*[trunc_div(F.sum(F.col(x) * w), F.sum(w)).alias(x) for x in LANES]).collect()
        new = {r["slot"]: tuple(r) for r in means}
        c = [new.get(r[0], r) for r in c]
    return spark.createDataFrame(c, "slot int, l long, a long, b long")


def sinkhorn_frames(pairs: DataFrame, epsilon: float, rounds: int) -> DataFrame:
    """pairs: pair, side (0 or 1), x (array<double>), w. Debiased transport cost of each pair."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = [pdf[pdf["side"] == s] for s in (0, 1)]
        x, y = (np.stack(s["x"].to_numpy()) for s in side)
        p, q = (s["w"].to_numpy(float) / s["w"].sum() for s in side)
        return pd.DataFrame({"pair": [keys[0]], "cost": [kernels.sinkhorn_divergence(x, y, p, q, epsilon, rounds)]})

    return pairs.groupBy("pair").applyInPandas(run, "pair long, cost double")


def fed_average(updates: DataFrame, keys=("model",)) -> DataFrame:
    """Mean of users' weight vectors, component by component."""
    p = updates.select(*keys, F.posexplode("weights").alias("i", "w"))
    m = p.groupBy(*keys, "i").agg(F.avg("w").alias("w"))
    return m.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"]).alias("weights"))


def gene_ids(rows: DataFrame, payload: str, parents: str) -> DataFrame:
    """Content address of each row: FNV-1a over length-prefixed words."""

    @F.pandas_udf("long")
    def address(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([kernels.gene_hash(a, b) for a, b in zip(p, q)], dtype="int64")

    return rows.withColumn("gene_id", address(payload, parents))


def chain_hashes(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """Hash chain per key: each link hashes its number, the hash before and its payload."""

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        prev, out = 0, []
        for i, v in enumerate(pdf[payload]):
            prev = kernels.gene_hash([i, int(v)], [prev])
            out.append(prev)
        return pdf[[key, order]].assign(link=np.array(out, np.int64))

    s = rows.schema
    return rows.groupBy(key).applyInPandas(run, f"{key} {s[key].dataType.simpleString()}, {order} {s[order].dataType.simpleString()}, link long")


def synthetic_burst(spark, seed: int, frames: int, side: int, parallelism: int = 8) -> DataFrame:
    """t, y, x, v of a stateless synthetic burst: a triangle wave over frames plus grain by position."""

    def run(batches):
        for pdf in batches:
            i = pdf["id"].to_numpy(np.uint64)
            z = kernels.splitmix64(seed, 1)[0] ^ (i * np.uint64(0x9E3779B97F4A7C15))
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            grain = (z >> np.uint64(58)).astype(np.int64)
            n = i.astype(np.int64)
            t, y, x = n // (side * side), n // side % side, n % side
            wave = np.abs((t * 8) % 256 - 128)
            yield pd.DataFrame({"t": t.astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": wave + x + y + grain})

    return spark.range(0, frames * side * side, 1, parallelism).mapInPandas(run, "t int, y int, x int, v long")


def two_nn_dimension(points: DataFrame, keys, idx: str, vector: str, limit: int = 1000) -> DataFrame:
    """TwoNN intrinsic dimension per group from every (n div ``limit``)-th point by id: the reference's subsample over the whole group."""
    every = Window.partitionBy(*keys)
    step = F.greatest(F.lit(1), F.expr(f"_n div {limit}"))
    p = points.withColumn("_r", F.row_number().over(every.orderBy(idx)) - 1).withColumn("_n", F.count("*").over(every)).filter(F.col("_r") % step == 0)
    groups = p.groupBy(*keys).agg(F.collect_list(vector).alias("_v"))

    @F.pandas_udf("double")
    def estimate(v: pd.Series) -> pd.Series:
        out = []
        for rows in v:
            x = np.unique(np.stack([np.asarray(r, float) for r in rows]), axis=0)
            if len(x) < 3:
                out.append(float("nan"))
                continue
            d = np.sqrt(np.maximum(0, ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)))
            near = np.sort(d, 1)[:, 1:3]
            mu = np.log(near[:, 1] / np.maximum(near[:, 0], 1e-300))
            out.append(len(mu) / mu.sum() if mu.sum() > 0 else float("nan"))
        return pd.Series(out)

    return groups.select(*keys, estimate("_v").alias("dimension"))


def per_group(df: DataFrame, key: str, schema: str, kernel) -> DataFrame:
    """Apply ``kernel(key value, pandas frame) -> rows`` to each group; rows are tuples in the order of ``schema``."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(kernel(keys[0], pdf)), columns=names)

    return df.groupBy(key).applyInPandas(run, schema)


def moment_cells(pixels: DataFrame, bins: int, key: str = "frame") -> DataFrame:
    """Moments of each cell of a colour grid of ``bins`` an axis: key, i, j, k, n, sl, sa, sb, sq. Counted by Spark."""
    axis = lambda c, low: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) + low) * bins / 65536.0))).cast("int")
    x = [F.col(c) / 65536.0 for c in LANES]
    cells = pixels.groupBy(key, axis("l", 0).alias("i"), axis("a", 32768).alias("j"), axis("b", 32768).alias("k"))
    return cells.agg(F.count("*").cast("double").alias("n"), *[F.sum(v).alias(f"s{c}") for c, v in zip(LANES, x)], F.sum(sum(v * v for v in x)).alias("sq"))


def variance_quantize(pixels: DataFrame, k: int, bins: int = 16, key: str = "frame") -> DataFrame:
    """Boxes of most spread cut greedily on the prefix sums of the moment grid: key, slot, n, ml, ma, mb; empty slots pad to k."""

    def cut(keys, pdf):
        grid = np.zeros((bins, bins, bins, 5))
        grid[pdf["i"], pdf["j"], pdf["k"]] = pdf[["n", "sl", "sa", "sb", "sq"]].to_numpy()
        boxes = kernels.variance_boxes(grid, k)
        for slot in range(k):
            m = np.zeros(5)
            if slot < len(boxes):
                (i0, i1), (j0, j1), (k0, k1) = boxes[slot]
                m = grid[i0:i1, j0:j1, k0:k1].sum((0, 1, 2))
            yield (int(keys), slot, int(round(m[0])), *(m[1:4] / m[0] if m[0] else m[1:4]))

    return per_group(moment_cells(pixels, bins, key), key, f"{key} long, slot int, n long, ml double, ma double, mb double", cut)
