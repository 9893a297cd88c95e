"""Meta-initialisation of a linear head over many captures, by first-order outer steps.

A capture's squared loss depends on its pairs only through n, X'X, X'y and y'y:
Spark sums these once, and no later round reads the pairs again. Inner descent
from the common start then works on one small matrix a capture, many captures at
once in Arrow batches; an outer step moves the start a part of the way to the mean
of the adapted weights, which is one aggregation of a row a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sufficient(pairs: DataFrame, key: str, features: list[Column], target: Column) -> DataFrame:
    """key, n, xx (row by row), xy and yy of each capture; pairs with a null are left out."""
    d = len(features)
    names = [f"_x{i}" for i in range(d)]
    rows = pairs.select(F.col(key).alias("capture"), *[f.cast("double").alias(n) for f, n in zip(features, names)], target.cast("double").alias("_y")).dropna()
    sums = rows.groupBy("capture").agg(
        F.count("*").alias("n"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_{i}_{j}") for i in range(d) for j in range(i, d)],
        *[F.sum(F.col(n) * F.col("_y")).alias(f"_{i}_y") for i, n in enumerate(names)], F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )
    xx = F.array(*[F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(d) for j in range(d)])
    return sums.select("capture", "n", xx.alias("xx"), F.array(*[F.col(f"_{i}_y") for i in range(d)]).alias("xy"), "yy")


def _arrays(batch: pa.RecordBatch, d: int):
    flat = lambda c: batch.column(c).flatten().to_numpy()
    return batch.column("n").to_numpy().astype(float), flat("xx").reshape(-1, d, d), flat("xy").reshape(-1, d), batch.column("yy").to_numpy()


def descend(start: np.ndarray, n, xx, xy, steps: int, eta: float) -> np.ndarray:
    """Weights of every capture after ``steps`` steps of size ``eta`` down half its mean squared error."""
    w = np.broadcast_to(start, xy.shape).copy()
    for _ in range(steps):
        w = w - eta * (np.einsum("cij,cj->ci", xx, w) - xy) / n[:, None]
    return w


def _summed(stats: DataFrame, d: int, of: Callable) -> np.ndarray:
    """The sum over captures of of(n, xx, xy, yy), an array of a row a capture; each task sends one row."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of(*_arrays(batch, d)).sum(0)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["at", "v"])

    rows = stats.select("n", "xx", "xy", "yy").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([r["v"] for r in rows])


def reptile(stats: DataFrame, d: int, outer: int, inner: int, eta: float, epsilon: float) -> np.ndarray:
    """The start after ``outer`` rounds from zero; zero if there are no captures. stats: a stored table of :func:`sufficient`."""
    start = np.zeros(d)
    count = stats.count()
    for _ in range(outer if count else 0):
        held = start
        adapted = _summed(stats, d, lambda n, xx, xy, yy: descend(held, n, xx, xy, inner, eta))
        start = start + epsilon * (adapted / count - start)
    return start


def adapted_loss(stats: DataFrame, start: np.ndarray, steps: int, eta: float) -> float:
    """Mean over captures of the mean squared error after ``steps`` steps from ``start``."""

    def loss(n, xx, xy, yy):
        w = descend(start, n, xx, xy, steps, eta)
        return ((np.einsum("ci,cij,cj->c", w, xx, w) - 2 * (w * xy).sum(1) + yy) / n)[:, None]

    total = _summed(stats, len(start), loss)
    return float(total[0] / stats.count()) if len(total) else float("nan")
