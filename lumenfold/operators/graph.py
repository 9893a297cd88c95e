"""Reachability, generations and components by loops of joins.

Each round is written to the checkpoint folder, so plans stay short and lost
executors cost one round; the tables of an operation go when it is done, but
for its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import Scratch


def closure(edges: DataFrame) -> DataFrame:
    """edges (child, parent): every (node, ancestor) pair, in rounds of doubled length; a node of a cycle is its own ancestor.

    Round k knows what is up to 2**k steps away, and which pairs a walk of
    exactly so many steps joins; both are joined once to get the next round.
    """
    with Scratch(edges.sparkSession, "closure") as scratch:
        walks = scratch.write(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
        known, n = walks, walks.count()
        on = lambda left, right: left.join(right.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up")), "ancestor").select("node", F.col("_up").alias("ancestor"))
        while True:
            known = scratch.write(known.union(on(known, walks)).distinct())
            before, n = n, known.count()
            if n == before:
                return scratch.result(known)
            walks = scratch.write(on(walks, walks).distinct())
            if walks.isEmpty():
                return scratch.result(known)


def generations(nodes: DataFrame, edges: DataFrame, limit: int = 10_000) -> DataFrame:
    """Longest path to an origin; 0 for origins and for what only cycles reach. A path of ``limit`` steps is an error."""
    with Scratch(nodes.sparkSession, "generations") as scratch:
        return scratch.result(_generations(nodes, edges, limit, scratch.write))


def _generations(nodes: DataFrame, edges: DataFrame, limit: int, cut) -> DataFrame:
    depth = nodes.select("node", F.lit(0).alias("depth"))
    frontier, k = nodes.join(edges.select(F.col("child").alias("node")), "node", "left_anti").select("node"), 0
    best = []
    while True:
        if k == limit:
            raise ValueError(f"a path of more than {limit} steps, or a cycle")
        k += 1
        frontier = cut(frontier.join(edges.select(F.col("parent").alias("node"), "child"), "node").select(F.col("child").alias("node")).distinct())
        if frontier.isEmpty():
            break
        best.append(frontier.select("node", F.lit(k).alias("depth")))
    for b in best:
        depth = depth.union(b)
    return depth.groupBy("node").agg(F.max("depth").alias("depth"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), undirected: node and the least node of its component.

    Labels take the least label of their neighbours, then that label's own
    label, which shortens long chains by halves.
    """
    with Scratch(edges.sparkSession, "components") as scratch:
        return scratch.result(_components(edges, scratch.write))


def _components(edges: DataFrame, cut) -> DataFrame:
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_l"))
        step = label.join(near, "node").select("node", F.least("label", "_l").alias("label"))
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("_j")), "label", "left")
        new = cut(jump.select("node", F.least("label", F.coalesce("_j", "label")).alias("label")))
        changed = new.join(label.withColumnRenamed("label", "_o"), "node").filter("label <> _o")
        label = new
        if changed.isEmpty():
            return label
