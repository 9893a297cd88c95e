"""Entropic transport between weighted point sets as alternating joins and log-sum-exp aggregations.

The table of costs (pair, i, j, cost) is written once. Half a round joins it
with the potentials of one side and reduces to the other side in two map-side
aggregations: the largest exponent, then the sum of what is left of the others.
So any number of pairs and supports of any size go through their rounds
together, and no task holds a pair. The plan comes back as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import Scratch, small

#: Bytes of a potential with its key.
ROW_BYTES = 64


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def _soft(costs: DataFrame, side: DataFrame, mine: str, theirs: str, epsilon: float, hint) -> DataFrame:
    """pair, ``mine`` and the potential -epsilon * log sum exp((potential - cost) / epsilon + log weight) over ``theirs``."""
    term = (F.col("potential") - F.col("cost")) / epsilon + F.col("log_w")
    terms = costs.join(hint(side), ["pair", theirs]).select("pair", mine, term.alias("t"))
    top = terms.groupBy("pair", mine).agg(F.max("t").alias("top"))
    rest = terms.join(hint(top), ["pair", mine]).groupBy("pair", mine).agg(F.sum(F.exp(F.col("t") - F.col("top"))).alias("s"), F.max("top").alias("top"))
    return rest.select("pair", mine, (-epsilon * (F.col("top") + F.log("s"))).alias("potential"))


def transport_plan(points: DataFrame, epsilon: float, rounds: int) -> DataFrame:
    """pair, i, j, cost and mass of the plan after a fixed number of rounds.

    points: pair, side (0 or 1), i (unique in pair and side), x (array<double>)
    and w >= 0. Weights are scaled to sum to 1 on each side; points without
    weight take no part; a pair that lacks a side gives no rows.
    """
    with Scratch(points.sparkSession, "transport") as scratch:
        total = points.groupBy("pair", "side").agg(F.sum("w").alias("_total"))
        live = scratch.write(points.filter("w > 0").join(total, ["pair", "side"]).select("pair", "side", "i", "x", F.log(F.col("w") / F.col("_total")).alias("log_w")))
        hint = F.broadcast if small(live.count(), ROW_BYTES) else (lambda df: df)
        left = live.filter("side = 0").select("pair", "i", F.col("x").alias("_x"), "log_w")
        right = live.filter("side = 1").select("pair", F.col("i").alias("j"), F.col("x").alias("_y"), "log_w")
        costs = scratch.write(left.drop("log_w").join(right.drop("log_w"), "pair").select("pair", "i", "j", squared_distance(F.col("_x"), F.col("_y")).alias("cost")))
        a, b = left.drop("_x"), right.drop("_y")
        g = scratch.write(b.withColumn("potential", F.lit(0.0)))
        for _ in range(rounds):
            f = scratch.write(_soft(costs, g, "i", "j", epsilon, hint).join(a, ["pair", "i"]))
            g = scratch.write(_soft(costs, f, "j", "i", epsilon, hint).join(b, ["pair", "j"]))
        if rounds == 0:
            f = a.withColumn("potential", F.lit(0.0))
        both = costs.join(hint(f.select("pair", "i", F.col("potential").alias("_f"), F.col("log_w").alias("_p"))), ["pair", "i"])
        both = both.join(hint(g.select("pair", "j", F.col("potential").alias("_g"), F.col("log_w").alias("_q"))), ["pair", "j"])
        mass = F.exp((F.col("_f") + F.col("_g") - F.col("cost")) / epsilon + F.col("_p") + F.col("_q"))
        return scratch.result(both.select("pair", "i", "j", "cost", mass.alias("mass")))
