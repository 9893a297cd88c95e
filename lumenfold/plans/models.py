"""Queries over games, small models and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.functions.lift import DETAILS
from lumenfold.operators import assign, games, models, sequence
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PIXELS_SQL, TICKS_SQL, pixels, table, ticks


def _numbered(spark, d):
    return sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])


@query("merge_board")
def merge_board(spark, d):
    kind = F.element_at(F.array(F.lit("pour"), F.lit("split"), F.lit("merge"), F.lit("keep")), (F.pmod(F.col("v"), F.lit(5)).cast("int") % 4 + 1))
    moves = _numbered(spark, d).select(F.col("burst").alias("game"), F.col("i").alias("seq"), kind.alias("kind"), (F.col("tick_id") % 17).alias("region"))
    return games.replay_boards(moves)


@query("loom_replay")
def loom_replay(spark, d):
    folds = _numbered(spark, d).select(F.col("burst").alias("game"), F.col("i").alias("seq"), (F.col("v") % 8).alias("i"), (F.col("tick_id") % 8).alias("j"))
    return games.replay_looms(folds, 16)


@query("band_predictor")
def band_predictor(spark, d):
    """Each burst's time band from its coarse value and siblings, against predicting zero."""
    o = sequence.lift_octants(ticks(spark, d), ["burst"], ["ts", "tick_id"], "v").select(F.lit(0).alias("model"), *[(F.col(c) / 65536.0).alias(c) for c in ("coarse", *DETAILS)])
    f = models.linear_fit(o, ["model"], ["coarse", *DETAILS[:-1]], "dz")
    return f.select("model", "n", F.round("loss", 8).alias("loss"), F.round("floor", 8).alias("floor"), (F.col("loss") < 0.98 * F.col("floor")).alias("beats"))


@query("linear_slope", f"WITH {PIXELS_SQL} SELECT frame, count(*) AS n, round(regr_intercept(a / 65536.0, l / 65536.0), 4) AS intercept, round(regr_slope(a / 65536.0, l / 65536.0), 4) AS slope FROM pixels GROUP BY frame")
def linear_slope(spark, d):
    px = pixels(spark, d).select("frame", (F.col("l") / 65536.0).alias("l"), (F.col("a") / 65536.0).alias("a"))
    f = models.linear_fit(px, ["frame"], ["l"], "a", ridge=0.0)
    return f.select("frame", "n", F.round(F.col("weights")[0], 4).alias("intercept"), F.round(F.col("weights")[1], 4).alias("slope"))


@query("fed_rounds")
def fed_rounds(spark, d):
    e = table(spark, d, "embeddings")
    sign = F.when(F.col("vec_id") % 3 == 0, -1.0).otherwise(1.0)
    pairs = e.select(F.col("label").alias("user"), F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double") * sign).alias("yd"))
    theta = models.federated_rounds(pairs, 6, 3)
    return spark.createDataFrame([(i, round(v, 9)) for i, v in enumerate(theta)], "i int, weight double")


@query("bootstrap_ci")
def bootstrap_ci(spark, d):
    px = pixels(spark, d).select("frame", "idx", (F.col("l") / 65536.0).alias("v"))
    return models.bootstrap_mean(px, ["frame"], "v", "idx", 100)


@query("triplets")
def triplets(spark, d):
    px = pixels(spark, d)
    plane = px.groupBy("frame", (trunc_div("idx", 16) % 16).alias("y"), (F.col("idx") % 16).alias("x")).agg(F.sum("l").alias("v"))
    return models.sample_triplets(plane, ["frame"], "t-1")


@query("holonomy", f"WITH {PIXELS_SQL}, s AS (SELECT frame, sum(idx % 7) AS s FROM pixels GROUP BY frame) SELECT frame, round((2 - 2 * cos(s / 10.0)) / 2, 6) AS defect FROM s")
def holonomy(spark, d):
    """Rotations by a tenth of idx mod 7 radians, multiplied in order around each frame."""
    a = (F.col("idx") % 7) / 10.0
    m = pixels(spark, d).select("frame", "idx", F.array(F.cos(a), -F.sin(a), F.sin(a), F.cos(a)).alias("m"))
    return models.holonomy(m, "frame", "idx", "m", 2).select("frame", F.round("defect", 6).alias("defect"))


@query("genome_dimension", f"WITH {PIXELS_SQL}, c AS (SELECT frame, var_pop(l) AS ll, covar_pop(l, a) AS la, covar_pop(l, b) AS lb, var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb FROM pixels GROUP BY frame) SELECT frame, round((ll + aa + bb) * (ll + aa + bb) / (ll * ll + aa * aa + bb * bb + 2 * (la * la + lb * lb + ab * ab)), 5) AS dimension FROM c")
def genome_dimension(spark, d):
    g = pixels(spark, d).select("frame", F.array(*[F.col(c).cast("double") for c in "lab"]).alias("v"))
    return models.genome_dimension(g, ["frame"], "v").select("frame", F.round("dimension", 5).alias("dimension"))


@query("covariance_barycenter")
def covariance_barycenter(spark, d):
    c = assign.covariance(pixels(spark, d).select("frame", *[(F.col(x) / 65536.0).alias(x) for x in "lab"]), ["frame"])
    m = c.select(F.lit(0).alias("g"), F.array("c_ll", "c_la", "c_lb", "c_la", "c_aa", "c_ab", "c_lb", "c_ab", "c_bb").alias("c"))
    b = models.barycenters(m, "g", "c", 3)
    return b.select("g", F.transform("barycenter", lambda x: F.round(x, 8)).alias("barycenter"), F.round("spread", 8).alias("spread"))


def _split_sql(source: str, out: str, weight: str, total: str) -> str:
    """CTEs that share ``total`` of each parent among its children m by largest remainder."""
    return (
        f"{out}_b AS (SELECT *, {total} * {weight} // sum({weight}) OVER (PARTITION BY parent) AS base, {total} * {weight} % sum({weight}) OVER (PARTITION BY parent) AS rem FROM {source}), "
        f"{out}_k AS (SELECT *, {total} - sum(base) OVER (PARTITION BY parent) AS spare, row_number() OVER (PARTITION BY parent ORDER BY rem DESC, m) AS k FROM {out}_b), "
        f"{out} AS (SELECT m, (base + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS cells FROM {out}_k)"
    )


MORTON_SQL = " + ".join(f"((({c} >> {b}) & 1) << {3 * b + lane})" for b in range(2) for lane, c in enumerate(("x", "y", "t")))


@query(
    "octant_budget",
    f"WITH {TICKS_SQL}, v AS (SELECT burst % 4 AS t, tick_id % 4 AS y, tick_id // 4 % 4 AS x, count(*) AS w FROM ticks GROUP BY ALL), leaf AS (SELECT ({MORTON_SQL})::BIGINT AS m, w FROM v), "
    "one AS (SELECT m >> 3 AS m, 0 AS parent, sum(w)::BIGINT AS w FROM leaf GROUP BY ALL), " + _split_sql("one", "first", "w", "1000") + ", "
    "two AS (SELECT leaf.m, leaf.m >> 3 AS parent, w::BIGINT AS w, cells FROM leaf JOIN first ON first.m = leaf.m >> 3 WHERE cells > 0), " + _split_sql("two", "share", "w", "cells") + " SELECT m, cells FROM share WHERE cells > 0",
)
def octant_budget(spark, d):
    """Cells of a budget of 1,000 given to the voxels of a 4-cube, octant by octant."""
    t = ticks(spark, d)
    w = t.groupBy((F.col("burst") % 4).alias("t"), (F.col("tick_id") % 4).alias("y"), (trunc_div("tick_id", 4) % 4).alias("x")).agg(F.count("*").alias("w"))
    return models.octant_budget(w, 2, 1000)
