"""Queries over histograms and their transport."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import histogram as h
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import CURVES_SQL, LEVELS, TICKS_SQL, samples, table, ticks

C = f"WITH {CURVES_SQL}"
KEYS = ["curve"]


def curves(spark, d):
    return h.histogram(samples(spark, d), KEYS)


@query("value_hist", f"{C} SELECT curve, level, n FROM hist")
def value_hist(spark, d):
    return curves(spark, d)


@query("hist_mass_q16", f"{C}, t AS (SELECT *, sum(n) OVER (PARTITION BY curve) AS total FROM hist) SELECT curve, level, ((n * 65536 + total // 2) // total)::BIGINT AS mass FROM t")
def hist_mass_q16(spark, d):
    return h.masses(curves(spark, d), KEYS).select("curve", "level", "mass")


@query(
    "soft_hist",
    f"""WITH {TICKS_SQL}, p AS (SELECT channel, v // 256 AS level, 256 - v % 256 AS n FROM ticks WHERE v >= 0 UNION ALL SELECT channel, v // 256 + 1, v % 256 FROM ticks WHERE v >= 0)
    SELECT channel, level, sum(n)::BIGINT AS n FROM p WHERE n > 0 GROUP BY ALL""",
)
def soft_hist(spark, d):
    return h.soft_histogram(ticks(spark, d).filter("v >= 0"), ["channel"], "v", 256)


GRID = f"{C}, g AS (SELECT c.curve, l::INTEGER AS level, coalesce(n, 0) AS n FROM (SELECT DISTINCT curve FROM hist) c CROSS JOIN generate_series(0, {LEVELS - 1}) t(l) LEFT JOIN hist USING (curve, level))"
GRID = GRID.replace("LEFT JOIN hist USING (curve, level)", "LEFT JOIN hist h ON h.curve = c.curve AND h.level = l")


@query("hist_cdf", f"{GRID} SELECT curve, level, n, (sum(n) OVER (PARTITION BY curve ORDER BY level))::BIGINT AS cum FROM g")
def hist_cdf(spark, d):
    return h.cdf(curves(spark, d), KEYS, LEVELS)


@query(
    "hist_distances",
    f"""{GRID}, p AS (SELECT a.curve, a.level, a.n - b.n AS n FROM g a JOIN g b ON b.curve = 1 AND a.level = b.level), s AS (SELECT *, sum(n) OVER (PARTITION BY curve ORDER BY level) AS cum FROM p)
    SELECT curve, sum(abs(n))::BIGINT AS tv, sum(abs(cum))::BIGINT AS w1 FROM s GROUP BY curve""",
)
def hist_distances(spark, d):
    """Total variation and W1 of every curve to curve 1."""
    c = curves(spark, d)
    first = c.filter("curve = 1").select("level", "n").crossJoin(F.broadcast(c.select("curve").distinct()))  # LEVELS x curves
    return h.distances(c, first.select("curve", "level", "n"), KEYS, LEVELS)


RANKS = f"{C}, q AS (SELECT curve, level AS q, row_number() OVER (PARTITION BY curve ORDER BY level) - 1 AS rank FROM samples)"


def _anchor(c):
    first = c.filter("curve = 1").select("level", "n")
    return first.crossJoin(F.broadcast(c.select("curve").distinct())).select("curve", "level", "n")  # LEVELS x curves


@query("transport_displacement", f"{RANKS} SELECT a.curve, a.rank, (a.q - b.q)::BIGINT AS d FROM q a JOIN q b ON b.curve = 1 AND a.rank = b.rank")
def transport_displacement(spark, d):
    c = curves(spark, d)
    return h.transport(_anchor(c), c, KEYS).select("curve", "rank", F.col("d").cast("long").alias("d"))


@query("pushforward_check", f"{C} SELECT curve, level, n FROM hist")
def pushforward_check(spark, d):
    """The anchor pushed along its displacement is the target again."""
    c = curves(spark, d)
    return h.pushforward(_anchor(c), h.transport(_anchor(c), c, KEYS), KEYS, LEVELS)


@query("flow_cost", f"{RANKS} SELECT a.curve, sum(abs(a.q - b.q))::BIGINT AS cost FROM q a JOIN q b ON b.curve = 1 AND a.rank = b.rank GROUP BY a.curve")
def flow_cost(spark, d):
    c = curves(spark, d)
    return h.transport(_anchor(c), c, KEYS).groupBy("curve").agg(F.sum(F.abs("d")).cast("long").alias("cost"))


@query("hist_barycenter", f"{RANKS}, m AS (SELECT rank, sum(q) // count(*) AS level FROM q GROUP BY rank) SELECT level::BIGINT AS level, count(*) AS n FROM m GROUP BY 1")
def hist_barycenter(spark, d):
    c = curves(spark, d).withColumn("g", F.lit(0))
    return h.barycenter(c, ["g"], "curve").select("level", "n")


@query("curve_modes", f"{C} SELECT curve, arg_min(level, (-n, level)) AS mode, (sum(n) - max(n))::BIGINT AS disagreement FROM hist GROUP BY curve")
def curve_modes(spark, d):
    return h.modes(curves(spark, d), KEYS)


@query("curve_energy", f"{C} SELECT curve, level, ((sum(n) OVER (PARTITION BY curve)) - n)::BIGINT AS energy, (n - min(n) OVER (PARTITION BY curve))::BIGINT AS centred FROM hist")
def curve_energy(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("curve")
    return curves(spark, d).select("curve", "level", (F.sum("n").over(w) - F.col("n")).alias("energy"), (F.col("n") - F.min("n").over(w)).alias("centred"))


@query("mode_relative", f"{C}, m AS (SELECT curve, arg_min(level, (-n, level)) AS mode FROM hist GROUP BY curve) SELECT curve, (level - mode + {LEVELS}) % {LEVELS} AS level, n FROM hist JOIN m USING (curve)")
def mode_relative(spark, d):
    """Curves rotated so that their mode is level 0."""
    c = curves(spark, d)
    return c.join(h.modes(c, KEYS), "curve").select("curve", F.pmod(F.col("level") - F.col("mode"), F.lit(LEVELS)).alias("level"), "n")


@query(
    "entropy",
    f"""{C}, p AS (SELECT curve, n / sum(n) OVER (PARTITION BY curve) AS p, sum(n) OVER (PARTITION BY curve) AS total FROM hist)
    SELECT curve, round(sum(-p * log2(p)), 6) AS bits, round(sum(-p * ln(p)), 6) AS nats, max(total)::BIGINT AS total, round(sum(-p * ln(p)) + (count(*) - 1) / (2.0 * max(total)), 6) AS corrected FROM p GROUP BY curve""",
)
def entropy(spark, d):
    e = h.entropies(curves(spark, d), KEYS)
    return e.select("curve", *[F.round(c, 6).alias(c) for c in ("bits", "nats", "corrected")], "total")


@query(
    "char_entropy",
    "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(sum(-p * log2(p)), 5) AS bits FROM p GROUP BY doc_id",
)
def char_entropy(spark, d):
    docs = table(spark, d, "documents")
    chars = docs.select("doc_id", F.explode(F.split("text", "")).alias("level")).filter("level <> ''")
    return h.entropies(h.histogram(chars, ["doc_id"]), ["doc_id"]).select("doc_id", F.round("bits", 5).alias("bits"))


@query(
    "hist_moments",
    f"""{C}, m AS (SELECT curve, sum(n) AS s0, sum(n * level)::DOUBLE AS s1, sum(n * level * level)::DOUBLE AS s2, sum(n * level * level * level)::DOUBLE AS s3, max(level) - min(level) AS span FROM hist GROUP BY curve),
    k AS (SELECT curve, span, s1 / s0 AS mean, s2 / s0 - (s1 / s0) * (s1 / s0) AS var, s3 / s0 - 3 * (s1 / s0) * (s2 / s0) + 2 * (s1 / s0) * (s1 / s0) * (s1 / s0) AS third FROM m)
    SELECT curve, round(sqrt(greatest(var, 0)), 5) AS std, span, CASE WHEN var > 0 THEN round(tanh(third / pow(var, 1.5)), 5) ELSE 0 END AS skew FROM k""",
)
def hist_moments(spark, d):
    return h.moments(curves(spark, d), KEYS).select("curve", F.round("std", 5).alias("std"), "span", F.round("skew", 5).alias("skew"))


@query(
    "apportionment",
    f"""{C}, t AS (SELECT curve, level, n, 1000 AS total, sum(n) OVER (PARTITION BY curve) AS w FROM hist), b AS (SELECT *, total * n // w AS base, total * n % w AS rem FROM t),
    k AS (SELECT *, total - sum(base) OVER (PARTITION BY curve) AS spare, row_number() OVER (PARTITION BY curve ORDER BY rem DESC, level) AS k FROM b)
    SELECT curve, level, (base + CASE WHEN k <= spare THEN 1 ELSE 0 END)::BIGINT AS share FROM k""",
)
def apportionment(spark, d):
    c = curves(spark, d).withColumn("total", F.lit(1000).cast("long"))
    return h.apportion(c, KEYS, ["level"], "n", "total").select("curve", "level", "share")


@query(
    "distinct_allocation",
    f"""{C}, r AS (SELECT curve, level, count(*) OVER (PARTITION BY curve) AS k, row_number() OVER (PARTITION BY curve ORDER BY n DESC, level) - 1 AS rank FROM hist),
    b AS (SELECT *, 2000 - k * (k - 1) // 2 AS spare FROM r) SELECT curve, level, (spare // k + (k - 1 - rank) + CASE WHEN rank < spare % k THEN 1 ELSE 0 END)::BIGINT AS share FROM b""",
)
def distinct_allocation(spark, d):
    """Strictly different shares of 2000 by rank of count (ties: lower level first)."""
    from pyspark.sql import Window

    c = curves(spark, d)
    r = c.withColumn("k", F.count("*").over(Window.partitionBy("curve"))).withColumn("rank", F.row_number().over(Window.partitionBy("curve").orderBy(F.desc("n"), "level")) - 1)
    spare = F.lit(2000) - F.call_function("div", F.col("k") * (F.col("k") - 1), F.lit(2))
    share = F.call_function("div", spare, F.col("k")) + F.col("k") - 1 - F.col("rank") + (F.col("rank") < spare % F.col("k")).cast("int")
    return r.select("curve", "level", share.alias("share"))


@query("best_constant", f"WITH {TICKS_SQL}, g AS (SELECT channel, count(*) AS n, sum(v)::BIGINT AS s, sum(v * v)::HUGEINT AS q FROM ticks GROUP BY channel), c AS (SELECT *, s // n AS c FROM g) SELECT channel, least(q - 2 * c * s + n * c * c, q - 2 * (c + 1) * s + n * (c + 1) * (c + 1))::BIGINT AS loss FROM c")
def best_constant(spark, d):
    """Least squared loss of one integer per key: the floor or ceiling of the mean."""
    g = ticks(spark, d).groupBy("channel").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    c = F.call_function("div", F.col("s"), F.col("n"))
    loss = lambda k: F.col("q") - 2 * k * F.col("s") + F.col("n") * k * k
    return g.select("channel", F.least(loss(c), loss(c + 1)).alias("loss"))


@query("distinct_grid", "SELECT label, count(DISTINCT (round(embedding[1]::DOUBLE / 0.05), round(embedding[2]::DOUBLE / 0.05), round(embedding[3]::DOUBLE / 0.05))) AS cells FROM embeddings GROUP BY label")
def distinct_grid(spark, d):
    """Distinct cells of an epsilon grid."""
    e = table(spark, d, "embeddings")
    cell = F.struct(*[F.round(F.col("embedding")[i].cast("double") / 0.05).alias(c) for i, c in enumerate("xyz")])
    return e.groupBy("label").agg(F.countDistinct(cell).alias("cells"))
