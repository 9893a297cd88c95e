"""Queries over generated scenes, populations and users, and over fits to groups; tests hold their laws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenfold.functions import kernels, signatures
from lumenfold.functions.arith import trunc_div
from lumenfold.operators import frames
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, palette, pixels, table

KINDS = ("gradient", "blob", "edge", "waves", "mixed")


@query("variance_quantize")
def variance_quantize(spark, d):
    """Eight boxes of most spread a frame, with their counts and mean colours."""
    q = frames.variance_quantize(pixels(spark, d), 8)
    return q.select("frame", "slot", "n", *[F.round(c, 8).alias(c) for c in ("ml", "ma", "mb")])


@query("scene_burst")
def scene_burst(spark, d):
    """A moving scene of each kind for every nation as seed: eight frames of 8 x 8, by mean and range of lightness."""

    def make(seed, pdf):
        for kind in KINDS:
            v = kernels.scene(int(seed), kind, 8, 8)[:, :, 0]
            for t in range(len(v)):
                yield int(seed), kind, t, int(v[t].sum()), int(v[t].min()), int(v[t].max())

    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))
    return frames.per_group(seeds, "seed", "seed long, kind string, t int, total long, low long, high long", make)


@query("zipf_populations")
def zipf_populations(spark, d):
    """Populations of sixteen slots, at least two each of 4,096, whose entropy comes near a target for every nation."""

    def make(seed, pdf):
        target = 0.4 + 0.09 * (int(seed) % 25)
        for slot, n in enumerate(kernels.populations(4096, 2, 16, target)):
            yield int(seed), slot, int(n), target

    seeds = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("seed"))
    return frames.per_group(seeds, "seed", "seed long, slot int, n long, target double", make)


@query("tile_stream")
def tile_stream(spark, d):
    """Slices of an endless stream, one for each part, made from its number alone: sums of its four frames."""

    def make(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                tiles = pdf["p_partkey"].to_numpy()[at : at + 512]
                totals = kernels.tile_slices(5, tiles, 4, 16).sum((2, 3))
                yield type(pdf)({"tile": np.repeat(tiles, 4), "t": np.tile(np.arange(4, dtype=np.int32), len(tiles)), "total": totals.ravel()})

    parts = table(spark, d, "part").select("p_partkey")
    return parts.repartition("p_partkey").mapInPandas(make, "tile long, t int, total long")


@query("user_clusters")
def user_clusters(spark, d):
    """Worlds of twelve users round three tastes, one a region, and the clusters that averaging by least loss gives."""

    def make(seed, pdf):
        pairs, group = kernels.user_pairs(int(seed), 12, 3, 40, 8)
        _, found = kernels.clustered_average(pairs, 3)
        for user in range(len(group)):
            yield int(seed), user, int(group[user]), int(found[user])

    seeds = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("seed"))
    return frames.per_group(seeds, "seed", "seed long, user int, taste int, cluster int", make)


@query("free_barycenter")
def free_barycenter(spark, d):
    """Four support points a frame, moved to the mean of their images in its two halves of a palette."""

    def make(frame, pdf):
        x, slot = pdf[["l", "a", "b"]].to_numpy(float) / 65536, pdf["slot"].to_numpy()
        x, slot = x[np.argsort(slot)], np.sort(slot)
        halves = [(x[slot % 2 == s], np.ones((slot % 2 == s).sum())) for s in (0, 1)]
        for k, z in enumerate(kernels.free_barycenter(halves, x[:4], 0.05, 30, 3)):
            yield (int(frame), k, *(round(float(v), 6) for v in z))

    return frames.per_group(palette(spark, d), "frame", "frame long, k int, l double, a double, b double", make)


def descriptor_sql(rounds: int, epsilon: float) -> str:
    """The sixteen numbers of every frame's loop, the scaling written out round by round."""
    sql = f"""WITH {PALETTE_SQL}, x AS (SELECT frame AS g, slot // 4 AS t, slot % 4 AS i, l / 65536.0::DOUBLE AS l, a / 65536.0::DOUBLE AS a, b / 65536.0::DOUBLE AS b, (slot % 4 + 1)::DOUBLE AS w FROM palette),
    p AS MATERIALIZED (SELECT *, w / sum(w) OVER (PARTITION BY g, t) AS p FROM x),
    mean AS (SELECT g, t, sum(p * l) AS l, sum(p * a) AS a, sum(p * b) AS b, -sum(p * ln(p)) AS plain FROM p GROUP BY g, t),
    cov AS (SELECT p.g, p.t, any_value(plain) AS plain, sum(p * (p.l - m.l) * (p.l - m.l)) AS ll, sum(p * (p.l - m.l) * (p.a - m.a)) AS la, sum(p * (p.l - m.l) * (p.b - m.b)) AS lb, sum(p * (p.a - m.a) * (p.a - m.a)) AS aa, sum(p * (p.a - m.a) * (p.b - m.b)) AS ab, sum(p * (p.b - m.b) * (p.b - m.b)) AS bb FROM p JOIN mean m ON m.g = p.g AND m.t = p.t GROUP BY p.g, p.t),
    c AS MATERIALIZED (SELECT p.g, p.t, p.i, q.i AS k, p.p AS pa, q.p AS pb, (p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) AS cost FROM p JOIN p q ON q.g = p.g AND q.t = (p.t + 1) % 4),
    e AS MATERIALIZED (SELECT *, exp(-cost / {epsilon}) AS kk FROM c), u0 AS (SELECT g, t, i, 1.0::DOUBLE AS u FROM p)"""
    for r in range(rounds):
        sql += f", v{r} AS MATERIALIZED (SELECT e.g, e.t, k, any_value(pb) / sum(u * kk) AS v FROM e JOIN u{r} s ON s.g = e.g AND s.t = e.t AND s.i = e.i GROUP BY e.g, e.t, k)"
        sql += f", u{r + 1} AS MATERIALIZED (SELECT e.g, e.t, i, any_value(pa) / sum(v * kk) AS u FROM e JOIN v{r} s ON s.g = e.g AND s.t = e.t AND s.k = e.k GROUP BY e.g, e.t, i)"
    product = lambda left, m: f"SELECT s.g, s.i, m.k, sum(s.m * m.m) AS m FROM {left} s JOIN {m} m ON m.g = s.g AND m.i = s.k GROUP BY s.g, s.i, m.k"
    power = lambda name: f"SELECT g, k, pow(sum({name} * cos(2 * pi() * k * t / 4)), 2) + pow(sum({name} * sin(2 * pi() * k * t / 4)), 2) AS a FROM s, (VALUES (1), (2), (3)) f(k) GROUP BY g, k"
    sql += f""", plan AS MATERIALIZED (SELECT e.g, e.t, e.i, e.k, cost, u * kk * v AS m FROM e JOIN u{rounds} x ON x.g = e.g AND x.t = e.t AND x.i = e.i JOIN v{rounds - 1} y ON y.g = e.g AND y.t = e.t AND y.k = e.k),
    ways AS (SELECT g, t, sum(m * cost) AS cost, -sum(CASE WHEN m > 0 THEN m * ln(m) ELSE 0 END) AS ent FROM plan GROUP BY g, t),
    s AS MATERIALIZED (SELECT cov.g, cov.t, plain, 0.5 * ln(pow(2 * pi() * exp(1.0::DOUBLE), 3) * greatest(ll * (aa * bb - ab * ab) - la * (la * bb - ab * lb) + lb * (la * ab - aa * lb), 1e-12::DOUBLE)) AS colour, cost, ent FROM cov JOIN ways USING (g, t)),
    row AS MATERIALIZED (SELECT g, t, i, k, m / sum(m) OVER (PARTITION BY g, t, i) AS m FROM plan),
    r0 AS (SELECT * FROM row WHERE t = 0), r1 AS (SELECT * FROM row WHERE t = 1), r2 AS (SELECT * FROM row WHERE t = 2), r3 AS (SELECT * FROM row WHERE t = 3),
    h1 AS MATERIALIZED ({product('r0', 'r1')}), h2 AS MATERIALIZED ({product('h1', 'r2')}), h3 AS ({product('h2', 'r3')}),
    hol AS (SELECT g, 1 - sum(m) / 4 AS h FROM h3 WHERE i = k GROUP BY g),
    fp AS ({power('plain')}), fc AS ({power('colour')}), ft AS ({power('cost')}),
    ent AS (SELECT w, g, CASE WHEN sum(a) <= 1e-12 THEN 0 ELSE -sum(CASE WHEN a > 0 THEN a / tot * ln(a / tot) ELSE 0 END) END AS h, CASE WHEN sum(a) <= 1e-12 THEN 0 ELSE 0.5 * ln(2 * pi() * exp(1.0::DOUBLE)) + sum(ln(greatest(a, 1e-12::DOUBLE))) / 6 END AS rate
        FROM (SELECT *, sum(a) OVER (PARTITION BY w, g) AS tot FROM (SELECT 7 AS w, * FROM fp UNION ALL SELECT 8, * FROM fc UNION ALL SELECT 9, * FROM ft)) GROUP BY w, g)
    SELECT g AS frame, k::INTEGER AS k, round(v, 6) AS v FROM (
        SELECT g, 0 AS k, avg(plain) AS v FROM s GROUP BY g UNION ALL SELECT g, 1, stddev_pop(plain) FROM s GROUP BY g UNION ALL SELECT g, 2, avg(colour) FROM s GROUP BY g UNION ALL SELECT g, 3, stddev_pop(colour) FROM s GROUP BY g
        UNION ALL SELECT g, 4, sum(cost) FROM s GROUP BY g UNION ALL SELECT g, 5, avg(cost) FROM s GROUP BY g UNION ALL SELECT g, 6, avg(ent) FROM s GROUP BY g UNION ALL SELECT g, w, h FROM ent UNION ALL SELECT g, 10, rate FROM ent WHERE w = 7
        UNION ALL SELECT g, 11, h FROM hol UNION ALL SELECT g, 11 + k, CASE WHEN sum(a) OVER (PARTITION BY g) > 1e-12 THEN a / sum(a) OVER (PARTITION BY g) ELSE 0 END FROM fp UNION ALL SELECT g, 15, 0 FROM hol)"""
    return sql


@query("cyclic_descriptor", descriptor_sql(30, 0.05))
def cyclic_descriptor(spark, d):
    """Sixteen invariants of the loop of every frame's palette, cut in four palettes of four."""

    def make(frame, pdf):
        pdf = pdf.sort_values("slot")
        x = pdf[["l", "a", "b"]].to_numpy(float) / 65536
        loop = [(x[i : i + 4], np.arange(1, len(x[i : i + 4]) + 1)) for i in range(0, len(x), 4)]
        for k, v in enumerate(kernels.cyclic_descriptor(loop)):
            yield int(frame), k, round(float(v), 6)

    return frames.per_group(palette(spark, d), "frame", "frame long, k int, v double", make)


def _octants(spark, d):
    """frame, coarse and seven bands of every eight consecutive lightnesses of a frame."""
    p = pixels(spark, d).select("frame", trunc_div("idx", 8).alias("cell"), (F.col("idx") % 8).alias("k"), (F.col("l") / 65536.0).alias("v"))
    g = p.groupBy("frame", "cell").agg(F.avg("v").alias("coarse"), *[F.coalesce(F.max(F.when(F.col("k") == i, F.col("v"))), F.avg("v")).alias(f"v{i}") for i in range(8)])
    return g.select("frame", "cell", "coarse", *[(F.col(f"v{i}") - F.col("coarse")).alias(f"b{i}") for i in range(7)])


@query("detail_head")
def detail_head(spark, d):
    """Per frame, a head of 21 weights from coarse to seven bands, its loss and that of no detail; the gate keeps it where it wins."""

    def make(frame, pdf):
        pdf = pdf.sort_values("cell")
        theta, loss, floor = kernels.detail_head(pdf["coarse"].to_numpy(), pdf[[f"b{i}" for i in range(7)]].to_numpy())
        yield int(frame), theta.size, round(loss, 9), round(floor, 9), loss < floor

    return frames.per_group(_octants(spark, d), "frame", "frame long, weights int, loss double, floor double, kept boolean", make)


@query("band_head", "WITH p AS (SELECT label AS frame, vec_id // 8 AS cell, vec_id % 8 AS k, round_even(embedding[1]::DOUBLE * 65536, 0) / 65536.0 AS v FROM embeddings), g AS (SELECT frame, cell, avg(v) AS x, coalesce(max(v) FILTER (WHERE k = 0), avg(v)) - avg(v) AS y FROM p GROUP BY ALL) SELECT frame::BIGINT AS frame, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM g GROUP BY frame")
def band_head(spark, d):
    """The pooled first band regressed on the coarse value, in closed form."""
    o = _octants(spark, d)
    return o.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.round(F.regr_slope("b0", "coarse"), 6).alias("slope"), F.round(F.regr_intercept("b0", "coarse"), 6).alias("intercept"))


@query("psd_metric")
def psd_metric(spark, d):
    """A metric for every frame from triplets of a pixel, the next one and the seventh after: its six numbers, the loss and that of the plain metric."""

    def fit(frame, pdf):
        x = pdf.sort_values("idx")[["l", "a", "b"]].to_numpy(float) / 65536
        if len(x) > 8:
            a, p, n = x[:-7], x[1:-6], x[7:]
            low, loss = kernels.psd_metric(a, p, n)
            plain = np.maximum(0.0, ((a - p) ** 2).sum(1) - ((a - n) ** 2).sum(1) + 0.1).mean()
            yield (int(frame), *(round(float(v), 8) for v in low[np.tril_indices(3)]), round(loss, 8), round(float(plain), 8))

    return frames.per_group(pixels(spark, d), "frame", "frame long, m00 double, m10 double, m11 double, m20 double, m21 double, m22 double, loss double, plain double", fit)


@query("signed_events", "SELECT n_nationkey AS id, true AS own, false AS other, false AS changed FROM nation")
def signed_events(spark, d):
    """A signature of every nation's event: good for its own key and message, for no other key and no other message."""

    def check(nation, pdf):
        key, other = (bytes([int(nation) + k]) * 32 for k in (0, 100))
        text = str(pdf["n_name"].iloc[0]).encode()
        made, public = signatures.sign(key, text), signatures.public_key(key)
        yield int(nation), signatures.verify(public, text, made), signatures.verify(signatures.public_key(other), text, made), signatures.verify(public, text + b"!", made)

    return frames.per_group(table(spark, d, "nation").withColumn("id", F.col("n_nationkey").cast("long")), "id", "id long, own boolean, other boolean, changed boolean", check)
