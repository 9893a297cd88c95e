"""Queries over pixels and palettes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import arith, color
from lumenfold.functions.lift import inverse3
from lumenfold.operators import assign
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, palette, pixels, table

P, PP = f"WITH {PIXELS_SQL}", f"WITH {PALETTE_SQL}"
D2 = "(p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b)"
NEAR = f"{PP}, d AS (SELECT p.frame, p.idx, p.l, p.a, p.b, q.slot, {D2} AS d2 FROM pixels p JOIN palette q USING (frame)), r AS (SELECT *, row_number() OVER (PARTITION BY frame, idx ORDER BY d2, slot) AS k FROM d)"


@query("nearest_centroid", f"{NEAR} SELECT frame, idx, slot, d2 FROM r WHERE k = 1")
def nearest_centroid(spark, d):
    return assign.nearest(pixels(spark, d), palette(spark, d)).select("frame", "idx", "slot", "d2")


@query("two_nearest", f"{NEAR} SELECT frame, idx, max(slot) FILTER (WHERE k = 1) AS first, max(slot) FILTER (WHERE k = 2) AS second FROM r GROUP BY ALL")
def two_nearest(spark, d):
    return assign.two_nearest(pixels(spark, d), palette(spark, d)).select("frame", "idx", "first", "second")


@query("prior_nearest", f"{PP}, d AS (SELECT p.frame, p.idx, q.slot, {D2} - 1000000 * q.slot AS s FROM pixels p JOIN palette q USING (frame)) SELECT frame, idx, arg_min(slot, (s, slot)) AS slot FROM d GROUP BY ALL")
def prior_nearest(spark, d):
    """Nearest after a prior of one million per slot number is taken off."""
    return assign.nearest(pixels(spark, d), palette(spark, d), penalty=lambda p: p["slot"] * 1_000_000).select("frame", "idx", "slot")


@query("tolerant_index", f"{NEAR}, m AS (SELECT frame, idx, min(d2) AS m FROM d GROUP BY ALL) SELECT d.frame, d.idx, min(slot) AS slot FROM d JOIN m ON d.frame = m.frame AND d.idx = m.idx WHERE d2 <= m + 5000000 GROUP BY ALL")
def tolerant_index(spark, d):
    return assign.within_tolerance(pixels(spark, d), palette(spark, d), 5_000_000).select("frame", "idx", "slot")


@query("palette_lookup", f"{NEAR} SELECT r.frame, idx, q.l, q.a, q.b FROM r JOIN palette q USING (frame, slot) WHERE k = 1")
def palette_lookup(spark, d):
    near = assign.nearest(pixels(spark, d), palette(spark, d)).select("frame", "idx", "slot")
    return assign.look_up(near, palette(spark, d)).select("frame", "idx", "l", "a", "b")


@query("global_remap", f"{PP}, d AS (SELECT p.frame, p.slot, q.slot AS target, {D2} AS d2 FROM palette p JOIN palette q ON q.frame = 0) SELECT frame, slot, arg_min(target, (d2, target)) AS target FROM d GROUP BY ALL")
def global_remap(spark, d):
    """Each frame's slots to the nearest slot of frame 0, which is broadcast as one array."""
    p = palette(spark, d)
    anchor = p.filter("frame = 0").select(F.lit(0).alias("g"), "slot", "l", "a", "b")
    return assign.nearest(p.select(F.lit(0).alias("g"), "frame", F.col("slot").alias("own"), "l", "a", "b"), anchor, ("g",)).select("frame", F.col("own").alias("slot"), F.col("slot").alias("target"))


@query("slot_alignment", f"{PP}, d AS (SELECT p.frame, p.slot, q.slot AS image, {D2} AS d2 FROM palette p JOIN palette q ON q.frame = 0), g AS (SELECT frame, slot, arg_min(image, (d2, image)) AS image, FROM d GROUP BY ALL), low AS (SELECT frame, image, min(slot) AS low FROM g GROUP BY ALL), n AS (SELECT p.frame, p.slot, q.slot AS back, {D2} AS d2 FROM palette p JOIN palette q ON q.frame = (p.frame + 1) % 10), f AS (SELECT frame, slot, arg_min(back, (d2, back)) AS back FROM n GROUP BY ALL) SELECT g.frame, g.slot, coalesce(low, back) AS aligned FROM g LEFT JOIN low ON low.frame = (g.frame + 1) % 10 AND low.image = g.image JOIN f ON f.frame = g.frame AND f.slot = g.slot")
def slot_alignment(spark, d):
    """Slots of the next frame with the same global image (lowest), else the nearest colour."""
    g = global_remap(spark, d).withColumnRenamed("target", "image")
    low = g.groupBy(F.pmod(F.col("frame") - 1, F.lit(10)).alias("frame"), "image").agg(F.min("slot").alias("low"))
    p = palette(spark, d)
    nxt = p.withColumn("frame", F.pmod(F.col("frame") - 1, F.lit(10)))
    near = assign.nearest(p.select("frame", F.col("slot").alias("own"), "l", "a", "b"), nxt).select("frame", F.col("own").alias("slot"), F.col("slot").alias("back"))
    return g.join(low, ["frame", "image"], "left").join(near, ["frame", "slot"]).select("frame", "slot", F.coalesce("low", "back").alias("aligned"))


@query("pairwise_cost", f"{PP} SELECT p.frame, p.slot AS i, q.slot AS j, {D2} AS cost FROM palette p JOIN palette q ON q.frame = (p.frame + 1) % 10")
def pairwise_cost(spark, d):
    """Cost matrix of each frame to the next (cyclic): at most 256 x 256 entries a frame, by equi-join."""
    p = palette(spark, d)
    q = p.select(F.pmod(F.col("frame") - 1, F.lit(10)).alias("frame"), F.col("slot").alias("j"), F.struct("l", "a", "b").alias("q"))
    return p.join(q, "frame").select("frame", F.col("slot").alias("i"), "j", assign.dist2(F.struct("l", "a", "b"), F.col("q")).alias("cost"))


@query("cyclic_momentum", f"{PP} SELECT p.frame, round(avg({D2}), 3) AS mse FROM palette p JOIN palette q ON q.frame = (p.frame + 1) % 10 AND p.slot = q.slot GROUP BY p.frame")
def cyclic_momentum(spark, d):
    p = palette(spark, d)
    q = p.select(F.pmod(F.col("frame") - 1, F.lit(10)).alias("frame"), "slot", F.struct("l", "a", "b").alias("q"))
    return p.join(q, ["frame", "slot"]).groupBy("frame").agg(F.round(F.avg(assign.dist2(F.struct("l", "a", "b"), F.col("q"))), 3).alias("mse"))


@query("value_delta", f"{PP} SELECT slot, coalesce(b.l, 0) - coalesce(a.l, 0) AS dl, coalesce(b.a, 0) - coalesce(a.a, 0) AS da, coalesce(b.b, 0) - coalesce(a.b, 0) AS db FROM (SELECT * FROM palette WHERE frame = 0 AND slot < 12) a FULL JOIN (SELECT * FROM palette WHERE frame = 1 AND slot >= 4) b USING (slot)")
def value_delta(spark, d):
    p = palette(spark, d)
    return assign.value_delta(p.filter("frame = 0 AND slot < 12"), p.filter("frame = 1 AND slot >= 4"), ["slot"])


@query("policy_delta", f"{NEAR}, g AS (SELECT p.idx, arg_min(q.slot, ({D2}, q.slot)) AS new FROM pixels p JOIN palette q ON q.frame = 0 GROUP BY p.idx) SELECT r.idx, slot AS old, new FROM r JOIN g USING (idx) WHERE k = 1 AND slot <> new")
def policy_delta(spark, d):
    px, p = pixels(spark, d), palette(spark, d)
    old = assign.nearest(px, p).select("idx", "slot")
    one = p.filter("frame = 0").withColumn("g", F.lit(0)).drop("frame")
    new = assign.nearest(px.withColumn("g", F.lit(0)), one, ("g",)).select("idx", "slot")
    return assign.policy_delta(old, new, ["idx"])


@query("palette_blend", f"{PP} SELECT p.slot, ((1 * p.l + 3 * q.l) >> 2) AS l, ((1 * p.a + 3 * q.a) >> 2) AS a, ((1 * p.b + 3 * q.b) >> 2) AS b FROM palette p JOIN palette q USING (slot) WHERE p.frame = 0 AND q.frame = 1")
def palette_blend(spark, d):
    p = palette(spark, d)
    q = p.filter("frame = 1").select("slot", F.struct("l", "a", "b").alias("q"))
    return p.filter("frame = 0").join(q, "slot").select("slot", *[color.blend(c, F.col("q")[c], 3).alias(c) for c in "lab"])


STATS = f"{NEAR}, a AS (SELECT * FROM r WHERE k = 1), m AS (SELECT frame, slot, count(*) AS n, trunc(sum(l)::DOUBLE / count(*))::BIGINT AS mean_l, trunc(sum(a)::DOUBLE / count(*))::BIGINT AS mean_a, trunc(sum(b)::DOUBLE / count(*))::BIGINT AS mean_b FROM a GROUP BY ALL)"


@query("cluster_stats", f"{STATS} SELECT frame, slot, any_value(n) AS n, any_value(mean_l) AS mean_l, any_value(mean_a) AS mean_a, any_value(mean_b) AS mean_b, floor(sqrt(sum((l - mean_l) * (l - mean_l))::BIGINT // any_value(n)))::BIGINT AS std_l, floor(sqrt(sum((a - mean_a) * (a - mean_a))::BIGINT // any_value(n)))::BIGINT AS std_a, floor(sqrt(sum((b - mean_b) * (b - mean_b))::BIGINT // any_value(n)))::BIGINT AS std_b FROM a JOIN m USING (frame, slot) GROUP BY frame, slot")
def cluster_stats(spark, d):
    return assign.cluster_stats(assign.nearest(pixels(spark, d), palette(spark, d)), ["frame", "slot"])


@query("fidelity", f"{NEAR} SELECT frame, round(avg(d2), 3) AS distortion FROM r WHERE k = 1 GROUP BY frame")
def fidelity(spark, d):
    return assign.nearest(pixels(spark, d), palette(spark, d)).groupBy("frame").agg(F.round(F.avg("d2"), 3).alias("distortion"))


COV = f"{P}, x AS (SELECT frame, l / 65536.0 AS l, a / 65536.0 AS a, b / 65536.0 AS b FROM pixels), c AS (SELECT frame, var_pop(l) AS ll, covar_pop(l, a) AS la, covar_pop(l, b) AS lb, var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb FROM x GROUP BY frame), e AS (SELECT *, ll * (aa * bb - ab * ab) - la * (la * bb - ab * lb) + lb * (la * ab - aa * lb) AS det, ll + aa + bb AS trace, ll * ll + aa * aa + bb * bb + 2 * (la * la + lb * lb + ab * ab) AS sq FROM c)"


def _shape(spark, d):
    x = pixels(spark, d).select("frame", *[(F.col(c) / 65536.0).alias(c) for c in "lab"])
    c = assign.covariance(x, ["frame"])
    e = [F.col(f"c_{p}") for p in ("ll", "la", "lb", "aa", "ab", "bb")]
    det, _ = inverse3(*e)
    return c.withColumn("det", det).withColumn("trace", e[0] + e[3] + e[5]).withColumn("sq", e[0] * e[0] + e[3] * e[3] + e[5] * e[5] + 2 * (e[1] * e[1] + e[2] * e[2] + e[4] * e[4]))


@query("covariance_shape", f"{COV} SELECT frame, round(trace, 6) AS trace, round(0.5 * ln(pow(2 * pi() * exp(1), 3) * greatest(det, 1e-12)), 5) AS gauss_entropy, round(trace * trace / sq, 5) AS effective_dim FROM e")
def covariance_shape(spark, d):
    entropy = 0.5 * F.log(F.pow(2 * F.lit(3.141592653589793) * F.exp(F.lit(1.0)), F.lit(3)) * F.greatest("det", F.lit(1e-12)))
    return _shape(spark, d).select("frame", F.round("trace", 6).alias("trace"), F.round(entropy, 5).alias("gauss_entropy"), F.round(F.col("trace") * F.col("trace") / F.col("sq"), 5).alias("effective_dim"))


@query("outlier_admission", f"{COV}, m AS (SELECT frame, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM x GROUP BY frame), y AS (SELECT x.frame, l - ml AS l, a - ma AS a, b - mb AS b FROM x JOIN m USING (frame)), z AS (SELECT y.frame, (l * l * (aa * bb - ab * ab) + a * a * (ll * bb - lb * lb) + b * b * (ll * aa - la * la) + 2 * (l * a * (lb * ab - la * bb) + l * b * (la * ab - lb * aa) + a * b * (la * lb - ll * ab))) / det AS d2, det FROM y JOIN e USING (frame)) SELECT frame, count(*) FILTER (WHERE abs(det) < 1e-12 OR d2 > 7.8147) AS admitted FROM z GROUP BY frame")
def outlier_admission(spark, d):
    """Colours whose squared Mahalanobis distance exceeds the 95 % point of chi-squared with 3 degrees."""
    c = _shape(spark, d)
    e = [F.col(f"c_{p}") for p in ("ll", "la", "lb", "aa", "ab", "bb")]
    _, adj = inverse3(*e)
    x = pixels(spark, d).select("frame", *[(F.col(k) / 65536.0).alias(k) for k in "lab"]).join(c, "frame")
    dl, da, db = (F.col(k) - F.col(f"m_{k}") for k in "lab")
    d2 = (dl * dl * adj[0] + da * da * adj[3] + db * db * adj[5] + 2 * (dl * da * adj[1] + dl * db * adj[2] + da * db * adj[4])) / F.col("det")
    return x.groupBy("frame").agg(F.count_if((F.abs("det") < 1e-12) | (d2 > 7.8147)).alias("admitted"))


AX = lambda e: f"least(15, greatest(0, CAST(floor(({e}) / 4096.0) AS INTEGER)))"
BIN = f"({AX('l')} * 16 + {AX('a + 32768')}) * 16 + {AX('b + 32768')}"


@query("bins_occupied", f"{P} SELECT frame, count(DISTINCT {BIN}) AS bins FROM pixels GROUP BY frame")
def bins_occupied(spark, d):
    return pixels(spark, d).groupBy("frame").agg(F.countDistinct(color.bin_index("l", "a", "b")).alias("bins"))


@query("scene_readout", f"{P}, n AS (SELECT frame, {BIN} AS bin, count(*) AS n FROM pixels GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, bin) AS k FROM n) SELECT frame, k AS rank, bin, n FROM r WHERE k <= 6")
def scene_readout(spark, d):
    n = pixels(spark, d).groupBy("frame", color.bin_index("l", "a", "b").alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "bin"))).filter("rank <= 6")


@query("gamut_clamp", f"{P} SELECT idx, l BETWEEN 0 AND 65536 AND a BETWEEN -32768 AND 32768 AND b BETWEEN -32768 AND 32768 AS inside, least(65536, greatest(0, l)) AS l, least(32768, greatest(-32768, a)) AS a, least(32768, greatest(-32768, b)) AS b FROM pixels")
def gamut_clamp(spark, d):
    fit = color.clamp_gamut("l", "a", "b")
    return pixels(spark, d).select("idx", color.in_gamut("l", "a", "b").alias("inside"), *[c.alias(n) for c, n in zip(fit, "lab")])


@query("opponent_projections", f"{P}, o AS (SELECT frame, l AS r, a AS g, b AS b, l + a + b AS sum, l - a AS r_g, l + a - 2 * b AS rg_2b, l - b AS r_b, a - b AS g_b FROM pixels) SELECT frame, p, sum(v)::BIGINT AS total FROM o UNPIVOT (v FOR p IN (r, g, b, sum, r_g, rg_2b, r_b, g_b)) GROUP BY ALL")
def opponent_projections(spark, d):
    o = color.opponents("l", "a", "b")
    return pixels(spark, d).select("frame", *[c.alias(k) for k, c in o.items()]).unpivot("frame", list(o), "p", "v").groupBy("frame", "p").agg(F.sum("v").alias("total"))


FACET = f"{P}, o AS (SELECT frame, l AS r, a AS g, b AS b, l + a + b AS sum, l - a AS r_g, l + a - 2 * b AS rg_2b, l - b AS r_b, a - b AS g_b FROM pixels), u AS (SELECT frame, p, v FROM o UNPIVOT (v FOR p IN (r, g, b, sum, r_g, rg_2b, r_b, g_b)))"


@query(
    "frame_facets",
    f"""{FACET}, n AS (SELECT frame, p, v, count(*) AS n FROM u GROUP BY ALL), md AS (SELECT frame, p, arg_min(v, (-n, v)) AS mode FROM n GROUP BY ALL), c AS (SELECT frame, p, avg(v) AS mean, median(v) AS median FROM u GROUP BY ALL)
    SELECT u.frame, u.p, round(any_value(mean), 4) AS mean, any_value(median) AS median, any_value(mode) AS mode, round(avg((v - mean) * (v - mean)), 2) AS l2, round(avg(abs(v - median)), 4) AS l1, count(*) FILTER (WHERE v <> mode) AS l0
    FROM u JOIN c USING (frame, p) JOIN md USING (frame, p) GROUP BY ALL""",
)
def frame_facets(spark, d):
    """Mean, median and mode of eight projections per frame, and the energies left around them."""
    o = color.opponents("l", "a", "b")
    u = pixels(spark, d).select("frame", *[c.alias(k) for k, c in o.items()]).unpivot("frame", list(o), "p", "v")
    c = u.groupBy("frame", "p").agg(F.avg("v").alias("mean"), F.median("v").alias("median"), F.mode("v", True).alias("mode"))
    j = u.join(c, ["frame", "p"])
    energies = j.groupBy("frame", "p").agg(F.avg((F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))).alias("l2"), F.avg(F.abs(F.col("v") - F.col("median"))).alias("l1"), F.count_if(F.col("v") != F.col("mode")).alias("l0"))
    return c.join(energies, ["frame", "p"]).select("frame", "p", F.round("mean", 4).alias("mean"), "median", "mode", F.round("l2", 2).alias("l2"), F.round("l1", 4).alias("l1"), "l0")


@query(
    "zone_profile",
    f"""{P}, z AS (SELECT least(7, greatest(0, CAST(floor((l + 32768) / 8192.0) AS INTEGER))) AS zone, a, b FROM pixels), g AS (SELECT trunc(sum(a)::DOUBLE / count(*))::BIGINT AS a, trunc(sum(b)::DOUBLE / count(*))::BIGINT AS b FROM z),
    m AS (SELECT zone, trunc(sum(a)::DOUBLE / count(*))::BIGINT AS a, trunc(sum(b)::DOUBLE / count(*))::BIGINT AS b FROM z GROUP BY zone) SELECT s::INTEGER AS zone, coalesce(m.a, g.a) AS a, coalesce(m.b, g.b) AS b FROM generate_series(0, 7) t(s) CROSS JOIN g LEFT JOIN m ON m.zone = s""",
)
def zone_profile(spark, d):
    """Mean a and b of eight luminance zones; an empty zone takes the global mean."""
    z = pixels(spark, d).select(F.least(F.lit(7), F.greatest(F.lit(0), arith.floor_div(F.col("l") + 32768, 8192))).cast("int").alias("zone"), "a", "b")
    mean = lambda c: arith.trunc_div(F.sum(c), F.count("*"))
    every = z.agg(mean("a").alias("ga"), mean("b").alias("gb"))  # one row
    own = z.groupBy("zone").agg(mean("a").alias("a"), mean("b").alias("b"))
    zones = spark.range(8).select(F.col("id").cast("int").alias("zone")).crossJoin(F.broadcast(every))
    return zones.join(own, "zone", "left").select("zone", F.coalesce("a", "ga").alias("a"), F.coalesce("b", "gb").alias("b"))


@query("sigma_pairs", f"{PP} SELECT frame, slot, s AS sign, l + 100 * slot AS l, s * (a + 50) AS a, s * (b - 50) AS b FROM palette, (VALUES (1), (-1)) t(s)")
def sigma_pairs(spark, d):
    """Each leaf with its mirror image (l, -a, -b), displaced by a per-slot delta."""
    p = palette(spark, d).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    return p.select("frame", "slot", "sign", (F.col("l") + 100 * F.col("slot")).alias("l"), (F.col("sign") * (F.col("a") + 50)).alias("a"), (F.col("sign") * (F.col("b") - 50)).alias("b"))


@query("grid_layout_blocks", "WITH c AS (SELECT p_partkey AS idx, p_partkey // 256 AS block, p_size AS x, p_retailprice AS y FROM part), k AS (SELECT *, ((row_number() OVER (PARTITION BY block ORDER BY x, idx) - 1) // 16)::INTEGER AS col FROM c) SELECT idx, block, col, (row_number() OVER (PARTITION BY block, col ORDER BY y, idx) - 1)::INTEGER AS row FROM k")
def grid_layout_blocks(spark, d):
    """All parts, one 16 x 16 grid for each block of 256."""
    c = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), arith.floor_div(F.col("p_partkey"), 256).alias("block"), F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    return assign.grid_layout(c, F.col("x"), F.col("y"), 16, ["block"]).select("idx", "block", "col", "row")


@query("block_pool", f"{P} SELECT frame, (idx % 64) // 4 AS x, ((idx // 64) % 64) // 4 AS y, count(*) AS n, sum(l)::BIGINT AS l, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM pixels GROUP BY ALL")
def block_pool(spark, d):
    px = pixels(spark, d).withColumn("x", F.col("idx") % 64).withColumn("y", arith.trunc_div("idx", 64) % 64)
    return assign.pool_blocks(px, ["frame"], 4, "lab")


@query("pool_pyramid", f"{P} SELECT frame, (idx % 64) // 16 AS x, ((idx // 64) % 64) // 16 AS y, count(*) AS n, sum(l)::BIGINT AS l FROM pixels GROUP BY ALL")
def pool_pyramid(spark, d):
    """The coarse rung pooled from the fine rung's sums: equal to pooling the pixels."""
    fine = block_pool(spark, d)
    return fine.groupBy("frame", arith.trunc_div("x", 4).alias("x"), arith.trunc_div("y", 4).alias("y")).agg(F.sum("n").alias("n"), F.sum("l").alias("l"))


@query("replicate_decimate", f"{P} SELECT idx, l FROM pixels")
def replicate_decimate(spark, d):
    """Every cell repeated 2 x 2 and its top-left kept again."""
    px = pixels(spark, d).select("idx", "l", (F.col("idx") * 2).alias("x"), F.lit(0).cast("long").alias("y"))
    up = px.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return up.filter(((F.col("x") + F.col("dx")) % 2 == 0) & ((F.col("y") + F.col("dy")) % 2 == 0)).select("idx", "l")


@query("top2_margins", f"{NEAR} , m AS (SELECT frame, slot, count(*) AS n FROM r WHERE k = 1 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n DESC, slot) AS k FROM m) SELECT frame, (max(n) FILTER (WHERE k = 1) - coalesce(max(n) FILTER (WHERE k = 2), 0))::BIGINT AS margin FROM t GROUP BY frame")
def top2_margins(spark, d):
    n = assign.nearest(pixels(spark, d), palette(spark, d)).groupBy("frame", "slot").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("n"), "slot"))).filter("k <= 2")
    return top.groupBy("frame").agg((F.max(F.when(F.col("k") == 1, F.col("n"))) - F.coalesce(F.max(F.when(F.col("k") == 2, F.col("n"))), F.lit(0))).alias("margin"))


@query("quartet_displacement", f"{PP}, q AS (SELECT frame // 4 AS quartet, slot, frame, l, a, b FROM palette), j AS (SELECT p.quartet, p.slot, sqrt({D2}) AS s FROM q p JOIN q ON p.quartet = q.quartet AND p.slot = q.slot AND q.frame = p.frame + 1), t AS (SELECT quartet, slot, round(sum(s), 3) AS disp FROM j GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY quartet ORDER BY disp, slot) - 1 AS rank FROM t")
def quartet_displacement(spark, d):
    """Path length of each slot over four frames, and its coreness rank."""
    q = palette(spark, d).withColumn("quartet", arith.trunc_div("frame", 4))
    w = Window.partitionBy("quartet", "slot").orderBy("frame")
    step = q.withColumn("p", F.lag(F.struct("l", "a", "b")).over(w)).filter("p IS NOT NULL")
    t = step.groupBy("quartet", "slot").agg(F.round(F.sum(F.sqrt(assign.dist2(F.struct("l", "a", "b"), F.col("p")).cast("double"))), 3).alias("disp"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("quartet").orderBy("disp", "slot")) - 1)


@query("cell_outer_sums", f"{P} SELECT frame, sum(l * (idx % 4))::BIGINT AS l_x, sum(l * (idx // 4 % 4))::BIGINT AS l_y, sum(a * (idx % 4))::BIGINT AS a_x, sum(a * (idx // 4 % 4))::BIGINT AS a_y, sum(b * (idx % 4))::BIGINT AS b_x, sum(b * (idx // 4 % 4))::BIGINT AS b_y FROM pixels GROUP BY frame")
def cell_outer_sums(spark, d):
    """Sums of colour times place: an outer product as six aggregates."""
    x, y = F.col("idx") % 4, arith.trunc_div("idx", 4) % 4
    return pixels(spark, d).groupBy("frame").agg(*[F.sum(F.col(c) * s).alias(f"{c}_{n}") for c in "lab" for n, s in (("x", x), ("y", y))])


@query("variance_hinge", f"{P} SELECT frame, round(greatest(0, 0.2 - sqrt(var_pop(l / 65536.0) + 1e-4)) + greatest(0, 0.2 - sqrt(var_pop(a / 65536.0) + 1e-4)) + greatest(0, 0.2 - sqrt(var_pop(b / 65536.0) + 1e-4)), 6) AS hinge, round(pow(coalesce(corr(l, a), 0), 2) + pow(coalesce(corr(l, b), 0), 2) + pow(coalesce(corr(a, b), 0), 2), 6) AS redundancy FROM pixels GROUP BY frame")
def variance_hinge(spark, d):
    hinge = sum(F.greatest(F.lit(0.0), 0.2 - F.sqrt(F.var_pop(F.col(c) / 65536.0) + 1e-4)) for c in "lab")
    red = sum(F.pow(F.coalesce(F.corr(x, y), F.lit(0.0)), F.lit(2)) for x, y in ("la", "lb", "ab"))
    return pixels(spark, d).groupBy("frame").agg(F.round(hinge, 6).alias("hinge"), F.round(red, 6).alias("redundancy"))


def _lin_sql(m, v):
    return [" + ".join(f"({x}) * {v[i]}" for i, x in enumerate(row)) for row in m]


@query("oklab_float", f"{P}, n AS (SELECT idx, abs(l) / 65536.0::DOUBLE AS r, abs(a) / 65536.0::DOUBLE AS g, abs(b) / 65536.0::DOUBLE AS bl FROM pixels), t AS (SELECT idx, " + ", ".join(f"cbrt({e}) AS t{i}" for i, e in enumerate(_lin_sql(color.LMS, ("r", "g", "bl")))) + " FROM n) SELECT idx, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in zip("lab", _lin_sql(color.LAB, ("t0", "t1", "t2")))) + " FROM t")
def oklab_float(spark, d):
    rgb = [F.abs(c) / 65536.0 for c in "lab"]
    return pixels(spark, d).select("idx", *[F.round(x, 6).alias(c) for c, x in zip("lab", color.linear_to_oklab(*rgb))])


@query("oklab_roundtrip", f"{P} SELECT idx, round(abs(l) / 65536.0, 4) AS l, round(abs(a) / 65536.0, 4) AS a, round(abs(b) / 65536.0, 4) AS b FROM pixels")
def oklab_roundtrip(spark, d):
    px = pixels(spark, d).select("idx", *[(F.abs(c) / 65536.0).alias(c) for c in "lab"])
    lab = px.select("idx", *[x.alias(c) for c, x in zip("lab", color.linear_to_oklab(*"lab"))])
    return lab.select("idx", *[F.abs(F.round(x, 4)).alias(c) for c, x in zip("lab", color.oklab_to_linear(*"lab"))])


@query("srgb_transfer", f"{P}, c AS (SELECT idx, (abs(l) % 256) / 255.0::DOUBLE AS c FROM pixels), n AS (SELECT idx, CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END AS lin, c FROM c) SELECT idx, round(lin, 7) AS linear, round(c, 6) AS back FROM n")
def srgb_transfer(spark, d):
    c = pixels(spark, d).select("idx", color.srgb_to_linear((F.abs("l") % 256) / 255.0).alias("linear"))
    return c.select("idx", F.round("linear", 7).alias("linear"), F.round(color.linear_to_srgb("linear"), 6).alias("back"))


@query("brush_neighbourhood", "SELECT k, m FROM (SELECT DISTINCT CAST(p_partkey % 256 AS INTEGER) AS k FROM part), LATERAL (SELECT unnest([(k & ~3), (k & ~3) + 1, (k & ~3) + 2, (k & ~3) + 3]) AS m)")
def brush_neighbourhood(spark, d):
    """The quartet of slots around each slot."""
    k = table(spark, d, "part").select((F.col("p_partkey") % 256).cast("int").alias("k")).distinct()
    return k.withColumn("m", F.explode(F.sequence(F.col("k") - F.col("k") % 4, F.col("k") - F.col("k") % 4 + 3)))


@query("halting", "WITH h AS (SELECT p_partkey, 1.0 / (1 + p_size) AS h FROM part), w AS (SELECT p_partkey, i, pow(1 - h, i) * h AS w FROM h, generate_series(0, 7) t(i)) SELECT p_partkey, i::INTEGER AS i, round(w / sum(w) OVER (PARTITION BY p_partkey), 8) AS p FROM w")
def halting(spark, d):
    """Geometric halting probabilities over eight steps, normalised."""
    p = table(spark, d, "part").select("p_partkey", (1.0 / (1 + F.col("p_size"))).alias("h"))
    w = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pow(1 - F.col("h"), i) * F.col("h"))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return p.withColumn("w", w).withColumn("total", total).select("p_partkey", F.posexplode("w").alias("i", "x"), "total").select("p_partkey", "i", F.round(F.col("x") / F.col("total"), 8).alias("p"))
