"""Queries over volumes, pyramids and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import floor_div, trunc_div
from lumenfold.operators import assign, sequence, volume
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TICKS_SQL, palette, pixels, table, ticks

P, T = f"WITH {PIXELS_SQL}", f"WITH {TICKS_SQL}"
W = "PARTITION BY burst ORDER BY ts, tick_id"
NUMBERED = f"{T}, o AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM ticks)"
PLANE = "plane AS (SELECT frame, (idx // 64) % 64 AS y, idx % 64 AS x, sum(l)::BIGINT AS v FROM pixels GROUP BY ALL)"

WHOLE = "plane AS (SELECT 0 AS frame, (idx // 16) % 16 AS y, idx % 16 AS x, sum(l)::BIGINT AS v FROM pixels GROUP BY ALL)"


def _plane(spark, d):
    px = pixels(spark, d)
    return px.groupBy("frame", (trunc_div("idx", 64) % 64).alias("y"), (F.col("idx") % 64).alias("x")).agg(F.sum("l").alias("v"))


@query("render_select", "WITH r AS (SELECT DISTINCT p_partkey % 4 AS t, (p_partkey // 4) % 4 AS y, (p_partkey // 16) % 4 AS x FROM part), d AS (SELECT *, (t + y + x) % 3 AS scale FROM r), f AS (SELECT t * 4 + a AS t, y * 4 + b AS y, x * 4 + c AS x, scale FROM d, generate_series(0, 3) q(a), generate_series(0, 3) w(b), generate_series(0, 3) e(c)) SELECT t, y, x, scale::INTEGER AS scale, (scale * 100000 + (t >> scale) * 400 + (y >> scale) * 20 + (x >> scale))::BIGINT AS v FROM f")
def render_select(spark, d):
    """Depth by region picks one of three volumes, whose values name their cell."""
    p = F.col("p_partkey")
    r = table(spark, d, "part").select((p % 4).alias("t"), (trunc_div(p, 4) % 4).alias("y"), (trunc_div(p, 16) % 4).alias("x")).distinct()
    depth = r.withColumn("scale", ((F.col("t") + F.col("y") + F.col("x")) % 3).cast("int"))
    grid = spark.range(4096).select((trunc_div("id", 256)).alias("t"), (trunc_div("id", 16) % 16).alias("y"), (F.col("id") % 16).alias("x"))
    vols = grid.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("v", F.col("scale").cast("long") * 100000 + F.col("t") * 400 + F.col("y") * 20 + F.col("x"))
    return volume.render_select(vols, depth)


@query("owner_integrate", f"{NUMBERED} SELECT [0, 1, 0, 2, 0, 1, 0, 2][i % 8 + 1] AS scale, burst AS cell, sum(least(1023, greatest(0, v)))::BIGINT AS total FROM o GROUP BY ALL")
def owner_integrate(spark, d):
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    return volume.owner_integrate(n.select((F.col("i") % 8).alias("s"), F.col("burst").alias("cell"), "v"), [0, 1, 0, 2, 0, 1, 0, 2])


@query("multiscale_reads", f"{NUMBERED} SELECT burst, i // 8 AS slow, sum(v)::BIGINT AS total, coalesce(sum(v) FILTER (WHERE i % 2 = 0), 0)::BIGINT AS fast, coalesce(sum(v) FILTER (WHERE i % 8 < 4), 0)::BIGINT AS mid FROM o GROUP BY ALL HAVING count(*) = 8")
def multiscale_reads(spark, d):
    """Slow reads of eight sub-slices, the pooled fast samples and the first mid read within each."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    g = n.groupBy("burst", trunc_div("i", 8).alias("slow")).agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.when(F.col("i") % 2 == 0, F.col("v"))).alias("fast"), F.sum(F.when(F.col("i") % 8 < 4, F.col("v"))).alias("mid"))
    return g.filter("n = 8").drop("n")


@query("moment_cube", f"{P}, c AS (SELECT least(7, greatest(0, CAST(floor((l + 32768) / 8192.0) AS BIGINT))) AS i, least(7, greatest(0, CAST(floor((a + 32768) / 8192.0) AS BIGINT))) AS j, count(*) AS n, sum(l)::BIGINT AS s FROM pixels GROUP BY ALL), g AS (SELECT i, j, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM (SELECT x::BIGINT AS i, y::BIGINT AS j FROM generate_series(0, 7) q(x), generate_series(0, 7) w(y)) LEFT JOIN c USING (i, j)) SELECT a.i, a.j, sum(b.n)::BIGINT AS n, sum(b.s)::BIGINT AS s FROM g a JOIN g b ON b.i <= a.i AND b.j <= a.j GROUP BY ALL")
def moment_cube(spark, d):
    """Moments on a grid of bins, and their sums over all lower bins: box sums are then four look-ups."""
    axis = lambda c: F.least(F.lit(7), F.greatest(F.lit(0), floor_div(F.col(c) + 32768, 8192)))
    cells = pixels(spark, d).groupBy(axis("l").alias("i"), axis("a").alias("j")).agg(F.count("*").alias("n"), F.sum("l").alias("s"))
    grid = spark.range(64).select(trunc_div("id", 8).alias("i"), (F.col("id") % 8).alias("j"))
    dense = grid.join(cells, ["i", "j"], "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("s", F.lit(0)).alias("s"))
    return volume.prefix_cube(dense, [], ["i", "j"], ["n", "s"])


@query("cube_level_lift", f"{P}, {WHOLE}, c AS (SELECT frame, y // 2 AS y, x // 2 AS x, max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 0) AS a, max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 1) AS b, max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 0) AS c, max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 1) AS d FROM plane GROUP BY ALL HAVING count(*) = 4), h AS (SELECT frame, y, x, b + ((a - b) >> 1) AS l0, a - b AS h0, d + ((c - d) >> 1) AS l1, c - d AS h1 FROM c) SELECT frame, y, x, l1 + ((l0 - l1) >> 1) AS dc, l0 - l1 AS g, h1 + ((h0 - h1) >> 1) AS b, h0 - h1 AS t FROM h")
def cube_level_lift(spark, d):
    px = pixels(spark, d)
    plane = px.groupBy(F.lit(0).alias("frame"), (trunc_div("idx", 16) % 16).alias("y"), (F.col("idx") % 16).alias("x")).agg(F.sum("l").alias("v"))
    return volume.lift_level(plane, ["frame"], "v")


@query("palette_haar", f"WITH {PALETTE_SQL}, a AS (SELECT frame, 0 AS level, slot // 2 AS node, max(l) FILTER (WHERE slot % 2 = 0) AS x, max(l) FILTER (WHERE slot % 2 = 1) AS y FROM palette GROUP BY ALL), b AS (SELECT frame, 0 AS level, node::BIGINT AS node, y + ((x - y) >> 1) AS low, x - y AS high FROM a), c AS (SELECT frame, node // 2 AS node, max(low) FILTER (WHERE node % 2 = 0) AS x, max(low) FILTER (WHERE node % 2 = 1) AS y FROM b GROUP BY ALL) SELECT frame, level, node, low, high FROM b UNION ALL SELECT frame, 1, node, y + ((x - y) >> 1), x - y FROM c")
def palette_haar(spark, d):
    return volume.haar_levels(palette(spark, d), ["frame"], "slot", "l", 2)


@query("float_haar", f"WITH {PALETTE_SQL} SELECT frame, slot // 2 AS node, round((max(l) FILTER (WHERE slot % 2 = 0) + max(l) FILTER (WHERE slot % 2 = 1)) / 2.0, 4) AS low, round((max(l) FILTER (WHERE slot % 2 = 0) - max(l) FILTER (WHERE slot % 2 = 1)) / 2.0, 4) AS high FROM palette GROUP BY ALL")
def float_haar(spark, d):
    g = palette(spark, d).groupBy("frame", trunc_div("slot", 2).alias("node")).agg(F.max(F.when(F.col("slot") % 2 == 0, F.col("l"))).alias("x"), F.max(F.when(F.col("slot") % 2 == 1, F.col("l"))).alias("y"))
    return g.select("frame", "node", F.round((F.col("x") + F.col("y")) / 2, 4).alias("low"), F.round((F.col("x") - F.col("y")) / 2, 4).alias("high"))


@query("quaternary_branches", f"WITH {PALETTE_SQL} SELECT frame, slot // 4 AS branch, (sum(l) >> 2)::BIGINT AS l, (sum(a) >> 2)::BIGINT AS a, (sum(b) >> 2)::BIGINT AS b FROM (SELECT frame, slot, l, a, b FROM palette) GROUP BY frame, branch".replace("sum(l) >> 2", "sum(l)::BIGINT >> 2").replace("sum(a) >> 2", "sum(a)::BIGINT >> 2").replace("sum(b) >> 2", "sum(b)::BIGINT >> 2"))
def quaternary_branches(spark, d):
    """Means of four slots, rounded down."""
    return palette(spark, d).groupBy("frame", trunc_div("slot", 4).alias("branch")).agg(*[F.shiftright(F.sum(c), 2).alias(c) for c in "lab"])


@query("context_window", f"{P}, {PLANE} SELECT p.frame, p.y, p.x, sum(coalesce(q.v, 0) * ((q.y - p.y + 1) * 3 + q.x - p.x + 1))::BIGINT AS digest FROM plane p LEFT JOIN plane q ON q.frame = p.frame AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL")
def context_window(spark, d):
    n = volume.neighbourhood(_plane(spark, d), ["frame"], "v", 1)
    digest = F.aggregate(F.transform("window", lambda v, k: v * k), F.lit(0).cast("long"), lambda a, x: a + x)
    return n.select("frame", "y", "x", digest.alias("digest"))


@query("detail_energy", f"{P}, {PLANE} SELECT frame, round(avg(abs(d)), 4) AS energy FROM (SELECT frame, v - lag(v) OVER (PARTITION BY frame, y ORDER BY x) AS d FROM plane) GROUP BY frame")
def detail_energy(spark, d):
    w = Window.partitionBy("frame", "y").orderBy("x")
    return _plane(spark, d).withColumn("d", F.col("v") - F.lag("v").over(w)).groupBy("frame").agg(F.round(F.avg(F.abs("d")), 4).alias("energy"))


@query("frame_energy", f"{P}, m AS (SELECT frame, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb FROM pixels GROUP BY frame) SELECT frame, round(avg((l - ml) * (l - ml) + (a - ma) * (a - ma) + (b - mb) * (b - mb)), 2) AS energy, round(var_pop(l), 2) AS luma, round(avg((a - ma) * (a - ma) - (a - ma) * (b - mb) + (b - mb) * (b - mb)), 2) AS chroma FROM pixels JOIN m USING (frame) GROUP BY frame")
def frame_energy(spark, d):
    """Spread around the mean colour, of luma, and in the hexagonal norm of chroma: all from one covariance."""
    c = assign.covariance(pixels(spark, d), ["frame"])
    return c.select("frame", F.round(F.col("c_ll") + F.col("c_aa") + F.col("c_bb"), 2).alias("energy"), F.round("c_ll", 2).alias("luma"), F.round(F.col("c_aa") - F.col("c_ab") + F.col("c_bb"), 2).alias("chroma"))


@query("pooled_covariance", f"{P} SELECT round(var_pop(l / 65536.0), 8) AS ll, round(covar_pop(l / 65536.0, a / 65536.0), 8) AS la FROM pixels")
def pooled_covariance(spark, d):
    """Total covariance from the frames' own: within plus between, weighted by count."""
    c = assign.covariance(pixels(spark, d).select("frame", *[(F.col(x) / 65536.0).alias(x) for x in "lab"]), ["frame"])
    total, ml, ma = F.sum("w"), F.sum(F.col("w") * F.col("m_l")) / F.sum("w"), F.sum(F.col("w") * F.col("m_a")) / F.sum("w")
    return c.agg(F.round(F.sum(F.col("w") * (F.col("c_ll") + F.col("m_l") * F.col("m_l"))) / total - ml * ml, 8).alias("ll"), F.round(F.sum(F.col("w") * (F.col("c_la") + F.col("m_l") * F.col("m_a"))) / total - ml * ma, 8).alias("la"))


@query("temporal_residual", f"{P}, m AS (SELECT frame, CAST(floor(sum(l)::DOUBLE / count(*)) AS BIGINT) AS v FROM pixels GROUP BY frame), p AS (SELECT frame // 2 AS pair, max(v) FILTER (WHERE frame % 2 = 0) AS x, max(v) FILTER (WHERE frame % 2 = 1) AS y FROM m GROUP BY ALL) SELECT pair::BIGINT AS pair, coalesce(y + ((x - y) >> 1), x) AS low, x - y AS high FROM p")
def temporal_residual(spark, d):
    """Floor means of the frames, split once in time."""
    m = pixels(spark, d).groupBy("frame").agg(floor_div(F.sum("l"), F.count("*")).alias("v")).withColumn("g", F.lit(0))
    return volume.haar_levels(m, ["g"], "frame", "v", 1).select(F.col("node").alias("pair"), "low", "high")


@query("persistence_baseline", f"{PALETTE_SQL.join(['WITH ', ''])} SELECT p.frame, round(avg((p.l - q.l) * (p.l - q.l) / 4294967296.0), 8) AS mse FROM palette p JOIN palette q ON q.frame = p.frame + 1 AND p.slot = q.slot GROUP BY p.frame")
def persistence_baseline(spark, d):
    """Error of predicting no change from frame to frame."""
    p = palette(spark, d)
    q = p.select((F.col("frame") - 1).alias("frame"), "slot", F.col("l").alias("next"))
    return p.join(q, ["frame", "slot"]).groupBy("frame").agg(F.round(F.avg((F.col("l") - F.col("next")) * (F.col("l") - F.col("next")) / 4294967296.0), 8).alias("mse"))


@query("ycbcr_to_rgb10", "WITH x AS (SELECT p_partkey, p_size * 18 + 64 AS y, p_partkey % 897 + 64 AS cb, (p_partkey * 7) % 897 + 64 AS cr FROM part), l AS (SELECT p_partkey, (y - 64) * 1196 AS y, cb - 512 AS cb, cr - 512 AS cr FROM x) SELECT p_partkey, least(1023, greatest(0, (y + 1883 * cr) >> 10)) AS r, least(1023, greatest(0, (y - 210 * cb - 730 * cr) >> 10)) AS g, least(1023, greatest(0, (y + 2402 * cb) >> 10)) AS b FROM l")
def ycbcr_to_rgb10(spark, d):
    """Ten-bit video-range YCbCr to RGB by integer weights of 1/1024."""
    p = F.col("p_partkey")
    x = table(spark, d, "part").select(p, (F.col("p_size") * 18).cast("long").alias("y"), (p % 897 - 448).alias("cb"), ((p * 7) % 897 - 448).alias("cr"))
    y = F.col("y") * 1196
    fit = lambda v: F.least(F.lit(1023), F.greatest(F.lit(0), F.shiftright(v, 10)))
    return x.select("p_partkey", fit(y + 1883 * F.col("cr")).alias("r"), fit(y - 210 * F.col("cb") - 730 * F.col("cr")).alias("g"), fit(y + 2402 * F.col("cb")).alias("b"))


#: Zone centres and targets of a look.
ZONES = [(0, 10), (100, 40), (250, 30), (600, 90), (1000, 100)]


@query("look_transfer", "WITH z(c, g) AS (VALUES " + ", ".join(map(str, ZONES)) + "), x AS (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) % 1200 AS v FROM part), b AS (SELECT p_partkey, v, (SELECT max(c) FROM z WHERE c <= v) AS lo, (SELECT min(c) FROM z WHERE c > v) AS hi FROM x) SELECT p_partkey, CASE WHEN hi IS NULL THEN zl.g ELSE zl.g + trunc((zh.g - zl.g) * (v - lo) / (hi - lo)::DOUBLE)::BIGINT END AS target FROM b JOIN z zl ON zl.c = lo LEFT JOIN z zh ON zh.c = hi")
def look_transfer(spark, d):
    """Targets piecewise linear between zone centres, ends clamped; every division truncates."""
    v = F.floor("p_retailprice").cast("long") % 1200
    out = F.lit(ZONES[-1][1]).cast("long")
    for (c0, g0), (c1, g1) in reversed(list(zip(ZONES, ZONES[1:]))):
        out = F.when(v < c1, F.lit(g0) + trunc_div((v - c0) * (g1 - g0), c1 - c0)).otherwise(out)
    return table(spark, d, "part").select("p_partkey", out.alias("target"))


@query("lut_grid", "SELECT i::BIGINT AS k, i % 9 AS r, i // 9 % 9 AS g, i // 81 AS b FROM generate_series(0, 728) t(i)")
def lut_grid(spark, d):
    """Nodes of a 9**3 table, red fastest."""
    return spark.range(729).select(F.col("id").alias("k"), (F.col("id") % 9).alias("r"), (trunc_div("id", 9) % 9).alias("g"), trunc_div("id", 81).alias("b"))


@query("exposure_ratio", f"{T} SELECT burst, tick_id, v * (tick_id % 400 + 50) AS product, v // gcd(v, 50000) AS num, 50000 // gcd(v, 50000) AS den FROM ticks WHERE v > 0")
def exposure_ratio(spark, d):
    """Duration times gain, and the exact ratio to 50 ms in lowest terms (Euclid in a fixed number of steps)."""
    step = lambda a, _: F.when(a["y"] == 0, a).otherwise(F.struct(a["y"].alias("x"), (a["x"] % F.greatest(a["y"], F.lit(1))).alias("y")))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.col("v").alias("x"), F.lit(50000).cast("long").alias("y")), step)["x"]
    t = ticks(spark, d).filter("v > 0").withColumn("g", g)
    return t.select("burst", "tick_id", (F.col("v") * (F.col("tick_id") % 400 + 50)).alias("product"), trunc_div("v", F.col("g")).alias("num"), trunc_div(50000, F.col("g")).alias("den"))


@query("binomials", "SELECT n::INTEGER AS n, k::INTEGER AS k, (factorial(n::INTEGER) // (factorial(k::INTEGER) * factorial((n - k)::INTEGER)))::BIGINT AS c FROM generate_series(0, 20) a(n), generate_series(0, 20) b(k) WHERE k <= n")
def binomials(spark, d):
    n = spark.range(21).select(F.col("id").cast("int").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    steps = F.filter(F.sequence(F.lit(0), F.lit(19)), lambda i: i < F.col("k"))
    return n.select("n", "k", F.aggregate(steps, F.lit(1).cast("long"), lambda c, i: trunc_div(c * (F.col("n") - i), i + 1)).alias("c"))


@query("stable_functions", "WITH x AS (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer) SELECT c_custkey, round(1 / (1 + exp(-x)), 8) AS sigmoid, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 8) AS softplus FROM x")
def stable_functions(spark, d):
    x = F.col("c_acctbal") / 1000
    e = F.exp(-F.abs(x))
    return table(spark, d, "customer").select("c_custkey", F.round(F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e)), 8).alias("sigmoid"), F.round(F.greatest(x, F.lit(0.0)) + F.log1p(e), 8).alias("softplus"))


@query("softmax", f"WITH {PALETTE_SQL}, e AS (SELECT frame, slot, exp((l - max(l) OVER (PARTITION BY frame)) / 8192.0) AS e FROM palette) SELECT frame, slot, round(e / sum(e) OVER (PARTITION BY frame), 8) AS p FROM e")
def softmax(spark, d):
    w = Window.partitionBy("frame")
    e = palette(spark, d).withColumn("e", F.exp((F.col("l") - F.max("l").over(w)) / 8192.0))
    return e.select("frame", "slot", F.round(F.col("e") / F.sum("e").over(w), 8).alias("p"))


@query("dft_power", f"WITH {PALETTE_SQL}, k AS (SELECT frame, k::INTEGER AS k, sum(l * cos(2 * pi() * k * slot / 16)) AS re, sum(l * sin(2 * pi() * k * slot / 16)) AS im FROM palette, generate_series(0, 8) t(k) GROUP BY ALL) SELECT frame, k, round((re * re + im * im) / 1e8, 3) AS power FROM k")
def dft_power(spark, d):
    """Power of nine frequencies over the slots of each palette, by one grouping."""
    p = palette(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(8))))
    angle = F.lit(2 * 3.141592653589793) * F.col("k") * F.col("slot") / 16
    g = p.groupBy("frame", "k").agg(F.sum(F.col("l") * F.cos(angle)).alias("re"), F.sum(F.col("l") * F.sin(angle)).alias("im"))
    return g.select("frame", "k", F.round((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 1e8, 3).alias("power"))


@query("gene_metrics", f"{P} SELECT idx, abs(l) + abs(a) + abs(b) AS l1, greatest(abs(l), abs(a), abs(b)) AS linf FROM pixels")
def gene_metrics(spark, d):
    v = F.array("l", "a", "b")
    return pixels(spark, d).select("idx", F.aggregate(v, F.lit(0).cast("long"), lambda s, x: s + F.abs(x)).alias("l1"), F.array_max(F.transform(v, F.abs)).alias("linf"))


@query("array_rotation", "SELECT vec_id, round(embedding[4]::DOUBLE, 6) AS first_item, round(embedding[3]::DOUBLE, 6) AS last_item, len(embedding) AS n FROM embeddings")
def array_rotation(spark, d):
    e = F.col("embedding")
    r = F.concat(F.slice(e, 4, F.size(e) - 3), F.slice(e, 1, 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(r, 1).cast("double"), 6).alias("first_item"), F.round(F.element_at(r, -1).cast("double"), 6).alias("last_item"), F.size(r).cast("long").alias("n"))


@query("json_maps", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_maps(spark, d):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, d, "events").select("event_id", F.element_at(m, "k").alias("k"))


@query("string_keys", "SELECT o_orderkey, 'adopt-' || o_custkey || '-' || o_orderkey AS id, regexp_extract(o_orderpriority, '^[0-9]+-(.*)$', 1) AS stem FROM orders")
def string_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", F.lit("adopt"), "o_custkey", "o_orderkey").alias("id"), F.regexp_extract("o_orderpriority", "^[0-9]+-(.*)$", 1).alias("stem"))


@query("time_units", "SELECT event_id, epoch_us(ts) // 50000 AS tick, epoch_us(ts) // 10000 AS cs, (epoch_us(ts) // 50000) & 63 AS loop FROM events")
def time_units(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", trunc_div(us, 50000).alias("tick"), trunc_div(us, 10000).alias("cs"), trunc_div(us, 50000).bitwiseAND(F.lit(63)).alias("loop"))


@query("paint_gate", f"{P} SELECT frame, sum(CASE WHEN idx % 3 = 0 THEN a ELSE 0 END)::BIGINT AS painted, count(*) FILTER (WHERE idx % 3 = 0) AS n FROM pixels GROUP BY frame")
def paint_gate(spark, d):
    """Detail is zeroed where the mask is off."""
    mask = F.col("idx") % 3 == 0
    return pixels(spark, d).groupBy("frame").agg(F.sum(F.when(mask, F.col("a")).otherwise(0)).alias("painted"), F.count_if(mask).alias("n"))


@query("gene_recombination", f"{P}, s AS (SELECT a.idx, ((a.l * (65536 - 16384) + b.l * 16384) >> 16) AS l, ((a.a * (65536 - 16384) + b.a * 16384) >> 16) AS a FROM pixels a JOIN pixels b ON b.idx = a.idx + 1) SELECT * FROM s")
def gene_recombination(spark, d):
    """Words of two parents blended at a quarter, rounded down."""
    p = pixels(spark, d)
    q = p.select((F.col("idx") - 1).alias("idx"), F.array("l", "a").alias("q"))
    mixed = F.zip_with(F.array("l", "a"), F.col("q"), lambda x, y: F.shiftright(x * (65536 - 16384) + y * 16384, 16))
    return p.join(q, "idx").withColumn("m", mixed).select("idx", F.col("m")[0].alias("l"), F.col("m")[1].alias("a"))


@query("affine_look", f"{P} SELECT idx, round(tanh((l / 65536.0 - 0.5) * 1.2 + 0.05), 7) AS l, round((a / 65536.0) * 1.1 + 0.01, 7) AS a FROM pixels")
def affine_look(spark, d):
    return pixels(spark, d).select("idx", F.round(F.tanh((F.col("l") / 65536.0 - 0.5) * 1.2 + 0.05), 7).alias("l"), F.round(F.col("a") / 65536.0 * 1.1 + 0.01, 7).alias("a"))


@query("depth_merge", "WITH x AS (SELECT p_partkey % 64 AS cell, p_size % 5 AS ord FROM part) SELECT cell, max(CASE WHEN ord <= 1 THEN 0 WHEN ord = 2 THEN 1 ELSE 2 END) AS depth FROM x GROUP BY cell")
def depth_merge(spark, d):
    """Orders as depths, merged by maximum."""
    o = F.col("p_size") % 5
    return table(spark, d, "part").groupBy((F.col("p_partkey") % 64).alias("cell")).agg(F.max(F.when(o <= 1, 0).when(o == 2, 1).otherwise(2)).alias("depth"))


@query("colour_tokens", f"{P} SELECT frame, count(*)::DOUBLE AS w, round(avg(l / 65536.0), 7) AS m0, round(var_pop(a / 65536.0), 7) AS s3 FROM pixels GROUP BY frame")
def colour_tokens(spark, d):
    """Gaussian tokens of a frame (mean, upper triangle, weight); three entries are shown."""
    c = assign.covariance(pixels(spark, d).select("frame", *[(F.col(x) / 65536.0).alias(x) for x in "lab"]), ["frame"])
    token = F.array("m_l", "m_a", "m_b", "c_ll", "c_la", "c_lb", "c_aa", "c_ab", "c_bb", "w")
    return c.withColumn("k", token).select("frame", F.element_at("k", 10).alias("w"), F.round(F.element_at("k", 1), 7).alias("m0"), F.round(F.element_at("k", 7), 7).alias("s3"))


@query("population_validator", f"{P}, n AS (SELECT frame, idx % 8 AS slot, count(*) AS n FROM pixels GROUP BY ALL) SELECT frame, min(n) >= 2 AND count(*) = 8 AS valid FROM n GROUP BY frame")
def population_validator(spark, d):
    n = pixels(spark, d).groupBy("frame", (F.col("idx") % 8).alias("slot")).agg(F.count("*").alias("n"))
    return n.groupBy("frame").agg(((F.min("n") >= 2) & (F.count("*") == 8)).alias("valid"))


@query("ranking_accuracy", "WITH x AS (SELECT label, sum(embedding[1]::DOUBLE * embedding[2]) AS d, sqrt(sum(embedding[1]::DOUBLE * embedding[1])) * sqrt(sum(embedding[2]::DOUBLE * embedding[2])) AS n FROM embeddings GROUP BY label) SELECT label, round(CASE WHEN n = 0 THEN 0.5 ELSE 1 - acos(greatest(-1, least(1, d / n))) / pi() END, 6) AS accuracy FROM x")
def ranking_accuracy(spark, d):
    """One minus the angle of two weight vectors over pi; a half for a null vector."""
    x, y = (F.col("embedding")[i].cast("double") for i in (0, 1))
    g = table(spark, d, "embeddings").groupBy("label").agg(F.sum(x * y).alias("d"), (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("n"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d") / F.col("n")))
    return g.select("label", F.round(F.when(F.col("n") == 0, 0.5).otherwise(1 - F.acos(cos) / 3.141592653589793), 6).alias("accuracy"))
