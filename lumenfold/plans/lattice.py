"""Queries over bytes, lattices, moves, schedules and cell budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import color
from lumenfold.functions.arith import floor_div, trunc_div
from lumenfold.operators import sequence
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TICKS_SQL, palette, pixels, table, ticks

P, PP, T = f"WITH {PIXELS_SQL}", f"WITH {PALETTE_SQL}", f"WITH {TICKS_SQL}"
NUMBERED = f"{T}, o AS (SELECT *, row_number() OVER (PARTITION BY burst ORDER BY ts, tick_id) - 1 AS i FROM ticks)"


def _tdiv(x: str, n: int) -> str:
    """SQL of a quotient towards zero."""
    return f"(CASE WHEN ({x}) < 0 THEN -((-({x})) // {n}) ELSE ({x}) // {n} END)"


def _fdiv(x: str, n: int) -> str:
    """SQL of a quotient rounded down."""
    return f"((({x}) - ((({x}) % {n} + {n}) % {n})) // {n})"


def _lin(row, names) -> str:
    return " + ".join(f"({round(w * 65536)})::BIGINT * {c}" for w, c in zip(row, names))


def _lab_q16_sql(source: str, keep: str, r: str, g: str, b: str) -> str:
    """CTEs ending in ``lab``: keep, l, a, b of linear Q16 columns of ``source``."""
    roots = ", ".join(f"least(131072, greatest(0, {_tdiv(_lin(row, (r, g, b)), 65536)}))::HUGEINT * 4294967296 AS n{i}" for i, row in enumerate(color.LMS))
    fix = ", ".join(f"(CASE WHEN m{i}::HUGEINT * m{i} * m{i} > n{i} THEN m{i} - 1 WHEN (m{i} + 1)::HUGEINT * (m{i} + 1) * (m{i} + 1) <= n{i} THEN m{i} + 1 ELSE m{i} END)::BIGINT AS t{i}" for i in range(3))
    guess = ", ".join(f"floor(cbrt(n{i}::DOUBLE))::BIGINT AS m{i}, n{i}" for i in range(3))
    lab = ", ".join(f"{_tdiv(_lin(row, ('t0', 't1', 't2')), 65536)} AS {c}" for row, c in zip(color.LAB, "lab"))
    return f"c0 AS (SELECT {keep}, {roots} FROM {source}), c1 AS (SELECT {keep}, {guess} FROM c0), c2 AS (SELECT {keep}, {fix} FROM c1), lab AS (SELECT {keep}, {lab} FROM c2)"


LIN_SQL = "CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
BYTES_SQL = "bytes AS (SELECT p_partkey AS id, p_partkey % 256 AS r, (p_partkey * 7 + p_size) % 256 AS g, (p_partkey * 31 + 11 * p_size) % 256 AS b FROM part)"


def _bytes(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(p.alias("id"), (p % 256).alias("r"), ((p * 7 + s) % 256).alias("g"), ((p * 31 + 11 * s) % 256).alias("b"))


@query("srgb8_oklab_q16", f"WITH {BYTES_SQL}, q AS (SELECT id, " + ", ".join(f"round_even(({LIN_SQL.format(c=c)}) * 65536, 0)::BIGINT AS {c}" for c in "rgb") + f" FROM bytes), {_lab_q16_sql('q', 'id', 'r', 'g', 'b')} SELECT * FROM lab")
def srgb8_oklab_q16(spark, d):
    """Bytes to integer OKLab."""
    return _bytes(spark, d).select("id", *[x.alias(c) for c, x in zip("lab", color.srgb8_to_oklab_q16("r", "g", "b"))])


@query("oklab_q16", f"{P}, {_lab_q16_sql('pixels', 'idx', 'greatest(0, l)', 'greatest(0, a)', 'greatest(0, b)')} SELECT * FROM lab")
def oklab_q16(spark, d):
    """Exact integer OKLab of linear light; the tests also hold a Python mirror."""
    return pixels(spark, d).select("idx", *[x.alias(c) for c, x in zip("lab", color.linear_to_oklab_q16("l", "a", "b"))])


def _byte_sql(x: str) -> str:
    c = f"(least(65536, greatest(0, {x})) / 65536.0::DOUBLE)"
    return f"floor((CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4::DOUBLE) - 0.055 END) * 255.0 + 0.5)::INTEGER"


@query("oklab_q16_srgb8", f"{P}, r0 AS (SELECT idx, " + ", ".join(f"{_tdiv(_lin(row, ('(abs(l) + 20000)', 'a', 'b')), 65536)} AS v{i}" for i, row in enumerate(color.ROOTS)) + " FROM pixels), r1 AS (SELECT idx, " + ", ".join(f"{_tdiv(f'v{i} * v{i} * v{i}', 4294967296)} AS v{i}" for i in range(3)) + " FROM r0), r2 AS (SELECT idx, " + ", ".join(f"{_tdiv(_lin(row, ('v0', 'v1', 'v2')), 65536)} AS {c}" for row, c in zip(color.RGB, "rgb")) + " FROM r1) SELECT idx, " + ", ".join(f"{_byte_sql(c)} AS {c}" for c in "rgb") + " FROM r2")
def oklab_q16_srgb8(spark, d):
    """Integer OKLab to bytes."""
    return pixels(spark, d).select("idx", *[x.alias(c) for c, x in zip("rgb", color.oklab_q16_to_srgb8(F.abs("l") + 20000, F.col("a"), F.col("b")))])


@query("half_widen", "WITH h AS (SELECT p_partkey, ((p_partkey * 40503) % 65536)::BIGINT AS bits FROM part), s AS (SELECT p_partkey, bits, (bits >> 10) & 31 AS e, bits & 1023 AS m FROM h) SELECT p_partkey, (CASE WHEN bits >= 32768 THEN -1 ELSE 1 END * CASE WHEN e = 31 THEN 0 WHEN e = 0 THEN floor(m / 256.0 + 0.5) ELSE least(1073741824, floor((1024 + m) * pow(2.0, e - 9) + 0.5)) END)::BIGINT AS q16 FROM s")
def half_widen(spark, d):
    """Bit patterns of 16-bit floats to Q16: half away from zero, clamped to 2**30, 0 where not finite."""
    bits = ((F.col("p_partkey") * 40503) % 65536).cast("long")
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    size = F.when(e == 31, 0.0).when(e == 0, F.floor(m / 256.0 + 0.5).cast("double")).otherwise(F.least(F.lit(1073741824.0), F.floor((m + 1024) * F.pow(F.lit(2.0), e - 9) + 0.5).cast("double")))
    return table(spark, d, "part").select("p_partkey", (F.when(bits >= 32768, -1).otherwise(1) * size).cast("long").alias("q16"))


MOVES = [(dl, 0, 0) for dl in range(-2, 3)] + [(0, *u) for u in color.HEX_UNITS]


@query("lattice_snap", f"WITH {BYTES_SQL}, t AS (SELECT id, r + g + b + id % 3 AS l, r - b AS ca, g - b AS cb FROM bytes), c AS (" + " UNION ALL ".join(f"SELECT id, {k} AS k, {dl * dl + x * x - x * y + y * y} AS cost, {abs(dl)} AS dl, l + {dl} AS luma, ca + {x} AS ca, cb + {y} AS cb FROM t" for k, (dl, x, y) in enumerate(MOVES)) + "), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, dl, abs(ca) + abs(cb), k) AS n FROM c WHERE ((luma - ca - cb) % 3 + 3) % 3 = 0) SELECT id, luma, (luma - ca - cb) // 3 + ca AS r, (luma - ca - cb) // 3 + cb AS g, (luma - ca - cb) // 3 AS b FROM o WHERE n = 1")
def lattice_snap(spark, d):
    """Luma and hexagonal chroma off the lattice, snapped to the nearest point with an integer colour."""
    p = _bytes(spark, d).select("id", (F.col("r") + F.col("g") + F.col("b") + F.col("id") % 3).alias("l"), (F.col("r") - F.col("b")).alias("ca"), (F.col("g") - F.col("b")).alias("cb"))
    s = p.select("id", color.closest_lattice_point("l", "ca", "cb").alias("s")).select("id", "s.*")
    blue = trunc_div(F.col("luma") - F.col("ca") - F.col("cb"), 3)
    return s.select("id", "luma", (blue + F.col("ca")).alias("r"), (blue + F.col("cb")).alias("g"), blue.alias("b"))


@query("isometry_moves", f"{PP} SELECT frame, slot, (CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END) * l + 4096 AS l, -a - 512 AS a, b + 77 AS b, CASE slot % 4 WHEN 0 THEN a WHEN 1 THEN -b WHEN 2 THEN -a ELSE b END AS ra, CASE slot % 4 WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN -b ELSE -a END AS rb FROM palette")
def isometry_moves(spark, d):
    """Sign flips with a shift, and quarter turns of the chroma."""
    turn, a, b = F.col("slot") % 4, F.col("a"), F.col("b")
    ra = F.when(turn == 0, a).when(turn == 1, -b).when(turn == 2, -a).otherwise(b)
    rb = F.when(turn == 0, b).when(turn == 1, a).when(turn == 2, -b).otherwise(-a)
    return palette(spark, d).select("frame", "slot", (F.when(F.col("slot") % 2 == 0, 1).otherwise(-1) * F.col("l") + 4096).alias("l"), (-a - 512).alias("a"), (b + 77).alias("b"), ra.alias("ra"), rb.alias("rb"))


@query("voxel_projection", "SELECT p_partkey AS id, rx, ry, 2 * (p_partkey % 64 - 32) + rx * (63 - p_partkey // 4096 % 64) AS u, 2 * (p_partkey // 64 % 64 - 32) + ry * (63 - p_partkey // 4096 % 64) AS v FROM part, generate_series(0, 2) a(rx), generate_series(0, 2) b(ry)")
def voxel_projection(spark, d):
    """Cells of a 64-cube on the art grid, under each of nine rungs: depth shears, two art pixels a voxel."""
    p = F.col("p_partkey")
    depth = 63 - trunc_div(p, 4096) % 64
    rungs = table(spark, d, "part").select(p.alias("id"), F.explode(F.sequence(F.lit(0), F.lit(8)).cast("array<bigint>")).alias("k"))
    rx, ry, p = trunc_div("k", 3), F.col("k") % 3, F.col("id")
    depth = 63 - trunc_div(p, 4096) % 64
    return rungs.select("id", rx.alias("rx"), ry.alias("ry"), (2 * (p % 64 - 32) + rx * depth).alias("u"), (2 * (trunc_div(p, 64) % 64 - 32) + ry * depth).alias("v"))


@query("divergence_schedule", "SELECT p_partkey, round(0.5 + (0.05 + 0.75 * 8.0 / (p_size + 8.0)) / 2, 9) AS ratio_a, round(0.5 - (0.05 + 0.75 * 8.0 / (p_size + 8.0)) / 2, 9) AS ratio_b FROM part")
def divergence_schedule(spark, d):
    """The gap between two ratios halves its excess every eight steps."""
    gap = 0.05 + 0.75 * 8.0 / (F.col("p_size") + 8.0)
    return table(spark, d, "part").select("p_partkey", F.round(0.5 + gap / 2, 9).alias("ratio_a"), F.round(0.5 - gap / 2, 9).alias("ratio_b"))


@query("blend_directions", "WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS c FROM embeddings, generate_series(1, 8) t(i) GROUP BY ALL), u AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 8) t(i)), n AS (SELECT vec_id, i, label, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12) AS x FROM u), k AS (SELECT label, i, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY label)), 1e-12) AS c FROM m) SELECT vec_id, round(sum(i * (vec_id / (vec_id + 50.0) * x + (1 - vec_id / (vec_id + 50.0)) * c)), 6) AS digest FROM n JOIN k USING (label, i) GROUP BY vec_id")
def blend_directions(spark, d):
    """Unit vectors blended with their label's mean direction, by n / (n + 50)."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 8).cast("array<double>").alias("x"))
    core = e.groupBy("label").agg(*[F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(8)]).select("label", F.array(*[f"c{i}" for i in range(8)]).alias("c"))
    unit = lambda v: F.transform(v, lambda y: y / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, z: s + z * z)), F.lit(1e-12)))
    beta = F.col("vec_id") / (F.col("vec_id") + 50.0)
    both = e.join(core, "label").withColumn("x", unit(F.col("x"))).withColumn("c", unit(F.col("c")))
    mixed = F.zip_with("x", "c", lambda x, c: beta * x + (1 - beta) * c)
    return both.select("vec_id", F.round(F.aggregate(F.transform(mixed, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 6).alias("digest"))


@query("group_mask", f"{NUMBERED} SELECT burst, i, v FROM o WHERE i // 4 < 12 AND ((burst * 40503 + 977) >> (i // 4)) & 1 = 1")
def group_mask(spark, d):
    """Ticks of the groups of four that a burst's mask of twelve keeps; groups behind the mask go."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    bits = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda g: F.call_function("getbit", F.col("burst") * 40503 + 977, g) == 1)
    masks = n.select("burst").distinct().select("burst", F.posexplode(bits).alias("g", "kept")).filter("kept").select("burst", F.col("g").cast("long").alias("g"))
    return n.withColumn("g", trunc_div("i", 4)).join(masks, ["burst", "g"]).select("burst", "i", "v")


@query("temporal_cosine", f"{NUMBERED} SELECT burst, i, i & 63 AS phase, round_even(65536 * cos(2 * pi() * (i & 63) / 64), 0)::BIGINT AS c FROM o")
def temporal_cosine(spark, d):
    """The loop's phase and cosine in Q16."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    phase = F.col("i").bitwiseAND(F.lit(63).cast("long"))
    return n.select("burst", "i", phase.alias("phase"), F.rint(65536 * F.cos(phase * (2 * 3.141592653589793) / 64)).cast("long").alias("c"))


@query("time_slide", f"{PP}, f AS (SELECT frame, slot, a, k FROM palette, generate_series(0, 2) t(k)) SELECT frame::BIGINT AS frame, slot, k, (frame + 1) % 10 AS after, (frame + 9) % 10 AS before, slot // (1 << k) AS grp, slot // (1 << k) * (1 << k) + (1 << k) - 1 AS group_end, {_fdiv('2 * sum(a) OVER (PARTITION BY frame, k, slot // (1 << k)) + count(*) OVER (PARTITION BY frame, k, slot // (1 << k))', 1)} AS twice FROM f")
def time_slide(spark, d):
    """Frames after and before, the group shown at each detent, its last frame, and twice its sum plus its size."""
    p = palette(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")))
    size = F.pow(F.lit(2), F.col("k")).cast("long")
    p = p.withColumn("grp", trunc_div("slot", size))
    w = Window.partitionBy("frame", "k", "grp")
    frame = F.col("frame").cast("long")
    return p.select(frame.alias("frame"), "slot", "k", ((frame + 1) % 10).alias("after"), ((frame + 9) % 10).alias("before"), "grp", (F.col("grp") * size + size - 1).alias("group_end"), (2 * F.sum("a").over(w) + F.count("*").over(w)).alias("twice"))


@query("group_integral", f"{PP} SELECT frame, slot // 4 AS grp, {_fdiv('2 * sum(a) + 4', 8)}::BIGINT AS mean FROM palette GROUP BY ALL")
def group_integral(spark, d):
    """Mean of each group of four, rounded half up also below zero."""
    return palette(spark, d).groupBy("frame", trunc_div("slot", 4).alias("grp")).agg(floor_div(2 * F.sum("a") + 4, 8).alias("mean"))


def _lcg_sql(steps: int) -> str:
    ctes, last = "s0 AS (SELECT p_partkey, (p_partkey * 7919 + p_size) % 2147483648 AS s FROM part)", "s0"
    for k in range(1, steps + 1):
        ctes += f", s{k} AS (SELECT p_partkey, (s * 1103515245 + 12345) % 2147483648 AS s FROM s{k - 1})"
    return f"WITH {ctes} " + " UNION ALL ".join(f"SELECT p_partkey, {k} AS step, s AS state FROM s{k}" for k in range(1, steps + 1))


@query("lcg_states", _lcg_sql(6))
def lcg_states(spark, d):
    """Six states of a linear congruential generator for every seed."""
    seed = ((F.col("p_partkey") * 7919 + F.col("p_size")) % 2147483648).cast("long")
    states = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.array(seed), lambda a, _: F.concat(a, F.array((F.element_at(a, -1) * 1103515245 + 12345) % 2147483648)))
    return table(spark, d, "part").select("p_partkey", F.posexplode(states).alias("step", "state")).filter("step > 0")


VOXELS_SQL = "voxels AS (SELECT p_partkey // 64 % 8 AS t, p_partkey // 8 % 8 AS y, p_partkey % 8 AS x, ch, ((p_partkey * 13 + p_size * (ch + 3)) % 32)::INTEGER AS v FROM part, generate_series(0, 2) c(ch))"


def _voxels(spark, d):
    """t, y, x, ch, v: parts as readings of an 8-cube in three channels, several a cell."""
    p = F.col("p_partkey")
    own = table(spark, d, "part").select(p, "p_size", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("ch"))
    return own.select((trunc_div(p, 64) % 8).alias("t"), (trunc_div(p, 8) % 8).alias("y"), (p % 8).alias("x"), "ch", ((p * 13 + F.col("p_size") * (F.col("ch") + 3)) % 32).cast("int").alias("v"))


@query("box_histogram", f"WITH {VOXELS_SQL} SELECT t // 2 AS t, y // 4 AS y, x // 4 AS x, ch, v AS level, count(*) AS n FROM voxels GROUP BY ALL")
def box_histogram(spark, d):
    """Counts of every level in each coarse voxel and channel."""
    return sequence.box_histogram(_voxels(spark, d), 8, 8, 8, 2, 4, 4, 32)


@query("contested_margins", f"WITH {VOXELS_SQL}, h AS (SELECT t // 2 AS t, y // 4 AS y, x // 4 AS x, ch, v, count(*) AS n FROM voxels GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY t, y, x, ch ORDER BY n DESC, v) AS k FROM h) SELECT t, y, x, ch, (coalesce(max(n) FILTER (WHERE k = 1), 0) - coalesce(max(n) FILTER (WHERE k = 2), 0))::BIGINT AS margin FROM r GROUP BY ALL")
def contested_margins(spark, d):
    """The largest count of each cell less the second, as a bundle's reader recomputes it."""
    h = box_histogram(spark, d).groupBy("t", "y", "x", "ch").agg(F.sort_array(F.collect_list("n"), asc=False).alias("n"))
    return h.select("t", "y", "x", "ch", (F.col("n")[0] - F.coalesce(F.get("n", 1), F.lit(0))).alias("margin"))


@query("pooled_fuse", f"WITH {VOXELS_SQL}, a AS (SELECT t, y, x, avg(v) AS v FROM voxels GROUP BY ALL), b AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM b GROUP BY ALL) SELECT a.t, a.y, a.x, round(CASE (a.t // 4 + a.y // 4 + a.x // 4) % 3 WHEN 0 THEN c.v WHEN 1 THEN b.v ELSE a.v END, 6) AS v FROM a JOIN b ON b.t = a.t // 2 AND b.y = a.y // 2 AND b.x = a.x // 2 JOIN c ON c.t = a.t // 4 AND c.y = a.y // 4 AND c.x = a.x // 4")
def pooled_fuse(spark, d):
    """Two rungs of mean pools, of which each region's depth selects one."""
    fine = _voxels(spark, d).groupBy("t", "y", "x").agg(F.avg("v").alias("v"))
    half = fine.groupBy(*[trunc_div(c, 2).alias(c + "2") for c in "tyx"]).agg(F.avg("v").alias("v2"))
    quarter = half.groupBy(*[trunc_div(c + "2", 2).alias(c + "4") for c in "tyx"]).agg(F.avg("v2").alias("v4"))
    at = fine.select("t", "y", "x", "v", *[trunc_div(c, n).alias(f"{c}{n}") for c in "tyx" for n in (2, 4)])
    depth = (F.col("t4") + F.col("y4") + F.col("x4")) % 3
    both = at.join(half, ["t2", "y2", "x2"]).join(quarter, ["t4", "y4", "x4"])
    return both.select("t", "y", "x", F.round(F.when(depth == 0, F.col("v4")).when(depth == 1, F.col("v2")).otherwise(F.col("v")), 6).alias("v"))


@query("rendered_cells", f"{PP}, c AS (SELECT DISTINCT frame AS f0, (idx // 8 % 4) * 2 AS y0, (idx % 4) * 2 AS x0 FROM pixels), v AS (SELECT f0, y0, x0, t, dy, dx, ((y0 + dy) * 8 + x0 + dx) % 16 AS slot FROM c, generate_series(0, 1) a(t), generate_series(0, 1) b(dy), generate_series(0, 1) e(dx)) SELECT f0, y0, x0, t, dy, dx, l, a, b FROM v JOIN palette p ON p.frame = f0 + t AND p.slot = v.slot")
def rendered_cells(spark, d):
    """Two frames of a 2 x 2 block as eight voxels, coloured through each frame's palette."""
    cells = pixels(spark, d).select(F.col("frame").alias("f0"), (trunc_div("idx", 8) % 4 * 2).alias("y0"), (F.col("idx") % 4 * 2).alias("x0")).distinct()
    corner = F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>"))
    v = cells.withColumn("k", corner).select("f0", "y0", "x0", trunc_div("k", 4).alias("t"), (trunc_div("k", 2) % 2).alias("dy"), (F.col("k") % 2).alias("dx"))
    v = v.withColumn("frame", (F.col("f0") + F.col("t")).cast("int")).withColumn("slot", (((F.col("y0") + F.col("dy")) * 8 + F.col("x0") + F.col("dx")) % 16).cast("int"))
    return v.join(palette(spark, d), ["frame", "slot"]).select("f0", "y0", "x0", "t", "dy", "dx", "l", "a", "b")


@query("scale_gains", f"{PP}, p AS (SELECT frame, slot // 2 AS k, max(l) FILTER (WHERE slot % 2 = 0) AS x, max(l) FILTER (WHERE slot % 2 = 1) AS y FROM palette GROUP BY ALL HAVING count(*) = 2), b AS (SELECT frame, k, y + ((x - y) >> 1) AS coarse, x - y AS detail FROM p) SELECT frame, k, coarse, k % 4 AS level, detail * CASE WHEN k % 4 = 3 THEN 1 ELSE 2 + k % 4 END AS detail FROM b")
def scale_gains(spark, d):
    """Details times the gain of their level; the coarse part stays, and the last level's gain is held at 1."""
    p = palette(spark, d).groupBy("frame", trunc_div("slot", 2).alias("k")).agg(F.max(F.when(F.col("slot") % 2 == 0, F.col("l"))).alias("x"), F.max(F.when(F.col("slot") % 2 == 1, F.col("l"))).alias("y"), F.count("*").alias("n")).filter("n = 2")
    level = F.col("k") % 4
    gains = spark.range(4).select(F.col("id").alias("level"), F.when(F.col("id") == 3, 1).otherwise(F.col("id") + 2).alias("gain"))
    x, y = F.col("x"), F.col("y")
    return p.withColumn("level", level).join(gains, "level").select("frame", "k", (y + F.shiftright(x - y, 1)).alias("coarse"), "level", ((x - y) * F.col("gain")).alias("detail"))


@query("feature_maps", f"{PP}, f AS (SELECT p.frame, p.slot, p.l / 65536.0::DOUBLE AS v, (SELECT list(q.l / 65536.0::DOUBLE ORDER BY q.slot) FROM palette q WHERE q.frame = p.frame AND q.slot // 4 = p.slot // 4 AND q.slot <> p.slot) AS sibs FROM palette p) SELECT frame, slot, round(1 + 2 * v + 3 * v * v + coalesce(list_sum(list_transform(sibs, lambda s, i: s * (i + 3))), 0) + 10 * (slot % 4) / 65536.0 + 11 * (slot // 4) / 65536.0, 8) AS digest, 11 AS width FROM f")
def feature_maps(spark, d):
    """[1, v, v * v, six siblings padded with 0, x, y], as a weighted sum and its width."""
    p = palette(spark, d).withColumn("v", F.col("l") / 65536.0)
    w = Window.partitionBy("frame", trunc_div("slot", 4))
    sibs = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("slot", "v")).over(w)), lambda s: s["slot"] != F.col("slot")), lambda s: s["v"])
    full = F.slice(F.concat(sibs, F.array_repeat(F.lit(0.0), 6)), 1, 6)
    x, y = (F.col("slot") % 4) / 65536.0, trunc_div("slot", 4) / 65536.0
    f = p.withColumn("f", F.concat(F.array(F.lit(1.0), F.col("v"), F.col("v") * F.col("v")), full, F.array(x, y)))
    return f.select("frame", "slot", F.round(F.aggregate(F.transform("f", lambda z, i: z * (i + 1)), F.lit(0.0), lambda s, z: s + z), 8).alias("digest"), F.size("f").alias("width"))


@query("paint_budget", "WITH e AS (SELECT event_id, user_id % 24 AS cell, event_id % 11 AS channel, greatest(0, floor(value) - 40)::BIGINT AS v FROM events), k AS (SELECT cell, channel, arg_max(v, event_id) AS v FROM e WHERE cell < 16 AND channel < 9 GROUP BY ALL) SELECT c AS cell, p AS channel, coalesce(v, 0) AS v FROM generate_series(0, 15) a(c), generate_series(0, 8) b(p) LEFT JOIN k ON k.cell = c AND k.channel = p")
def paint_budget(spark, d):
    """A grid of sixteen cells by nine channels: the last paint counts, below zero is zero, out of range is nothing."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 24).alias("cell"), (F.col("event_id") % 11).alias("channel"), F.greatest(F.lit(0), F.floor("value") - 40).cast("long").alias("v"))
    last = e.filter("cell < 16 AND channel < 9").groupBy("cell", "channel").agg(F.max_by("v", "event_id").alias("v"))
    grid = spark.range(144).select(trunc_div("id", 9).alias("cell"), (F.col("id") % 9).alias("channel"))
    return grid.join(last, ["cell", "channel"], "left").select("cell", "channel", F.coalesce("v", F.lit(0)).alias("v"))


@query("up_rung", f"WITH {VOXELS_SQL}, a AS (SELECT t // 2 AS t, y // 2 AS y, x // 2 AS x, sum(v)::BIGINT AS v FROM voxels GROUP BY ALL), m AS (SELECT *, (t + y + x) % 2 AS live FROM a) SELECT t * 2 + i AS t, y * 2 + j AS y, x * 2 + k AS x, v + live * (i * 4 + j * 2 + k) AS v, live::INTEGER AS live FROM m, generate_series(0, 1) p(i), generate_series(0, 1) q(j), generate_series(0, 1) r(k)")
def up_rung(spark, d):
    """Each cell's eight children: the parent's value, and detail only where the parent is painted, whose mask they take."""
    a = _voxels(spark, d).groupBy(*[trunc_div(c, 2).alias(c) for c in "tyx"]).agg(F.sum("v").alias("v")).withColumn("live", (F.col("t") + F.col("y") + F.col("x")) % 2)
    c = a.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<bigint>")))
    i, j, k = trunc_div("k", 4), trunc_div("k", 2) % 2, F.col("k") % 2
    return c.select((F.col("t") * 2 + i).alias("t"), (F.col("y") * 2 + j).alias("y"), (F.col("x") * 2 + k).alias("x"), (F.col("v") + F.col("live") * F.col("k")).alias("v"), F.col("live").cast("int").alias("live"))


@query("conditioned_cells", f"{PP} SELECT frame, slot, l + round((slot % 3) * 0.5 * 100)::BIGINT AS l, a - round((slot % 3) * 0.25 * 100)::BIGINT AS a, b FROM palette")
def conditioned_cells(spark, d):
    """Cells moved by their budget times a fixed basis; no budget leaves a cell as it is."""
    budget = F.col("slot") % 3
    return palette(spark, d).select("frame", "slot", (F.col("l") + F.round(budget * 50.0).cast("long")).alias("l"), (F.col("a") - F.round(budget * 25.0).cast("long")).alias("a"), "b")


@query("drop_accounting", f"{NUMBERED} SELECT burst, CASE WHEN least(i, 15) < 8 THEN 0 WHEN least(i, 15) < 13 THEN 1 ELSE 2 END AS scale, count(*) AS dropped FROM o WHERE channel = 'error' GROUP BY ALL")
def drop_accounting(spark, d):
    """Dropped ticks, each charged to the scale that the plan of sixteen has live at it; the last one holds beyond."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    at = F.least(F.col("i"), F.lit(15))
    scale = F.when(at < 8, 0).when(at < 13, 1).otherwise(2)
    return n.filter("channel = 'error'").groupBy("burst", scale.alias("scale")).agg(F.count("*").alias("dropped"))
