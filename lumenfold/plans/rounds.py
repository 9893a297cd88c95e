"""Queries whose rounds are joins and aggregations over tables: palettes, transport, ownership of streamed ticks, meta-initialisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import clusters, evolution, meta, transport
from lumenfold.operators.sequence import numbered
from lumenfold.plans.catalog import ORACLES, query
from lumenfold.plans.frames import NUMBERED, _stream
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TICKS_SQL, palette, pixels, ticks
from lumenfold.plans.signal import PLAN, PLAN_SQL
from lumenfold.storage import Scratch
from lumenfold.streaming import captures
from lumenfold.streaming.ticks import run_to_table

D2 = " + ".join("(p.{c} - {s}.{c}) * (p.{c} - {s}.{c})".format(c=c, s="{s}") for c in "lab")
TRUNC = "(CASE WHEN sum({c}) < 0 THEN -((-sum({c})) // count(*)) ELSE sum({c}) // count(*) END)::BIGINT"


def palette_sql(k: int, lloyd: int, points: str = PIXELS_SQL) -> str:
    """Farthest-first palettes of all frames of ``points`` (pixels), written out round by round: idx, frame, slot and the slot's colour."""
    colour = "struct_pack(l := p.l, a := p.a, b := p.b)"
    pick = f"SELECT frame, c.l AS l, c.a AS a, c.b AS b FROM (SELECT p.frame, arg_max({colour}, (d, -idx)) AS c FROM {{rows}} p GROUP BY p.frame)"
    mean = ", ".join(f"{TRUNC.format(c=c)} AS {c}" for c in "lab")
    sql = f"WITH {points}, px AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY frame) AS n FROM pixels), mean AS (SELECT frame, {mean} FROM px GROUP BY frame)"
    sql += f", r0 AS MATERIALIZED (SELECT p.*, {D2.format(s='m')} AS d FROM px p JOIN mean m USING (frame)), s0 AS MATERIALIZED ({pick.format(rows='r0')})"
    for i in range(1, k):
        least = f"least(p.d, {D2.format(s='s')})" if i > 1 else D2.format(s="s")
        sql += f", r{i} AS MATERIALIZED (SELECT p.frame, p.idx, p.l, p.a, p.b, p.n, {least} AS d FROM r{i - 1} p JOIN s{i - 1} s USING (frame)), s{i} AS MATERIALIZED ({pick.format(rows=f'(SELECT * FROM r{i} WHERE n > {i})')})"
    sql += ", c0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT frame, {i} AS slot, l, a, b FROM s{i}" for i in range(k)) + ")"
    near = f"SELECT p.frame, p.idx, p.l, p.a, p.b, arg_min(c.slot, ({D2.format(s='c')}, c.slot)) AS slot FROM px p JOIN {{c}} c USING (frame) GROUP BY p.frame, p.idx, p.l, p.a, p.b"
    for i in range(lloyd):
        sql += f", a{i} AS MATERIALIZED ({near.format(c=f'c{i}')}), m{i} AS MATERIALIZED (SELECT frame, slot, {mean} FROM a{i} GROUP BY frame, slot)"
        sql += f", c{i + 1} AS MATERIALIZED (SELECT c.frame, c.slot, coalesce(m.l, c.l) AS l, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{i} c LEFT JOIN m{i} m USING (frame, slot))"
    return f"{sql}, a AS ({near.format(c=f'c{lloyd}')}) SELECT a.frame, a.idx, a.slot, c.l AS cl, c.a AS ca, c.b AS cb FROM a JOIN c{lloyd} c USING (frame, slot)"


#: The one-frame form of the same rule, which :mod:`lumenfold.plans.frames` registers.
ORACLES["quantize_frame"] = palette_sql(16, 2)


@query("quantize_large", palette_sql(12, 2))
def quantize_large(spark, d):
    """A palette of twelve for every frame, by rounds over the table of all pixels, and every pixel's slot."""
    return clusters.quantize_large(pixels(spark, d), 12, 2).select("frame", "idx", "slot", "cl", "ca", "cb")


def transport_sql(rounds: int, epsilon: float) -> str:
    soft = "SELECT t.pair, t.{m}, -{e} * (max(top) + ln(sum(exp(t - top)))) AS v FROM (SELECT c.pair, c.{m}, (o.v - c.cost) / {e} + o.lw AS t, max((o.v - c.cost) / {e} + o.lw) OVER (PARTITION BY c.pair, c.{m}) AS top FROM costs c JOIN {o} o ON o.pair = c.pair AND o.i = c.{h}) t GROUP BY t.pair, t.{m}"
    sql = f"""WITH {PALETTE_SQL}, pts AS (SELECT frame::BIGINT AS pair, 0 AS side, slot AS i, l, a, b, 1 + slot % 3 AS w FROM palette UNION ALL SELECT (frame + 9) % 10, 1, slot, l, a, b, 1 + slot % 2 FROM palette),
    p AS (SELECT pair, side, i::BIGINT AS i, l / 65536.0::DOUBLE AS l, a / 65536.0::DOUBLE AS a, b / 65536.0::DOUBLE AS b, ln(w::DOUBLE / sum(w) OVER (PARTITION BY pair, side)) AS lw FROM pts),
    costs AS MATERIALIZED (SELECT x.pair, x.i, y.i AS j, (x.l - y.l) * (x.l - y.l) + (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) AS cost FROM p x JOIN p y ON x.pair = y.pair AND x.side = 0 AND y.side = 1),
    g0 AS MATERIALIZED (SELECT pair, i, lw, 0.0::DOUBLE AS v FROM p WHERE side = 1)"""
    for k in range(rounds):
        f, g = (soft.format(m=m, h=h, o=o, e=epsilon) for m, h, o in (("i", "j", f"g{k}"), ("j", "i", f"f{k}")))
        sql += f", f{k} AS MATERIALIZED (SELECT p.pair, p.i, p.lw, s.v FROM ({f}) s JOIN p ON p.pair = s.pair AND p.i = s.i AND side = 0), g{k + 1} AS MATERIALIZED (SELECT p.pair, p.i, p.lw, s.v FROM ({g}) s JOIN p ON p.pair = s.pair AND p.i = s.j AND side = 1)"
    return f"{sql} SELECT c.pair, c.i, c.j, round(exp((f.v + g.v - c.cost) / {epsilon} + f.lw + g.lw), 6) AS mass FROM costs c JOIN f{rounds - 1} f ON f.pair = c.pair AND f.i = c.i JOIN g{rounds} g ON g.pair = c.pair AND g.i = c.j"


@query("transport_plan", transport_sql(5, 0.05))
def transport_plan(spark, d):
    """The entropic plan between the weighted palettes of each frame and the next, after five rounds."""
    p = palette(spark, d)
    x = F.array(*[F.col(c) / 65536.0 for c in "lab"]).alias("x")
    one = p.select(F.col("frame").cast("long").alias("pair"), F.lit(0).alias("side"), F.col("slot").cast("long").alias("i"), x, (1 + F.col("slot") % 3).alias("w"))
    two = p.select(((F.col("frame") + 9) % 10).cast("long").alias("pair"), F.lit(1).alias("side"), F.col("slot").cast("long").alias("i"), x, (1 + F.col("slot") % 2).alias("w"))
    return transport.transport_plan(one.union(two), 0.05, 5).select("pair", "i", "j", F.round("mass", 6).alias("mass"))


@query("stream_ownership", f"{NUMBERED}, {PLAN_SQL} SELECT burst, scale, count(*) FILTER (WHERE owned) AS owned, count(*) FILTER (WHERE NOT owned) AS skipped, coalesce(sum(v) FILTER (WHERE owned), 0)::BIGINT AS total FROM o JOIN plan ON i % 16 = phase GROUP BY ALL")
def stream_ownership(spark, d):
    """Ticks of a stream, numbered by state and joined with the static plan of dwells: what each scale owns and skips."""
    plan = spark.createDataFrame(PLAN, "phase int, scale int, owned boolean")  # 16 rows
    with captures.state_store(spark):
        owned = captures.numbered_ticks(_stream(spark, d), len(PLAN)).join(F.broadcast(plan), "phase")
        j = run_to_table(owned.select("burst", "scale", "owned", "v"), "ownership")
    return j.groupBy("burst", "scale").agg(F.count_if("owned").alias("owned"), F.count_if(~F.col("owned")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("owned"), F.col("v"))), F.lit(0)).alias("total"))


#: Pairs of a burst: its readings against their place in a cycle of 16.
PAIRS_SQL = f"{NUMBERED}, p AS (SELECT burst, i % 16 / 16.0::DOUBLE AS x, v / 10000.0::DOUBLE AS y FROM o), s AS (SELECT burst, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM p GROUP BY burst)"


def reptile_sql(outer: int, inner: int, eta: float, epsilon: float) -> str:
    """Two weights, a constant and a slope, through all rounds."""
    sql, start = PAIRS_SQL + ", w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)", "w0"
    for o in range(outer):
        sql += f", i{o}_0 AS (SELECT s.*, a, b FROM s, {start})"
        for k in range(inner):
            sql += f", i{o}_{k + 1} AS (SELECT burst, n, sx, sxx, sy, sxy, a - {eta} * (n * a + sx * b - sy) / n AS a, b - {eta} * (sx * a + sxx * b - sxy) / n AS b FROM i{o}_{k})"
        sql += f", w{o + 1} AS (SELECT any_value(w.a) + {epsilon} * (avg(i.a) - any_value(w.a)) AS a, any_value(w.b) + {epsilon} * (avg(i.b) - any_value(w.b)) AS b FROM i{o}_{inner} i, {start} w)"
        start = f"w{o + 1}"
    return f"{sql} SELECT 0 AS i, round(a, 6) AS w FROM {start} UNION ALL SELECT 1, round(b, 6) FROM {start}"


@query("meta_start", reptile_sql(4, 3, 0.5, 0.3))
def meta_start(spark, d):
    """A common start of the bursts' lines (reading against place in a cycle of 16) after four outer rounds of three steps."""
    t = numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    with Scratch(spark, "meta") as scratch:
        stats = scratch.write(meta.sufficient(t, "burst", [F.lit(1.0), F.col("i") % 16 / 16.0], F.col("v") / 10000.0))
        start = meta.reptile(stats, 2, outer=4, inner=3, eta=0.5, epsilon=0.3)
    return spark.createDataFrame([(i, round(float(w), 6)) for i, w in enumerate(start)], "i int, w double")


@query("coverage_search")
def coverage_search(spark, d):
    """The share of all pixels near one of eight colours, through six generations of a search; the tests hold that it rises and repeats."""
    px = pixels(spark, d).select(*[(F.col(c) / 65536.0).alias(c) for c in "lab"])
    _, story = evolution.evolve(px, 8, 0.12, 6, sigma=0.08)
    return spark.createDataFrame(list(enumerate(story)), "generation long, coverage double")
