"""Queries from pixels to pictures and back: encoded bursts, ingested loops, colour tokens, applied index changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import color
from lumenfold.functions.arith import to_q16, trunc_div
from lumenfold.operators import assign, bursts
from lumenfold.plans.catalog import query
from lumenfold.plans.colors import D2, NEAR
from lumenfold.plans.inputs import palette, pixels, table
from lumenfold.plans.lattice import LIN_SQL, _byte_sql, _lab_q16_sql, _lin, _tdiv
from lumenfold.plans.rounds import palette_sql

SIDE, COLOURS = 16, 8
#: Three components of each vector as colours; 256 vectors a frame, what the last frame lacks is grey; eight frames a capture.
POINTS_SQL = (
    "v AS (SELECT vec_id // 256 AS frame, vec_id % 256 AS idx, " + ", ".join(f"abs(round_even(embedding[{i}]::DOUBLE * 65536, 0)::BIGINT){s} AS {c}" for i, c, s in ((1, "l", " + 20000"), (2, "a", " - 8000"), (3, "b", " - 8000"))) + " FROM embeddings), "
    "pixels AS (SELECT f.frame, i AS idx, coalesce(l, 20000) AS l, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT DISTINCT frame FROM v) f CROSS JOIN generate_series(0, 255) g(i) LEFT JOIN v ON v.frame = f.frame AND v.idx = i)"
)
SLOTS_SQL = f"slots AS MATERIALIZED ({palette_sql(COLOURS, 0, POINTS_SQL)})"
RGB_SQL = (
    "e AS (SELECT DISTINCT frame, slot, cl, ca, cb FROM slots), e0 AS (SELECT frame, slot, " + ", ".join(f"{_tdiv(_lin(row, ('cl', 'ca', 'cb')), 65536)} AS v{i}" for i, row in enumerate(color.ROOTS)) + " FROM e), "
    "e1 AS (SELECT frame, slot, " + ", ".join(f"{_tdiv(f'v{i} * v{i} * v{i}', 4294967296)} AS v{i}" for i in range(3)) + " FROM e0), "
    "e2 AS (SELECT frame, slot, " + ", ".join(f"{_tdiv(_lin(row, ('v0', 'v1', 'v2')), 65536)} AS {c}" for row, c in zip(color.RGB, "rgb")) + " FROM e1), "
    "rgb AS (SELECT frame, slot, " + ", ".join(f"{_byte_sql(c)} AS {c}" for c in "rgb") + " FROM e2)"
)


def _bursts(spark, d):
    """capture, t, idx, l, a, b: whole frames of 16 x 16."""
    lanes = [(F.abs(to_q16(F.col("embedding")[i].cast("double"))) + s).alias(c) for i, c, s in ((0, "l", 20_000), (1, "a", -8_000), (2, "b", -8_000))]
    at = F.col("vec_id")
    v = table(spark, d, "embeddings").select(trunc_div(at, 256).alias("frame"), (at % 256).alias("idx"), *lanes)
    grid = v.select("frame").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(255)).cast("array<bigint>")))
    whole = grid.join(v, ["frame", "idx"], "left").select("frame", "idx", F.coalesce("l", F.lit(20_000)).alias("l"), *[F.coalesce(c, F.lit(0)).alias(c) for c in "ab"])
    return whole.select(trunc_div("frame", 8).alias("capture"), (F.col("frame") % 8).alias("t"), "idx", "l", "a", "b")


def _pictures(spark, d):
    gifs = bursts.encode_bursts(_bursts(spark, d), SIDE, COLOURS, 5)
    return gifs.select(F.col("capture").cast("string").alias("stem"), F.col("gif").alias("content"))


@query("burst_encode", f"WITH {SLOTS_SQL}, {RGB_SQL} SELECT frame // 8 AS capture, (frame % 8)::INTEGER AS t, s.slot, any_value(r || ',' || g || ',' || b) AS colour, count(*) AS n, sum(idx)::BIGINT AS places FROM slots s JOIN rgb USING (frame, slot) GROUP BY frame, s.slot")
def burst_encode(spark, d):
    """Pixels to animations in one call, decoded again: colour, number and places of every slot of every frame."""
    px, frames = bursts.gif_pixels, bursts.decode_gifs(_pictures(spark, d))
    used = px(frames).groupBy("stem", "t", "slot").agg(F.count("*").alias("n"), F.sum(F.col("y") * SIDE + F.col("x")).alias("places"))
    colour = F.array_join(F.element_at("palette", F.col("slot") + 1).cast("array<string>"), ",")
    return used.join(frames.select("stem", "t", "palette"), ["stem", "t"]).select(F.col("stem").cast("long").alias("capture"), "t", "slot", colour.alias("colour"), "n", "places")


@query("loop_ingest", f"WITH {SLOTS_SQL} SELECT frame // 8 AS capture, (frame % 8)::INTEGER AS t, (idx // 16 // 4)::INTEGER AS y, (idx % 16 // 4)::INTEGER AS x, slot FROM slots WHERE idx // 16 % 4 = 0 AND idx % 16 % 4 = 0")
def loop_ingest(spark, d):
    """The animations as loops of a quarter of their side: the top left pixel of each block of four."""
    loops, _ = bursts.ingest_loops(_pictures(spark, d), SIDE, 4, COLOURS)
    return loops.select(F.col("stem").cast("long").alias("capture"), "t", "y", "x", "slot")


TOKENS_SQL = f"WITH {SLOTS_SQL}, {RGB_SQL}, lin AS (SELECT frame * 16 + slot AS id, " + ", ".join(f"round_even(({LIN_SQL.format(c=c)}) * 65536, 0)::BIGINT AS {c}" for c in "rgb") + f" FROM rgb), {_lab_q16_sql('lin', 'id', 'r', 'g', 'b')}, n AS (SELECT frame, slot, count(*) AS n FROM slots GROUP BY ALL)"


@query("picture_tokens", f"{TOKENS_SQL} SELECT frame // 8 AS capture, (frame % 8)::INTEGER AS t, slot, l / 65536.0 AS m_l, a / 65536.0 AS m_a, b / 65536.0 AS m_b, round(n / sum(n) OVER (PARTITION BY frame // 8), 9) AS weight FROM n JOIN lab ON id = frame * 16 + slot")
def picture_tokens(spark, d):
    """A token for each colour in use of every animation, from its bytes alone."""
    tokens = bursts.picture_tokens(_pictures(spark, d)).filter("weight > 0")
    return tokens.select(F.col("stem").cast("long").alias("capture"), "t", "slot", "m_l", "m_a", "m_b", F.round("weight", 9).alias("weight"))


@query("policy_apply", f"{NEAR}, g AS (SELECT p.idx, arg_min(q.slot, ({D2}, q.slot)) AS new FROM pixels p JOIN palette q ON q.frame = 0 GROUP BY p.idx) SELECT r.idx, CASE WHEN slot <> new AND r.idx % 3 <> 0 THEN new ELSE slot END AS slot FROM r JOIN g USING (idx) WHERE k = 1")
def policy_apply(spark, d):
    """Changes of slots, without every third pixel's, applied to the slots before: untouched places keep theirs."""
    px, p = pixels(spark, d), palette(spark, d)
    old = assign.nearest(px, p).select("idx", "slot")
    one = p.filter("frame = 0").withColumn("g", F.lit(0)).drop("frame")
    new = assign.nearest(px.withColumn("g", F.lit(0)), one, ("g",)).select("idx", "slot")
    delta = assign.policy_delta(old, new, ["idx"]).filter("idx % 3 <> 0")
    return assign.policy_apply(old, delta, ["idx"])
