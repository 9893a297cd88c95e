"""Queries over tick sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import arith
from lumenfold.functions.lift import DETAILS, unlift_pair
from lumenfold.operators import sequence as seq
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import TICKS_SQL, table, ticks

KEYS, ORDER = ["burst"], ["ts", "tick_id"]
W = "PARTITION BY burst ORDER BY ts, tick_id"
NUMBERED = f"WITH {TICKS_SQL}, o AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM ticks)"


@query("tick_deltas", f"WITH {TICKS_SQL} SELECT * FROM (SELECT burst, tick_id, v - lag(v) OVER ({W}) AS delta FROM ticks) WHERE delta IS NOT NULL")
def tick_deltas(spark, d):
    return seq.deltas(ticks(spark, d), KEYS, ORDER, "v").select("burst", "tick_id", "delta")


@query("tick_pool4", f"{NUMBERED} SELECT burst, i // 4 AS pool, sum(v)::BIGINT AS total FROM o GROUP BY ALL HAVING count(*) = 4")
def tick_pool4(spark, d):
    return seq.pool_by_count(ticks(spark, d), KEYS, ORDER, "v", 4)


@query(
    "burst_timing",
    f"""WITH {TICKS_SQL}, d AS (SELECT burst, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) AS d FROM ticks)
    SELECT burst, count(*) AS n, CASE WHEN count(*) < 2 THEN 0 ELSE max(t) - min(t) END AS duration, CASE WHEN count(*) < 2 THEN 0 ELSE round(avg(d), 3) END AS mean,
        CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_pop(d), 1) END AS std, CASE WHEN count(*) < 2 THEN 0 ELSE min(d) END AS low,
        CASE WHEN count(*) < 2 THEN 0 ELSE max(d) END AS high, CASE WHEN count(*) < 2 THEN 0 ELSE max(abs(d - 50000)) END AS worst FROM d GROUP BY burst""",
)
def burst_timing(spark, d):
    t = ticks(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return seq.timing(t, KEYS, ORDER, "us", 50_000).withColumn("mean", F.round("mean", 3)).withColumn("std", F.round("std", 1))


@query(
    "late_missing",
    f"""WITH {TICKS_SQL}, d AS (SELECT burst, epoch_us(ts) - lag(epoch_us(ts)) OVER ({W}) AS d FROM ticks)
    SELECT burst, count(*) FILTER (WHERE d >= 3600000000) AS late, greatest(0, 64 - count(*)) AS missing FROM d GROUP BY burst""",
)
def late_missing(spark, d):
    t = ticks(spark, d).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    gaps = t.withColumn("gap", F.col("us") - F.lag("us").over(seq._window(KEYS, ORDER)))
    return gaps.groupBy("burst").agg(F.count_if(F.col("gap") >= 3_600_000_000).alias("late"), F.greatest(F.lit(0), 64 - F.count("*")).alias("missing"))


@query(
    "comovement",
    f"""WITH {TICKS_SQL}, s AS (SELECT burst, sign(v - lag(v) OVER ({W})) AS x, sign(tick_id % 11 - lag(tick_id % 11) OVER ({W})) AS y FROM ticks)
    SELECT burst, CASE WHEN count(x) = 0 THEN 1000 ELSE count(*) FILTER (WHERE x = y) * 1000 // count(x) END AS permille FROM s GROUP BY burst""",
)
def comovement(spark, d):
    return seq.comovement(ticks(spark, d).withColumn("w", F.col("tick_id") % 11), KEYS, ORDER, "v", "w")


PAIRS = f"""{NUMBERED}, p AS (SELECT burst, i // 2 AS pair, max(v) FILTER (WHERE i % 2 = 0) AS x, max(v) FILTER (WHERE i % 2 = 1) AS y FROM o GROUP BY ALL),
    lifted AS (SELECT burst, pair, x, y, coalesce(y + ((x - y) >> 1), x) AS low, x - y AS high FROM p)"""


@query("s_lift_pairs", f"{PAIRS} SELECT burst, pair, low, high FROM lifted")
def s_lift_pairs(spark, d):
    return seq.lift_pairs(ticks(spark, d), KEYS, ORDER, "v")


@query("s_unlift_roundtrip", f"{PAIRS} SELECT burst, pair, x, y FROM lifted WHERE y IS NOT NULL")
def s_unlift_roundtrip(spark, d):
    x, y = unlift_pair("low", "high")
    return seq.lift_pairs(ticks(spark, d), KEYS, ORDER, "v").filter("high IS NOT NULL").select("burst", "pair", x.alias("x"), y.alias("y"))


def _octant_sql() -> str:
    lanes = ", ".join(f"max(v) FILTER (WHERE i % 8 = {k}) AS v{k}" for k in range(8))
    rows = ", ".join(f"v{k + 1} + ((v{k} - v{k + 1}) >> 1) AS l{k // 2}, v{k} - v{k + 1} AS h{k // 2}" for k in (0, 2, 4, 6))
    faces = ", ".join(f"l{2 * f + 1} + ((l{2 * f} - l{2 * f + 1}) >> 1) AS r{f}, l{2 * f} - l{2 * f + 1} AS g{f}, h{2 * f + 1} + ((h{2 * f} - h{2 * f + 1}) >> 1) AS b{f}, h{2 * f} - h{2 * f + 1} AS t{f}" for f in (0, 1))
    return f"""{NUMBERED}, c AS (SELECT burst, i // 8 AS cell, {lanes} FROM o GROUP BY ALL HAVING count(*) = 8), r AS (SELECT burst, cell, {rows} FROM c), f AS (SELECT burst, cell, {faces} FROM r)
    SELECT burst, cell, r1 + ((r0 - r1) >> 1) AS coarse, g0, b0, t0, g1, b1, t1, r0 - r1 AS dz FROM f"""


@query("octant_lift", _octant_sql())
def octant_lift(spark, d):
    return seq.lift_octants(ticks(spark, d), KEYS, ORDER, "v")


@query("octant_corpus", f"SELECT burst, cell, band, target FROM ({_octant_sql()}) UNPIVOT (target FOR band IN ({', '.join(DETAILS)}))")
def octant_corpus(spark, d):
    """Masked-band records: each detail of a cell is a target once."""
    o = seq.lift_octants(ticks(spark, d), KEYS, ORDER, "v")
    return o.unpivot(["burst", "cell"], list(DETAILS), "band", "target")


@query("detail_energy_budget", f"SELECT burst, round(avg(abs(target)), 6) AS mean_abs FROM (SELECT burst, cell, band, target FROM ({_octant_sql()}) UNPIVOT (target FOR band IN ({', '.join(DETAILS)}))) GROUP BY burst")
def detail_energy_budget(spark, d):
    return octant_corpus(spark, d).groupBy("burst").agg(F.round(F.avg(F.abs("target")), 6).alias("mean_abs"))


@query(
    "certified_order",
    f"""WITH {TICKS_SQL}, x AS (SELECT burst, v // 20000 AS v, lag(v // 20000) OVER ({W}) AS a, lag(v // 20000, 2) OVER ({W}) AS b, lag(v // 20000, 3) OVER ({W}) AS c FROM ticks),
    g AS (SELECT burst, count(*) AS n, coalesce(max(abs(v - a)), 0) AS m1, coalesce(max(abs(v - 2 * a + b)), 0) AS m2, coalesce(max(abs(v - 3 * a + 3 * b - c)), 0) AS m3 FROM x GROUP BY burst)
    SELECT burst, n, n < 5 AS refused, CASE WHEN n < 5 THEN NULL WHEN m1 = 0 THEN 0 WHEN m2 = 0 THEN 1 WHEN m3 = 0 THEN 2 END AS k FROM g""",
)
def certified_order(spark, d):
    t = ticks(spark, d).withColumn("v", arith.trunc_div("v", 20000))
    return seq.certified_order(t, KEYS, ORDER, "v", 3)


@query(
    "newton_residual",
    f"""{NUMBERED}, h AS (SELECT burst, max(v) FILTER (WHERE i = 0) AS f0, max(v) FILTER (WHERE i = 1) AS f1, max(v) FILTER (WHERE i = 2) AS f2 FROM o GROUP BY burst)
    SELECT burst, sum(abs(v - (f0 + i * coalesce(f1 - f0, 0) + (i * (i - 1) // 2) * coalesce(f2 - 2 * f1 + f0, 0))))::BIGINT AS residual FROM o JOIN h USING (burst) GROUP BY burst""",
)
def newton_residual(spark, d):
    """Prediction from the first three readings: sum of |f - C(t,k) D^k f(0)|."""
    n = seq.numbered(ticks(spark, d), KEYS, ORDER).withColumn("i", F.col("i").cast("long"))
    head = n.filter("i < 3").groupBy("burst").agg(*[F.max(F.when(F.col("i") == k, F.col("v"))).alias(f"f{k}") for k in range(3)])
    first, second = F.coalesce(F.col("f1") - F.col("f0"), F.lit(0)), F.coalesce(F.col("f2") - 2 * F.col("f1") + F.col("f0"), F.lit(0))
    guess = F.col("f0") + F.col("i") * first + arith.trunc_div(F.col("i") * (F.col("i") - 1), 2) * second
    return n.join(head, "burst").groupBy("burst").agg(F.sum(F.abs(F.col("v") - guess)).alias("residual"))


@query(
    "rle_runs",
    f"""WITH {TICKS_SQL}, m AS (SELECT *, CASE WHEN channel = lag(channel) OVER ({W}) THEN 0 ELSE 1 END AS new FROM ticks),
    r AS (SELECT burst, channel, sum(new) OVER ({W}) - 1 AS run FROM m) SELECT burst, run::BIGINT AS run, any_value(channel) AS channel, count(*) AS length FROM r GROUP BY burst, run""",
)
def rle_runs(spark, d):
    return seq.runs(ticks(spark, d), KEYS, ORDER, "channel")


@query("rle_decode", f"WITH {TICKS_SQL} SELECT burst, channel, count(*) AS n FROM ticks GROUP BY ALL")
def rle_decode(spark, d):
    """Runs expanded again and counted: the counts of the input."""
    r = rle_runs(spark, d)
    return r.select("burst", "channel", F.explode(F.sequence(F.lit(1), "length"))).groupBy("burst", "channel").agg(F.count("*").alias("n"))


@query("asof_hold", f"WITH {TICKS_SQL} SELECT t.burst, t.tick_id, coalesce(o.v, 0) AS held FROM ticks t ASOF LEFT JOIN (SELECT burst, (epoch_us(ts), tick_id) AS k, v FROM ticks WHERE channel = 'click') o ON t.burst = o.burst AND (epoch_us(t.ts), t.tick_id) >= o.k")
def asof_hold(spark, d):
    return seq.hold_last(ticks(spark, d), KEYS, ORDER, "v", F.col("channel") == "click").select("burst", "tick_id", "held")


@query("slot_history", f"WITH {TICKS_SQL} SELECT burst, tick_id, array_to_string(list(v) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS history FROM ticks")
def slot_history(spark, d):
    h = seq.history(ticks(spark, d), KEYS, ORDER, "v", 4)
    return h.select("burst", "tick_id", F.array_join(F.col("history").cast("array<string>"), ",").alias("history"))


@query("keep_last_n", f"WITH {TICKS_SQL} SELECT burst, tick_id, v FROM ticks QUALIFY row_number() OVER (PARTITION BY burst ORDER BY ts DESC, tick_id DESC) <= 8")
def keep_last_n(spark, d):
    return seq.keep_last(ticks(spark, d), KEYS, [F.desc("ts"), F.desc("tick_id")], 8).select("burst", "tick_id", "v")


@query("temporal_quantize", f"{NUMBERED} SELECT burst, tick_id, (i // 5) * 5 AS t FROM o")
def temporal_quantize(spark, d):
    n = seq.numbered(ticks(spark, d), KEYS, ORDER).withColumn("i", F.col("i").cast("long"))
    return n.select("burst", "tick_id", (arith.trunc_div("i", 5) * 5).alias("t"))


@query("sample_volumes", f"WITH {TICKS_SQL} SELECT burst, sum(greatest(0, v - 5000))::BIGINT AS volume FROM ticks GROUP BY burst")
def sample_volumes(spark, d):
    return ticks(spark, d).groupBy("burst").agg(F.sum(F.greatest(F.lit(0), F.col("v") - 5000)).alias("volume"))


@query("zigzag_codes", f"{NUMBERED}, x AS (SELECT burst, tick_id, v - 5000 AS s FROM o) SELECT burst, tick_id, CASE WHEN s >= 0 THEN 2 * s ELSE -2 * s - 1 END AS code, s AS decoded FROM x")
def zigzag_codes(spark, d):
    t = ticks(spark, d).withColumn("code", arith.zigzag(F.col("v") - 5000))
    return t.select("burst", "tick_id", "code", arith.unzigzag("code").alias("decoded"))


#: Cadence plan of a 16-tick cycle: dwells of 8, 5 and 3 ticks on scales 0, 1, 2, whose first two ticks settle.
PLAN = [(t, 0 if t < 8 else 1 if t < 13 else 2, (t < 8 and t >= 2) or (8 <= t < 13 and t >= 10) or t >= 15) for t in range(16)]
PLAN_SQL = "plan(phase, scale, owned) AS (VALUES " + ", ".join(f"({t}, {s}, {str(o).upper()})" for t, s, o in PLAN) + ")"


@query("dwell_ownership", f"{NUMBERED}, {PLAN_SQL} SELECT burst, scale, count(*) FILTER (WHERE owned) AS owned, count(*) FILTER (WHERE NOT owned) AS skipped, coalesce(sum(v) FILTER (WHERE owned), 0)::BIGINT AS total FROM o JOIN plan ON i % 16 = phase GROUP BY ALL")
def dwell_ownership(spark, d):
    """Owned ticks are added to their scale, settling ticks are counted as skipped."""
    plan = spark.createDataFrame(PLAN, "phase int, scale int, owned boolean")  # 16 rows
    n = seq.numbered(ticks(spark, d), KEYS, ORDER)
    j = n.join(F.broadcast(plan), n.i % 16 == plan.phase)
    return j.groupBy("burst", "scale").agg(F.count_if("owned").alias("owned"), F.count_if(~F.col("owned")).alias("skipped"), F.coalesce(F.sum(F.when(F.col("owned"), F.col("v"))), F.lit(0)).alias("total"))


@query("settled_levels", f"{NUMBERED} SELECT burst, tick_id, (i // 6) % 3 AS level FROM o WHERE i % 6 = 5")
def settled_levels(spark, d):
    """Each level is held for six ticks and emits when settled; levels advance cyclically."""
    n = seq.numbered(ticks(spark, d), KEYS, ORDER).withColumn("i", F.col("i").cast("long"))
    return n.filter("i % 6 = 5").select("burst", "tick_id", (arith.trunc_div("i", 6) % 3).alias("level"))


@query("fair_split", f"WITH {TICKS_SQL}, b AS (SELECT burst, least(4096, sum(v // 100))::BIGINT AS a FROM ticks GROUP BY burst) SELECT burst, i::INTEGER AS i, (i + 1) * a // 16 - i * a // 16 AS share FROM b, generate_series(0, 15) g(i)")
def fair_split(spark, d):
    """A budget, capped at 4096, over 16 cells as differences of floors."""
    b = ticks(spark, d).groupBy("burst").agg(F.least(F.lit(4096), F.sum(arith.trunc_div("v", 100))).alias("a"))
    e = b.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return e.select("burst", "i", (arith.trunc_div((F.col("i") + 1) * F.col("a"), 16) - arith.trunc_div(F.col("i") * F.col("a"), 16)).alias("share"))


@query("colour_time_slots", f"{NUMBERED} SELECT burst, i % 64 AS slot, count(*) AS n, sum(v)::BIGINT AS total FROM o GROUP BY ALL")
def colour_time_slots(spark, d):
    n = seq.numbered(ticks(spark, d), KEYS, ORDER)
    return n.groupBy("burst", (F.col("i").bitwiseAND(F.lit(63))).cast("long").alias("slot")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("ladder_delay", "SELECT c_custkey, CASE WHEN 320 % (c_custkey % 64 + 1) = 0 THEN 320 // (c_custkey % 64 + 1) END AS delay FROM customer")
def ladder_delay(spark, d):
    """320 / side where it divides, else refused (null)."""
    side = F.col("c_custkey") % 64 + 1
    return table(spark, d, "customer").select("c_custkey", F.when(320 % side == 0, arith.trunc_div(320, side)).alias("delay"))


@query("chain_continuity", "SELECT conv_id, count(*) AS links, bool_and(turn = expect) AS contiguous FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS expect FROM conversations) GROUP BY conv_id")
def chain_continuity(spark, d):
    c = table(spark, d, "conversations")
    n = seq.numbered(c, ["conv_id"], ["turn"])
    low = c.groupBy("conv_id").agg(F.min("turn").alias("low"))
    return n.join(low, "conv_id").groupBy("conv_id").agg(F.count("*").alias("links"), F.bool_and(F.col("turn") == F.col("low") + F.col("i")).alias("contiguous"))


@query("order_keys", "WITH x AS (SELECT vec_id, vec_id % 64 AS x, (vec_id // 64) % 64 AS y FROM embeddings) SELECT vec_id, y * 64 + x AS row_major, y * 64 + CASE WHEN y % 2 = 0 THEN x ELSE 63 - x END AS serpentine, " + " + ".join(f"((x >> {b}) & 1) * {1 << (3 * b)} + ((y >> {b}) & 1) * {1 << (3 * b + 1)}" for b in range(6)) + " AS morton FROM x")
def order_keys(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 64).alias("x"), (arith.trunc_div("vec_id", 64) % 64).alias("y"))
    row = F.col("y") * 64
    return e.select("vec_id", (row + F.col("x")).alias("row_major"), (row + F.when(F.col("y") % 2 == 0, F.col("x")).otherwise(63 - F.col("x"))).alias("serpentine"), arith.morton3("x", "y", F.lit(0)).alias("morton"))
