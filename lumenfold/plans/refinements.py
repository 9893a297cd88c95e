"""Queries over applied deltas, seams, cell statistics, further pools and laws of membership."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.arith import floor_div, half_up_div, isqrt, trunc_div
from lumenfold.operators import sequence
from lumenfold.plans.catalog import query
from lumenfold.plans.frames import NUMBERED, _stream
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TRADES_SQL, palette, pixels, table, ticks, trades
from lumenfold.streaming import ticks as stream

P, PP = f"WITH {PIXELS_SQL}", f"WITH {PALETTE_SQL}"


@query("value_apply", f"{PP} SELECT p.frame, p.slot, " + ", ".join(f"p.{c} + coalesce(CASE WHEN p.slot % 3 <> 0 THEN q.{c} - p.{c} END, 0) AS {c}" for c in "lab") + " FROM palette p LEFT JOIN palette q ON q.frame = p.frame + 1 AND q.slot = p.slot")
def value_apply(spark, d):
    """Displacements to the next palette, without every third slot, applied: a missing one counts as none."""
    p = palette(spark, d)
    nxt = p.select((F.col("frame") - 1).alias("frame"), "slot", *[F.col(c).alias(f"n{c}") for c in "lab"])
    delta = p.join(nxt, ["frame", "slot"]).filter("slot % 3 <> 0").select("frame", "slot", *[(F.col(f"n{c}") - F.col(c)).alias(f"d{c}") for c in "lab"])
    return p.join(delta, ["frame", "slot"], "left").select("frame", "slot", *[(F.col(c) + F.coalesce(f"d{c}", F.lit(0))).alias(c) for c in "lab"])


@query("seam_momentum", f"{PP}, n AS (SELECT max(frame) + 1 AS n FROM palette), m AS (SELECT p.frame, avg((p.l - q.l) * (p.l - q.l) / 4294967296.0::DOUBLE + (p.a - q.a) * (p.a - q.a) / 4294967296.0::DOUBLE + (p.b - q.b) * (p.b - q.b) / 4294967296.0::DOUBLE) AS mse FROM n, palette p JOIN palette q ON q.slot = p.slot AND q.frame = (p.frame + 1) % (SELECT n FROM n) GROUP BY p.frame) SELECT frame, round(mse, 8) AS mse, frame = (SELECT n - 1 FROM n) AS seam FROM m")
def seam_momentum(spark, d):
    """Mean squared change to the next palette of the loop; the last one's is the seam."""
    p = palette(spark, d)
    n = p.agg((F.max("frame") + 1).cast("int").alias("n")).first()["n"]
    nxt = p.select(F.pmod(F.col("frame") - 1, F.lit(n)).alias("frame"), "slot", *[F.col(c).alias(f"n{c}") for c in "lab"])
    change = sum((F.col(c) - F.col(f"n{c}")) * (F.col(c) - F.col(f"n{c}")) / 4294967296.0 for c in "lab")
    return p.join(nxt, ["frame", "slot"]).groupBy("frame").agg(F.round(F.avg(change), 8).alias("mse")).withColumn("seam", F.col("frame") == n - 1)


@query("dead_time", f"{NUMBERED} SELECT burst, i // 8 AS slow, sum(abs(v))::BIGINT - sum(abs(v)) FILTER (WHERE i % 8 NOT IN (3, 7))::BIGINT AS lost, sum(abs(v) * (1 + i % 4))::BIGINT AS product FROM o GROUP BY ALL HAVING count(*) = 8")
def dead_time(spark, d):
    """What a slow read holds beyond its pooled fast reads, which miss every fourth tick, and the exposure product."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    v = F.abs("v")
    fast = F.sum(F.when(~(F.col("i") % 8).isin(3, 7), v))
    g = n.groupBy("burst", trunc_div("i", 8).alias("slow")).agg(F.count("*").alias("n"), (F.sum(v) - fast).alias("lost"), F.sum(v * (1 + F.col("i") % 4)).alias("product"))
    return g.filter("n = 8").drop("n")


QUARTETS = f"{PP}, q AS (SELECT slot, frame // 4 AS quartet, max((l - m) * (l - m)) AS far, count(*) AS n FROM (SELECT *, avg(l) OVER (PARTITION BY slot, frame // 4) AS m FROM palette) GROUP BY ALL)"


@query("core_colours", f"{QUARTETS} SELECT quartet::BIGINT AS quartet, slot FROM q WHERE n = 4 AND far <= 150000000")
def core_colours(spark, d):
    """Slots that stay within a distance of their mean over a quartet of frames."""
    w = Window.partitionBy("slot", "quartet")
    p = palette(spark, d).withColumn("quartet", trunc_div("frame", 4)).withColumn("m", F.avg("l").over(w))
    g = p.groupBy("quartet", "slot").agg(F.max((F.col("l") - F.col("m")) * (F.col("l") - F.col("m"))).alias("far"), F.count("*").alias("n"))
    return g.filter("n = 4 AND far <= 150000000").select("quartet", "slot")


def _tmean(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -((-({x})) // n) ELSE ({x}) // n END)"


@query("cell_statistics", f"{P}, s AS (SELECT frame, idx % 8 AS slot, count(*) AS n, " + ", ".join(f"sum({c})::BIGINT AS s{c}" for c in "lab") + " FROM pixels GROUP BY ALL), m AS (SELECT frame, slot, n, " + ", ".join(f"{_tmean(f's{c}')}::BIGINT AS m{c}" for c in "lab") + " FROM s), v AS (SELECT m.frame, slot, n, " + ", ".join(f"m{c}, (sum(({c} - m{c}) * ({c} - m{c})) // n)::BIGINT AS v{c}" for c in "lab") + " FROM m JOIN pixels p ON p.frame = m.frame AND p.idx % 8 = m.slot GROUP BY m.frame, slot, n, ml, ma, mb) SELECT frame, slot, n, " + ", ".join(f"m{c}, floor(sqrt(v{c}::DOUBLE))::BIGINT AS s{c}" for c in "lab") + " FROM v")
def cell_statistics(spark, d):
    """Count, truncated mean and integer deviation of every cell: a second pass sums squares around the mean."""
    px = pixels(spark, d).withColumn("slot", F.col("idx") % 8)
    mean = px.groupBy("frame", "slot").agg(F.count("*").alias("n"), *[trunc_div(F.sum(c), F.count("*")).alias(f"m{c}") for c in "lab"])
    both = px.join(mean, ["frame", "slot"])
    spread = [isqrt(trunc_div(F.sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}"))), F.first("n"))).alias(f"s{c}") for c in "lab"]
    return both.groupBy("frame", "slot").agg(F.first("n").alias("n"), *[F.first(f"m{c}").alias(f"m{c}") for c in "lab"], *spread)


@query("cluster_losses", "WITH u AS (SELECT label AS usr, vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, generate_series(1, 6) t(i)), z AS (SELECT usr, vec_id, m, sum(x * cos(i * (m + 1))) AS z FROM u, generate_series(0, 2) c(m) GROUP BY ALL), l AS (SELECT usr, m, avg(ln(1 + exp(-z))) AS loss FROM z GROUP BY ALL) SELECT usr AS user, m AS model, round(loss, 8) AS loss, loss = min(loss) OVER (PARTITION BY usr) AS own FROM l")
def cluster_losses(spark, d):
    """Mean logistic loss of three models on every user's pairs, and the model of least loss."""
    e = table(spark, d, "embeddings").select(F.col("label").alias("user"), F.slice("embedding", 1, 6).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("model"))
    z = F.aggregate(F.transform("x", lambda v, i: v.cast("double") * F.cos((i + 1) * (F.col("model") + 1))), F.lit(0.0), lambda s, v: s + v)
    loss = e.groupBy("user", "model").agg(F.avg(F.log1p(F.exp(-z))).alias("loss"))
    return loss.select("user", "model", F.round("loss", 8).alias("loss"), (F.col("loss") == F.min("loss").over(Window.partitionBy("user"))).alias("own"))


@query("hash_query", "SELECT a.p_partkey AS id, min(b.p_partkey) AS found FROM part a JOIN part b ON md5((a.p_size % 7)::VARCHAR || ':' || (a.p_partkey % 24)::VARCHAR) = md5((b.p_size % 7)::VARCHAR || ':' || (b.p_partkey % 24)::VARCHAR) GROUP BY a.p_partkey")
def hash_query(spark, d):
    """The first part whose key (by hash of its attributes) is that of each part."""
    key = F.md5(F.concat_ws(":", (F.col("p_size") % 7).cast("string"), (F.col("p_partkey") % 24).cast("string")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), key.alias("key"))
    return p.join(p.groupBy("key").agg(F.min("id").alias("found")), "key").select("id", "found")


@query("holdings_grow", f"WITH {TRADES_SQL}, h AS (SELECT DISTINCT proposer, want, epoch FROM trades WHERE state = 'accepted'), k AS (SELECT proposer, count(DISTINCT want) FILTER (WHERE epoch <= 1500) AS before, count(DISTINCT want) AS after FROM h GROUP BY proposer) SELECT proposer, before, after, 0 AS missing FROM k")
def holdings_grow(spark, d):
    """Holdings at an epoch and at the end: none of the earlier ones is missing later."""
    h = trades(spark, d).filter("state = 'accepted'").select("proposer", "want", "epoch").distinct()
    early = h.filter("epoch <= 1500").select("proposer", "want").distinct()
    late = h.select("proposer", "want").distinct()
    gone = early.join(late, ["proposer", "want"], "left_anti").groupBy("proposer").agg(F.count("*").cast("int").alias("missing"))
    counts = h.groupBy("proposer").agg(F.countDistinct(F.when(F.col("epoch") <= 1500, F.col("want"))).alias("before"), F.countDistinct("want").alias("after"))
    return counts.join(gone, "proposer", "left").select("proposer", "before", "after", F.coalesce("missing", F.lit(0)).alias("missing"))


@query("sums_to_bytes", "WITH s AS (SELECT l_orderkey % 500 AS bin, sum((l_partkey * 7 + l_linenumber) % 256)::BIGINT AS s, count(*) AS a FROM lineitem GROUP BY ALL) SELECT bin, ((s + a // 2) // a)::BIGINT AS byte, (s + a // 2) // a > 255 AS refused FROM s")
def sums_to_bytes(spark, d):
    """Sums over bins of any area to bytes, rounded half up; more than 255 is refused."""
    li = table(spark, d, "lineitem")
    s = li.groupBy((F.col("l_orderkey") % 500).alias("bin")).agg(F.sum((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 256).alias("s"), F.count("*").alias("a"))
    byte = half_up_div("s", "a")
    return s.select("bin", byte.alias("byte"), (byte > 255).alias("refused"))


VARIANTS = (("spatial2", 1, 2), ("spatial4", 1, 4), ("spatial8", 1, 8), ("time2", 2, 1), ("time4", 4, 1), ("cube2", 2, 2))
GRID_SQL = f"{NUMBERED}, g AS (SELECT i AS t, burst // 8 % 8 AS y, burst % 8 AS x, sum(abs(v))::BIGINT AS v FROM o WHERE i < 16 GROUP BY ALL)"


@query("pool_variants", GRID_SQL + " " + " UNION ALL ".join(f"SELECT '{n}' AS variant, t // {dt} AS t, y // {ds} AS y, x // {ds} AS x, sum(v)::BIGINT AS total FROM g GROUP BY ALL" for n, dt, ds in VARIANTS))
def pool_variants(spark, d):
    """Exact sums of a grid of readings over six shapes of blocks, in one pass."""
    n = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"]).filter("i < 16")
    g = n.groupBy(F.col("i").cast("long").alias("t"), (trunc_div("burst", 8) % 8).alias("y"), (F.col("burst") % 8).alias("x")).agg(F.sum(F.abs("v")).alias("v"))
    shapes = F.array(*[F.struct(F.lit(name).alias("variant"), trunc_div("t", dt).alias("t"), trunc_div("y", ds).alias("y"), trunc_div("x", ds).alias("x")) for name, dt, ds in VARIANTS])
    return g.select("v", F.explode(shapes).alias("s")).groupBy("s.variant", "s.t", "s.y", "s.x").agg(F.sum("v").alias("total"))


@query("curve_octants", f"{P}, h AS (SELECT idx % 8 AS cell, least(7, greatest(0, (l + 32768) // 8192)) AS level, count(*) AS n FROM pixels GROUP BY ALL), e AS (SELECT level, cell, n FROM h), p AS (SELECT level, cell // 2 AS pair, coalesce(max(n) FILTER (WHERE cell % 2 = 0), 0) AS x, coalesce(max(n) FILTER (WHERE cell % 2 = 1), 0) AS y FROM e GROUP BY ALL) SELECT level, pair, y + ((x - y) >> 1) AS low, x - y AS high FROM p")
def curve_octants(spark, d):
    """The counts of every level over eight cells, lifted pair by pair as curves."""
    level = F.least(F.lit(7), F.greatest(F.lit(0), trunc_div(F.col("l") + 32768, 8192)))
    h = pixels(spark, d).groupBy(level.alias("level"), (F.col("idx") % 8).alias("cell")).agg(F.count("*").alias("n"))
    side = lambda k: F.coalesce(F.max(F.when(F.col("cell") % 2 == k, F.col("n"))), F.lit(0))
    p = h.groupBy("level", trunc_div("cell", 2).alias("pair")).agg(side(0).alias("x"), side(1).alias("y"))
    return p.select("level", "pair", (F.col("y") + F.shiftright(F.col("x") - F.col("y"), 1)).alias("low"), (F.col("x") - F.col("y")).alias("high"))


@query("rounded_means", f"{PP} SELECT frame, slot // 4 AS grp, CAST(floor((2 * sum(b) + 4) / 8.0::DOUBLE) AS BIGINT) AS up, CAST(floor(sum(b) / 4.0::DOUBLE) AS BIGINT) AS down FROM palette GROUP BY ALL")
def rounded_means(spark, d):
    """Group means of values below zero, half up and down."""
    return palette(spark, d).groupBy("frame", trunc_div("slot", 4).alias("grp")).agg(floor_div(2 * F.sum("b") + 4, 8).alias("up"), floor_div(F.sum("b"), 4).alias("down"))


@query("stream_captures", f"{NUMBERED}, c AS (SELECT burst, i // 64 AS c, epoch_us(min(ts)) AS begun, sum(v)::BIGINT AS total, max(v) AS high, count(*) AS n FROM o GROUP BY ALL) SELECT burst, begun, total, high FROM c WHERE n = 64")
def stream_captures(spark, d):
    """Captures of 64 ticks as a stream gives them when they are full; the buffer is empty again after each."""
    return stream.run_to_table(stream.full_captures(_stream(spark, d)), "captures")
