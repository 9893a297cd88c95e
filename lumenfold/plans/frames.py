"""Queries over frame kernels, hashes, codecs and streams; most are no SQL, and tests hold their mirrors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions import kernels
from lumenfold.operators import frames, sequence
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TICKS_SQL, palette, pixels, table, ticks
from lumenfold.streaming import ticks as stream


@query("quantize_frame")
def quantize_frame(spark, d):
    return frames.quantize_frames(pixels(spark, d), 16, lloyd=2).select("frame", "idx", "slot", "cl", "ca", "cb")


@query("global_collapse")
def global_collapse(spark, d):
    """One palette of the pooled palettes of all frames."""
    p = palette(spark, d)
    pooled = p.select(F.lit(0).alias("frame"), (F.col("frame").cast("long") * 256 + F.col("slot")).alias("idx"), "l", "a", "b")
    return frames.quantize_frames(pooled, 32).select("idx", "slot", "cl", "ca", "cb")


@query("significance_fill")
def significance_fill(spark, d):
    q = frames.quantize_frames(pixels(spark, d), 16, least=2)
    return q.groupBy("frame", "slot").agg(F.count("*").alias("n"))


@query("fs_dither")
def fs_dither(spark, d):
    return frames.dither_frames(pixels(spark, d), 8, 6)


@query("atkinson_dither")
def atkinson_dither(spark, d):
    return frames.dither_frames(pixels(spark, d), 8, 6, "atkinson")


@query("threshold_dither")
def threshold_dither(spark, d):
    return frames.dither_frames(pixels(spark, d), 8, 6, "threshold")


@query("median_cut")
def median_cut(spark, d):
    return frames.median_cut_frames(pixels(spark, d), 4)


def _rounds_sql(rounds: int, start: str = f"WITH {PIXELS_SQL}, c0 AS (SELECT idx::INTEGER AS slot, l, a, b FROM pixels ORDER BY idx LIMIT 8)", points: str = "pixels", w: str = "1") -> str:
    sql = start
    mean = lambda c: f"CASE WHEN sum({c} * {w}) < 0 THEN -((-sum({c} * {w})) // sum({w})) ELSE sum({c} * {w}) // sum({w}) END::BIGINT AS {c}"
    extra = "" if w == "1" else f", p.{w}"
    for k in range(rounds):
        d2 = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in "lab")
        sql += f", n{k} AS (SELECT p.idx, p.l, p.a, p.b{extra}, arg_min(q.slot, ({d2}, q.slot)) AS slot FROM {points} p, c{k} q GROUP BY ALL)"
        sql += f", m{k} AS (SELECT slot, {', '.join(mean(c) for c in 'lab')} FROM n{k} GROUP BY slot)"
        sql += f", c{k + 1} AS (SELECT c.slot, coalesce(m.l, c.l) AS l, coalesce(m.a, c.a) AS a, coalesce(m.b, c.b) AS b FROM c{k} c LEFT JOIN m{k} m USING (slot))"
    return f"{sql} SELECT * FROM c{rounds}"


@query("kmeans_rounds", _rounds_sql(3))
def kmeans_rounds(spark, d):
    """Three Lloyd steps over the pixels of all frames."""
    px = pixels(spark, d)
    return frames.cluster_large(px, px.orderBy("idx").limit(8).select(F.col("idx").cast("int").alias("slot"), "l", "a", "b"), 3)


POOLED_SQL = f"WITH {PALETTE_SQL}, pool AS (SELECT frame * 256 + slot AS idx, l, a, b, 1 + slot * slot % 7 AS weight FROM palette), c0 AS (SELECT idx::INTEGER AS slot, l, a, b FROM pool ORDER BY idx LIMIT 8)"


@query("weighted_collapse", _rounds_sql(2, POOLED_SQL, "pool", "weight"))
def weighted_collapse(spark, d):
    """One palette of eight from all palettes' colours by their weights: two Lloyd steps of weighted means."""
    p = palette(spark, d).select((F.col("frame").cast("long") * 256 + F.col("slot")).alias("idx"), "l", "a", "b", (1 + F.col("slot") * F.col("slot") % 7).alias("weight"))
    return frames.cluster_large(p, p.orderBy("idx").limit(8).select(F.col("idx").cast("int").alias("slot"), "l", "a", "b"), 2, "weight")


@query("sinkhorn")
def sinkhorn(spark, d):
    p = palette(spark, d).select("frame", F.array(*[F.col(c) / 65536.0 for c in "lab"]).alias("x"))
    sides = [p.select(F.pmod(F.col("frame") - s, F.lit(10)).cast("long").alias("pair"), F.lit(s).alias("side"), "x", F.lit(1.0).alias("w")) for s in (0, 1)]
    return frames.sinkhorn_frames(sides[0].union(sides[1]), 0.05, 30).select("pair", F.round("cost", 6).alias("cost"))


@query("fed_average", "WITH u AS (SELECT label AS model, i, avg(embedding[i]::DOUBLE) AS w FROM embeddings, generate_series(1, 8) t(i) GROUP BY ALL) SELECT model, round(sum(w * i), 6) AS digest FROM u GROUP BY model")
def fed_average(spark, d):
    u = table(spark, d, "embeddings").select(F.col("label").alias("model"), F.slice("embedding", 1, 8).cast("array<double>").alias("weights"))
    m = frames.fed_average(u)
    digest = F.aggregate(F.transform("weights", lambda w, i: w * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("model", F.round(digest, 6).alias("digest"))


#: SQL of a hash: words as eight bytes each, folded from the offset basis, and as a signed number.
WORD_SQL = "list_transform(generate_series(0, 7), lambda k: (({w})::HUGEINT >> (8 * k)::INTEGER) & 255)"
FOLD_SQL = "list_reduce(list_prepend(14695981039346656037::HUGEINT, {bytes}), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
SIGNED_SQL = "(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END)::BIGINT"


def _gene_sql(words: list[str]) -> str:
    """SQL of the hash of a list of non-negative words."""
    return FOLD_SQL.format(bytes=" || ".join(WORD_SQL.format(w=w) for w in words))


@query("gene_hash", f"WITH g AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN {_gene_sql(['2', 'conv_id', 'turn', '1', 'turn - 1'])} ELSE {_gene_sql(['2', 'conv_id', 'turn', '0'])} END AS h FROM conversations) SELECT conv_id, turn, {SIGNED_SQL.format(h='h')} AS gene_id FROM g")
def gene_hash(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array("conv_id", "turn").alias("payload"), F.when(F.col("turn") > 0, F.array(F.col("turn") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"))
    return frames.gene_ids(t, "payload", "parents").select("conv_id", "turn", "gene_id")


@query("hash_chain", f"WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), c AS (SELECT conv_id, turn, i, {_gene_sql(['2', 'i', 'n', '1', '0'])} AS h FROM o WHERE i = 0 UNION ALL SELECT o.conv_id, o.turn, o.i, {_gene_sql(['2', 'o.i', 'o.n', '1', 'c.h'])} FROM c JOIN o ON o.conv_id = c.conv_id AND o.i = c.i + 1) SELECT conv_id, turn, {SIGNED_SQL.format(h='h')} AS link FROM c")
def hash_chain(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return frames.chain_hashes(t, "conv_id", "turn", "n")


W = "PARTITION BY burst ORDER BY ts, tick_id"
NUMBERED = f"WITH {TICKS_SQL}, o AS (SELECT *, row_number() OVER ({W}) - 1 AS i FROM ticks)"


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").load(d, format="parquet")
    return raw.select(F.col("user_id").alias("burst"), "ts", F.col("event_id").alias("tick_id"), F.rint(F.col("value") * 100).cast("long").alias("v"), (F.col("event_type") == "error").alias("dropped"))


@query("stream_count_windows", f"{NUMBERED}, c AS (SELECT burst, i // 64 AS c, i % 64 AS i, v, ts, epoch_us(min(ts) OVER (PARTITION BY burst, i // 64)) AS begun, epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER (PARTITION BY burst, i // 64 ORDER BY i), ts)) AS gap FROM o), w AS (SELECT burst, begun, s AS scale, i // s AS win, sum(v)::BIGINT AS total, count(*) AS n, max(gap) AS gap FROM c, (VALUES (1), (2), (4)) t(s) GROUP BY ALL) SELECT burst, begun, scale, win AS window, total, CASE WHEN scale = 1 AND gap >= 75000 THEN 1 ELSE 0 END AS late FROM w WHERE n = scale")
def stream_count_windows(spark, d):
    """Tumbling windows of 1, 2 and 4 ticks of captures of 64, and late ticks, over a stream: the same rows as the batch form."""
    return stream.run_to_table(stream.count_windows(_stream(spark, d)), "windows")


@query("stream_drops", f"{NUMBERED}, x AS (SELECT burst, i, channel, CASE WHEN least(i, 15) < 8 THEN 0 WHEN least(i, 15) < 13 THEN 1 ELSE 2 END AS s FROM o) SELECT burst, count(*) AS ticks, count(*) FILTER (WHERE channel = 'error' AND s = 0) AS s0, count(*) FILTER (WHERE channel = 'error' AND s = 1) AS s1, count(*) FILTER (WHERE channel = 'error' AND s = 2) AS s2 FROM x GROUP BY burst")
def stream_drops(spark, d):
    """Drops of each burst, charged to scales by a stream: the counts after the last micro-batch."""
    counts = stream.run_updates(stream.drop_counts(_stream(spark, d)), "drops")
    return counts.groupBy("burst").agg(F.max_by(F.struct("ticks", "s0", "s1", "s2"), "ticks").alias("c")).select("burst", "c.*")


@query("stream_routed_sums", f"{NUMBERED}, p AS (SELECT burst, i, v, CASE WHEN i % 16 < 8 THEN 0 WHEN i % 16 < 13 THEN 1 ELSE 2 END AS s, i % 16 NOT IN (0, 1, 8, 9, 13, 14) AS own FROM o), r AS (SELECT burst, i, coalesce(sum(v) FILTER (WHERE own AND s = 0) OVER w, 0)::BIGINT AS t0, coalesce(sum(v) FILTER (WHERE own AND s = 1) OVER w, 0)::BIGINT AS t1, coalesce(sum(v) FILTER (WHERE own AND s = 2) OVER w, 0)::BIGINT AS t2 FROM p WINDOW w AS (PARTITION BY burst ORDER BY i)) SELECT burst, i + 1 AS tick, t0, t1, t2 FROM r WHERE (i + 1) % 4 = 0")
def stream_routed_sums(spark, d):
    return stream.run_to_table(stream.routed_sums(_stream(spark, d)), "routed").select("burst", "tick", "t0", "t1", "t2")


@query("rank_permutation", f"WITH {PALETTE_SQL} SELECT frame, slot, row_number() OVER (PARTITION BY frame ORDER BY l, slot) - 1 AS rank FROM palette")
def rank_permutation(spark, d):
    w = Window.partitionBy("frame").orderBy("l", "slot")
    return palette(spark, d).select("frame", "slot", (F.row_number().over(w) - 1).alias("rank"))


@query(
    "burst_facets",
    f"""{NUMBERED}, n AS (SELECT burst, count(*) AS n FROM ticks GROUP BY burst), dl AS (SELECT burst, sum(abs(v - p)) AS travel FROM (SELECT burst, v, lag(v) OVER ({W}) AS p FROM ticks) GROUP BY burst),
    p4 AS (SELECT burst, max(t) AS peak FROM (SELECT burst, i // 4, sum(v) AS t FROM o GROUP BY ALL HAVING count(*) = 4) GROUP BY burst),
    pr AS (SELECT burst, sum(y + ((x - y) >> 1)) AS low FROM (SELECT burst, i // 2, max(v) FILTER (WHERE i % 2 = 0) AS x, max(v) FILTER (WHERE i % 2 = 1) AS y FROM o GROUP BY ALL) WHERE y IS NOT NULL GROUP BY burst)
    SELECT n.burst, n.n, coalesce(travel, 0)::BIGINT AS travel, coalesce(peak, 0)::BIGINT AS peak, coalesce(low, 0)::BIGINT AS low FROM n LEFT JOIN dl USING (burst) LEFT JOIN p4 USING (burst) LEFT JOIN pr USING (burst)""",
)
def burst_facets(spark, d):
    """One row a burst: ticks, travel, highest pool of four and sum of the low band. One sort serves all of it."""
    t = sequence.numbered(ticks(spark, d), ["burst"], ["ts", "tick_id"])
    w = Window.partitionBy("burst").orderBy("ts", "tick_id")
    nxt = [F.lead("v", k).over(w) for k in (1, 2, 3)]
    last = F.lag("v").over(w)
    t = t.select("burst", "i", F.abs(F.col("v") - last).alias("step"), F.when(F.col("i") % 4 == 0, F.col("v") + nxt[0] + nxt[1] + nxt[2]).alias("pool"), F.when(F.col("i") % 2 == 0, nxt[0] + F.shiftright(F.col("v") - nxt[0], 1)).alias("low"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return t.groupBy("burst").agg(F.count("*").alias("n"), zero(F.sum("step")).alias("travel"), zero(F.max("pool")).alias("peak"), zero(F.sum("low")).alias("low"))
