"""Queries over the two-way data sources, adoption, replayed mints, encoded pools and captures with timers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.arith import trunc_div
from lumenfold.operators import exchange, mints, pools
from lumenfold.plans.catalog import query
from lumenfold.plans.frames import _stream
from lumenfold.plans.inputs import TICKS_SQL, table, ticks
from lumenfold.sources.artifacts import export, listing
from lumenfold.sources.frames import FrameSource, run_until
from lumenfold.storage import new_path
from lumenfold.streaming import captures
from lumenfold.streaming.ticks import run_to_table


@query("frame_stream", "SELECT user_id AS burst, count(*) AS frames, count(*) AS numbers, sum(event_id)::BIGINT AS ids, min(ts) AS begun FROM events GROUP BY user_id")
def frame_stream(spark, d):
    """All events as frames of a stream that is read to its end: what arrived of each burst, and how many frame numbers."""
    spark.dataSource.register(FrameSource)
    path = new_path(spark, "frames")
    frames = spark.readStream.format("frames").option("path", f"{d}/events.parquet").load()
    q = frames.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").start()
    run_until(q)
    got = spark.read.schema(frames.schema).parquet(path)
    return got.groupBy(F.col("user_id").alias("burst")).agg(F.count("*").alias("frames"), F.countDistinct("frame").alias("numbers"), F.sum("event_id").alias("ids"), F.min("ts").alias("begun"))


@query("staged_export", "SELECT page_id::VARCHAR AS stem, 2 AS files, (octet_length(encode(coalesce(html, ''))) + octet_length(encode(coalesce(url, ''))))::BIGINT AS bytes, sha256(coalesce(html, '')) AS html FROM pages")
def staged_export(spark, d):
    """Every page's text and url as two artifacts, exported twice and read back: the second export adds nothing."""
    path = new_path(spark, "artifacts")
    pages = table(spark, d, "pages")
    pair = F.inline(F.array(*[F.struct(F.lit(s).alias("suffix"), F.coalesce(c, F.lit("")).cast("binary").alias("content")) for s, c in ((".html", "html"), (".url", "url"))]))
    files = pages.select(F.col("page_id").cast("string").alias("stem"), pair)
    export(files, path)
    export(files, path)
    html = F.max(F.when(F.col("suffix") == ".html", F.sha2("content", 256))).alias("html")
    return listing(spark, path, contents=True).groupBy("stem").agg(F.count("*").cast("int").alias("files"), F.sum("bytes").alias("bytes"), html)


WANTED_SQL = "want AS (SELECT DISTINCT o_custkey AS adopter, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("store_adopt", f"WITH {WANTED_SQL} SELECT 'adopt-' || adopter || '-' || w.item AS adoption_id, adopter, w.item, CASE WHEN adopter % 10 = 0 AND w.item % 2 = 0 THEN 'held' WHEN w.item % 7 = 0 THEN 'not_found' WHEN p_size % 11 = 0 THEN 'malformed_record' WHEN p_size % 5 = 0 THEN 'blob_unavailable' ELSE 'adopted' END AS outcome FROM want w JOIN part ON p_partkey = w.item")
def store_adopt(spark, d):
    """Buyers adopt the parts they ordered, from a store that lacks some parts, some records' names and some contents, and where some are held."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("adopter"))
    wanted = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item")).join(orders, "o_orderkey").select("adopter", "item")
    part = table(spark, d, "part").filter("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("item"), F.when(F.col("p_size") % 11 != 0, F.col("p_name")).alias("name"), "p_size")
    held = wanted.filter("adopter % 10 = 0 AND item % 2 = 0").select(exchange.adoption_id(F.col("adopter"), F.col("item")).alias("adoption_id"))
    return exchange.adopt(wanted, part, part.filter("p_size % 5 <> 0"), held, ("name",))


@query("adopted_popularity", f"WITH {WANTED_SQL} SELECT w.item, count(*) AS adopters FROM want w JOIN part ON p_partkey = w.item WHERE w.item % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 5 <> 0 GROUP BY w.item")
def adopted_popularity(spark, d):
    """How many buyers each part has after their requests were met as far as they could."""
    out = store_adopt(spark, d).filter(F.col("outcome").isin(exchange.ADOPTED, exchange.HELD))
    sound = table(spark, d, "part").filter("p_partkey % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 5 <> 0").select(F.col("p_partkey").alias("item"))
    return exchange.popularity(out.join(sound, "item", "left_semi"))


#: Ticks as mint operations: what a tick makes and of which two others (none: an origin, every fifth of a burst).
MINTS_SQL = f"{TICKS_SQL}, o AS (SELECT burst, tick_id AS seq, row_number() OVER (PARTITION BY burst ORDER BY tick_id) AS i, abs(v) % 23 AS gene, [abs(v) // 23 % 23, abs(v) // 529 % 23] AS pair FROM ticks), p AS (SELECT burst, seq, i, gene, CASE WHEN gene % 5 = 0 THEN [] ELSE pair END AS parents FROM o)"


@query(
    "mint_replay",
    f"""WITH RECURSIVE {MINTS_SQL}, f AS (SELECT burst, 0::BIGINT AS i, []::BIGINT[] AS held, NULL::BIGINT AS seq, NULL::BOOLEAN AS granted, NULL::BOOLEAN AS fresh FROM (SELECT DISTINCT burst FROM p)
    UNION ALL SELECT p.burst, p.i, CASE WHEN list_has_all(held, parents) AND NOT list_contains(held, gene) THEN list_append(held, gene) ELSE held END, p.seq, list_has_all(held, parents), list_has_all(held, parents) AND NOT list_contains(held, gene) FROM f JOIN p ON p.burst = f.burst AND p.i = f.i + 1)
    SELECT burst, seq, granted, fresh AS is_new FROM f WHERE i > 0""",
)
def mint_replay(spark, d):
    """Ticks of each burst as mint operations on 23 genes: which are granted, and which made their gene."""
    v = F.abs("v")
    pair = F.array(trunc_div(v, 23) % 23, trunc_div(v, 529) % 23)
    ops = ticks(spark, d).select("burst", F.col("tick_id").alias("seq"), (v % 23).alias("gene"), F.when(v % 23 % 5 != 0, pair).otherwise(F.array().cast("array<bigint>")).alias("parents"))
    return mints.replay(ops, ("burst",)).select("burst", "seq", F.col("generation").isNotNull().alias("granted"), "is_new")


@query("grantable_children", "WITH h AS (SELECT DISTINCT o_custkey AS who, l_partkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey), c AS (SELECT p_partkey AS child, p_partkey // 2 AS a, p_partkey // 3 AS b FROM part) SELECT x.who, child FROM c JOIN h x ON x.gene = a JOIN h y ON y.gene = b AND y.who = x.who")
def grantable_children(spark, d):
    """Each part as a child of two others: who holds both."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("who"))
    holdings = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("gene")).join(orders, "o_orderkey")
    children = table(spark, d, "part").select(F.col("p_partkey").alias("child"), F.array(trunc_div("p_partkey", 2), trunc_div("p_partkey", 3)).alias("parents"))
    return mints.grantable(children, holdings)


SIDE = 16
CODES = {"srgb8": 256, "linear_srgb8": 256, "linear_hlg10": 1024}


def _lane(c: int, codes: int) -> str:
    return f"abs(CAST(round_even(CAST(embedding[{c}] AS DOUBLE) * 65536, 0) AS BIGINT)) % {codes}"


def _coded_sql(codes: int, broken: str = "0") -> str:
    return f"px AS (SELECT vec_id // 256 AS frame, vec_id // 16 % 16 AS y, vec_id % 16 AS x, {_lane(1, codes)} + {broken} AS r, {_lane(2, codes)} AS g, {_lane(3, codes)} AS b FROM embeddings)"


def _coded(spark, d, codes: int):
    """frame, y, x, r, g, b: three components of each vector as codes, 256 vectors a frame of 16 x 16, the last one as far as it goes."""
    at = F.col("vec_id")
    lanes = [(F.abs(F.rint(F.col("embedding")[i].cast("double") * 65536).cast("long")) % codes).alias(c) for i, c in enumerate("rgb")]
    return table(spark, d, "embeddings").select(trunc_div(at, 256).alias("frame"), (trunc_div(at, 16) % 16).alias("y"), (at % 16).alias("x"), *lanes)


@query("pool_window", f"WITH {_coded_sql(256)} SELECT frame, (y - 4) // 2 AS bin_y, (x - 4) // 2 AS bin_x, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, count(*) AS n FROM px WHERE y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11 GROUP BY ALL")
def pool_window(spark, d):
    """The middle 8 x 8 of every frame in bins of 2 x 2, read from packed rows of B, G, R, A bytes."""
    px = _coded(spark, d, 256)
    pixel = F.concat(*[F.unhex(F.lpad(F.hex(c), 2, "0")) for c in ("b", "g", "r")], F.unhex(F.lit("FF")))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", F.hex(pixel).alias("p")))), lambda s: s["p"]), "")
    packed = px.groupBy("frame", "y").agg(F.unhex(row).alias("row"))
    return pools.pool_sums(pools.bgra_pixels(packed, 4 * SIDE, (4, 4), 8), 8, 4, window=(4, 4))


SRGB_SQL = "least(65535, floor(CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * 65535 + 0.5))::BIGINT"
HLG_SQL = "least(65535, floor(CASE WHEN {c} / 1023.0::DOUBLE <= 0.5 THEN ({c} / 1023.0::DOUBLE) * ({c} / 1023.0::DOUBLE) / 3.0 ELSE (exp(({c} / 1023.0::DOUBLE - 0.55991073::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12.0 END * 65535 + 0.5))::BIGINT"


def _light_sql(px: str, curve: str, rest: str = "") -> str:
    sums = ", ".join(f"sum({curve.format(c=c)})::BIGINT AS {c}" for c in "rgb")
    return f"WITH {px} SELECT frame, y // 4 AS bin_y, x // 4 AS bin_x, {sums}, count(*) AS n FROM px {rest} GROUP BY ALL"


@query("pool_linear_srgb8", _light_sql(_coded_sql(256), SRGB_SQL))
def pool_linear_srgb8(spark, d):
    """Linear light of every frame in bins of 4 x 4, from 8-bit codes."""
    return pools.pool_sums(_coded(spark, d, 256), SIDE, 4, "linear_srgb8")


#: Every second frame has one code out of range.
BROKEN_SQL = "CASE WHEN vec_id // 256 % 2 = 1 AND vec_id % 256 = 100 THEN 1024 ELSE 0 END"


def _broken(spark, d):
    return _coded(spark, d, 1024).withColumn("r", F.when((F.col("frame") % 2 == 1) & (F.col("y") == 6) & (F.col("x") == 4), F.col("r") + 1024).otherwise(F.col("r")))


@query("pool_linear_hlg10", _light_sql(_coded_sql(1024, BROKEN_SQL), HLG_SQL, "WHERE frame NOT IN (SELECT frame FROM px WHERE r > 1023)"))
def pool_linear_hlg10(spark, d):
    """Linear light of every frame in bins of 4 x 4, from 10-bit codes of the hybrid log-gamma curve; frames with a code out of range are refused whole."""
    return pools.pool_sums(_broken(spark, d), SIDE, 4, "linear_hlg10")


@query("pool_refusals", f"WITH {_coded_sql(1024, BROKEN_SQL)} SELECT DISTINCT frame, -3 AS code FROM px WHERE r > 1023")
def pool_refusals(spark, d):
    return pools.refused_frames(_broken(spark, d), SIDE, "linear_hlg10")


#: A burst's capture ends after a day and a half without a tick.
IDLE_MS = 129_600_000


@query(
    "timed_captures",
    f"""WITH {TICKS_SQL}, t AS (SELECT burst, epoch_us(ts) // 1000 AS ms, tick_id, v, lag(epoch_us(ts) // 1000) OVER w AS before FROM ticks WINDOW w AS (PARTITION BY burst ORDER BY epoch_us(ts) // 1000, tick_id)),
    s AS (SELECT *, sum(CASE WHEN ms - before > {IDLE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY burst ORDER BY ms, tick_id) AS run FROM t),
    c AS (SELECT *, (row_number() OVER (PARTITION BY burst, run ORDER BY ms, tick_id) - 1) // 64 AS part, (row_number() OVER (PARTITION BY burst, run ORDER BY ms, tick_id) - 1) % 64 % 16 AS p FROM s),
    o AS (SELECT *, CASE WHEN p < 8 THEN 0 WHEN p < 13 THEN 1 ELSE 2 END AS k, p NOT IN (0, 1, 8, 9, 13, 14) AS own FROM c),
    g AS (SELECT burst, run, part, min(ms) AS begun, max(ms) AS ended, count(*) AS ticks, {', '.join(f"coalesce(sum(v) FILTER (WHERE own AND k = {k}), 0)::BIGINT AS t{k}, count(*) FILTER (WHERE own AND k = {k}) AS n{k}" for k in range(3))} FROM o GROUP BY ALL),
    l AS (SELECT *, run = max(run) OVER (PARTITION BY burst) AND part = max(part) OVER (PARTITION BY burst, run) AS open FROM g)
    SELECT burst, begun, ended, ticks, CASE WHEN ticks = 64 THEN 'full' WHEN open THEN 'idle' ELSE 'gap' END AS reason, t0, t1, t2, n0, n1, n2
    FROM l WHERE ticks = 64 OR NOT open OR ended + {IDLE_MS} < (SELECT max(ms) FROM t)""",
)
def timed_captures(spark, d):
    """Routed sums of every capture of the stream that has ended, by count, by a gap, or by a timer."""
    with captures.state_store(spark):
        return run_to_table(captures.routed_captures(_stream(spark, d), idle_ms=IDLE_MS), "captures")
