"""Queries over stores, documents and codecs: what is written comes back, and the SQL says what that must be."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenfold.functions.arith import isqrt, trunc_div
from lumenfold.functions.lift import SUBSTRATE_BOUND, in_bound
from lumenfold.operators import assign
from lumenfold.plans.catalog import query
from lumenfold.plans.inputs import PALETTE_SQL, PIXELS_SQL, TICKS_SQL, palette, pixels, table, ticks
from lumenfold.plans.lattice import BYTES_SQL, _bytes
from lumenfold.sources import codecs, readers
from lumenfold.storage import new_path

P, PP = f"WITH {PIXELS_SQL}", f"WITH {PALETTE_SQL}"


@query("csv_scan", "SELECT s_suppkey AS id, s_name AS name, s_acctbal::DOUBLE AS balance FROM supplier")
def csv_scan(spark, d):
    """Suppliers as comma-separated files with a header, read back under a schema."""
    path = new_path(spark, "csv")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance")).write.csv(path, header=True)
    return readers.read_csv(spark, path, "id long, name string, balance double")


@query("golden_records", "SELECT n_nationkey AS seed, n_nationkey || ',' || n_regionkey AS out FROM nation")
def golden_records(spark, d):
    """Expected records in one JSON document a region, exploded."""
    path = new_path(spark, "golden")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("seed"), F.array("n_nationkey", "n_regionkey").alias("out"))).alias("records"))
    rows.write.partitionBy("n_regionkey").json(path)  # one document a file
    return readers.read_golden(spark, path, "seed:long, out:array<long>").select("seed", F.array_join(F.col("out").cast("array<string>"), ",").alias("out"))


@query("corpus_manifest", "SELECT n_name AS stem, true AS has_volume, n_regionkey = 1 AS has_record, false AS has_gif FROM nation")
def corpus_manifest(spark, d):
    """A manifest written for the nations' captures, and what it says they have."""
    path = new_path(spark, "corpus")
    nations = table(spark, d, "nation").collect()  # 25 rows
    readers.write_manifest(spark, path, {n["n_name"]: [f"{n['n_name']}.volume.npy"] + [f"{n['n_name']}.s4cr"] * (n["n_regionkey"] == 1) for n in nations})
    return readers.read_corpus(spark, path).drop("files")


BURSTS_SQL = f"WITH {TICKS_SQL}, b AS (SELECT burst, count(*) AS n, sum(abs(v))::BIGINT AS total, max(abs(v)) AS high, min(v) AS low FROM ticks GROUP BY burst)"


@query("record_codec", f"{BURSTS_SQL} SELECT burst::VARCHAR AS stem, 2 AS v, n::INTEGER AS win, n AS ticks, total, high AS exposure, low AS shift FROM b")
def record_codec(spark, d):
    """Every burst's readings as a capture record in canonical bytes, decoded again."""

    @F.pandas_udf("binary")
    def encode(win: pd.Series, values: pd.Series, high: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([codecs.write_record({"v": 2, "win": int(w), "dtus": [int(x) for x in xs], "ev": [(int(h), 1, int(s))]}) for w, xs, h, s in zip(win, values, high, low)])

    b = ticks(spark, d).groupBy("burst").agg(F.count("*").alias("n"), F.collect_list(F.abs("v")).alias("values"), F.max(F.abs("v")).alias("high"), F.min("v").alias("low"))
    got = readers.decode_records(b.select(F.col("burst").cast("string").alias("stem"), encode("n", "values", "high", "low").alias("content")))
    e = F.col("ev")[0]
    return got.select("stem", "v", "win", F.size("dtus").cast("long").alias("ticks"), F.aggregate("dtus", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), e["dur_us"].alias("exposure"), e["ev_cs"].alias("shift"))


@query("gif_codec", f"{PP}, f AS (SELECT DISTINCT frame FROM palette), c AS (SELECT frame, (frame + i * i) % 16 AS slot, count(*) AS n, min(i)::INTEGER AS first FROM f, generate_series(0, 63) t(i) GROUP BY ALL) SELECT frame::VARCHAR AS stem, slot::INTEGER AS slot, n, first, (slot * 16) || ',' || (255 - slot) || ',' || frame AS colour FROM c")
def gif_codec(spark, d):
    """A picture of 8 x 8 for every frame as an animation of one, assembled and decoded: the places of each colour."""
    f = palette(spark, d).select("frame").distinct()
    colours = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.array(s * 16, 255 - s, F.col("frame").cast("int")))
    frames = f.select(F.col("frame").cast("string").alias("capture"), F.lit(0).alias("t"), colours.alias("palette"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("frame") + i * i) % 16).cast("int")).alias("indices"))
    gifs = readers.decode_gifs(readers.assemble_gifs(frames, 8, 5).select(F.col("capture").alias("stem"), F.col("gif").alias("content")))
    px = readers.gif_pixels(gifs).groupBy("stem", "slot").agg(F.count("*").alias("n"), F.min(F.col("y") * 8 + F.col("x")).alias("first"))
    return px.join(gifs.select("stem", "palette"), "stem").select("stem", "slot", "n", "first", F.array_join(F.element_at("palette", F.col("slot") + 1).cast("array<string>"), ",").alias("colour"))


@query("shared_gif_codec", f"{PP}, f AS (SELECT DISTINCT frame FROM palette), c AS (SELECT frame, (frame * 3 + i) % 16 AS slot, count(*) AS n FROM f, generate_series(0, 63) t(i) GROUP BY ALL) SELECT frame::INTEGER AS t, slot::INTEGER AS slot, n, (slot * 16) || ',' || (255 - slot) || ',0' AS colour FROM c")
def shared_gif_codec(spark, d):
    """The frames as one animation under one global table of colours, assembled and decoded."""
    f = palette(spark, d).select("frame").distinct()
    colours = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda s: F.array(s * 16, 255 - s, F.lit(0)))
    frames = f.select(F.lit("all").alias("capture"), F.col("frame").cast("int").alias("t"), colours.alias("palette"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("frame") * 3 + i) % 16).cast("int")).alias("indices"))
    gifs = readers.decode_gifs(readers.assemble_gifs(frames, 8, 5, shared=True).select(F.col("capture").alias("stem"), F.col("gif").alias("content")))
    px = readers.gif_pixels(gifs).groupBy("t", "slot").agg(F.count("*").alias("n"))
    return px.join(gifs.select("t", "palette"), "t").select("t", "slot", "n", F.array_join(F.element_at("palette", F.col("slot") + 1).cast("array<string>"), ",").alias("colour"))


@query("volume_codec", f"{PP}, f AS (SELECT DISTINCT frame FROM palette) SELECT frame::VARCHAR AS stem, t::INTEGER AS t, (16 * (frame * 1000 + t * 100 + 37.5))::BIGINT AS l, (16 * (frame * 1000 + t * 100 + 38.5))::BIGINT AS a, max(frame * 1000 + t * 100 + y * 20 + x * 5 + 2)::INTEGER AS b FROM f, generate_series(0, 1) p(t), generate_series(0, 3) q(y), generate_series(0, 3) r(x) GROUP BY ALL")
def volume_codec(spark, d):
    """A volume array for every frame, read voxel by voxel."""

    @F.pandas_udf("binary")
    def encode(frame: pd.Series) -> pd.Series:
        t, y, x, c = np.meshgrid(np.arange(2), np.arange(4), np.arange(4), np.arange(3), indexing="ij")
        out = []
        for n in frame:
            buffer = io.BytesIO()
            np.save(buffer, (int(n) * 1000 + t * 100 + y * 20 + x * 5 + c).astype(np.int32))
            out.append(buffer.getvalue())
        return pd.Series(out)

    f = palette(spark, d).select("frame").distinct()
    v = readers.decode_volumes(f.select(F.col("frame").cast("string").alias("stem"), encode("frame").alias("content")))
    return v.groupBy("stem", "t").agg(F.sum("l").alias("l"), F.sum("a").alias("a"), F.max("b").alias("b"))


@query("carrier_codec", "SELECT page_id::VARCHAR AS stem, CASE page_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_block' ELSE 'corrupt' END AS status, CASE WHEN page_id % 3 = 0 THEN sha256(coalesce(url, '')) END AS payload FROM pages")
def carrier_codec(spark, d):
    """Urls carried in pictures: a third whole, a third without a block, a third with a byte changed."""

    @F.pandas_udf("binary")
    def wrap(page: pd.Series, url: pd.Series) -> pd.Series:
        out = []
        for n, u in zip(page, url):
            block = bytearray(codecs.wrap_carrier((u or "").encode()))
            if n % 3 == 2:
                block[20] ^= 1
            out.append(b"GIF89a" + (b"" if n % 3 == 1 else bytes(block)) + b";")
        return pd.Series(out)

    c = readers.decode_carriers(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("stem"), wrap("page_id", "url").alias("content")))
    return c.select("stem", "status", F.sha2("payload", 256).alias("payload"))


@query("swap_codec", f"{PP} SELECT frame::VARCHAR AS stem, 'ok' AS status, frame::INTEGER AS minted, (frame - 1) || ',' || (frame::BIGINT * 1000000007) AS parents, string_agg(l::VARCHAR, ',' ORDER BY slot) AS weights FROM palette GROUP BY frame")
def swap_codec(spark, d):
    """Every palette's lightnesses as the weights of a swap block."""

    @F.pandas_udf("binary")
    def wrap(frame: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([b"GIF89a" + codecs.wrap_swap(int(n), [int(n) - 1, int(n) * 1000000007], [int(w) for w in ws]) + b";" for n, ws in zip(frame, weights)])

    p = palette(spark, d).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "l"))), lambda s: s["l"]).alias("w"))
    return readers.decode_swaps(p.select(F.col("frame").cast("string").alias("stem"), wrap("frame", "w").alias("content"))).select("stem", "status", "minted", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("parents", "weights")])


LUT_SQL = "c AS (SELECT r // 64 AS r, g // 64 AS g, b // 64 AS b, avg(r) / 255.0 AS x, avg(g) / 255.0 AS y, avg(b) / 255.0 AS z FROM bytes GROUP BY ALL)"


@query("lut_lines", f"WITH {BYTES_SQL}, {LUT_SQL} SELECT -1 AS k, 'LUT_3D_SIZE 4' AS value UNION ALL SELECT (b * 4 + g) * 4 + r, printf('%.6f %.6f %.6f', coalesce(x, r / 3.0), coalesce(y, g / 3.0), coalesce(z, b / 3.0)) FROM generate_series(0, 3) p(r) CROSS JOIN generate_series(0, 3) q(g) CROSS JOIN generate_series(0, 3) s(b) LEFT JOIN c USING (r, g, b)")
def lut_lines(spark, d):
    """The lines of a small colour table, red fastest, with their places: each cell's mean colour of all parts, its own corner where there is none."""
    grid = spark.range(64).select((F.col("id") % 4).alias("r"), (trunc_div("id", 4) % 4).alias("g"), trunc_div("id", 16).alias("b"))
    cells = _bytes(spark, d).groupBy(*[trunc_div(c, 64).cast("long").alias(c) for c in "rgb"]).agg(*[(F.avg(c) / 255.0).alias(f"_{c}") for c in "rgb"])
    filled = grid.join(cells, ["r", "g", "b"], "left").select("r", "g", "b", *[F.coalesce(f"_{c}", F.col(c) / 3.0).alias(f"out_{c}") for c in "rgb"])
    lines = readers.cube_lut_lines(filled, 4)
    return lines.coalesce(1).select((F.monotonically_increasing_id() - 1).alias("k"), "value")


@query("store_upsert", "SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN c_custkey IS NOT NULL THEN c_nationkey + 100 ELSE s_nationkey END AS v FROM supplier FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON s_suppkey = c_custkey")
def store_upsert(spark, d):
    """Suppliers by key, replaced by every third customer of the same key, others appended."""
    store = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("v"))
    rows = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 100).alias("v"))
    return readers.upsert(store, rows, "id")


@query("store_publish", "SELECT p_partkey AS id, 0 AS adopted FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT l_partkey, 1 FROM lineitem WHERE l_partkey % 2 = 1")
def store_publish(spark, d):
    """Parts of order lines published to a store that holds the even ones, twice: the second time changes nothing."""
    store = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(0).alias("adopted"))
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.lit(1).alias("adopted"))
    return readers.publish(readers.publish(store, rows, "id"), rows, "id")


@query("bag_difference", "WITH a AS (SELECT o_custkey % 50 AS k FROM orders), b AS (SELECT c_custkey % 50 AS k FROM customer) SELECT (SELECT count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b)) AS more, (SELECT count(*) FROM (SELECT k FROM b EXCEPT ALL SELECT k FROM a)) AS fewer")
def bag_difference(spark, d):
    """How far two bags are from equal: the rows that each has more of."""
    a = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"))
    b = table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("k"))
    side = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias(n))
    return side(a, b, "more").crossJoin(side(b, a, "fewer"))  # one row each


@query("integer_roots", "SELECT p_partkey, floor(sqrt((p_partkey * 7919 + p_size)::DOUBLE))::BIGINT AS root FROM part")
def integer_roots(spark, d):
    return table(spark, d, "part").select("p_partkey", isqrt((F.col("p_partkey") * 7919 + F.col("p_size")).cast("long")).alias("root"))


@query("domain_guard", f"{P} SELECT frame, CASE WHEN abs(l * 65536) <= {SUBSTRATE_BOUND} AND abs(a * 65536) <= {SUBSTRATE_BOUND} AND abs(b * 65536) <= {SUBSTRATE_BOUND} THEN 0 ELSE -3 END AS code, count(*) AS n FROM pixels GROUP BY ALL")
def domain_guard(spark, d):
    """Colours that leave the exact range once scaled get a refusal code."""
    ok = in_bound(F.col("l") * 65536) & in_bound(F.col("a") * 65536) & in_bound(F.col("b") * 65536)
    return pixels(spark, d).groupBy("frame", F.when(ok, 0).otherwise(-3).alias("code")).agg(F.count("*").alias("n"))


@query("weights_export", f"{PP}, w AS (SELECT frame, list(l::DOUBLE ORDER BY slot) AS w FROM palette GROUP BY frame) SELECT frame::VARCHAR AS stem, len(w)::INTEGER AS count, list_sum(w) AS total FROM w")
def weights_export(spark, d):
    """Palettes as blobs of weights, read, and exported as JSON with a hash of the text; its numbers add up."""

    @F.pandas_udf("binary")
    def blob(values: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, "<f4").tobytes() for v in values])

    p = palette(spark, d).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "l"))), lambda s: s["l"].cast("double")).alias("w"))
    w = readers.decode_weights(p.select(F.col("frame").cast("string").alias("stem"), blob("w").alias("content")), 16)
    out = readers.weights_json(w)
    right = F.when(F.sha2(F.col("json").cast("binary"), 256) == F.col("sha256"), F.from_json("json", "stem string, w array<double>"))
    return out.select("stem", "count", F.aggregate(right["w"], F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("anchored_palettes")
def anchored_palettes(spark, d):
    """Each palette with three anchors put in the nearest free slots; the law is in the tests."""
    from lumenfold.operators.frames import per_group
    from lumenfold.operators.models import anchors

    wanted = np.array([[0, 0, 0], [30_000, 1000, -1000], [60_000, -5000, 5000]])

    def place(frame, pdf):
        pdf = pdf.sort_values("slot")
        for slot, c in zip(pdf["slot"], anchors(pdf[["l", "a", "b"]].to_numpy(np.int64), wanted)):
            yield (int(frame), int(slot), *map(int, c))

    return per_group(palette(spark, d), "frame", "frame long, slot int, l long, a long, b long", place)


@query("fold_probe", f"{P}, c AS (SELECT frame, idx // 64 % 8 AS y, idx % 64 AS x, sum(l)::BIGINT AS v FROM pixels GROUP BY ALL) SELECT frame, sum(v)::BIGINT AS total, 0 AS wrong FROM c GROUP BY frame")
def fold_probe(spark, d):
    """Pools of four made at once and in two steps: their total, and in how many cells they differ."""
    fine = pixels(spark, d).groupBy("frame", (trunc_div("idx", 64) % 8).alias("y"), (F.col("idx") % 64).alias("x")).agg(F.sum("l").alias("v"))
    pool = lambda df, k: df.groupBy("frame", trunc_div("y", k).alias("y"), trunc_div("x", k).alias("x")).agg(F.sum("v").alias("v"))
    both = pool(fine, 4).withColumnRenamed("v", "direct").join(pool(pool(fine, 2), 2), ["frame", "y", "x"], "full")
    return both.groupBy("frame").agg(F.sum("direct").alias("total"), F.sum((~F.col("direct").eqNullSafe(F.col("v"))).cast("int")).cast("int").alias("wrong"))


def _upscale_sql() -> str:
    blend = ", ".join(f"((4 - k) * p.{c} + k * coalesce(q.{c}, p.{c})) >> 2 AS {c}" for c in "lab")
    d2 = " + ".join(f"(x.{c} - y.{c}) * (x.{c} - y.{c})" for c in "lab")
    return f"""{PP}, ph AS (SELECT unnest(generate_series(0, 3)) AS k),
    mixed AS (SELECT p.frame, k, p.slot, {blend} FROM palette p CROSS JOIN ph LEFT JOIN palette q ON q.frame = p.frame + 1 AND q.slot = p.slot),
    cells AS (SELECT frame, slot, slot // 4 AS y, slot % 4 AS x FROM palette),
    cand AS (SELECT DISTINCT c.frame, c.slot AS cell, n.slot AS cand FROM cells c JOIN cells n ON n.frame = c.frame AND abs(n.y - c.y) <= 1 AND abs(n.x - c.x) <= 1),
    want AS (SELECT frame, k, slot AS cell, l + 3000 * (k - 1) AS l, a, b FROM mixed)
    SELECT x.frame::BIGINT * 4 + x.k AS t, x.cell, arg_min(c.cand, ({d2}, c.cand)) AS slot FROM want x JOIN cand c ON c.frame = x.frame AND c.cell = x.cell JOIN mixed y ON y.frame = x.frame AND y.k = x.k AND y.slot = c.cand GROUP BY ALL"""


@query("upscale_frames", _upscale_sql())
def upscale_frames(spark, d):
    """Each frame at four phases towards the next: palettes blend, and every cell takes the nearest colour among its neighbours' slots."""
    p = palette(spark, d)
    nxt = p.select((F.col("frame") - 1).alias("frame"), "slot", *[F.col(c).alias(f"n{c}") for c in "lab"])
    phases = p.join(nxt, ["frame", "slot"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    mixed = phases.select("frame", "k", "slot", *[F.shiftright((4 - F.col("k")) * F.col(c) + F.col("k") * F.coalesce(f"n{c}", c), 2).alias(c) for c in "lab"])
    y, x = trunc_div("slot", 4), F.col("slot") % 4
    near = F.array(*[F.when((y + i).between(0, 3) & (x + j).between(0, 3), (y + i) * 4 + x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    palettes = mixed.groupBy("frame", "k").agg(F.array_sort(F.collect_list(F.struct("slot", *"lab"))).alias("palette"))
    want = mixed.select("frame", "k", F.col("slot").alias("cell"), (F.col("l") + 3000 * (F.col("k") - 1)).alias("l"), "a", "b", F.array_compact(near).alias("near"))
    both = want.join(palettes, ["frame", "k"]).withColumn("pixel", F.struct("l", "a", "b"))
    able = F.filter("palette", lambda q: F.array_contains("near", q["slot"].cast("long")))
    best = F.array_min(F.transform(able, lambda q: F.struct(assign.dist2(q, F.col("pixel")).alias("d"), q["slot"].alias("slot"))))
    return both.select((F.col("frame").cast("long") * 4 + F.col("k")).alias("t"), "cell", best["slot"].alias("slot"))


@query("ladder_export", f"{PP}, g AS (SELECT p.frame, p.slot, arg_min(q.slot, ((p.l - q.l) * (p.l - q.l) + (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b), q.slot)) AS target FROM palette p JOIN palette q ON q.frame = 0 GROUP BY ALL), t AS (SELECT k, k * 10 // 4 AS frame FROM generate_series(0, 3) s(k)) SELECT k, y * 2 + x AS cell, target FROM t, generate_series(0, 1) a(y), generate_series(0, 1) b(x), g WHERE g.frame = t.frame AND g.slot = y * 2 * 4 + x * 2")
def ladder_export(spark, d):
    """A working copy at a coarser rung: every frame reindexed to one palette, four of ten frames, every second cell."""
    p = palette(spark, d)
    anchor = p.filter("frame = 0").select(F.lit(0).alias("g"), "slot", "l", "a", "b")
    g = assign.nearest(p.select(F.lit(0).alias("g"), "frame", F.col("slot").alias("own"), "l", "a", "b"), anchor, ("g",)).select("frame", F.col("own").alias("cell"), F.col("slot").alias("target"))
    times = spark.range(4).select(F.col("id").alias("k"), trunc_div(F.col("id") * 10, 4).cast("int").alias("frame"))
    y, x = trunc_div("cell", 4), F.col("cell") % 4
    return g.join(F.broadcast(times), "frame").filter((y % 2 == 0) & (x % 2 == 0)).select("k", (y + trunc_div(x, 2)).alias("cell"), "target")


@query("synthetic_octants", "WITH s AS (SELECT n_nationkey AS seed, t, y, x, ((n_nationkey * 31 + t * 7 + y * 3 + x * 5) * 2654435761) % 65536 AS v FROM nation, generate_series(0, 3) a(t), generate_series(0, 3) b(y), generate_series(0, 3) c(x)), o AS (SELECT seed, t // 2 AS t, y // 2 AS y, x // 2 AS x, list(v ORDER BY t, y, x) AS v FROM s GROUP BY ALL) SELECT seed, t, y, x, v[1] AS first, list_sum(v)::BIGINT AS total, len(v)::INTEGER AS n FROM o")
def synthetic_octants(spark, d):
    """A synthetic capture for every nation as seed, cut in octants of eight voxels."""
    v = table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<bigint>")).alias("k"))
    t, y, x = trunc_div("k", 16), trunc_div("k", 4) % 4, F.col("k") % 4
    v = v.select("seed", t.alias("t"), y.alias("y"), x.alias("x"), (((F.col("seed") * 31 + t * 7 + y * 3 + x * 5) * 2654435761) % 65536).alias("v"))
    o = v.groupBy("seed", *[trunc_div(c, 2).alias(c) for c in "tyx"]).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("t").alias("a"), F.col("y").alias("b"), F.col("x").alias("c"), "v"))), lambda s: s["v"]).alias("v"))
    return o.select("seed", "t", "y", "x", F.col("v")[0].alias("first"), F.aggregate("v", F.lit(0).cast("long"), lambda s, z: s + z).alias("total"), F.size("v").alias("n"))
