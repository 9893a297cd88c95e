"""Palettes, transport, ownership and meta-initialisation by rounds over tables, against kernels and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import color, kernels
from lumenfold.functions.kernels import Refused
from lumenfold.operators import assign, bursts, clusters, evolution, meta, pools, transport, volume
from lumenfold.operators.frames import quantize_frames
from lumenfold.sources import codecs


def frame_rows(rng, frame, n, spread=3000):
    return [(frame, i, *map(int, rng.integers(-spread, spread, 3))) for i in range(n)]


@pytest.mark.parametrize("k,lloyd", [(1, 0), (7, 2), (20, 1)])
def test_quantize_large_equals_the_kernel(spark, k, lloyd):
    rng = np.random.default_rng(k)
    rows = frame_rows(rng, 0, 300) + frame_rows(rng, 1, 5) + frame_rows(rng, 2, 40, 3) + [(3, i, 7, 7, 7) for i in range(30)]
    px = spark.createDataFrame(rows, "frame long, idx long, l long, a long, b long").repartition(5)
    key = lambda df: sorted((r["frame"], r["idx"], r["slot"], r["cl"], r["ca"], r["cb"]) for r in df.collect())
    assert key(clusters.quantize_large(px, k, lloyd)) == key(quantize_frames(px, k, lloyd))


def test_quantize_one_large_frame(spark):
    """All rows in one frame: no task holds more than its share of it, and shuffles carry a row a task and frame."""
    px = spark.range(0, 60_000, 1, 8).select(F.lit(0).alias("frame"), F.col("id").alias("idx"), *[(F.xxhash64("id", F.lit(c)) % 20_000).alias(c) for c in "lab"])
    got = clusters.quantize_large(px, 4, 1).orderBy("idx").toPandas()
    c, slot = kernels.quantize(px.orderBy("idx").toPandas()[["l", "a", "b"]].to_numpy(), 4, 1)
    assert (got["slot"].to_numpy() == slot).all() and (got[["cl", "ca", "cb"]].to_numpy() == c[slot]).all()


def test_quantize_large_edges(spark):
    px = spark.createDataFrame([], "frame long, idx long, l long, a long, b long")
    assert clusters.quantize_large(px, 3).count() == 0
    for k in (0, 257):
        with pytest.raises(Refused):
            clusters.quantize_large(px, k)


def test_transport_plan_equals_the_kernel(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for pair, (n, m) in enumerate([(4, 6), (1, 3), (12, 5)]):
        x, y, p, q = rng.random((n, 2)), rng.random((m, 2)), rng.random(n) + 0.1, rng.random(m) + 0.1
        rows += [(pair, 0, i, x[i].tolist(), float(p[i])) for i in range(n)] + [(pair, 1, j, y[j].tolist(), float(q[j])) for j in range(m)]
        want[pair] = kernels.sinkhorn_plan(x, y, p / p.sum(), q / q.sum(), 0.1, 60), p / p.sum(), q / q.sum()
    rows += [(0, 0, 99, [0.0, 0.0], 0.0), (7, 0, 0, [1.0, 1.0], 1.0)]  # no weight; no other side
    got = transport.transport_plan(spark.createDataFrame(rows, "pair long, side int, i long, x array<double>, w double"), 0.1, 60).collect()
    for pair, (plan, p, q) in want.items():
        own = np.zeros(plan.shape)
        for r in got:
            if r["pair"] == pair:
                own[r["i"], r["j"]] = r["mass"]
        assert np.allclose(own, plan, atol=1e-9) and np.allclose(own.sum(0), q, atol=1e-9) and np.allclose(own.sum(1), p, atol=1e-3)
    assert {r["pair"] for r in got} == set(want) and len(got) == 24 + 3 + 60


def brute_adapted(pairs, start, steps, eta):
    out, losses = [], []
    for x, y in pairs:
        w = np.array(start, float)
        for _ in range(steps):
            w = w - eta * x.T @ (x @ w - y) / len(y)
        out.append(w)
        losses.append(((x @ w - y) ** 2).mean())
    return np.mean(out, 0), float(np.mean(losses))


def test_meta_start(spark):
    rng = np.random.default_rng(2)
    truth = np.array([0.4, -0.8, 0.6])
    pairs = []
    for c in range(24):
        x = np.stack([np.ones(30), rng.random(30), rng.random(30)], 1)
        pairs.append((x, x @ (truth + rng.normal(0, 0.05, 3)) + rng.normal(0, 0.01, 30)))
    rows = [(c, float(r[1]), float(r[2]), float(v)) for c, (x, y) in enumerate(pairs) for r, v in zip(x, y)] + [(0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "c long, u double, v double, y double").repartition(4)
    stats = meta.sufficient(df, "c", [F.lit(1.0), F.col("u"), F.col("v")], F.col("y")).cache()
    train, held = stats.filter("capture < 16"), stats.filter("capture >= 16")
    start = meta.reptile(train, 3, outer=40, inner=5, eta=0.3, epsilon=0.4)
    want = np.zeros(3)
    for _ in range(40):
        want += 0.4 * (brute_adapted(pairs[:16], want, 5, 0.3)[0] - want)
    assert np.allclose(start, want)
    ours, zero = (meta.adapted_loss(held, w, 5, 0.3) for w in (start, np.zeros(3)))
    assert np.isclose(ours, brute_adapted(pairs[16:], start, 5, 0.3)[1]) and np.isclose(zero, brute_adapted(pairs[16:], np.zeros(3), 5, 0.3)[1])
    assert ours < 0.5 * zero
    assert (meta.reptile(stats.filter("false"), 3, 4, 5, 0.3, 0.4) == 0).all()


def test_evolution_raises_coverage_and_repeats(spark):
    rng = np.random.default_rng(9)
    centres = rng.uniform(-1, 1, (4, 3))
    pts = np.concatenate([c + rng.normal(0, 0.1, (50, 3)) for c in centres])
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "l double, a double, b double")
    args = dict(k=4, radius=0.5, generations=12, sigma=0.25, seed=3)
    genes, story = evolution.evolve(df.repartition(3), **args)
    again = evolution.evolve(df.repartition(5), **args)
    assert (genes, story) == again and all(b >= a for a, b in zip(story, story[1:])) and story[-1] > story[0] + 0.2
    own = np.array(genes).reshape(-1, 3)
    assert abs((((pts[:, None] - own[None]) ** 2).sum(2).min(1) <= 0.25).mean() - story[-1]) < 1e-9
    assert evolution.evolve(df.limit(0), 2, 0.1, 1)[1] == [0.0, 0.0]
    with pytest.raises(Refused):
        evolution.evolve(df, 2, 0.1, 1, members=2, parents=3)
    drawn = spark.range(4000).select(evolution.normal(5, F.col("id")).alias("z")).toPandas()["z"]
    assert abs(drawn.mean()) < 0.06 and abs(drawn.std() - 1) < 0.05


# pictures


def burst_pixels(spark, rng, captures=2, frames=3, side=8):
    return spark.createDataFrame([(c, t, i, int(rng.integers(5_000, 60_000)), *map(int, rng.integers(-9_000, 9_000, 2))) for c in range(captures) for t in range(frames) for i in range(side * side)], "capture long, t int, idx long, l long, a long, b long")


@pytest.mark.parametrize("dither", bursts.DITHERS)
def test_burst_to_picture(spark, dither):
    rng = np.random.default_rng(12)
    px = burst_pixels(spark, rng)
    gifs = {r["capture"]: bytes(r["gif"]) for r in bursts.encode_bursts(px.repartition(3), 8, 6, 7, dither).collect()}
    rows = px.orderBy("capture", "t", "idx").collect()
    for c in range(2):
        w, h, frames = codecs.read_gif(gifs[c])
        assert (w, h, len(frames)) == (8, 8, 3) and all(delay == 7 for *_, delay in frames)
        for t, (palette, indices, _) in enumerate(frames):
            points = np.array([[r["l"], r["a"], r["b"]] for r in rows if (r["capture"], r["t"]) == (c, t)])
            colours, slot = kernels.quantize(points, 6)
            if dither == "none":
                assert list(indices) == slot.tolist()
            else:
                assert len(set(indices)) > 1 and max(indices) < 6
            want = spark.createDataFrame([tuple(map(int, v)) for v in colours], "l long, a long, b long").select(*color.oklab_q16_to_srgb8(F.col("l"), F.col("a"), F.col("b"))).collect()
            assert [list(p) for p in palette[:6]] == [list(v) for v in want]


def test_bursts_that_are_refused(spark):
    px = burst_pixels(spark, np.random.default_rng(1), 1, 1, 4)
    with pytest.raises(Exception, match="not a whole frame: 0/0"):
        bursts.encode_bursts(px.filter("idx <> 5"), 4, 3, 5).collect()
    for bad in (dict(side=4, k=0), dict(side=4, k=17), dict(side=0, k=1), dict(side=4, k=2, dither="noise"), dict(side=4, k=2, large=True, least=1)):
        with pytest.raises(Refused):
            bursts.encode_bursts(px, delay_cs=5, **bad)
    plain, large = (bytes(bursts.encode_bursts(px, 4, 3, 5, large=v).first()["gif"]) for v in (False, True))
    assert plain == large
    assert bursts.encode_bursts(px.limit(0), 4, 3, 5).count() == 0


def test_loops_and_tokens_of_literal_pictures(spark):
    """Pictures whose bytes are written down here: 4 x 4 with two colours, and 2 x 2."""
    head = lambda side: b"GIF89a" + bytes([side, 0, side, 0, 0x80, 0, 0, 255, 0, 0, 0, 0, 255])  # red, blue
    # two-bit codes after a clear code: literals of three bits until the table grows; written by hand for 2 x 2
    small = head(2) + b",\x00\x00\x00\x00\x02\x00\x02\x00\x00" + bytes([2, 3, 0x44, 0x02, 0x05, 0]) + b";"
    w, h, frames = codecs.read_gif(small)
    assert (w, h) == (2, 2) and len(frames) == 1
    indices = list(frames[0][1])
    four = codecs.write_gif(4, [([[10, 20, 30], [200, 100, 50]], [(y * 4 + x) // 4 % 2 for y in range(4) for x in range(4)])] * 2, 3)
    df = spark.createDataFrame([("small", small), ("four", four)], "stem string, content binary")
    loops, outcomes = bursts.ingest_loops(df, 4, 2)
    assert {tuple(r) for r in outcomes.collect()} == {("small", "kept"), ("four", "decimated")}
    got = sorted(tuple(r) for r in loops.collect())
    assert [v for v in got if v[0] == "small"] == [("small", 0, i // 2, i % 2, indices[i]) for i in range(4)]
    assert [v for v in got if v[0] == "four"] == [("four", t, y, x, 0) for t in range(2) for y in range(2) for x in range(2)]
    colours = len(codecs.read_gif(four)[2][0][0])
    loops, outcomes = bursts.ingest_loops(df, 4, 2, colours + 1)
    assert {tuple(r) for r in outcomes.collect()} == {("small", "wrong_side"), ("four", "wrong_colours")} and loops.count() == 0
    tokens = bursts.picture_tokens(df).collect()
    for stem, n in (("small", 4), ("four", 32)):
        own = [r for r in tokens if r["stem"] == stem]
        assert abs(sum(r["weight"] for r in own) - 1) < 1e-12
    red = next(r for r in tokens if r["stem"] == "small" and r["slot"] == 0)
    assert abs(red["m_l"] - 0.62796) < 2e-3 and red["weight"] == indices.count(0) / 4


def test_policy_apply(spark):
    now = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "idx int, slot int")
    delta = spark.createDataFrame([(1, 6, 9)], "idx int, old int, new int")
    assert sorted(tuple(r) for r in assign.policy_apply(now, delta, ["idx"]).collect()) == [(0, 5), (1, 9), (2, 7)]


# exact inverses, reversible cubes, the descriptor's definition


def test_light_to_codes_undoes_codes_to_light(spark):
    both = spark.range(256).select(F.col("id"), pools.linear16_to_srgb8(pools.srgb8_to_linear16(F.col("id"))).alias("back"))
    assert both.filter("id <> back").count() == 0
    light = lambda v: (v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4)
    edges = np.array([0] + [int(np.floor(light(v - 0.5) * 65535 + 0.5)) for v in range(1, 256)])
    got = [r[0] for r in spark.range(65536).orderBy("id").select(pools.linear16_to_srgb8(F.col("id"))).collect()]
    assert got == (np.searchsorted(edges, np.arange(65536), "right") - 1).tolist()


@pytest.mark.parametrize("frames", [8, 9, 3])
def test_cubes_come_back(spark, frames):
    rng = np.random.default_rng(frames)
    cube = rng.integers(-500, 500, (frames, 8, 8))
    rows = [(t, y, x, int(cube[t, y, x])) for t in range(frames) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "t long, y long, x long, v long").repartition(3)
    parts = volume.voxel_reduce(df, 2)
    pairs = lambda n: n // 2 + n % 2  # an odd frame is carried
    assert parts[0].count() == 4 * pairs(pairs(frames))
    assert sorted(tuple(r) for r in volume.voxel_expand(*parts, 2).select("t", "y", "x", "v").collect()) == sorted(rows)


def test_descriptor_by_its_definition():
    rng = np.random.default_rng(6)
    loop = [(rng.random((4, 3)), rng.random(4) + 0.1) for _ in range(5)]
    x, y, p, q = loop[0][0], loop[1][0], loop[0][1] / loop[0][1].sum(), loop[1][1] / loop[1][1].sum()
    plan = kernels.scaled_plan(x, y, p, q, 0.05, 200)
    assert np.allclose(plan.sum(1), p) and np.allclose(plan.sum(0), q, atol=1e-6) and np.allclose(plan, kernels.sinkhorn_plan(x, y, p, q, 0.05, 400), atol=1e-6)
    far = kernels.scaled_plan(np.zeros((1, 3)), np.full((1, 3), 1e3), np.ones(1), np.ones(1), 0.05, 3)
    assert (far == 0).all()  # out of the kernel's reach
    whole = kernels.cyclic_descriptor(loop)
    turned = kernels.cyclic_descriptor(loop[2:] + loop[:2])
    mixed = kernels.cyclic_descriptor([(a[::-1], w[::-1]) for a, w in loop])
    assert np.allclose(whole, turned, atol=1e-6) and np.allclose(whole, mixed, atol=1e-6)
    flat = kernels.cyclic_descriptor([(np.zeros((4, 3)), np.ones(4))] * 3)
    assert np.isclose(flat[2], 0.5 * np.log((2 * np.pi * np.e) ** 3 * 1e-12)) and np.isclose(flat[0], np.log(4))
