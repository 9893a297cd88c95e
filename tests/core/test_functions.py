"""Exact arithmetic, lifts, kernels, codecs and sources against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import arith, color, kernels, lift
from lumenfold.operators import games, graph, ledger, models
from lumenfold.sources import codecs, readers


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "i long, x long")
    return [r[1] for r in rows.select("i", expr).orderBy("i").collect()]


def test_divisions(spark):
    xs = list(range(-25, 26))
    assert column(spark, xs, arith.floor_div("x", 7)) == [x // 7 for x in xs]
    assert column(spark, xs, arith.trunc_div("x", 7)) == [int(x / 7) for x in xs]
    assert column(spark, xs, arith.halve("x")) == [x // 2 for x in xs]
    assert column(spark, range(50), arith.half_up_div("x", 7)) == [(x + 3) // 7 for x in range(50)]
    assert column(spark, xs, arith.unzigzag(arith.zigzag("x"))) == xs


def test_roots(spark):
    rng = random.Random(1)
    squares = [0, 1, 2, 3, 4, *[rng.randrange(1 << 50) for _ in range(200)], *[k * k + d for k in (12345, 9999999) for d in (-1, 0, 1)]]
    assert column(spark, squares, arith.isqrt("x")) == [__import__("math").isqrt(x) for x in squares]
    cubes = [0, 1, 2, 131072, *[rng.randrange(131073) for _ in range(200)]]
    for x, m in zip(cubes, column(spark, cubes, arith.icbrt_q16("x"))):
        assert m**3 <= x << 32 < (m + 1) ** 3


def test_octant_roundtrip(spark):
    rng = random.Random(2)
    rows = [(i, *[rng.randrange(-1000, 1000) for _ in range(8)]) for i in range(50)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"v{k} long" for k in range(8)))
    bands = df.select("i", *[b.alias(f"b{k}") for k, b in enumerate(lift.lift_octant([F.col(f"v{k}") for k in range(8)]))])
    back = bands.select("i", *[v.alias(f"v{k}") for k, v in enumerate(lift.unlift_octant([F.col(f"b{k}") for k in range(8)]))])
    assert sorted(map(tuple, back.collect())) == rows


def test_oklab_q16_is_near_the_float_form(spark):
    rng = random.Random(3)
    rows = [(i, *[rng.randrange(65537) for _ in range(3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, r long, g long, b long")
    exact = color.linear_to_oklab_q16("r", "g", "b")
    floats = color.linear_to_oklab(*[F.col(c) / 65536.0 for c in "rgb"])
    worst = df.select(*[F.max(F.abs(e - f * 65536)).alias(c) for c, e, f in zip("lab", exact, floats)]).first()
    assert max(worst) < 80


def test_quantize_mirror():
    rng = np.random.default_rng(4)
    px = rng.integers(-40000, 40000, (60, 3))
    c, slot = kernels.quantize(px, 5, 3)
    for i, p in enumerate(px):
        d = [sum(int(a - b) ** 2 for a, b in zip(p, q)) for q in c]
        assert slot[i] == d.index(min(d))
    with pytest.raises(kernels.Refused):
        kernels.quantize(px[:3], 4)
    filled = kernels.fill(px, c, slot, 9)
    assert np.bincount(filled, minlength=5).min() >= 9
    with pytest.raises(kernels.Refused):
        kernels.fill(px, c, slot, 13)


def test_dither_and_median_cut():
    rng = np.random.default_rng(5)
    px = rng.integers(0, 65536, (36, 3))
    c, near = kernels.quantize(px, 36)
    assert (kernels.diffuse(px, c, 6) == near).all()  # no error to carry
    assert (kernels.threshold_dither(px, c, np.full(36, 255)) == near).all()
    assert sorted(np.bincount(kernels.median_cut(px, 2))) == [9, 9, 9, 9]
    with pytest.raises(kernels.Refused):
        kernels.diffuse(px, c, 5)


def test_hashes():
    assert kernels.fnv1a64(b"") == 0xCBF29CE484222325
    assert kernels.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    assert kernels.gene_hash([1, 2], []) != kernels.gene_hash([1], [2])
    assert int(kernels.splitmix64(0, 1)[0]) == 0xE220A8397B1DCDAF


def test_sinkhorn_of_equal_measures_is_zero():
    x = np.random.default_rng(6).normal(size=(6, 3))
    w = np.full(6, 1 / 6)
    assert abs(kernels.sinkhorn_divergence(x, x, w, w, 0.1, 50)) < 1e-12
    eye = np.eye(3)
    assert abs(kernels.bures_squared([0, 0, 0], eye, [0, 0, 0], 4 * eye) - 3) < 1e-9


values = st.recursive(
    st.integers(0, 2**64 - 1) | st.binary(max_size=40) | st.text(st.characters(max_codepoint=127), max_size=30),
    lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(st.characters(max_codepoint=127), max_size=6), v, max_size=4),
    max_leaves=12,
)


@given(values)
@settings(max_examples=150, deadline=None)
def test_cbor_roundtrip(value):
    assert codecs.cbor_decode(codecs.cbor_encode(value)) == value


def test_cbor_refusals():
    for bad in (b"", b"\x01\x01", b"\x20", b"\x42a", b"\xf6", b"\x82\x01", b"\x18\x05", b"\x19\x00\xff", b"\x61\xff", b"\xa1\x80\x01"):
        with pytest.raises(codecs.BadFormat):
            codecs.cbor_decode(bad)
    with pytest.raises(codecs.BadFormat):
        codecs.read_record(codecs.cbor_encode({"win": 1}))
    rec = {"v": 2, "win": 320, "ev": [(10, 20, -3), (1, 2, 4)]}
    assert codecs.read_record(codecs.write_record(rec)) == rec


@given(st.lists(st.integers(0, 15), min_size=1, max_size=600), st.integers(4, 8))
@settings(max_examples=60, deadline=None)
def test_lzw_roundtrip(indices, bits):
    assert codecs.lzw_unpack(codecs.lzw_pack(indices, bits), bits, len(indices)) == indices


def test_gif_roundtrip_and_carrier():
    rng = random.Random(7)
    side = 64
    palette = [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(256)]
    frames = [(palette, [rng.randrange(256) for _ in range(side * side)]) for _ in range(3)]
    carrier = codecs.wrap_carrier(b"payload" * 100)
    data = codecs.write_gif(side, frames, 5, "a comment", carrier)
    w, h, got = codecs.read_gif(data)
    assert (w, h) == (side, side) and [(p, i) for p, i, _ in got] == [(palette, i) for _, i in frames] and got[0][2] == 5
    assert codecs.extract_carrier(data) == ("ok", b"payload" * 100)
    assert codecs.extract_carrier(data.replace(b"payload", b"pAyload"))[0] == "corrupt"
    assert codecs.extract_carrier(b"GIF89a")[0] == "no_block"
    with pytest.raises(codecs.BadFormat):
        codecs.read_gif(data[:100])


def test_readers(spark, tmp_path):
    import io

    folder = tmp_path / "corpus"
    folder.mkdir()
    volume = np.arange(2 * 4 * 4 * 3, dtype=np.int32).reshape(2, 4, 4, 3)
    buffer = io.BytesIO()
    np.save(buffer, volume)
    (folder / "one.volume.npy").write_bytes(buffer.getvalue())
    (folder / "one.s4cr").write_bytes(codecs.write_record({"v": 1, "win": 320, "d0": 3, "weave": [1, 2], "dtus": [50000], "s16": [5], "ev": [(1, 2, -3)]}))
    (folder / "bad.s4cr").write_bytes(b"\xff")
    palette = [(0, 0, 0), (255, 255, 255)]
    (folder / "one.gif").write_bytes(codecs.write_gif(4, [(palette, [0, 1] * 8)], 5))
    voxels = readers.read_volumes(spark, str(folder))
    assert voxels.count() == 32 and voxels.agg(F.sum("l")).first()[0] == int(volume[..., 0].sum())
    records = {r["stem"]: r for r in readers.read_records(spark, str(folder), strict=False).collect()}
    assert records["one"]["ev"][0]["ev_cs"] == -3 and records["bad"]["error"]
    pixels = readers.gif_pixels(readers.read_gifs(spark, str(folder)))
    assert sorted(r["slot"] for r in pixels.collect()) == [0] * 8 + [1] * 8
    readers.write_manifest(spark, str(folder), {"one": ["one.volume.npy", "one.gif"]})
    assert [(r["stem"], r["has_volume"], r["has_record"]) for r in readers.read_corpus(spark, str(folder)).collect()] == [("one", True, False)]
    frames = spark.createDataFrame([("c", 0, [[0, 0, 0], [9, 9, 9]], [0, 1, 1, 0])], "capture string, t int, palette array<array<int>>, indices array<int>")
    assert codecs.read_gif(bytes(readers.assemble_gifs(frames, 2, 5).first()["gif"]))[2][0][1] == [0, 1, 1, 0]


def test_store(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    rows = spark.createDataFrame([("b", 9), ("c", 3), ("c", 3)], "id string, v int")
    assert sorted(map(tuple, readers.upsert(store, rows.distinct(), "id").collect())) == [("a", 1), ("b", 9), ("c", 3)]
    once = readers.publish(store, rows, "id")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2), ("c", 3)]
    assert ledger.same_rows(readers.publish(once, rows, "id"), once)


def test_graph_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4)], "child long, parent long")
    got = {tuple(r) for r in graph.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 4)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    label = {r["node"]: r["label"] for r in graph.components(chain).collect()}
    assert set(label.values()) == {0, 100} and label[40] == 0


def test_closure_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(21)] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(35)] + [(200, 200)]
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    while True:
        more = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        if more == reach:
            break
        reach = more
    got = [tuple(r) for r in graph.closure(spark.createDataFrame(pairs, "child long, parent long")).collect()]
    assert sorted(got) == sorted((a, b) for a, bs in reach.items() for b in bs)
    assert graph.closure(spark.createDataFrame([], "child long, parent long")).count() == 0


def test_board_keeps_its_ledger():
    rng = random.Random(8)
    b, poured = games.Board(), 0
    for _ in range(400):
        kind = rng.choice(["pour", "split", "split", "split", "merge", "keep"])
        refused = b.play(kind, rng.randrange(18))
        poured += games.POUR * (kind == "pour" and refused is None)
        assert b.signal + b.spent == poured and all(0 <= d <= games.FINEST for d in b.depth) and b.pours <= games.POURS
    fresh = games.Board()
    assert fresh.play("merge", 0) == "already coarsest" and fresh.play("split", 0) == "no signal" and fresh.play("split", 16) == "off board"
    fresh.play("pour")
    assert fresh.play("split", 0) is None and fresh.play("split", 0) == "phase locked"


def test_loom_folds():
    assert games.fold_loom(4, [(0, 1)]) == [2, 3, (0, 1)]
    assert games.fold_loom(4, [(0, 1), (2, 0), (9, 0), (0, 0)]) == [3, (2, (0, 1))]


def test_measures():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(3, 3))
    cov = a @ a.T + np.eye(3)
    assert np.allclose(models.gaussian_barycenter([cov, cov]), cov)
    assert np.allclose(models.gaussian_barycenter([np.eye(3), 9 * np.eye(3)]), 4 * np.eye(3))
    palette, wanted = rng.integers(0, 99, (5, 3)), rng.integers(0, 99, (3, 3))
    got = models.anchors(palette, wanted)
    assert all((got == w).all(1).any() for w in wanted)


def test_linear_fit_finds_the_line(spark):
    rows = spark.createDataFrame([(0, float(x), 3.0 - 2.0 * x) for x in range(20)], "g int, x double, y double")
    r = models.linear_fit(rows, ["g"], ["x"], "y", ridge=0.0).first()
    assert np.allclose(r["weights"], [3, -2]) and r["loss"] < 1e-9


def test_dither_every_pixel(spark):
    from lumenfold.operators import frames

    rng = np.random.default_rng(3)
    rows = [(f, i, *map(int, rng.integers(-60000, 60000, 3))) for f, n in ((0, 50), (1, 20)) for i in range(n)]
    pixels = spark.createDataFrame(rows, "frame int, idx long, l long, a long, b long")
    for mode in ("floyd-steinberg", "atkinson", "threshold"):
        got = frames.dither_frames(pixels, 8, 6, mode).collect()
        assert sorted((r["frame"], r["idx"]) for r in got) == [r[:2] for r in rows]
        assert len({r["slot"] for r in got if r["idx"] >= 36}) > 1


def test_two_nn_reads_the_whole_group(spark):
    from lumenfold.operators import frames

    rng = np.random.default_rng(4)
    line, cloud = np.zeros((1000, 5)), rng.normal(size=(3000, 5))
    line[:, 0] = rng.normal(size=1000)
    x = np.concatenate([line, cloud])  # the first 1,000 points have dimension one
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "label int, vec_id long, v array<double>")
    y = x[::4]
    d = np.sort(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), 1)[:, 1:3]
    want = len(y) / np.log(d[:, 1] / d[:, 0]).sum()
    assert abs(frames.two_nn_dimension(df, ["label"], "vec_id", "v").first()["dimension"] - want) < 1e-6
