"""Laws of generators and fits, and brute-force forms of what has no SQL."""

import hashlib
import itertools
import time
import zlib

import numpy as np
import pytest

from lumenfold.functions import kernels, signatures
from lumenfold.operators import frames, sequence
from lumenfold.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_variance_boxes():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 3, (60, 3)), rng.integers(5, 8, (40, 3))])
    grid = np.zeros((8, 8, 8, 5))
    for p in x:
        grid[tuple(p)] += [1, *p, (p * p).sum()]
    boxes = kernels.variance_boxes(grid, 5)
    inside = lambda b: np.all([(x[:, i] >= b[i][0]) & (x[:, i] < b[i][1]) for i in range(3)], 0)
    assert len(boxes) == 5 and sum(inside(b).sum() for b in boxes) == 100
    spread = lambda p: float(((p - p.mean(0)) ** 2).sum()) if len(p) else 0.0
    first = kernels.variance_boxes(grid, 2)
    best = min(spread(x[x[:, a] < c]) + spread(x[x[:, a] >= c]) for a, c in itertools.product(range(3), range(1, 8)))
    assert sum(spread(x[inside(b)]) for b in first) == pytest.approx(best)


def test_variance_quantize_counts_every_pixel(spark):
    got = QUERIES["variance_quantize"](spark, DATA).groupBy("frame").sum("n").collect()
    want = {r["label"]: r["count"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").groupBy("label").count().collect()}
    assert {r["frame"]: r["sum(n)"] for r in got} == want


def test_populations_reach_their_entropy():
    for target in (0.5, 1.2, 2.2):
        n = kernels.populations(4096, 2, 16, target)
        assert n.sum() == 4096 and n.min() >= 2 and abs(kernels.entropy_of(n) - target) < 0.02
    with pytest.raises(kernels.Refused):
        kernels.populations(10, 2, 16, 1.0)


def test_scenes_are_reproducible_and_differ():
    made = {k: kernels.scene(3, k, 4, 8) for k in ("gradient", "blob", "edge", "waves", "mixed")}
    assert all(v.shape == (4, 64, 3) and (kernels.scene(3, k, 4, 8) == v).all() for k, v in made.items())
    assert len({v.tobytes() for v in made.values()}) == 5
    assert (made["mixed"] == np.rint(np.mean([kernels.scene(21 + i + 1, k, 4, 8) for i, k in enumerate(("gradient", "blob", "edge", "waves"))], 0))).all()
    with pytest.raises(kernels.Refused):
        kernels.scene(1, "unknown", 2, 4)


def test_tiles_do_not_depend_on_each_other(spark):
    got = {(r["tile"], r["t"]): r["total"] for r in QUERIES["tile_stream"](spark, DATA).collect()}
    assert len(got) == 800 and all(got[n, t] == kernels.tile_slice(5, n, 4, 16)[t].sum() for n in (0, 100, 199) for t in range(4))


def test_tiles_are_made_many_at_once():
    """The vectorised kernel equals the plain loop, edge by edge, at a cost far under a millisecond a tile."""

    def plain(seed, tile, frames, side):
        edge = lambda *at: int(kernels.splitmix64(seed ^ (kernels.hash_words(at) & 0xFFFFFFFF), 1)[0] & np.uint64(1))
        size, out = side // 4, np.zeros((frames, side, side), np.int64)
        for by, bx in itertools.product(range(4), range(4)):
            n = edge(tile, by, bx, 0) + 2 * edge(tile, by, bx, 1) + 4 * edge(tile, (by + 1) % 4, bx, 0) + 8 * edge(tile, by, (bx + 1) % 4, 1)
            grain = (kernels.splitmix64(seed + n, frames * size * size) >> np.uint64(56)).astype(np.int64).reshape(frames, size, size)
            out[:, by * size : (by + 1) * size, bx * size : (bx + 1) * size] = grain + n * 256
        return out

    tiles = np.array([0, 1, 7, 255, 256, 1_200_000, 2**40 + 3, -5, 2**63 - 1])
    for seed, frames, side in ((5, 4, 16), (9, 2, 8)):
        assert (kernels.tile_slices(seed, tiles, frames, side) == np.stack([plain(seed, int(n), frames, side) for n in tiles])).all()
    began = time.process_time()
    for at in range(0, 20_000, 500):
        kernels.tile_slices(5, np.arange(at, at + 500), 4, 16)
    assert time.process_time() - began < 4


def test_transport_plan_and_barycenter():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(5, 3)), rng.normal(size=(7, 3))
    p, q = np.full(5, 0.2), np.full(7, 1 / 7)
    plan = kernels.sinkhorn_plan(x, y, p, q, 0.1, 500)
    assert plan.sum(0) == pytest.approx(q, abs=1e-6) and plan.sum(1) == pytest.approx(p, abs=1e-3)
    z = kernels.free_barycenter([(y, np.ones(7)), (y, np.zeros(7))], x, 0.05, 200, 2)
    assert (z >= y.min(0) - 1e-9).all() and (z <= y.max(0) + 1e-9).all()
    assert (kernels.free_barycenter([(y, np.zeros(7))], x, 0.05, 10, 3) == x).all()


def test_cyclic_descriptor_is_invariant():
    rng = np.random.default_rng(2)
    loop = [(rng.normal(size=(4, 3)), rng.uniform(1, 2, 4)) for _ in range(6)]
    want = kernels.cyclic_descriptor(loop)
    turned = kernels.cyclic_descriptor(loop[2:] + loop[:2])
    order = [rng.permutation(4) for _ in loop]
    shuffled = kernels.cyclic_descriptor([(x[o], w[o]) for (x, w), o in zip(loop, order)])
    assert len(want) == 16 and want == pytest.approx(turned, abs=1e-6) and want == pytest.approx(shuffled, abs=1e-6)


def test_detail_head_learns_a_line(spark):
    x = np.linspace(-1, 1, 50)
    theta, loss, floor = kernels.detail_head(x, np.stack([k + x * k for k in range(7)], 1), steps=2000, rate=0.2)
    assert loss < 1e-3 * floor and theta[:, :2] == pytest.approx(np.repeat(np.arange(7.0)[:, None], 2, 1), abs=0.05)
    assert all(r["loss"] <= r["floor"] and r["kept"] for r in QUERIES["detail_head"](spark, DATA).collect())


def test_users_are_clustered(spark):
    right = 0
    got = QUERIES["user_clusters"](spark, DATA).collect()
    for seed in {r["seed"] for r in got}:
        own = [(r["taste"], r["cluster"]) for r in got if r["seed"] == seed]
        right += max(sum(p[t] == c for t, c in own) for p in itertools.permutations(range(3)))
    assert right >= 0.9 * len(got)


def test_carrier_checks(spark):
    urls = {r["page_id"]: (r["url"] or "").encode() for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["carrier_checks"](spark, DATA).collect():
        assert r["crc"] == zlib.crc32(urls[r["page_id"]]) and r["sha512"] == hashlib.sha512(urls[r["page_id"]]).hexdigest()


def test_box_histogram_refusals(spark):
    v = spark.createDataFrame([(0, 0, 0, 0, 9)], "t long, y long, x long, ch long, v int")
    with pytest.raises(ValueError):
        sequence.box_histogram(v, 8, 8, 8, 3, 4, 4, 32)
    with pytest.raises(Exception):
        sequence.box_histogram(v, 8, 8, 8, 2, 4, 4, 8).collect()
    assert frames.per_group(v, "t", "t long, n int", lambda k, pdf: [(k, len(pdf))]).first()["n"] == 1


def test_anchored_palettes(spark):
    rows = QUERIES["anchored_palettes"](spark, DATA).collect()
    wanted = {(0, 0, 0), (30_000, 1000, -1000), (60_000, -5000, 5000)}
    for frame in {r["frame"] for r in rows}:
        own = [(r["l"], r["a"], r["b"]) for r in rows if r["frame"] == frame]
        assert wanted <= set(own) and len(own) == 16


def test_signatures():
    """The first two test vectors of RFC 8032, and refusals."""
    vectors = (
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "",
         "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72",
         "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    )
    for key, public, message, made in (map(bytes.fromhex, v) for v in vectors):
        assert signatures.public_key(key) == public and signatures.sign(key, message) == made and signatures.verify(public, message, made)
        assert not signatures.verify(public, message + b"x", made) and not signatures.verify(public, message, made[:-1]) and not signatures.verify(bytes(32), message, made[:32] + b"\xff" * 32)


def test_psd_metric():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 3))
    p, n = a + rng.normal(size=(200, 3)) * [2, 0.1, 0.1], a + rng.normal(size=(200, 3)) * [2, 1, 1]
    low, loss = kernels.psd_metric(a, p, n)
    plain = np.maximum(0, ((a - p) ** 2).sum(1) - ((a - n) ** 2).sum(1) + 0.1).mean()
    assert (np.triu(low, 1) == 0).all() and loss < 0.5 * plain and abs(low[0, 0]) < abs(low[1, 1])


def test_blue_noise():
    mask = kernels.blue_noise(16)
    assert sorted(mask.ravel().tolist()) == list(range(256)) and (mask == kernels.blue_noise(16)).all()
    spectrum = np.abs(np.fft.fft2(mask - mask.mean())) ** 2
    f = np.minimum(np.arange(16), 16 - np.arange(16))
    low = f[:, None] ** 2 + f[None, :] ** 2 <= 9
    assert spectrum[low].mean() < 0.2 * spectrum[~low].mean()


def test_synthetic_burst_is_stateless(spark):
    whole = {(r["t"], r["y"], r["x"]): r["v"] for r in frames.synthetic_burst(spark, 7, 3, 8, 1).collect()}
    assert len(whole) == 192 and whole == {(r["t"], r["y"], r["x"]): r["v"] for r in frames.synthetic_burst(spark, 7, 3, 8, 5).collect()}
    z = (int(kernels.splitmix64(7, 1)[0]) ^ (100 * 0x9E3779B97F4A7C15)) % 2**64
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    assert whole[1, 4, 4] == abs(8 % 256 - 128) + 8 + (z >> 58)
