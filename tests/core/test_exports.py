"""Data sources with a guard, an end and two phases; adoption; replayed mints; encoded pools; captures with timers."""

import hashlib
import json
import os
import shutil
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.kernels import Refused
from lumenfold.operators import exchange, mints, pools
from lumenfold.sources import artifacts
from lumenfold.sources.artifacts import ArtifactSource, committed_parts, export, listing
from lumenfold.sources.frames import FormatChanged, Frames, FrameSource, run_until
from lumenfold.streaming import captures

# frames


def put(folder, name, rows, side=64, extra=None, group=10):
    os.makedirs(folder, exist_ok=True)
    long = lambda x: pa.array(x, pa.int64())
    data = {"ts": long(range(len(rows))), "side": long([side] * len(rows) if isinstance(side, int) else side), "v": long(rows), **(extra or {})}
    pq.write_table(pa.table(data), f"{folder}/{name}.parquet", row_group_size=group)


def start(spark, path, out, **options):
    spark.dataSource.register(FrameSource)
    frames = spark.readStream.format("frames").option("path", path).options(**options).load()
    return frames.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").start()


def rows_at(spark, out):
    return sorted((r["frame"], r["v"]) for r in spark.read.parquet(f"{out}/rows").collect())


def test_frames_end_at_their_target(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(path, "a", list(range(40)))
    query = start(spark, path, out, target="64", guard="side")
    late = threading.Timer(1.5, lambda: (put(path, "b", list(range(40, 100))), put(path, "c", [0] * 5, side=32)))
    late.start()
    assert run_until(query, 64) == 64 and not query.isActive
    assert rows_at(spark, out) == [(i, i) for i in range(64)]  # neither more frames nor the other format after them


def test_frames_abort_at_another_format(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(path, "a", list(range(25)))
    put(path, "b", list(range(25, 50)), side=[64] * 12 + [32] + [64] * 12)
    with pytest.raises(Exception, match="FormatChanged.*frame 37.*side is 32, was 64"):
        run_until(start(spark, path, out, guard="side"))
    assert rows_at(spark, out) == [(i, i) for i in range(37)]
    with pytest.raises(Exception, match="FormatChanged"):  # and again after a restart, with nothing written twice
        run_until(start(spark, path, out, guard="side"), target=50)
    assert rows_at(spark, out) == [(i, i) for i in range(37)]
    with pytest.raises(Exception, match="FormatChanged"):  # as a batch nothing is read
        spark.read.format("frames").option("path", path).option("guard", "side").load().collect()
    assert spark.read.format("frames").option("path", path).option("guard", "side").option("target", 30).load().count() == 30


def test_frames_abort_at_other_columns(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(path, "a", list(range(5)))
    put(path, "b", list(range(5)), extra={"more": [1] * 5})
    with pytest.raises(Exception, match="FormatChanged.*frame 5"):
        run_until(start(spark, path, out))
    assert len(rows_at(spark, out)) == 5


def test_frames_go_on_after_a_restart(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    put(path, "a", list(range(33)))
    assert run_until(start(spark, path, out)) == 33
    put(path, "b", list(range(33, 60)))
    assert run_until(start(spark, path, out)) == 60
    assert rows_at(spark, out) == [(i, i) for i in range(60)]


def test_frame_spans_cover_each_frame_once(tmp_path):
    path = str(tmp_path / "in")
    put(path, "a", list(range(37)), group=7)
    put(path, "b", list(range(1)), group=7)
    put(path, "c", [], group=7)
    put(path, "d", list(range(20)), group=7)
    frames = Frames({"path": path})
    assert frames.refresh() == 58 and frames.refresh() == 58
    for a, b in ((0, 58), (3, 3), (5, 6), (6, 40), (36, 39)):
        spans = frames.spans(a, b)
        assert [k for s in spans for k in range(s.frame, s.frame + s.take)] == list(range(a, b))
    assert Frames({"path": str(tmp_path / "nowhere")}).refresh() == 0
    with pytest.raises(ValueError):
        Frames({"path": path, "guard": "absent"}).refresh()
    assert issubclass(FormatChanged, ValueError)


# artifacts


def files_of(spark, path):
    return sorted((r["stem"], r["suffix"], bytes(r["content"]), r["bytes"], r["sha256"]) for r in listing(spark, path, contents=True).collect())


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def some(spark, n=20, suffix=".txt"):
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("stem"), F.lit(suffix).alias("suffix"), F.repeat(F.lit("é"), F.col("id").cast("int")).cast("binary").alias("content"))


def test_export_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    assert listing(spark, path).count() == 0
    assert export(some(spark).repartition(3), path) == 20
    want = sorted((f"s{i}", ".txt", b"\xc3\xa9" * i, 2 * i, hashlib.sha256(b"\xc3\xa9" * i).hexdigest()) for i in range(20))
    assert files_of(spark, path) == want
    before = tree(path)
    assert export(some(spark), path) == 0 and tree(path) == before
    # another content under a name that is there, repeated rows, and one new name
    more = some(spark, 3).withColumn("content", F.lit(b"other")).union(some(spark, 3, ".bin")).union(some(spark, 3, ".bin"))
    assert export(more, path) == 3
    assert [f for f in files_of(spark, path) if f[1] == ".txt"] == want and len(os.listdir(f"{path}/manifests")) == 2
    assert not os.path.exists(f"{path}/_staging") or not os.listdir(f"{path}/_staging")


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert export(some(spark, 4), path) == 4
    before = tree(path)
    bad = some(spark, 30, ".bin").repartition(3).withColumn("stem", F.when(F.col("stem") == "s17", "up/and/out").otherwise(F.col("stem")))
    spark.dataSource.register(ArtifactSource)
    with pytest.raises(Exception, match="BadName"):
        bad.write.format("artifacts").option("path", path).mode("append").save()
    assert tree(path) == before and len(files_of(spark, path)) == 4
    for name in (None, "", ".x", "_x", "a/b", "a\x00b"):
        with pytest.raises(artifacts.BadName):
            artifacts.file_name(name, "")


def test_parts_without_a_manifest_are_not_seen(spark, tmp_path):
    """A driver that dies between the two phases, and a later change of a file."""
    path = str(tmp_path / "store")
    export(some(spark, 4), path)
    part = committed_parts(path)[0]
    shutil.copytree(f"{path}/parts/{part}", f"{path}/parts/dead-0")
    assert len(files_of(spark, path)) == 4
    manifest = f"{path}/manifests/{os.listdir(f'{path}/manifests')[0]}"
    about = json.load(open(manifest))
    assert about["count"] == 4 and about["bytes"] == 12
    victim = next(f for d, _, fs in os.walk(f"{path}/parts/{part}") for f in fs if f.endswith("s3.txt"))
    with open(f"{path}/parts/{part}/{victim}", "wb") as f:
        f.write(b"changed")
    with pytest.raises(Exception, match="changed after it was committed"):
        files_of(spark, path)
    json.dump(about | {"schema": "artifacts/9"}, open(manifest, "w"))
    with pytest.raises(ValueError, match="artifacts/9"):
        committed_parts(path)


def test_adopt(spark):
    items = spark.createDataFrame([("g1", "n"), ("g2", None), ("g3", "n"), ("g1", None)], "item string, name string")
    blobs = spark.createDataFrame([("g1",), ("g2",), ("g1",)], "item string")
    wanted = spark.createDataFrame([("me", "g1"), ("me", "g1"), ("you", "g1"), ("me", "g2"), ("me", "g3"), ("me", "g4"), ("me", None), (None, "g1")], "adopter string, item string")
    got = exchange.adopt(wanted, items, blobs, needed=("name",))
    assert {(r["adopter"], r["item"]): (r["adoption_id"], r["outcome"]) for r in got.collect()} == {
        ("me", "g1"): ("adopt-me-g1", "adopted"), ("you", "g1"): ("adopt-you-g1", "adopted"), ("me", "g2"): ("adopt-me-g2", "malformed_record"),
        ("me", "g3"): ("adopt-me-g3", "blob_unavailable"), ("me", "g4"): ("adopt-me-g4", "not_found"), ("me", None): ("adopt-me", "not_found")}
    first = got.filter("outcome = 'adopted'")
    again = exchange.adopt(wanted, items, blobs, first, ("name",))
    assert again.filter("outcome = 'adopted'").count() == 0 and again.filter("outcome = 'held'").count() == 2
    assert [tuple(r) for r in exchange.popularity(first).collect()] == [("g1", 2)]
    exchange.require(first)
    for outcome, error in exchange.ERRORS.items():
        with pytest.raises(error) as caught:
            exchange.require(got.filter(F.col("outcome") == outcome).filter("item IS NOT NULL"))
        assert caught.value.item in ("g2", "g3", "g4")


# mints


def fold(ops):
    """The fold in order: what is held, and who made it."""
    out, held = {}, {}
    for key, seq, gene, parents in sorted(ops, key=lambda o: (str(o[0]), o[1])):
        own = held.setdefault(key, set())
        granted = all(p in own for p in parents or [])
        out[key, seq] = (granted, granted and gene not in own)
        if granted:
            own.add(gene)
    return out


def replayed(spark, ops):
    df = spark.createDataFrame(ops, "key string, seq long, gene long, parents array<long>").repartition(3)
    return {(r["key"], r["seq"]): (r["generation"] is not None, r["is_new"]) for r in mints.replay(df, ("key",)).collect()}


def test_mint_replay_by_hand(spark):
    ops = [
        ("a", 1, 1, []), ("a", 2, 2, None), ("a", 3, 3, [1, 2]), ("a", 4, 3, [1, 2]), ("a", 5, 5, [3, 3]),  # again; one parent twice
        ("b", 1, 7, [8]), ("b", 2, 8, [7]), ("b", 3, 9, [9]),  # cycles
        ("c", 1, 2, [1]), ("c", 2, 1, []), ("c", 3, 2, [1]),  # a late parent, and another try
        ("d", 1, 4, []), ("d", 2, 6, [4, 5]), ("d", 3, 5, [4]), ("d", 4, 6, [4, 5]), ("d", 5, 0, [None]),
        ("e", 3, 30, []), ("e", 10, 20, []), ("e", 5, 20, [30]), ("e", 7, 40, [20]),  # held earlier by way of a longer chain
    ]
    got = replayed(spark, ops)
    assert got == fold(ops)
    assert not any(got["b", k][0] for k in (1, 2, 3)) and not got["c", 1][0] and got["c", 3] == (True, True)
    assert got["e", 7] == (True, True) and got["e", 10] == (True, False) and got["a", 4] == (True, False)


def test_mint_replay_random_and_chained(spark):
    rng = np.random.default_rng(4)
    ops = [(f"r{i % 6}", i, int(rng.integers(12)), [] if rng.random() < 0.15 else [int(x) for x in rng.integers(0, 12, int(rng.integers(1, 4)))]) for i in range(600)]
    ops += [("chain", k, k, [k - 1] if k else []) for k in range(12)]
    assert replayed(spark, ops) == fold(ops)
    df = spark.createDataFrame([o for o in ops if o[0] == "chain"], "key string, seq long, gene long, parents array<long>")
    assert sorted((r["seq"], r["generation"]) for r in mints.replay(df).collect()) == [(k, k) for k in range(12)]
    with pytest.raises(ValueError):
        mints.replay(df, limit=5)
    assert mints.replay(df.limit(0)).count() == 0


def test_grantable(spark):
    children = spark.createDataFrame([(10, [1, 2]), (11, [2, 2]), (12, [3, 9])], "child long, parents array<long>")
    holdings = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 2), ("z", 3), ("z", 1)], "who string, gene long")
    assert sorted(tuple(r) for r in mints.grantable(children, holdings).collect()) == [("x", 10), ("x", 11), ("y", 11)]


def test_grantable_in_many_partitions(spark, monkeypatch):
    """One to three parents, nulls, repeated holdings and a child listed twice, in more partitions than the session's."""
    monkeypatch.setattr(mints, "TASK_ROWS", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    children = [(c, [c % 7, c % 5, c % 3][: 1 + c % 3]) for c in range(60)] + [(60, [None]), (61, [1, None]), (7, [0, 2])]
    holdings = [(w, g) for w in range(20) for g in range(7) if (w * 5 + g * 3) % 4] * 2 + [(3, None)]
    got = mints.grantable(spark.createDataFrame(children, "child long, parents array<long>"), spark.createDataFrame(holdings, "who long, gene long")).collect()
    want = {(w, c) for w in range(20) for c, parents in children if all(p is not None and (w, p) in holdings for p in parents)}
    assert sorted(tuple(r) for r in got) == sorted(want) and spark.conf.get("spark.sql.shuffle.partitions") == before


# pools


def test_transfer_curves(spark):
    """Fixed values of both curves at their ends, at the joints and between; monotone; 8-bit codes stay apart."""
    srgb = [r[0] for r in spark.range(256).orderBy("id").select(pools.srgb8_to_linear16(F.col("id"))).collect()]
    hlg = [r[0] for r in spark.range(1024).orderBy("id").select(pools.hlg10_to_linear16(F.col("id"))).collect()]
    assert srgb[0] == 0 and srgb[255] == 65535 and srgb[1] == 20 and sorted(set(srgb)) == srgb
    assert hlg[:16] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5] and hlg[-4:] == [64494, 64839, 65186, 65535] and sorted(hlg) == hlg
    exact = lambda e: e * e / 3 if e <= 0.5 else (np.exp((e - 0.55991073) / 0.17883277) + 0.28466892) / 12
    assert all(abs(v - 65535 * exact(k / 1023)) <= 0.51 for k, v in enumerate(hlg))


def test_pools_compose_and_refuse(spark):
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 1024, (3, 8, 8, 3))
    grid[1, 7, 7, 2] = 1024
    rows = [(t, y, x, *map(int, grid[t, y, x])) for t in range(3) for y in range(8) for x in range(8)] + [(5, 0, 0, 1, 2, None)]
    px = spark.createDataFrame(rows, "frame int, y int, x int, r int, g int, b int")
    light = {k: r[0] for k, r in enumerate(spark.range(1024).orderBy("id").select(pools.hlg10_to_linear16(F.col("id"))).collect())}
    fine = pools.pool_sums(px, 8, 4, "linear_hlg10")
    want = {(t, by, bx): tuple(sum(light[int(v)] for v in grid[t, 2 * by : 2 * by + 2, 2 * bx : 2 * bx + 2, c].ravel()) for c in range(3)) for t in (0, 2) for by in range(4) for bx in range(4)}
    assert {(r["frame"], r["bin_y"], r["bin_x"]): (r["r"], r["g"], r["b"]) for r in fine.collect()} == want
    again = fine.groupBy("frame", F.floor(F.col("bin_y") / 2).alias("bin_y"), F.floor(F.col("bin_x") / 2).alias("bin_x")).agg(*[F.sum(c).alias(c) for c in "rgbn"])
    direct = pools.pool_sums(px, 8, 2, "linear_hlg10")
    assert Counter(map(tuple, again.select("frame", "bin_y", "bin_x", *"rgbn").collect())) == Counter(map(tuple, direct.select("frame", "bin_y", "bin_x", *"rgbn").collect()))
    assert sorted(tuple(r) for r in pools.refused_frames(px, 8, "linear_hlg10").collect()) == [(1, -3), (5, -3)]
    assert pools.pool_sums(px, 4, 2, "linear_hlg10").select("frame").distinct().count() == 3  # the broken code lies outside this window
    for bad in ((8, 3), (0, 1), (4, 8)):
        with pytest.raises(Refused):
            pools.pool_sums(px, *bad)


def test_packed_rows(spark):
    rows = [(0, y, bytes(b for x in range(4) for b in (10 * y + x, 100 + x, 200 + y, 255))) for y in range(4)] + [(1, 1, b"\x01\x02\x03\x04\x05\x06\x07"), (1, 2, None)]
    got = pools.bgra_pixels(spark.createDataFrame(rows, "frame int, y int, row binary"), 16, (1, 1), 2)
    assert sorted(tuple(r) for r in got.collect()) == [(0, y, x, 200 + y, 100 + x, 10 * y + x) for y in (1, 2) for x in (1, 2)]
    for window, side in (((3, 0), 2), ((-1, 0), 1), ((0, 0), 0)):
        with pytest.raises(Refused):
            pools.bgra_pixels(spark.createDataFrame(rows, "frame int, y int, row binary"), 16, window, side)


# captures


TICKS = "burst long, ts timestamp, tick_id long, v long, dropped boolean"


def feed(spark, path, rows):
    df = spark.createDataFrame(rows, "burst long, s double, tick_id long, v long, dropped boolean")
    df.selectExpr("burst", "timestamp_millis(cast(s * 1000 as bigint)) AS ts", "tick_id", "v", "dropped").coalesce(1).write.mode("append").parquet(path)


def capture_run(spark, path, **kw):
    with captures.state_store(spark):
        return capture_rows(spark, path, **kw)


def capture_rows(spark, path, **kw):
    ticks = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = captures.routed_captures(ticks, **kw).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    held = captures.state_rows(spark, f"{path}/log", "capture").count(), captures.timers(spark, f"{path}/log").count()
    return sorted((r["burst"], r["begun"] // 1000, r["ended"] // 1000, r["ticks"], r["reason"], r["t0"]) for r in spark.read.parquet(f"{path}/out").collect()), held


def test_captures_end_and_leave_no_state(spark, tmp_path):
    path = str(tmp_path)
    tick = lambda burst, s, i: (burst, 1000.0 + s, i, 1, False)
    feed(spark, f"{path}/in", [tick(1, i, i) for i in range(10)] + [tick(2, i, i) for i in range(60)])
    feed(spark, f"{path}/in", [tick(1, 200 + i, 10 + i) for i in range(5)] + [tick(2, i, i) for i in range(60, 70)])
    got, held = capture_run(spark, path)
    # burst 1 by its gap, burst 2 full after 64 and, with the six ticks after that, by its timer
    assert got == [(1, 1000, 1009, 10, "gap", 6), (2, 1000, 1063, 64, "full", 24), (2, 1064, 1069, 6, "idle", 4)]
    assert held == (1, 1)  # burst 1 is open
    feed(spark, f"{path}/in", [tick(3, 900 + i, i) for i in range(64)])
    got, held = capture_run(spark, path)
    assert got[1] == (1, 1200, 1204, 5, "idle", 3) and got[-1] == (3, 1900, 1963, 64, "full", 24) and held == (0, 0)


def test_drops_live_for_a_while(spark, tmp_path):
    path = str(tmp_path)

    def run(rows, wanted):
        feed(spark, f"{path}/in", rows)
        ticks = spark.readStream.schema(TICKS).parquet(f"{path}/in")
        out = []
        # processing time goes on without data, so such a query ends when it is stopped
        q = captures.living_drops(ticks, 1500).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", f"{path}/log").trigger(processingTime="1 second")
        with captures.state_store(spark):
            q = q.start()
        until = time.time() + 60
        while len(out) < wanted and q.isActive and time.time() < until:
            time.sleep(0.2)
        q.stop()
        return sorted(out)

    tick = lambda burst, i, gone: (burst, 1000.0 + i, i, 1, gone)
    assert run([tick(1, i, i % 2 == 0) for i in range(10)] + [tick(2, 0, True)], 2) == [(1, 10, 4, 1, 0), (2, 1, 1, 0, 0)]
    time.sleep(3)
    assert run([tick(1, i, True) for i in range(10, 12)], 1) == [(1, 2, 2, 0, 0)]  # the first ten were forgotten
