"""Readers of tables, documents, weights, swaps and bundles on small files."""

import io
import json

import numpy as np
import pytest

from lumenfold.sources import codecs, readers


def npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def test_tables_and_documents(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,w\n1,x,0.5\n2,,1.5\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "id int, name string, w double").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "x", 0.5), (2, None, 1.5)]
    (tmp_path / "b.csv").write_text("id,name,w\nx,y,0.5\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "b.csv"), "id int, name string, w double").collect()
    (tmp_path / "golden.json").write_text(json.dumps({"law": "x", "records": [{"seed": 3, "out": [1, 2]}, {"seed": 4, "out": []}]}))
    golden = readers.read_golden(spark, str(tmp_path / "golden.json"), "seed:long, out:array<long>").orderBy("seed").collect()
    assert [(r["seed"], r["out"]) for r in golden] == [(3, [1, 2]), (4, [])]
    (tmp_path / "capture.json").write_text('{"planes": [[1, 2], [3]], "name": "c"}')
    assert readers.read_capture(spark, str(tmp_path / "capture.json"), "planes array<array<int>>, name string").first()["planes"] == [[1, 2], [3]]


def test_indexes_and_records(spark, tmp_path):
    for slot, rows in (("head", [{"id": "h1", "size": 3}]), ("tail", [{"id": "t1", "size": 1}, {"id": "t2", "size": 2}]), ("none", None)):
        (tmp_path / "store" / slot).mkdir(parents=True)
        if rows is not None:
            (tmp_path / "store" / slot / "index.json").write_text(json.dumps(rows))
    got = readers.read_indexes(spark, str(tmp_path / "store"), "id string, size int", [{"id": "base"}]).collect()
    assert sorted((r["slot"] or "", r["id"], r["size"], r["first"]) for r in got) == [("", "base", None, 1), ("head", "h1", 3, 0), ("tail", "t1", 1, 0), ("tail", "t2", 2, 0)]
    store = spark.createDataFrame([("a", "organ", 2), ("b", "gene", 1), ("c", "organ", 1)], "id string, type string, n int")
    assert [r["id"] for r in readers.records(store, "organ", "n").collect()] == ["c", "a"]
    assert [r["id"] for r in readers.records(store, "organ", "n", ascending=False).collect()] == ["a", "c"]
    assert readers.record(store, "id", "b").first()["n"] == 1 and readers.record(store, "id", "z").count() == 0
    (tmp_path / "bundle.json").write_text('{"id": "a", "type": "organ", "n": 9}\n{"id": "d", "type": "gene", "n": 4}\n')
    once, n = readers.import_bundle(spark, store, str(tmp_path / "bundle.json"), "id")
    twice, _ = readers.import_bundle(spark, once, str(tmp_path / "bundle.json"), "id")
    assert n == 2 and sorted(tuple(r) for r in once.collect()) == sorted(tuple(r) for r in twice.collect()) == [("a", "organ", 2), ("b", "gene", 1), ("c", "organ", 1), ("d", "gene", 4)]


def test_weights_and_swaps(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "m.weights").write_bytes(np.array([0.5, -2, 3], "<f4").tobytes())
    got = readers.read_weights(spark, str(tmp_path / "w"), 3)
    assert [(r["stem"], r["i"], r["w"]) for r in got.orderBy("i").collect()] == [("m", 0, 0.5), ("m", 1, -2.0), ("m", 2, 3.0)]
    assert "weights" in readers.read_weights(spark, str(tmp_path / "w"), 4, strict=False).first()["error"]
    out = readers.weights_json(got.drop("error")).first()
    assert out["count"] == 3 and json.loads(out["json"]) == {"stem": "m", "w": [0.5, -2.0, 3.0]}
    swap = codecs.wrap_swap(7, [-5, 1 << 40], list(range(100)))
    broken = bytearray(swap)
    broken[30] ^= 1
    for name, data in (("ok", b"GIF89a.." + swap + b";"), ("no", b"GIF89a;"), ("bad", bytes(broken)), ("short", swap[:-9])):
        (tmp_path / f"{name}.gif").write_bytes(data)
    found = {r["stem"]: r for r in readers.read_swaps(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in found.items()} == {"ok": "ok", "no": "no_block", "bad": "corrupt", "short": "corrupt"}
    assert (found["ok"]["minted"], found["ok"]["parents"], found["ok"]["weights"]) == (7, [-5, 1 << 40], list(range(100)))


def test_bundles(spark, tmp_path):
    rng = np.random.default_rng(0)
    field = rng.integers(0, 5, size=(4, 3, 3, 8)).astype(np.int32)
    margins = np.sort(field, -1)[..., -1] - np.sort(field, -1)[..., -2]
    for name, shape, side in (("good", field.shape, margins), ("shape", (4, 4, 3, 8), margins), ("margin", field.shape, margins + (np.arange(3) == 1))):
        (tmp_path / name).mkdir()
        man = {"field_source": "synthetic", "artifacts": {"field": "f.npy", "contested": "c.npy"}, "field": {"shape": list(shape)}, "contested": {"shape": list(side.shape)}}
        (tmp_path / name / f"{name}_manifest.json").write_text(json.dumps(man))
        (tmp_path / name / "f.npy").write_bytes(npy(field))
        (tmp_path / name / "c.npy").write_bytes(npy(side.astype(np.int32)))
    rows = readers.read_bundles(spark, str(tmp_path / "good")).collect()
    assert len(rows) == 36 and all(r["counts"] == field[r["y"], r["x"], r["ch"]].tolist() and r["margin"] == margins[r["y"], r["x"], r["ch"]] for r in rows)
    errors = {r["stem"]: r["error"] for r in readers.read_bundles(spark, str(tmp_path), strict=False).collect() if r["error"]}
    assert set(errors) == {"shape", "margin"} and "margins" in errors["margin"]
    with pytest.raises(Exception):
        readers.read_bundles(spark, str(tmp_path / "margin")).collect()
