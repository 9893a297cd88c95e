"""Every registered query on the smallest tables: its columns, types and values against brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lumenfold.llm.common import release
from lumenfold.llm.registry import ORACLES, QUERIES
from tests.llm.test_operators import brute_classes, brute_license, brute_pii, brute_repeats, brute_terms, words
from lumenfold.llm import licenses

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def texts(rows):
    return [(i, t) for i, t, _ in rows]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    plain = lambda r: str(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    assert sorted(map(plain, got)) == sorted(map(plain, want))
    release(spark)


def test_op2(spark, rows):
    df = QUERIES["op2_sharding"](spark, DATA)
    assert df.dtypes[:7] == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = df.collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(rows))
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {r["law"] for r in got} == {"bytes"}
    size, slots, shard = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        shard[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in shard.values())
    group = Counter()
    for i, t in texts(rows):
        group[t] += len((t or "").encode()) + 1
    assert max(size.values()) <= sum(size.values()) / 8 + max(group.values())


def test_op3(spark, rows):
    df = QUERIES["op3_jaccard"](spark, DATA)
    assert df.columns == ["doc_id", "class_id", "n_links"]
    assert sorted(str(tuple(r)) for r in df.collect()) == brute_classes(texts(rows))


def test_op4(spark, rows):
    df = QUERIES["op4_toxicity"](spark, DATA)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in texts(rows))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet").collect()}
    held = [r for r in QUERIES["op4_toxicity"](spark, DATA.replace("0.001", "0.01")).collect() if r["held_out"] and r["doc_id"] in toxic]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) > 0.9
    bad, good = ([r["score"] for r in held if toxic[r["doc_id"]] == v] for v in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.9


def test_op5(spark, rows):
    df = QUERIES["op5_licenses"](spark, DATA)
    assert df.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]

    def brute(t):
        w, found = words(t), []
        for p, label in licenses.PHRASES:
            q = p.split()
            found += [(i, label) for i in range(len(w)) if w[i : i + len(q)] == q]
        at = [i for i, _ in found]
        return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})), *brute_license(t))

    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str((i, *brute(t))) for i, t in texts(rows))


def test_op6(spark, rows):
    df = QUERIES["op6_pii"](spark, DATA)
    assert df.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = []
    for (i, t), terms in zip(texts(rows), brute_terms(texts(rows))):
        spans = brute_pii(t)
        base = [f"{k}:{a}:{b}" for k, s in spans.items() for a, b in s]
        want.append(str((i, *[len(s) for s in spans.values()], hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(base + [f"term:{a}:{b}" for a, b, _ in terms]))))
    got = df.collect()
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(want)
    assert sum("term:" in r["spans"] for r in got) > 0


def test_op7(spark, rows):
    df = QUERIES["op7_suffix_dedup"](spark, DATA)
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(str(tuple(r)) for r in df.collect()) == brute_repeats(texts(rows))


def test_op8(spark):
    data = DATA.replace("0.001", "0.1")
    df = QUERIES["op8_ann"](spark, data)
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    vectors = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([v["vec_id"] for v in vectors]), np.array([v["embedding"] for v in vectors], float)
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hit = 0
    for q, found in got.items():
        score = x @ x[ids == q][0]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit += len(best & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - score[ids == v][0]) < 1e-9 for _, v, s in found)
    assert hit >= 0.9 * 20 * len(got)
