"""Every stage of the pipeline against a brute-force version, on a small corpus with odd rows."""

import threading
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenfold.llm import mixing, toxicity
from lumenfold.llm.common import Scope, release, stored
from lumenfold.llm.registry import ORACLES, QUERIES
from tests.llm.test_operators import brute_classes, syllables, words

#: Names that stages use inside, as columns of the input.
CLASH = ("score", "_score", "items", "n_hit", "key", "_key", "_row", "n", "_n", "_d", "_k", "_s", "bucket", "shard", "size", "contaminated")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(240):
        w = syllables(4000 + i, 30).split()
        if i % 4 == 0:
            for p in rng.choice(30, 4, replace=False):
                w[p] = ["grumpf", "zorkig", "blargo"][rng.integers(3)]
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, int(i % 4 == 0)))
    item = syllables(9001, 40)
    rows += [(300, f"{item} tail", "s1"), (301, syllables(9002, 200) + " " + " ".join(item.split()[:12]), "s1"), (302, rows[1][1], "s1"), (303, rows[2][1] + " more", "s2")]
    rows += [(1, rows[1][1], "s0"), (1, rows[1][1], "s1"), (None, None, None), (None, "", None), (305, None, "s9"), (306, "", ""), (307, "!!!", "s0"), (308, "three small words", "s0"), (5, "another text under one id", "s0"), (309, syllables(9003, 40_000), "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", *[f"concat('{c}-', coalesce(doc_id, -1)) AS `{c}`" for c in CLASH])
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def rows_of(df):
    return Counter(str(tuple(r)) for r in df.collect())


def plain(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_toxicity_stage(spark, corpus):
    path, docs = corpus
    out = corpus_pipeline.drop_toxic(spark, docs, path)
    model = toxicity.train_on_folds(docs, spark.read.parquet(f"{path}/labels.parquet"))
    score = lambda t: model.score(np.array([toxicity.features(t, model.lexicon)]))[0]
    want = Counter(str(tuple(r)) for r in docs.collect() if score(r["text"]) < toxicity.THRESHOLD)
    assert out.columns == docs.columns and rows_of(out) == want
    left = {i for i, _, _ in plain(out)}
    assert sum(i in left for i in range(0, 240, 4)) <= 3 and sum(i in left for i in range(240) if i % 4) >= 177


def test_near_copies_stage(spark, corpus):
    path, docs = corpus
    out = corpus_pipeline.drop_near_copies(spark, docs, path)
    assert out.columns == docs.columns and not rows_of(out) - rows_of(docs)
    brute = [eval(c) for c in brute_classes([(i, t) for i, t, _ in plain(docs)])]
    classes = {c for _, c, _ in brute}
    kept = plain(out)
    # the two texts under id 5 are two classes
    assert None not in classes and len(kept) == len(classes) + 1 and {i for i, _, _ in kept} == classes
    again = corpus_pipeline.drop_near_copies(spark, docs.repartition(5), path)
    assert sorted(map(str, plain(again))) == sorted(map(str, kept))


def test_decontamination_stage(spark, corpus):
    path, docs = corpus
    out = corpus_pipeline.drop_contaminated(spark, docs, path)
    item = words(spark.read.parquet(f"{path}/benchmark.parquet").filter("item_id = 1").first()["text"])
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

    def bad(t):
        w = words(t)
        hit = {k for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for k in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    want = Counter(str(tuple(r)) for r in docs.collect() if not bad(r["text"]))
    assert out.columns == docs.columns and rows_of(out) == want and sum(want.values()) == docs.count() - 1


def test_mixing_stage(spark, corpus):
    path, docs = corpus
    out = corpus_pipeline.mix_sources(spark, docs, path)
    counts = {(r["doc_id"], r["source"], r["key"]): r["copies"] for r in mixing.mix_documents(docs).collect()}
    assert out.columns == docs.columns and set(rows_of(out)) <= set(rows_of(docs))
    seen, had = rows_of(out), rows_of(docs)
    assert all(n <= 3 * had[r] and n % had[r] == 0 for r, n in seen.items()) and max(counts.values()) <= 3
    size = lambda t: len([w for w in (t or "").split() if w])
    total, taken = Counter(), Counter()
    for _, t, s in plain(docs):
        total[s] += size(t)
    for _, t, s in plain(out):
        taken[s] += size(t)
    targets = {r["source"]: r["target"] for r in mixing.mix_documents(docs).collect()}
    biggest = {s: max(size(t) for _, t, x in plain(docs) if x == s) for s in total}
    assert abs(sum(targets.values()) - sum(total.values())) < 1e-6
    assert all(abs(taken[s] - targets[s]) <= max(3, biggest[s]) for s in total)


def test_sharding_stage(spark, corpus):
    path, docs = corpus
    out = corpus_pipeline.shard(spark, docs, path)
    assert out.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in plain(docs))
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_stages_on_an_empty_table(spark, corpus):
    path, docs = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run(spark, corpus):
    path, docs = corpus
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        step = stored(stage(spark, step, path), f"test-{name}")
    assert rows_of(corpus_pipeline.run(spark, path)) == rows_of(step) and step.count() > 100
    release(spark)


def test_scopes_keep_to_their_own_tables(spark):
    outside = stored(spark.range(3), "outside")
    with Scope(spark) as scope:
        first, second = stored(spark.range(5), "first"), stored(spark.range(7), "second")
        seen = []

        def other():  # another caller, another thread
            own = stored(spark.range(11), "other")
            release(spark, own)
            seen.append(own)

        caller = threading.Thread(target=other)
        caller.start()
        caller.join()
        scope.release(second)
        assert outside.count() == 3 and second.count() == 7 and seen[0].count() == 11
        with pytest.raises(Exception):
            first.count()
    release(spark, outside)  # what the scope has left is the caller's
    assert outside.count() == 3 and seen[0].count() == 11
    with pytest.raises(Exception):
        second.count()
    release(spark)


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
