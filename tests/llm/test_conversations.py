"""Prefix trie, chat formatting and ranked search against brute force, on rows with nulls, repeats, long texts and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import chat_format, lexical_search, prefix_trie
from lumenfold.llm.chat_format import Template, format_chats, read_back
from lumenfold.llm.common import release, stored
from lumenfold.llm.lexical_search import build_postings, search_documents, search_postings, slice_best
from lumenfold.llm.prefix_trie import cells_of, ends_digest, prefix_rows, prefix_sketch, prefix_trie as trie, screened, splice, turn_rows
from tests.llm.test_operators import syllables

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
CLASH = ("depth", "k1", "k2", "pos", "digest", "chars", "n", "h", "head", "block", "single", "last", "parts", "piece", "spans", "part", "number", "ids", "score", "rank", "item", "term")


@pytest.fixture(scope="module")
def turns():
    """(conv_id, turn, role, text): shared beginnings, copies, bases in 0 and 100, nulls, repeats, one long conversation and its fork."""
    rng = np.random.default_rng(11)
    rows = []
    for c in [*range(0, 14), *range(100, 108), *range(-12, 0), 207, 305]:
        for t in range(int(rng.integers(1, 8))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"text {int(rng.integers(0, 3))} {t}"))
    for c in range(20, 60):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(400, None, None, None), (400, None, "user", ""), (400, 3, "user", "x\u0000y \U0001f600"), (400, 3, "user", "x\u0000y \U0001f600"), (401, 5, "assistant", syllables(5, 30_000)), (None, 1, "user", "nobody")]
    rows += [(403, 0, "1:user", "a"), (404, 0, "1", "user:a")]  # alike only if run together
    rows += [(c, t, "user", f"long {t}") for c in (500, 600) for t in range(-20, 2500)] + [(600, 2500, "user", "fork")]
    return rows


@pytest.fixture(scope="module")
def conversations(spark, turns):
    return stored(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASH if c != "turn"]).repartition(3), "conversations")


def spliced(turns):
    own = defaultdict(list)
    digest = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).hexdigest()
    for c, t, r, x in turns:
        if c is not None:
            own[c].append((t is not None, t, digest(r or "", x or ""), r or "", x or ""))
    own = {c: [v[3:] for v in sorted(rows, key=lambda v: (v[0], v[1] or 0, v[2]))] for c, rows in own.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + rows[h:]
    return out


def brute_trie(convs):
    """Members of every prefix, by a dictionary."""
    members, ends, up = defaultdict(list), defaultdict(list), {}
    number = {(): 0}  # prefixes by number of (parent, turn)
    kids = defaultdict(set)
    chars = {0: 0}
    for c, rows in sorted(convs.items()):
        node = 0
        members[0].append(c)
        for r, x in rows:
            key = (node, r, x)
            child = number.setdefault(key, len(number))
            up[child], chars[child] = node, len(x)
            kids[node].add(child)
            node = child
            members[node].append(c)
        ends[node].append(c)
    depth = {0: 0}
    leaves, saved = Counter(), Counter()
    for node in sorted(up):  # parents have smaller numbers
        depth[node] = depth[up[node]] + 1
    for node in sorted(members, reverse=True):
        leaves[node] += not kids[node]
        saved[node] += (len(members[node]) - 1) * chars[node]
        if node:
            leaves[up[node]] += leaves[node]
            saved[up[node]] += saved[node]
    return Counter((min(m), depth[v], min(members[up[v]]) if v else None, len(m), len(kids[v]), leaves[v], saved[v], sha(",".join(map(str, sorted(ends[v]))))) for v, m in members.items())


@pytest.mark.parametrize("block,max_cells", [(1024, prefix_trie.MAX_CELLS), (64, 1 << 12), (1 << 20, 64)])
def test_prefix_trie(conversations, turns, monkeypatch, block, max_cells):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block)
    monkeypatch.setattr(prefix_trie, "MIN_CELLS", 64)
    got = trie(*splice(stored(turn_rows(conversations), "t")), max_cells=max_cells)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = brute_trie(spliced(turns))
    assert Counter(tuple(r) for r in got.collect()) == want
    root = next(k for k in want if k[1] == 0)
    assert root[3] == len({c for c, *_ in turns if c is not None}) and root[6] > 0
    release(conversations.sparkSession, conversations)


def test_prefix_trie_empty(conversations):
    assert trie(*splice(stored(turn_rows(conversations.limit(0)), "t"))).count() == 0


def test_sketch_proves_singletons_only(conversations):
    own, convs = splice(stored(turn_rows(conversations.filter("conv_id < 450")), "t"))
    rows = prefix_rows(own, convs)
    members = Counter((r["k1"], r["k2"]) for r in rows.collect())
    for cells in (64, 1 << 14):
        bits = prefix_sketch(rows, cells)
        cell = Counter()
        for k, n in members.items():
            for at in cells_of(np.array([k[0]]), np.array([k[1]]), cells):
                cell[int(at[0])] += n
        assert set(np.flatnonzero(np.unpackbits(bits)).tolist()) == {c for c, n in cell.items() if n > 1}
    out = screened(rows).collect()
    assert all(members[r["k1"], r["k2"]] == 1 for r in out if r["single"]) and all(members[r["p1"], r["p2"]] == 1 for r in out if r["parent_single"])
    single = sum(n == 1 for n in members.values())
    assert sum(r["single"] for r in out) >= 0.95 * single > 0
    release(conversations.sparkSession, conversations)


def test_ends_in_chunks(spark):
    rows = [(1, 7, 8, i) for i in [5, -3, 1000, 999, 12, 10, 2]] + [(2, 7, 8, 4)]
    got = ends_digest(spark.createDataFrame(rows, "depth long, k1 long, k2 long, conv_id long"), 3)
    assert {tuple(r) for r in got.collect()} == {(1, 7, 8, sha("-3,2,5,10,12,999,1000")), (2, 7, 8, sha("4"))}


# chat formatting


def told(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        own[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [v[2:] for v in sorted(rows)] for c, rows in own.items()}


ODD = ["", "\\", "\\\\", "</turn>", "<\\/turn>", "<<turn>", "<says>x</turn>", "<image:1>", "\\<turn>", "a\\", chat_format.TRAP, "$1 \n\r\n  \U0001f600 é", "<", "</tur", "n>", "<turn", "<\\\\says>"]


def test_chat_round_trip(spark, turns):
    rows = [*turns, *[(700, i, ["user", "assistant"][i % 2], x) for i, x in enumerate(ODD)], *[(701, i, x, x) for i, x in enumerate(ODD)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASH])
    out = read_back(format_chats(df.repartition(3)))
    want = told(rows)
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == own
        assert got[c]["loss_text"] == "".join(x for r, x in own if r == "assistant")
        assert got[c]["formatted"].count("</turn>") == len(own) == got[c]["formatted"].count("<says>")
    assert format_chats(df.limit(0)).count() == 0


def test_chat_spans_and_custom_marks(spark):
    template = Template(open="<|start|>", says="<|message|>", close="<|end|>", learned=("assistant", "tool"))
    rows = [(1, 0, "user", "a <|end|> b"), (1, 1, "assistant", "c <|start|>\\ d"), (1, 2, "tool", "\U0001f600 e")]
    row = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template).first()
    blocks = row["formatted"].split("<|end|>")
    assert [blocks[s["turn"]][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]] == ["c <\\|start|>\\\\ d", "\U0001f600 e"]
    with pytest.raises(ValueError):
        Template(open="turn>")


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see <image:1> "), part("image", None, "s3://a.png", 28 * 28 * 3 + 1), part("audio", None, "b.wav", 80), part(None, " end")]),
        (1, 1, "assistant", [part("text", "it is "), part("text", "a dog"), part("image", None, None, None), part("text", "!")]),
        (1, 2, "assistant", []), (1, 3, "user", None), (1, 4, "user", [part("document", "ignored", "c.pdf", 9), part("video", "kept as text")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    shaped = format_chats(df, parts_col="parts")
    row = shaped.first()
    assert row["formatted"] == (
        "<turn>user<says>see <\\image:1> <image:1><audio:2> end</turn><turn>assistant<says>it is a dog<image:3>!</turn>"
        "<turn>assistant<says></turn><turn>user<says></turn><turn>user<says><document:4>kept as text</turn>"
    )
    assert [(a["number"], a["kind"], a["ref"], a["turn"], a["part"], a["tokens"]) for a in row["attachments"]] == [
        (1, "image", "s3://a.png", 0, 1, 6), (2, "audio", "b.wav", 0, 2, 4), (3, "image", None, 1, 2, 2), (4, "document", "c.pdf", 4, 0, 5)]
    blocks = row["formatted"].split("</turn>")
    assert all(blocks[a["turn"]][a["start"] :].startswith(f"<{a['kind']}:{a['number']}>") for a in row["attachments"])
    assert row["n_tokens"] == 4 + 6 + 4 + 1 + 2 + 2 + 2 + 1 + 5 + 3
    assert read_back(shaped).first()["loss_text"] == "it is a dog!"


# ranked search


def brute_search(docs, items, top=10):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(cut(text)) if b[t])
            if s > 0:
                found.append((-s, i is not None, i))
        for rank, (s, _, i) in enumerate(sorted(found)[:top], 1):
            out[item, rank, i, -s] += 1
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(7)
    vocabulary = [syllables(900 + i, 1) for i in range(60)]
    weights = 1 / np.arange(1, 61)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(7, docs[9][1]), (None, docs[3][1]), (None, None), (2000, ""), (2001, "!!! ..."), (2002, text(20_000)), (2003, "İK Kelvin-sign K mit_MIT")]
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(12)] + [(3, "only " + vocabulary[0]), (90, None), (91, ""), (92, "absent words only"), (None, docs[5][1]), (93, " ".join(vocabulary)), (94, "MIT kelvin İk")]
    return docs, items


@pytest.mark.parametrize("slice_bytes,short,walk", [(1 << 12, 0.5, 512), (4 << 20, 0.0, 16), (1 << 14, 9.0, 7)])
def test_lexical_search(spark, corpus, monkeypatch, slice_bytes, short, walk):
    monkeypatch.setattr(lexical_search.slice_best, "__defaults__", (short, walk))
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASH]).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASH])
    postings = build_postings(d, slice_bytes=slice_bytes)
    want = brute_search(docs, items)
    assert Counter(tuple(r) for r in search_postings(postings, i).collect()) == want
    assert Counter(tuple(r) for r in search_postings(postings, i, block_bytes=400).collect()) == want  # several passes
    release(spark)


def test_lexical_search_other_ids_and_empty_tables(spark, corpus):
    docs, items = [(None if i is None else f"d{i}", t) for i, t in corpus[0]], [(f"q{i}", t) for i, t in corpus[1]]
    d, i = spark.createDataFrame(docs, "name string, body string"), spark.createDataFrame(items, "item_id string, text string")
    assert Counter(tuple(r) for r in search_documents(d, i, "name", "body", top=3).collect()) == brute_search(docs, items, 3)
    assert search_documents(d.limit(0), i, "name", "body").count() == search_documents(d, i.limit(0), "name", "body").count() == search_documents(d.filter("body = ''"), i, "name", "body").count() == 0
    release(spark)


def test_slice_best_skips_but_loses_nothing():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n = int(rng.integers(1, 400))
        lists = []
        for _ in range(int(rng.integers(1, 12))):
            d = np.flatnonzero(rng.random(n) < rng.random() ** 3)
            if len(d):
                lists.append((d, rng.integers(0, 50, len(d)) * int(rng.integers(1, 20))))
        if not lists:
            continue
        total = np.zeros(n, np.int64)
        for d, s in lists:
            total[d] += s
        floor = int(rng.integers(1, 300))
        docs, scores = slice_best(lists, n, 5, floor, short_share=float(rng.random()), range_docs=int(rng.integers(1, 90)))
        assert (total[docs] == scores).all()
        best = sorted((-v, i) for i, v in enumerate(total.tolist()) if v >= floor)[:5]
        assert sorted((-v, i) for i, v in zip(docs.tolist(), scores.tolist()))[:5] == best


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_chat", "op13_lexical"])
def test_types(spark, name):
    from lumenfold.llm.registry import QUERIES

    text, whole = {"ends_sha256", "turns_sha256", "loss_sha256"}, {"rank": "int"}
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert all(kind == ("string" if c in text else whole.get(c, "bigint")) for c, kind in df.dtypes)
    release(spark)
