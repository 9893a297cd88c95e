"""Each operator against a brute-force version or an exact law, on small tables with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, decontaminate, jaccard_join, licenses, mixing, pii, sharding, suffix_dedup, toxicity, url_filter
from lumenfold.llm.common import release, words_bytes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def syllables(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["ta", "re", "né", "ko", "li", "Su"], 3)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, other = syllables(1, 300), syllables(2, 120)
    out = [None, "", "!!!", "!!!", "one two", "ONE, two", base, base, base.replace("ta", "xx", 1), other, other + " tail words here", base[:700] + " " + other]
    out += [syllables(k, 40) for k in range(10, 22)]
    out += ["Mail a.b@c.example.org or 10.0.0.256 and 10.0.0.1; card 4111 1111 1111 1111, call +1 (415) 555-2671. \U0001f600 x@y.z_d@e.f"]
    out += ["Under the Apache License and the MIT license; GNU General Public License. cc-by cc by", "İK Kelvin MIT\nLICENSE"]
    out += [" ".join([syllables(3, 50)] * 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows += [(6, texts[6], "en", "s0", 0), (6, texts[6], "en", "s0", 0), (None, syllables(50, 30), None, None, None), (3, "another text under one id", "en", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# ------------------------------------------------------------- URL filters


def brute_url(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = lower(re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    best = None
    for rule, action in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            rank = (len(rule), len(h), action == "block")
            if best is None or rank > best[0]:
                best = rank, rule, action
    return host, path, best and best[1], best[2] if best else "allow"


RULES = [*url_filter.RULES, ("example.org/en", "block"), ("a.net/x/y", "allow"), ("bare", "block"), ("b.net/q//r/", "block")]
URLS = [None, "", "no scheme", "http://Example.NET/en/x?q#z", "https://x.net", "https://x.net/", "http://example.com/de/1", "http://s.org/fr/", "ftp://example.org/english",
        "http://a.net/x/yy/z", "http://a.net/x", "bare://u.bare", "http://bare/", "http://.net/", "http://b.net/q//r/s", "http://net.com/", "x://y://z.net/", "http://a\nb.net/p"]


@pytest.mark.parametrize("joined", [False, True])
def test_url_filter(spark, joined):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "rule string, action string") if joined else RULES
    got = url_filter.filter_urls(pages, rules, max_broadcast_rules=1 if joined else 100).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_url(u, RULES) for u in URLS * 2]
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0


# ---------------------------------------------------------------- sharding


def brute_capacity(sizes, k):
    def fits(cap):
        used, n = 0, 1
        for s in sizes:
            if s > cap:
                return False
            if used + s > cap:
                used, n = 0, n + 1
            used += s
        return n <= k

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_capacity(spark, seed):
    rng = np.random.default_rng(seed)
    n = [5, 40, 3000, 9000][seed]
    keys = sorted(set(rng.integers(0, 1 << 60, n).tolist()))
    sizes = rng.integers(1, 1000, len(keys)).tolist()
    if seed >= 2:
        sizes[len(sizes) // 3] = sum(sizes) // 2  # a hot group
    if seed == 3:
        sizes[7] = sum(sizes) // 20
    groups = spark.createDataFrame(list(zip(keys, sizes)), "key long, size long")
    cap, starts = sharding.minimax_cuts(groups, 8)
    assert cap == brute_capacity(sizes, 8)
    shard = np.searchsorted(starts, keys, "right")
    assert max(np.bincount(shard, weights=sizes)) <= cap and len(starts) <= 7


def test_shard_documents(spark, docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    all_rows = rows_of(docs)
    assert sorted(str((r["doc_id"], r["size"], r["text_crc32"])) for r in got) == sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in all_rows)
    by_crc, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_crc[(r["text_crc32"], r["size"])].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_crc.values()) or any(t is None for _, t in all_rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0


# ------------------------------------------------------------ Jaccard join


def grams(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else ("none", t or "")


def brute_classes(rows):
    g = [grams(t) for _, t in rows]
    near = [[a == b if isinstance(a, tuple) or isinstance(b, tuple) else len(a & b) >= 0.8 * len(a | b) for b in g] for a in g]
    comp = list(range(len(rows)))
    for _ in rows:
        comp = [min(c for c, n in zip(comp, row) if n) for row in near]
    ids = {c: min((i for (i, _), k in zip(rows, comp) if k == c and i is not None), default=None) for c in comp}
    return sorted(str((i, ids[c], sum(row) - 1)) for (i, _), c, row in zip(rows, comp, near))


def test_jaccard_join(docs, empty):
    got = jaccard_join.near_duplicates(docs).collect()
    assert sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in got) == brute_classes(rows_of(docs))
    kept = jaccard_join.distinct_documents(docs)
    assert kept.count() == len({(r["class_id"], r["n_links"]) if r["class_id"] is None else r["class_id"] for r in got})
    assert kept.columns == docs.columns
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_crowd(spark):
    """A crowd of variants of one text, many of them near each other, in buckets above CROWD."""
    rng = np.random.default_rng(9)
    base = syllables(4, 120).split()
    rows = []
    for i in range(260):
        w = list(base)
        for p in rng.choice(len(w), rng.integers(0, 12), replace=False):
            w[p] = f"v{i}x{p}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(df).collect()
    want = brute_classes(rows)
    have = sorted(str((r["doc_id"], r["class_id"], r["n_links"])) for r in got)
    assert sum(a != b for a, b in zip(have, want)) <= 2  # banding may miss a pair with probability 1e-4


def test_band_plan():
    bands, rows = jaccard_join.plan(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        w = syllables(1000 + i, 30).split()
        if toxic:
            for p in rng.choice(30, 3, replace=False):
                w[p] = ["grumpf", "zorkig", "blarg" + "aeiou"[i % 5]][rng.integers(3)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (7000, ""), (0, rows[0][1])], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train_on_folds(docs, marks)
    scored = toxicity.score_documents(docs.withColumn("score", F.lit("clash")), model)
    got = {r["doc_id"]: r["score"] for r in scored.select("doc_id", "score").collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(got[i] >= 0.7) == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95 and len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train_on_folds(docs, marks.limit(0))
    assert toxicity.score_documents(docs, none).select("score").distinct().count() == 1
    assert toxicity.score_documents(docs.limit(0), none).count() == 0


def test_toxicity_repeated_ids_stay_bounded(spark):
    rows = [(i % 3, f"text {i} bad{i % 2}", "x") for i in range(400)] + [(7, "same", "y")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, max_train_rows=50)
    assert model.rows == 50
    kept = toxicity.clean_documents(docs, model)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} <= {"x", "y"}


def brute_features(text, lexicon):
    raw = (text or "").encode()
    w = [x.encode() for x in words(text)]
    weight = lambda x: max([lexicon.weights.get(x + b" ", 0.0)] + [lexicon.weights.get(x[:n], 0.0) for n in (4, 5, 6) if len(x) >= n])
    hit = [i for i, x in enumerate(w) if weight(x) > 0 or x in toxicity.SEED_LEXICON]
    n, size = max(1, len(w)), max(1, len(raw))
    near = sum(any(x in toxicity.SECOND_PERSON for x in w[max(0, i - 5) : i + 6]) for i in hit)
    capitals, marks = sum(65 <= c <= 90 for c in raw), sum(chr(c) in toxicity.PUNCTUATION.decode() for c in raw)
    odd = [m[0] for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z]+[@$0-9!*._-]+[A-Za-z][A-Za-z@$0-9!*._-]*", text or "", re.ASCII)]
    plain = [re.sub(r"[*._-]", "", o.translate(str.maketrans("@4310$5!7", "aaeiossit"))).lower().encode() for o in odd]
    return [
        len(hit) / n, math.log1p(len(hit)), math.log1p(len({w[i] for i in hit})), max([weight(w[i]) for i in hit], default=0.0), sum(x in toxicity.SEED_LEXICON for x in w) / n, near / n,
        sum(x in toxicity.SECOND_PERSON for x in w) / n, capitals / size, float(capitals > size * 0.3), (text or "").count("!") / n, marks / size, len(odd) / n,
        math.log1p(sum(p in toxicity.SEED_LEXICON or weight(p) > 0 for p in plain)), math.log1p(len(w)),
    ]


def test_toxicity_features():
    lexicon = toxicity.Lexicon({b"grum": 3.0, b"zorkig ": 4.0, b"blarga": 5.0})
    texts = [None, "", "!!!", "You GRUMPF! you zorkig, blargaeiou idiot", "zorkigs are fine, ich und du tú", "st*pid i.d.i.o.t gr4mpf m0ron b1argae", "A B C " * 50_000 + "stupid you", "é" * 30 + " YOUR\x00scum"]
    for t in texts:
        assert toxicity.features(t, lexicon) == pytest.approx(brute_features(t, lexicon))


def test_one_tree_and_isotonic_fit():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (200, 3)).astype(float)
    y = (x[:, 1] > 4).astype(float) * (rng.random(200) < 0.9)
    t = toxicity.Trees(rounds=1, depth=1, rate=1.0, bins=48).fit(x, y)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    g, h = y - p, np.full(200, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(score(x[:, f] <= c) + score(x[:, f] > c) for f in range(3) for c in range(8) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 1)
    side = t.margin(x) == t.margin(x)[0]
    assert score(side) + score(~side) == pytest.approx(best)
    for part in (side, ~side):
        assert t.margin(x[part])[0] == pytest.approx(math.log(p / (1 - p)) + g[part].sum() / (h[part].sum() + 1))
    m = rng.normal(size=60)
    v = (rng.random(60) < 1 / (1 + np.exp(-3 * m))).astype(float)
    knots, share = toxicity.isotonic(m, v)
    assert (np.diff(knots) > 0).all() and (np.diff(share) >= 0).all()
    o = v[np.argsort(m)]  # the monotone fit by its max-min formula
    fit = [max(min(o[i : j + 1].mean() for j in range(k, 60)) for i in range(k + 1)) for k in range(60)]
    blocks = [(f, fit.count(f)) for f in sorted(set(fit))]
    assert share == pytest.approx([(f * n + 0.02) / (n + 0.04) for f, n in blocks])


# ---------------------------------------------------------------- licenses


def test_licenses(docs, empty):
    def brute(t):
        w, found = words(t), []
        for p, label in licenses.PHRASES:
            q = p.split()
            found += [(i, label) for i in range(len(w)) if w[i : i + len(q)] == q]
        return len(w), len(found), ",".join(sorted({x for _, x in found}))

    spans = licenses.scan_licenses(docs)
    base = F.filter("spans", lambda s: s["exact"])
    got = spans.select("doc_id", "n_words", F.size(base), F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",")).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *brute(t))) for i, t in rows_of(docs))
    assert licenses.scan_licenses(empty).count() == 0


def test_license_notice_with_an_insertion(spark):
    notice = licenses.NOTICES[1][0].split()
    text = " ".join(["some", "words", *notice[:9], "plus", *notice[9:], "more"])
    spans = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
    assert [(s["label"], s["start"], s["end"]) for s in spans] == [("bsd", 2, 3 + len(notice))]


def brute_license(t, k=licenses.K):
    """(labels, best cover) of one text: exact phrases, and notices by diagonals that lie near each other."""
    w, labels, best = words(t), set(), 0.0
    grams = lambda v: [tuple(v[i : i + k]) for i in range(len(v) - k + 1)]
    for phrase, label in licenses.PHRASES:
        q = phrase.split()
        if any(w[i : i + len(q)] == q for i in range(len(w))):
            labels.add(label)
            best = 1.0
    for notice, label in licenses.NOTICES:
        q, diagonals = grams(words(notice)), defaultdict(list)
        for p, gram in enumerate(grams(w)):
            for place, other in enumerate(q):
                if gram == other:
                    diagonals[p - place].append((p, place))
        groups = []
        for d in sorted(diagonals):
            first, last = min(p for p, _ in diagonals[d]), max(p for p, _ in diagonals[d])
            places = {x for _, x in diagonals[d]}
            g = groups[-1] if groups else None
            if g and d - g[0] <= licenses.DRIFT and first - g[2] <= len(q) and g[1] - last <= len(q):
                groups[-1] = d, min(g[1], first), max(g[2], last), g[3] | places
            else:
                groups.append((d, first, last, places))
        for _, _, _, places in groups:
            if len(places) >= licenses.LEAST_COVER * len(q):
                labels.add(label)
                best = max(best, len(places) / len(q))
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores(spark, docs):
    rng = np.random.default_rng(31)
    rows = []
    for i in range(60):
        w = licenses.NOTICES[i % len(licenses.NOTICES)][0].split()
        for _ in range(i % 7):  # words put in, left out and changed
            p = int(rng.integers(len(w)))
            w[p : p + int(rng.integers(2))] = ["of", "the"][: int(rng.integers(3))]
        rows.append((800 + i, f"{syllables(i, 5)} {' '.join(w).upper()}, {syllables(i + 60, 5)} " + ("of the " * 300 if i % 10 == 0 else "")))
    rows += [(990, " ".join(licenses.NOTICES[0][0] for _ in range(400))), (991, "the software of any " * 20_000), (991, "the software of any " * 20_000)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    out = licenses.scan_licenses(every)
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))), ",")
    got = out.select("doc_id", labels, F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))).collect()
    want = [(i, *brute_license(t)) for i, t in rows_of(every)]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and sum(bool(x) for _, x, _ in want) > 40


# --------------------------------------------------------------------- PII

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if ok(k, m[0])] for k, p in PATTERNS.items()}


HARD = ["a@b.c_d@e.f x..y@z-1.com. @q.r 1.2.3.4.5.6.7.8 001.02.3.4 256.1.1.1 1.2.3", "4111-1111 1111 1111 4111  1111 1234567890128", "+44 20 7946 0958, +1-2-3 +1.(234).567.8901x +12345678901234567", "é\U0001f600 m@n.op " + "7 " * 4000, "%+-@x.y", "9" * 30_000 + " 1.1.1.1"]


def test_pii(spark, docs, empty):
    extra = spark.createDataFrame([(900 + i, t, "", "", 0) for i, t in enumerate(HARD)], SCHEMA)
    both = docs.union(extra)
    got = pii.find_personal_data(both).select("doc_id", *[f"spans_{k}" for k in pii.KINDS]).collect()
    have = sorted(str((r["doc_id"], [[(s["start"], s["end"]) for s in r[f"spans_{k}"]] for k in pii.KINDS])) for r in got)
    data = dict(rows_of(extra))
    for r in got:  # byte offsets
        if r["doc_id"] in data:
            assert all(data[r["doc_id"]][s["start"] : s["end"]].encode() == data[r["doc_id"]].encode()[s["from"] : s["to"]] for k in pii.KINDS for s in r[f"spans_{k}"])
    assert have == sorted(str((i, [brute_pii(t)[k] for k in pii.KINDS])) for i, t in rows_of(both))
    assert pii.find_personal_data(empty).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"{syllables(i, 20)} badge zorblat mail{i}@x.example.com {syllables(i + 99, 20)}") for i in range(8)]
    rows += [(100 + i, syllables(300 + i, 40) + " badge") for i in range(60)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = dict(rows)
    terms = {texts[r["doc_id"]][s["start"] : s["end"]] for r in found.collect() for s in r["terms"]}
    assert "zorblat" in terms and "badge" not in terms


def test_terms_of_whole_documents(spark):
    far = " ".join(["filler"] * 20)
    rows = [(i, f"Zorblat {far} mail{i}@x.example.com {far}") for i in range(8)]
    rows += [(20, f"{far} no address but ZORBLAT, zorblats")]
    rows += [(30 + i, f"{far} boss@y.example.com {far} Quimby") for i in range(2)]
    rows += [(40, f"sole@z.example.com {far} Hapley")]
    rows += [(100 + i, f"{far} plain {i}") for i in range(80)]
    texts = dict(rows)
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i: [texts[i][s["start"] : s["end"]] for s in r["terms"]] for i, r in got.items()}
    assert all(found[i] == ["Zorblat"] for i in range(8))  # far from the address
    assert found[20] == ["ZORBLAT"]  # a document without a span
    assert found[30] == found[31] == ["Quimby"] and found[40] == ["Hapley"]  # one address, two documents and one
    assert all(found[100 + i] == [] for i in range(80))
    assert got[40]["sanitised"] == f"[email] {far} [email]"
    assert got[20]["sanitised"] == f"{far} no address but [email], zorblats" and got[100]["sanitised"] == texts[100]


def test_sanitised_overlap(spark):
    row = spark.createDataFrame([(1, "call +4111111111111111 or 10.0.0.1 now"), (1, None)], "doc_id long, text string")
    texts = {r["sanitised"] for r in pii.find_personal_data(row).collect()}
    assert "" in texts and not any(re.search("[0-9]{4}", t) or "10.0" in t for t in texts)


def test_dense_texts(spark):
    """A megabyte of addresses, one of card numbers and one of words that all disclose: each in seconds."""
    import time

    mails = " ".join(f"é user{i}@mail{i % 7}.example.com" for i in range(36_000))
    cards = " ".join(["4111 1111 1111 1111,"] * 50_000)
    rare = " ".join(f"word{i}x" for i in range(4_000)) + " one@only.example.com"
    rows = [(1, mails), (2, cards), (3, rare), *[(10 + i, "plain words") for i in range(300)]]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("dense texts:", time.time() - began)
    assert time.time() - began < 90
    assert len(got[1]["spans_email"]) == 36_000 and len(got[2]["spans_card"]) == 50_000 and len(got[3]["terms"]) == 4_000
    assert got[1]["sanitised"] == " ".join(["[email] [email]"] * 36_000)  # the only other word stands there alone
    assert got[3]["sanitised"] == " ".join(["[email]"] * 4_001) and got[2]["sanitised"] == " ".join(["[card],"] * 50_000)


def brute_terms(rows, alpha=pii.ALPHA):
    """Per row the sorted places of disclosing terms, each with the kind that it discloses most of."""
    docs = []
    for _, t in rows:
        t, values = t or "", set()
        blank = list(t)
        for kind, spans in brute_pii(t).items():
            for a, b in spans:
                values.add((kind, lower(t[a:b]) if kind in ("email", "ip") else re.sub("[^0-9]", "", t[a:b])))
                blank[a:b] = " " * (b - a)
        places = [(m.start(), m.end(), lower(m[0])) for m in WORD.finditer(lower("".join(blank)))]
        docs.append((places, {w for _, _, w in places if not re.fullmatch("[0-9]+", w)}, values))
    n, holds, n_term, both = len(docs), Counter(), Counter(), Counter()
    for _, terms, values in docs:
        entities = {k for k, _ in values} | values
        holds.update(entities)
        n_term.update(terms)
        both.update((t, e) for t in terms for e in entities)
    telling = {}
    for (t, e), b in both.items():
        m, p = n_term[t], holds[e] / n
        # they meet in two documents, or the term stands in one document only
        if (b >= 2 or m == 1) and p < 1:
            pmi = math.log(wilson(b, m) / p)
            if pmi >= alpha * -math.log(p) - 1e-12:
                kind = e if isinstance(e, str) else e[0]
                telling.setdefault(t, []).append((round(pmi, 9), -pii.KINDS.index(kind), kind))
    return [sorted((a, b, max(telling[w])[2]) for a, b, w in places if w in telling) for places, _, _ in docs]


def wilson(hits, of, z=1.645):
    """Lower end of Wilson's score interval, from its textbook form."""
    p = hits / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def test_terms_match_brute_force(spark, docs):
    rng = np.random.default_rng(21)
    names = [f"nam{i}" for i in range(30)]
    rows = [(200 + i, f"{syllables(i, 10)} own{i % 12} mail{i % 12}@x.example.com {names[rng.integers(30)]} 7 10.0.0.{i % 4}" if i % 3 else f"{syllables(i, 6)} {names[rng.integers(30)]}") for i in range(90)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    all_rows = rows_of(every)
    got = sorted(str((r["doc_id"], sorted((s["start"], s["end"], s["label"]) for s in r["terms"]))) for r in pii.find_personal_data(every).collect())
    want = [str((i, t)) for (i, _), t in zip(all_rows, brute_terms(all_rows))]
    assert got == sorted(want)
    assert sum("[(" in w for w in want) > 60


@pytest.mark.parametrize("share", [1.0, 0.5, 0.25])
def test_a_common_value_is_not_told_by_unique_words(spark, share):
    rows = [(i, f"common words here unique{i}x {'boss@y.example.com' if i < 400 * share else ''}") for i in range(400)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["terms"] == [] for r in got) and sum(len(r["spans_email"]) for r in got) == 400 * share


def test_every_pair_that_meets_the_threshold_counts(spark):
    """Words of several documents that meet a value once, and a word that is no bare number to the end."""
    rng = np.random.default_rng(8)
    mail = lambda i: {0: f"solo{i}@x.example.com", 1: f"pair{i // 80}@x.example.com 10.0.0.{i % 7}"}.get(i % 40, "")
    rows = [(i, f"rest word{rng.integers(400)} both{i // 2} three{i // 3} 12{i % 50} 77\u2028 {mail(i)}") for i in range(1400)]
    n, docs = len(rows), []
    for _, t in rows:
        found = {k: [t[a:b] for a, b in v] for k, v in brute_pii(t).items()}
        values = {(k, v) for k, vs in found.items() for v in vs}
        for _, v in values:
            t = t.replace(v, " ")
        docs.append(({w for w in WORD.findall(t) if not re.fullmatch("[0-9]+", w)}, {k for k, _ in values} | values))
    n_term, holds = Counter(w for words, _ in docs for w in words), Counter(e for _, es in docs for e in es)
    both = Counter((w, e) for words, es in docs for w in words for e in es)
    telling = {w for (w, e), b in both.items() if math.log(wilson(b, n_term[w]) * n / holds[e]) >= pii.ALPHA * math.log(n / holds[e]) - 1e-12}
    assert {n_term[w] for w in telling} >= {1, 2} and any(both[w, e] == 1 < n_term[w] for w, e in both if w in telling)
    got = {r["doc_id"]: {rows[r["doc_id"]][1][s["start"] : s["end"]] for s in r["terms"]} for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: words & telling for i, (words, _) in enumerate(docs)}


def planted_quality(spark, docs=1500, people=40):
    """Precision and recall of told words over a corpus in which each person's name tells one address, in 3 to 9 documents."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}x" for i in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary, 60))) for i in range(docs)]
    planted = set()
    for p in range(people):
        for i in rng.choice(docs, int(rng.integers(3, 10)), replace=False).tolist():
            w = rows[i][1].split(" ")
            rows[i] = (i, " ".join([*w[:20], f"person{p}z", *w[20:], f"p{p}@x.example.com"]))
            planted.add((i, f"person{p}z"))
    texts = dict(rows)
    found = {(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]]) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r["terms"]}
    return len(found & planted) / max(1, len(found)), len(found & planted) / len(planted)


def test_planted_terms(spark):
    precision, recall = planted_quality(spark)
    print("planted terms:", precision, recall)
    assert precision > 0.9 and recall > 0.95


# ------------------------------------------------------ suffix-array dedup


def brute_repeats(rows):
    order = sorted(range(len(rows)), key=lambda k: (2**63 - 1 if rows[k][0] is None else rows[k][0], int(hashlib.sha256((rows[k][1] or "").encode()).hexdigest()[:15], 16)))
    seen, out = set(), []
    for k in order:
        b = (rows[k][1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append(str((rows[k][0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("hot", [1000, 3])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(docs).collect()) == brute_repeats(rows_of(docs))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_copies_by_the_whole_digest(spark, monkeypatch):
    """Texts whose short keys all collide are no copies of each other."""
    monkeypatch.setattr(suffix_dedup, "KEY_DIGITS", 0)
    rows = [(i, syllables(60 + i % 9, 40 + i % 9)) for i in range(30)] + [(40, ""), (41, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(df).collect()) == brute_repeats(rows)


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 700), np.full(500, 97), rng.integers(97, 99, 300), np.zeros(240)]).astype(np.uint8)
    data = np.concatenate([data, data[100:900], data[:400]])
    starts = np.array([0, 130, 333, 700, 1500, 2200])
    ends = np.append(starts[1:], len(data))
    windows = np.concatenate([np.arange(a, b - 99) for a, b in zip(starts, ends)])
    seg = np.repeat(np.arange(len(starts)), ends - 99 - starts)
    raw = data.tobytes()
    want = [raw[p : p + 100] for p in windows]
    order, rank = suffix_dedup.window_order(data, windows)
    assert [want[i] for i in order] == sorted(want)
    got = suffix_dedup.common_prefixes(data, windows, seg, order, rank)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 100)
    true = [common(want[a], want[b]) for a, b in zip(order[:-1], order[1:])]
    assert got.tolist() == [0] + [x if x >= 64 else 0 for x in true] and len({x for x in true if 64 <= x < 100}) > 5
    first = {}
    for i, w in enumerate(want):
        first.setdefault(w, i)
    later, firsts = suffix_dedup.later_windows(data, windows, seg, None)
    assert sorted(firsts.tolist()) == sorted(first.values()) and later.tolist() == [first[w] != i for i, w in enumerate(want)]


def test_suffix_low_entropy(spark, monkeypatch):
    """Constant, periodic and zero bytes in long texts, an anchor in many pieces merged in two levels, and odd ids."""
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    monkeypatch.setattr(suffix_dedup, "FAN", 3)
    block = syllables(77, 40)
    rows = [(1, "a" * 20_000), (2, "a" * 3000 + "b" + "a" * 500), (3, "abc" * 3000), (4, "\x00" * 900 + "x"), (2**63 - 1, "zz" + "abc" * 60), (None, "yy" + "abc" * 60)]
    rows += [(100 + i, f"{syllables(200 + i, 12)} {block} {syllables(500 + i, 12)}") for i in range(120)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    assert sorted(str(tuple(r)) for r in suffix_dedup.remove_repeats(docs).collect()) == brute_repeats(rows)


def test_suffix_lists_of_a_hot_anchor_stay_small(spark, monkeypatch):
    """A phrase under 100 bytes in many contexts: its runs meet by what they share, so no list holds every window of them."""
    sizes, real = [], suffix_dedup.stored

    def spy(df, name):
        out = real(df, name)
        if "firsts" in out.columns:
            sizes.append(out.agg(F.coalesce(F.sum(F.octet_length("firsts")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    monkeypatch.setattr(suffix_dedup, "stored", spy)
    phrase = syllables(9, 40)[:80]
    rows = [(i, f"{syllables(100 + i % 90, 40)} {phrase} {syllables(900 + i, 40)}") for i in range(150)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows)
    assert sizes and sum(sizes) < sum(len(t) for _, t in rows)


def test_suffix_hot_runs_are_not_multiplied(spark, monkeypatch):
    """A copied passage in many documents and a phrase in many contexts: a run of a hot anchor makes two rows at most, a copy of one makes one."""
    docs = [(i, f"{syllables(1000 + i, 30)} {syllables(5, 150)} {syllables(3000 + i, 30)}") for i in range(200)]
    docs += [(500 + i, f"{syllables(5000 + i, 30)} {syllables(9, 40)[:60]} {syllables(7000 + i, 30)}") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    made, real = [], type(df).mapInArrow

    def spy(self, func, schema, *more):
        out = real(self, func, schema, *more)
        if "places" in out.columns and "bytes" in out.columns:
            copies = self.filter("copy").count() if "copy" in self.columns else 0
            made.append((self.count() - copies, copies, out.count()))
        return out

    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    monkeypatch.setattr(type(df), "mapInArrow", spy)
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(docs)
    assert made and all(rows <= 2 * own + copies for own, copies, rows in made)
    assert made[0][1] > 1000 and sum(rows for *_, rows in made) < 2 * sum(made[0][:2])


def test_suffix_hot_runs_that_differ(spark, monkeypatch):
    """Windows that repeat inside runs which all differ: anchors stay hot to the last and are merged from pieces."""
    pieces, real = [], suffix_dedup.stored

    def spy(df, name):
        out = real(df, name)
        if name == "suffix-merged":
            pieces.append(out.filter("range IS NOT NULL").count())
        return out

    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "FAN", 3)
    monkeypatch.setattr(suffix_dedup, "stored", spy)
    common = syllables(4, 60)[:104]
    rows = [(i, f"{syllables(1000 + i, 20)}{i % 7}{common}{chr(97 + i % 23)}{syllables(3000 + i, 20)}") for i in range(120)]
    rows += [(i % 9, syllables(4, 60)[: 97 + i % 8] + "é" * (i % 5)) for i in range(40)] + [(3, rows[0][1]), (3, rows[0][1]), (None, rows[5][1])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_repeats(rows)
    assert len(pieces) > 1 and pieces[0] > 0


@pytest.mark.parametrize("block", suffix_dedup.BLOCKS)
def test_suffix_longer_anchors(block):
    """Equal windows have equal longer anchors, every window is in one run, and a run of one place is cut in two at most."""
    rng = np.random.default_rng(block)
    raws = [bytes(rng.integers(97, 99, 400).astype(np.uint8)), b"ab" * 200, b"x" * 99, b"a" * 177, syllables(3, 90).encode()]
    raws += [raws[0][50:300], b"q" + raws[4][:300], b""]
    text, anchor, first, n, _ = suffix_dedup.anchor_runs(raws, block=block)
    known, seen = {}, []
    for t, a, s, m in zip(text.tolist(), anchor.tolist(), first.tolist(), n.tolist()):
        for w in range(s, s + m):
            seen.append((t, w))
            assert known.setdefault(raws[t][w : w + 100], a) == a
    assert sorted(seen) == [(t, w) for t, r in enumerate(raws) for w in range(len(r) - 99)]
    text, _, first, n, places = suffix_dedup.anchor_runs(raws)
    alone = [raws[t][s : s + m + 99] for t, s, m, p in zip(text.tolist(), first.tolist(), n.tolist(), places.tolist()) if p == 1]
    parts = np.bincount(suffix_dedup.anchor_runs(alone, block=block)[0])
    assert len(alone) > 20 and parts.max() <= -(-77 // block)


def test_suffix_long_constant_text(spark):
    """5 MB of one letter: runs of bounded length in pieces."""
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "a" * 5_000_000)], "doc_id long, text string")).first()
    assert (got["n_removed"], got["n_spans"], got["kept_sha256"]) == (4_999_999, 1, hashlib.sha256(b"a").hexdigest())
    with pytest.raises(TypeError):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# ------------------------------------------------------- nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 12))
    x[100:130] = x[0]
    x *= rng.uniform(0.2, 3, (900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 12), (2040, [math.nan] * 12), (2060, [1.0, None] * 6), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.Index(df, list_rows=50)
    queries = index.rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = defaultdict(list)
    for r in index.search(queries).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for i in range(0, 900, 20):
        score = x @ x[i]
        score[i] = -np.inf
        best = np.lexsort((np.arange(900), -score))[:20]
        hit += len({v for v, _ in got[i]} & set(best.tolist()))
        assert len(got[i]) == 20 and all(abs(s - x[v] @ x[i]) < 1e-9 for v, s in got[i])
    assert set(got) == set(range(0, 900, 20)) and hit >= 0.9 * 45 * 20
    assert ann.Index(df.limit(0)).search(queries.limit(0)).count() == 0
    exact = defaultdict(list)
    for r in index.search(queries, exact=True).orderBy("query_id", "rank").collect():
        exact[r["query_id"]].append(r["vec_id"])
    for i in range(0, 900, 20):
        score = (x * x[i]).sum(1)
        score[i] = -np.inf
        assert exact[i] == np.lexsort((np.arange(900), -score))[:20].tolist()
    few = ann.Index(df.limit(4))
    assert few.search(few.rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))).count() == 12


def ann_recall(spark, x, every, list_rows):
    """Share of the true 20 best found, for every ``every``-th row: small norms, large norms."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.Index(df, list_rows=list_rows)
    queries = index.rows.filter(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    got = defaultdict(set)
    for r in index.search(queries).collect():
        got[r["query_id"]].add(r["vec_id"])
    norm, hit = np.linalg.norm(x, axis=1), []
    for i in range(0, len(x), every):
        score = x @ x[i]
        score[i] = -np.inf
        hit.append((norm[i], len(got[i] & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20))
    hit = np.array(sorted(hit))[:, 1]
    return len(index.graph.value.c), hit[: len(hit) // 2].mean(), hit[len(hit) // 2 :].mean()


def test_ann_mixed_norms(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 12))
    x *= (np.exp(rng.uniform(-3, 1, 6000)) / np.linalg.norm(x, axis=1))[:, None]
    x[77] *= 20  # one outlier sets the largest norm
    n, small, large = ann_recall(spark, x, 30, 15)
    print("mixed norms:", n, small, large)
    assert n >= 300 and small >= 0.9 and large >= 0.9


def test_ann_many_lists(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, low, high = ann_recall(spark, x, 30, 15)
    print("many lists:", n, low, high)
    assert n >= 300 and (low + high) / 2 >= 0.9


def test_ann_shelves_and_copies(spark, monkeypatch):
    """A third of all rows share one vector, an id repeats more often than a vector has replicas, and shelves and query blocks are small."""
    monkeypatch.setattr(ann, "SHELF_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 4)
    monkeypatch.setattr(ann, "BLOCK_SCORES", 500)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6))
    x[::3] = x[0]
    ids = np.arange(600)
    ids[5:205:4] = 5  # fifty rows of one id
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    index = ann.Index(df, list_rows=20)
    got = defaultdict(list)
    queries = spark.createDataFrame([(int(i), x[i].tolist()) for i in (0, 3, 40, 100, 599)], "query_id long, q array<double>")
    for r in index.search(queries, exact=True).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for i in (0, 3, 40, 100, 599):
        best = {}
        for j, v in zip(ids.tolist(), (x * x[i]).sum(1).tolist()):
            if j != i:
                best[j] = max(best.get(j, -np.inf), v)
        assert got[i] == [j for j, _ in sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]]


# ---------------------------------------------------------- decontamination


def test_decontaminate(spark, docs, empty):
    items = [(1, syllables(1, 20)), (10, "one two"), (2, syllables(12, 40)), (3, None), (4, "..."), (None, syllables(13, 15)), (2, syllables(15, 14)), (5, " ".join(syllables(2, 120).split()[40:70]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def brute(t):
        w, hit, found = words(t), set(), set()
        for i, it in items:
            v = words(it)
            n = min(13, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
            for p in range(len(w) - n + 1):
                if wins and tuple(w[p : p + n]) in wins:
                    hit.update(range(p, p + n))
                    found |= {str(i)} if i is not None else set()
        return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)

    want = sorted(str((i, *brute(t))) for i, t in rows_of(docs))
    for size in (1 << 25, 200):
        got = decontaminate.decontaminate(docs, benchmark, block_bytes=size).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


def test_near_phrases(spark):
    w = syllables(8, 13).split()
    changed = [*w[:4], "other", *w[5:]]
    docs = spark.createDataFrame([(1, " ".join(changed))], "doc_id long, text string")
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")).first()
    assert out["items"] == [] and out["near_items"] == ["9"]


def test_near_phrases_in_one_slice(spark):
    w = [f"term{i}" for i in range(13)]
    texts = {1: [*w[:4], "other", *w[5:]], 2: w, 3: w[2:], 4: ["lead", "in", *w[:11]], 5: ["no", "match"], 6: [*w[:3], "x", "y", "z", *w[6:]], 7: [*w[:6], "put", "in", *w[6:]], 8: [*w[:7], *w[8:], "tail"]}
    benchmark = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    for order in ([1, 2, 3, 4, 5, 6, 7, 8], [3, 5, 8, 2, 6, 1, 4, 7]):  # 3 starts before its text, also as the first one
        docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in order], "doc_id long, text string").coalesce(1)
        index = decontaminate.build_index(docs)
        assert index.count() == 1
        got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontaminate.search_index(index, benchmark).collect()}
        assert got == {i: (["9"] if i == 2 else [], ["9"] if i in (1, 3, 4, 7, 8) else []) for i in texts}


def test_index_of_long_and_dense_texts(spark):
    """One text of 2 MB that repeats a window, an item of one common word, and an extra column named like the output."""
    w = [f"t{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(w * 50_000), "x"), (2, "the " * 1000, "y"), (2, "the " * 1000, "y")], "doc_id long, text string, n_hit string")
    benchmark = spark.createDataFrame([(1, " ".join(w)), (2, "the")], "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, benchmark).collect())
    assert got == [(1, 650_000, 650_000, ["1"]), (2, 1000, 1000, ["2"]), (2, 1000, 1000, ["2"])]
    clean = decontaminate.clean_documents(docs.unionByName(docs.limit(1).selectExpr("9L AS doc_id", "'fine' AS text", "n_hit")), benchmark)
    assert [tuple(r) for r in clean.collect()] == [(9, "fine", "x")]


# ------------------------------------------------------------------ mixing


def test_mix(spark, docs, empty):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None if i % 5 == 4 else f"s{min(i % 5, 2)}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_documents(df).collect()
    size, target, taken = Counter(), {}, Counter()
    for r in got:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 3
    again = mixing.mix_documents(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    assert mixing.mix_documents(docs).count() == docs.count() and mixing.mix_documents(empty).count() == 0
    assert mixing.resample(df).count() == sum(r["copies"] for r in got)


def test_inclusion_frequencies(spark):
    """Over many seeds a document is taken as often as its size says, within a source and across sizes."""
    rows = [(i, " ".join(["w"] * (1 + i % 4 * 20)), "s0" if i % 3 else "s1") for i in range(400)] + [(None, "w " * k, "s1") for k in (5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seeds, taken = 16, Counter()
    for seed in range(seeds):
        for r in mixing.mix_documents(df, seed=f"t{seed}").filter("source = 's0'").collect():
            taken[r["size"]] += r["copies"] / seeds
        release(spark)
    number = Counter(1 + i % 4 * 20 for i in range(400) if i % 3)
    target = next(r["target"] for r in mixing.mix_documents(df).filter("source = 's0'").collect())
    free = lambda c: {s: min(3.0, c / math.sqrt(s)) for s in number}
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(number[s] * s * v for s, v in free(c).items()) < target else (low, c)
    for s, want in free(low).items():
        assert abs(taken[s] / number[s] - want) < 0.06, (s, taken[s] / number[s], want)
    assert taken[1] / number[1] > taken[61] / number[61] + 0.3
    ids = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert mixing.resample(ids).count() == sum(r["copies"] for r in mixing.mix_documents(ids).collect())


def test_sources_are_numbered_in_ranges(spark):
    names = [f"s{i:04d}" for i in range(500)] + [None, "", "\U0001f600", "é", "z"]
    sizes = spark.createDataFrame([(n, 1 + len(n or "")) for n in names], "source string, source_size long").repartition(6)
    want = {n: k for k, n in enumerate(sorted((n for n in names if n is not None), key=lambda n: n.encode()))} | {None: len(names) - 1}
    assert {r["source"]: r["turn"] for r in mixing.numbered_sources(sizes).collect()} == want


def test_targets_with_a_small_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got[None] == 0 and abs(got["b"] * 1.5 - got["c"]) < 1e-6 and abs(sum(got.values()) - 2010) < 1e-6


# ------------------------------------------------------------------ shared


def test_words_agree():
    for t in ("A b-c É_x 9\x7fz", "", None, "İK ſ"):
        assert [w.decode() for w in words_bytes(t)] == words(t)
