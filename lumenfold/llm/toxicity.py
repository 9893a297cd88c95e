"""Toxicity scores: gradient-boosted trees over dense features, calibrated.

Two small models are learned from labelled rows, never from more than
``max_train_rows`` of them (those with the smallest hash of their id, then of
their text; equal rows count once):

* a lexicon: words and word beginnings of four to six bytes whose presence
  marks a document as toxic, counted over the training rows by Spark;
* boosted regression trees of the logistic loss over features of a whole text:
  lexicon densities, lexicon words near second-person pronouns, capitals,
  punctuation and obfuscation rates. An isotonic fit of cross-fitted margins
  turns their output into probabilities.

Both are a few kilobytes and are broadcast; every document is then scored by
an Arrow function without a shuffle, and only its score leaves Python. Ids, sources, languages and labels are no
features.

Defined cases: null and empty texts are scored like a text without words; rows
without an id are scored, never learned from; several labels of an id count as
their maximum; null labels are ignored; with fewer than ``MIN_CLASS`` training
rows of either class every score is the smoothed share of toxic rows; an empty
table gives no rows. A column ``score`` of the input is replaced by
:func:`score_documents` and kept by :func:`clean_documents`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_TABLE, row_and, row_columns, small_batches, stored, table

MAX_TRAIN_ROWS = 20_000
#: Tokens of toxic training rows that are weighed, commonest first, and entries of the lexicon, heaviest first.
MAX_TOKENS = 50_000
MAX_LEXICON = 400
MIN_CLASS = 8
THRESHOLD = 0.7

#: General terms of abuse, which count beside the learned lexicon.
SEED_LEXICON = frozenset(b"idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown dumb ugly hate kill shut jerk fool bastard crap damn".split())
#: Second-person pronouns of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros vuestra tus".encode().split())
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = bytes.maketrans(b"@4310$5!7", b"aaeiossit")

UPPERCASE = bytes(range(65, 91))
PUNCTUATION = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""
OBFUSCATED = re.compile(rb"(?<![A-Za-z0-9])[A-Za-z]+[@$0-9!*._-]+[A-Za-z][A-Za-z@$0-9!*._-]*")
INNER = re.compile(rb"[*._-]")

FEATURES = ("lexicon_density", "lexicon_count", "lexicon_distinct", "lexicon_best", "seed_density", "near_second_person", "second_person_rate", "capital_rate", "shouted_rate", "exclamation_rate", "punctuation_rate", "obfuscated_rate", "obfuscated_lexicon", "log_words")


def tokens_of(word: bytes) -> tuple[bytes, ...]:
    """A word's lexicon entries: itself (marked by a closing space) and its beginnings."""
    return (word + b" ", *(word[:n] for n in (4, 5, 6) if len(word) >= n))


class Lexicon:
    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.heads = frozenset(t.rstrip(b" ")[:4] for t in weights) | frozenset(w[:4] for w in SEED_LEXICON)

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        return max(get(t, 0.0) for t in tokens_of(word))


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_TABLE).split()
    n, size = max(1, len(words)), max(1, len(raw))
    heads = lexicon.heads
    hits, seeds, best, distinct, total, second = [], 0, 0.0, set(), 0.0, 0
    for i, w in enumerate(words):
        if w in SECOND_PERSON:
            second += 1
        if w[:4] in heads:
            v = lexicon.weight(w)
            seeds += w in SEED_LEXICON
            if v > 0 or w in SEED_LEXICON:
                hits.append(i)
                distinct.add(w)
                total += v
                best = max(best, v)
    near = sum(1 for i in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - 5) : i + 6]))
    capitals = len(raw) - len(raw.translate(None, UPPERCASE))
    marks = len(raw) - len(raw.translate(None, PUNCTUATION))
    odd = odd_hits = 0
    for m in OBFUSCATED.finditer(raw):
        odd += 1
        plain = INNER.sub(b"", m[0].translate(LOOKALIKES)).lower()
        odd_hits += plain in SEED_LEXICON or (plain[:4] in heads and lexicon.weight(plain) > 0)
    shouted = capitals > size * 0.3
    return [
        len(hits) / n, math.log1p(len(hits)), math.log1p(len(distinct)), best, seeds / n, near / n, second / n, capitals / size,
        float(shouted), raw.count(b"!") / n, marks / size, odd / n, math.log1p(odd_hits), math.log1p(len(words)),
    ]


# ---------------------------------------------------------------- the models


class Trees:
    """Boosted regression trees of depth ``depth`` on quantile bins, logistic loss."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        width = self.bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = math.log(share / (1 - share))
        margin = np.full(n, self.base)
        self.trees = []
        leaf0 = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(leaf0, np.int64), np.full(leaf0, width, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                key = (node - first)[:, None] * (m * width) + np.arange(m) * width + binned
                gs = np.bincount(key.ravel(), np.repeat(g, m), count * m * width).reshape(count, m, width).cumsum(2)
                hs = np.bincount(key.ravel(), np.repeat(h, m), count * m * width).reshape(count, m, width).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                flat = gain.reshape(count, -1)
                top = flat.argmax(1)
                split = flat[np.arange(count), top] > 1e-6
                feature[first : first + count] = top // width
                cut[first : first + count] = np.where(split, top % width, width)
                node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
            leaf = node - leaf0
            value = self.rate * np.bincount(leaf, g, leaf0 + 1) / (np.bincount(leaf, h, leaf0 + 1) + 1)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, out, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean margin, smoothed share) of a monotone fit."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # rows, positives, sum of margins
    for m, v in zip(margin[order], y[order]):
        blocks.append([1.0, float(v), float(m)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[0] for b in blocks])
    share = np.array([(b[1] + 0.02) / (b[0] + 0.04) for b in blocks])
    return knots, np.maximum.accumulate(share)


class Model:
    """Lexicon, trees and calibration; without trees every score is ``prior``."""

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, folds: int = 4):
        self.lexicon, self.trees, self.rows = lexicon, None, len(y)
        self.prior = float((y.sum() + 0.5) / (len(y) + 10)) if len(y) else 0.05
        if min(y.sum(), len(y) - y.sum()) < MIN_CLASS:
            return
        fold = np.empty(len(y), np.int64)  # both classes in every fold
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            fold[own] = np.arange(len(own)) % folds
        held = np.empty(len(y))
        for k in range(folds):
            held[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.knots, self.share = isotonic(held, y)
        self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.interp(self.trees.margin(x), self.knots, self.share)


def train_lexicon(sample: DataFrame, max_lexicon: int = MAX_LEXICON) -> Lexicon:
    """sample: columns text and toxic (0 or 1), bounded by the caller."""

    def counts(wanted=None):
        def run(batches):
            found = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    words = set((text or "").encode("utf-8", "surrogatepass").translate(WORD_TABLE).split())
                    tokens = {t for w in words for t in tokens_of(w)}
                    found.update(tokens if wanted is None else tokens & wanted.value)
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

        return run

    by_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = by_class.get(1, 0), by_class.get(0, 0)
    if min(bad, good) < MIN_CLASS:
        return Lexicon({})
    least = max(3, bad // 400)
    one, zero = sample.filter("toxic = 1").select("text"), sample.filter("toxic = 0").select("text")
    total = lambda df: df.groupBy("token").agg(F.sum("n").alias("n"))
    often = {bytes(r[0]): r[1] for r in total(one.mapInArrow(counts(), "token binary, n long")).filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(MAX_TOKENS).collect()}
    wanted = sample.sparkSession.sparkContext.broadcast(frozenset(often))
    other = {bytes(r[0]): r[1] for r in total(zero.mapInArrow(counts(wanted), "token binary, n long")).collect()}
    weights = {}
    for token, n in often.items():
        m = other.get(token, 0)
        # a cautious estimate of how much likelier the token is in toxic texts
        odds = math.log((n - 0.5 * math.sqrt(n) + 0.1) / (bad + 1)) - math.log((m + math.sqrt(m) + 0.5) / (good + 1))
        if odds > 2.5:
            weights[token] = odds
    kept = sorted(weights.items(), key=lambda kv: (-kv[1], kv[0]))[:max_lexicon]
    return Lexicon(dict(kept))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """docs, labels (doc_id, toxic): both cut to training rows by the caller."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # at most max_train_rows pairs of an id and a label, so they are broadcast
    marks = marks.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(max_train_rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).join(F.broadcast(marks.filter("toxic IN (0, 1)")), "doc_id")
    # repeated ids could give more rows than ids: of the distinct ones, so many as well
    keys = rows.select("doc_id", "key").distinct().orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "key").limit(max_train_rows)
    once = rows.join(F.broadcast(keys), ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = stored(once.select("text", "toxic"), "toxicity-sample")
    lexicon = train_lexicon(sample)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        for batch in batches:
            x = [features(t, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = sample.mapInArrow(run, "x array<double>, toxic int").collect()
    got.sort(key=lambda r: (tuple(r[0]), r[1]))  # the order of rows must not matter
    x = np.array([r[0] for r in got], float).reshape(len(got), len(FEATURES))
    return Model(lexicon, x, np.array([r[1] for r in got], float))


def scorer(spark, model: Model):
    """The model as a function of a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py(), shared.value.lexicon) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x))

    return score.asNondeterministic()  # a filter on the score must not score again


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every document, and its ``score``."""
    score = scorer(docs.sparkSession, model)(F.col(text_col))
    return docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != "score"], score.alias("score"))


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns as they are."""
    scored = row_and(docs, scorer(docs.sparkSession, model)(F.col(text_col)).alias("_score"))
    return scored.filter(F.col("_score") < threshold).select(*row_columns(docs))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train_on_folds(docs: DataFrame, labels: DataFrame) -> Model:
    seen = F.coalesce(fold_of(F.col("doc_id")) != 1, F.lit(False))
    return train(docs.filter(seen), labels.filter(seen))


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train_on_folds(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model, keep=("doc_id",))
    held = F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
