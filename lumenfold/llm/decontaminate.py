"""Benchmark decontamination with a distributed positional inverted index.

1. :func:`build_index` tokenises all documents once and stores the posting
   lists: one row for a slice of documents (about ``INDEX_BYTES`` of text),
   with the sorted hashes of its terms (64 bits), the length of each posting
   list and the positions, ascending. The index is partitioned by document, so
   nothing is shuffled, a frequent word fills no partition, and the memory of a
   slice is bounded by its text. Any number of benchmarks can be looked up.
2. Items become windows of terms. How often each benchmark term occurs in the
   whole corpus is summed first, inside the tasks.
3. :func:`search_index` looks each window up from its rarest terms of the
   corpus, one more of them than may differ, so that every match agrees with
   one: the posting list of such a term, shifted by its place, is intersected
   by binary search with the shifted lists of the other terms, rarest first.
   What survives with every term in place is an exact phrase match. If at
   least ``near_terms`` of the terms stand within ``SLACK`` words of their
   place, it is a proximity match: words may be changed, put in or left out.

The benchmark is the side that every task needs: eight bytes a word and
fifteen a window. Its size is checked; items are dealt into blocks of about
``block_bytes`` of text, each block is one pass over the index, and the passes'
hits are united.

Defined cases: a null or empty document has no words, so no hits and is not
contaminated; null or wordless items have no window; repeated documents are
each judged; items with a null id hit words but are not listed; equal ids with
several texts are one item; empty tables give no rows, or rows without hits;
extra columns of documents stay in :func:`clean_documents` and are left out
otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import fits_broadcast, row_and, row_columns, small_batches, stored, table, text_slices
from lumenfold.llm.jaccard_join import word_hashes

WINDOW = 13
NEAR_TERMS = 11
#: Words by which a term of a proximity match may stand off its place.
SLACK = 2
BLOCK_BYTES = 8 << 20
#: A document is contaminated if hit words are at least one in this many.
HIT_SHARE = 20
#: Text of one row of the index.
INDEX_BYTES = 1 << 18
#: Free positions between two documents of a slice, more than any match can span.
GAP = 64
#: Candidates of one step of the intersection.
STEP = 1 << 16


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of ``docs``: slice, docs (doc_id, key, n_words each), terms, counts, positions."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))

    def post(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in text_slices(batch, "text", INDEX_BYTES):
                words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()])
                positions = np.arange(len(words)) + np.repeat(np.arange(len(counts)) * GAP, counts)
                order = np.argsort(words, kind="stable")
                terms, lengths = np.unique(words[order], return_counts=True)
                about = pa.StructArray.from_arrays([piece.column("doc_id"), piece.column("key"), pa.array(counts.astype(np.int64))], ["doc_id", "key", "n_words"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(about)], pa.int32()), about),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (terms, lengths.astype(np.uint32), positions[order].astype(np.uint32))]],
                    ["slice", "docs", "terms", "counts", "positions"])
                number += 1

    kind = rows.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(post, f"slice long, docs array<struct<doc_id:{kind}, key:long, n_words:long>>, terms binary, counts binary, positions binary"), "postings")


class Phrases:
    """The windows of one block of items, as places in one array of terms."""

    def __init__(self, items, window: int):
        items = [(None if i is None else str(i), t) for i, t in items]
        words, counts = word_hashes([t.encode("utf-8", "surrogatepass") for _, t in items])
        self.ids, self.window = [i for i, _ in items], window
        #: distinct terms, and the term number of every word
        self.terms, number = np.unique(words, return_inverse=True)
        self.words = number.astype(np.int32)
        per_item = np.where(counts > 0, np.maximum(1, counts - window + 1), 0)
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), per_item)
        first = np.repeat(np.cumsum(counts) - counts, per_item)
        self.start = (first + np.arange(len(first)) - np.repeat(np.cumsum(per_item) - per_item, per_item)).astype(np.int32)
        self.length = np.minimum(window, counts[self.item]).astype(np.int8)

    def order(self, frequency: np.ndarray) -> None:
        """Keep the places of each window, its rarest term of the corpus first, then the leftmost."""
        places = np.arange(self.window, dtype=np.int32)
        self.rarity = np.empty((len(self.start), self.window), np.int8)
        for a in range(0, len(self.start), STEP):
            inside = places < self.length[a : a + STEP, None]
            at = np.where(inside, self.start[a : a + STEP, None] + places, 0)
            self.rarity[a : a + STEP] = np.argsort(np.where(inside, frequency[self.words[at]], np.iinfo(np.int64).max), axis=1, kind="stable")


def _arrays(batch, i: int):
    """Terms, list lengths and positions of row i of an index batch."""
    return (np.frombuffer(batch.column(c)[i].as_buffer() or b"", t) for c, t in (("terms", np.uint64), ("counts", np.uint32), ("positions", np.uint32)))


def term_counts(index: DataFrame, phrases) -> np.ndarray:
    """Occurrences of each term of the (broadcast) phrases in the whole index; one short row a task."""

    def run(batches):
        total = np.zeros(len(phrases.value.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, counts, _ = _arrays(batch, i)
                both, here, there = np.intersect1d(phrases.value.terms, terms, assume_unique=True, return_indices=True)
                total[here] += counts[there]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(phrases.value.terms), np.int64)
    for r in index.select("terms", "counts", "positions").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def find_matches(phrases: Phrases, terms, counts, positions, near_terms: int):
    """Exact matches (window, start) and near ones (window, place of the seed) in one slice of the index."""
    none = np.empty((0, 2), np.int64)
    w = phrases.window
    if not len(phrases.start) or not len(terms):
        return none, none
    # where each benchmark term's list lies among the slice's lists
    at = np.minimum(np.searchsorted(terms, phrases.terms), len(terms) - 1)
    there = terms[at] == phrases.terms
    rank = np.where(there, at, 0)[phrases.words].astype(np.int64)
    absent = np.concatenate([[0], np.cumsum(~there[phrases.words])])
    lacking = absent[phrases.start + phrases.length] - absent[phrases.start]
    able = np.flatnonzero(lacking <= np.where(phrases.length == w, max(0, w - near_terms), 0))
    if not len(able):
        return none, none
    heads = np.cumsum(counts, dtype=np.int64) - counts
    #: all posting lists as one sorted array
    lists = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | positions
    present = there[phrases.words]
    exact, near = [none], [none]
    for seed in range(max(1, w - near_terms + 1)):
        own = able if seed == 0 else able[phrases.length[able] == w]
        place = phrases.rarity[own, seed].astype(np.int64)
        word = phrases.start[own] + place
        own, place, word = own[present[word]], place[present[word]], word[present[word]]
        many = counts[rank[word]].astype(np.int64)
        cuts = np.searchsorted(np.cumsum(many), np.arange(STEP, many.sum() + STEP, STEP), "left") + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            n = many[a:b]
            if not len(n):
                continue
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            win, off = np.repeat(own[a:b], n), np.repeat(place[a:b], n)
            start = positions[np.repeat(heads[rank[word[a:b]]], n) + within].astype(np.int64) - off
            strict, close = np.ones(len(win), bool), np.zeros(len(win), np.int64)
            for k in range(w):
                j = phrases.rarity[win, k].astype(np.int64)
                inside = k < phrases.length[win]
                v = np.where(inside, phrases.start[win] + j, 0)
                key = (rank[v] << 32) + start + j
                low = np.searchsorted(lists, key - SLACK)
                got = lists[np.minimum(low, len(lists) - 1)]
                by = inside & present[v] & (low < len(lists)) & (got <= key + SLACK) & (got >= rank[v] << 32)
                put = np.searchsorted(lists, key)
                strict &= ~inside | (by & (lists[np.minimum(put, len(lists) - 1)] == key))
                close += by
                full = phrases.length[win] == w
                alive = strict | (full & (close + w - 1 - k >= near_terms))
                win, off, start, strict, close = win[alive], off[alive], start[alive], strict[alive], close[alive]
            exact.append(np.stack([win[strict], start[strict]], 1))
            near.append(np.stack([win[~strict], (start + off)[~strict]], 1))
    return np.unique(np.concatenate(exact), axis=0), np.unique(np.concatenate(near), axis=0)


HITS = "slice long, ord int, spans array<struct<start:long, stop:long>>, items array<string>, near_items array<string>"


def block_hits(index: DataFrame, phrases, near_terms: int) -> DataFrame:
    """One row (HITS) for each document that a window of the (broadcast) phrases meets."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                p = phrases.value
                exact, near = find_matches(p, *_arrays(batch, i), near_terms)
                if not len(exact) and not len(near):
                    continue
                n_words = batch.column("docs")[i].values.field("n_words").to_numpy()
                begins = np.cumsum(n_words + GAP) - n_words - GAP
                held, met, marks = {}, {}, {}
                for found, into in ((exact, held), (near, met)):
                    ords = np.searchsorted(begins, found[:, 1], "right") - 1
                    for o, item in np.unique(np.stack([ords, p.item[found[:, 0]]], 1), axis=0).tolist():
                        into.setdefault(o, set()).add(p.ids[item])
                    if into is held:
                        order = np.argsort(found[:, 1], kind="stable")
                        for o, s, n in zip(ords[order].tolist(), found[order, 1].tolist(), p.length[found[order, 0]].tolist()):
                            s -= int(begins[o])
                            own = marks.setdefault(o, [])
                            if own and own[-1]["stop"] >= s:
                                own[-1]["stop"] = max(own[-1]["stop"], s + n)
                            else:
                                own.append({"start": s, "stop": s + n})
                docs = sorted({*held, *met})
                named = lambda x: sorted(v for v in x if v is not None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("slice")[i].as_py()] * len(docs), pa.int64()), pa.array(docs, pa.int32()), pa.array([marks.get(d, []) for d in docs], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                     *[pa.array([named(x.get(d, ())) for d in docs], pa.list_(pa.string())) for x in (held, met)]],
                    ["slice", "ord", "spans", "items", "near_items"])

    return index.mapInArrow(run, HITS)


def search_index(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, near_terms: int = NEAR_TERMS, hit_share: int = HIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, key (hash of the text), n_words, n_hit, items, near_items and contaminated of every indexed document."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("text"), F.lit(n_blocks))
    hits = None
    for b in range(n_blocks):
        phrases = Phrases([tuple(r) for r in items.filter(block == b).collect()], window)
        bare = index.sparkSession.sparkContext.broadcast(phrases)
        phrases.order(term_counts(index, bare))
        bare.unpersist()
        found = block_hits(index, index.sparkSession.sparkContext.broadcast(phrases), near_terms)
        if n_blocks > 1:
            found = stored(found, "block-hits")
        hits = found if hits is None else hits.union(found)
    merged = hits.groupBy("slice", "ord").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])
    # spans of several blocks may overlap: count what each adds behind the ones before it
    walk = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["at"], s["start"]))).alias("n")),
    )["n"]
    exact = F.array_sort(F.array_distinct("items"))
    merged = merged.select("slice", "ord", walk.alias("n_hit"), exact.alias("items"), F.array_sort(F.array_except("near_items", exact)).alias("near_items"))
    judged = index.select("slice", F.posexplode("docs").alias("ord", "doc")).join(merged, ["slice", "ord"], "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return judged.select(
        "doc.doc_id", "doc.key", "doc.n_words", n_hit.alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"),
        ((n_hit > 0) & (n_hit * hit_share >= F.col("doc.n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """:func:`search_index` over an index of ``docs``."""
    return search_index(build_index(docs, id_col, text_col), benchmark, **kw)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = stored(decontaminate(docs, benchmark, id_col, text_col, **kw).filter("contaminated").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct(), "contaminated")
    hint = F.broadcast if fits_broadcast(bad.count(), 64) else (lambda df: df)
    rows = row_and(docs, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).alias("_id"))
    return rows.join(hint(bad), (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left_anti").select(*row_columns(docs))


def op9_decontaminate(spark, sf_dir):
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
    FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
    FROM d, lens, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n),
m AS (SELECT rid, i, bw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM m, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
