"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time.

1. :func:`build_postings` tokenises all documents once and stores posting
   lists: one row for a slice of documents (about ``SLICE_BYTES`` of text) with
   the sorted hashes of its terms (64 bits, so two words of one hash would
   count as one), the length of each list, and document and occurrences of
   each posting. It is partitioned by document: nothing is shuffled, a frequent
   word fills no partition, and any number of query sets can be looked up.
2. :func:`corpus_statistics` sums N, L and the document frequencies of the
   query terms over all slices, inside the tasks.
3. :func:`slice_best` answers one query on one slice. The shortest lists are
   summed term at a time into accumulators; these then act as a single iterator
   with one bound, the largest accumulator, beside the long lists with theirs.
   Documents are walked in ranges: iterators whose bounds together stay under
   the floor (the score of the worst of the best documents so far) yield no
   candidates, they are only probed by binary search for the candidates of the
   others, and a candidate goes as soon as what is left cannot lift it to the
   floor. The floor of a query is carried from slice to slice of a task.
4. Each task leaves at most ``top`` rows a query; two windows merge them.

Scores are exact 64-bit integers. With N documents that hold a term, L terms in
all, n terms of a document, df documents with a term and tf occurrences:
w = floor(1000 ln((2N+2) / (2df+1))), m = 10 + (90 n N) div L, and a query sums
w * ((10^9 tf) div (1000 tf + 8 m)) over its distinct terms.

The queries are the side every task needs: items are dealt into blocks of about
``block_bytes`` of text, each block is one pass over the postings.

Defined cases: null, empty or wordless documents count nowhere and are never
found; null, empty or wordless items have no rows; an item shares its rank list
with no other, even one of the same id or text; repeated documents are each
ranked; equal scores go by ascending id, null first; empty tables give no rows;
extra columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumenfold.llm.common import batches_of, stored, table, text_slices
from lumenfold.llm.jaccard_join import word_hashes

TOP = 10
#: Text of one slice of the postings, and of one step of tokenising.
SLICE_BYTES, STEP_BYTES = 4 << 20, 1 << 18
#: Text of the items of one pass.
BLOCK_BYTES = 8 << 20
#: Short lists are those, shortest first, that together hold at most this share of a slice's documents.
SHORT_SHARE = 0.5
#: Documents of one range of the walk.
RANGE_DOCS = 512
#: Parts into which a query's rows are dealt before the last merge.
MERGE_PARTS = 32
#: Scale of the terms' weights, of the occurrences and of the lengths (fixed values).
WEIGHT, GAIN, TF, LENGTH, FLAT, SLOPE = 1000, 10**9, 1000, 8, 10, 90


def build_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The stored posting lists of ``docs``: ids, lengths, terms, counts, ords, tfs of each slice."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def row(ids, lengths, lists):
        terms, ords, tfs = (np.concatenate(x) for x in zip(*lists))
        order = np.argsort(terms, kind="stable")  # pieces come by document, so the lists stay ascending
        names, counts = np.unique(terms[order], return_counts=True)
        packed = [np.concatenate(lengths).astype(np.uint32), names, counts.astype(np.uint32), ords[order].astype(np.uint32), tfs[order].astype(np.uint32)]
        whole = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), *[pa.array([x.tobytes()], pa.binary()) for x in packed]],
            ["ids", "lengths", "terms", "counts", "ords", "tfs"])

    def post(batches):
        ids, lengths, lists, docs_held, held = [], [], [], 0, 0
        for batch in batches:
            for piece in text_slices(batch, "text", STEP_BYTES):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in piece.column("text").to_pylist()]
                words, counts = word_hashes(raws)
                doc = np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(words, kind="stable")
                words, doc = words[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])[: len(words)])
                ids.append(piece.column("doc_id"))
                lengths.append(counts)
                lists.append((words[first], doc[first] + docs_held, np.diff(np.append(first, len(words)))))
                docs_held, held = docs_held + len(counts), held + sum(map(len, raws))
                if held >= slice_bytes:
                    yield row(ids, lengths, lists)
                    ids, lengths, lists, docs_held, held = [], [], [], 0, 0
        if ids:
            yield row(ids, lengths, lists)

    with batches_of(docs.sparkSession):
        return stored(rows.mapInArrow(post, f"ids array<{kind.simpleString()}>, lengths binary, terms binary, counts binary, ords binary, tfs binary"), "lexical")


def _column(batch, name: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_buffer() or b"", np.uint64 if name == "terms" else np.uint32)


class Queries:
    """One block of items: their distinct terms as places in one sorted vocabulary."""

    def __init__(self, rows):
        self.numbers, self.ids = [r[0] for r in rows], [r[1] for r in rows]
        words, counts = word_hashes([r[2].encode("utf-8", "surrogatepass") for r in rows])
        self.vocabulary, place = np.unique(words, return_inverse=True)
        ends = np.cumsum(counts)
        self.terms = [np.unique(place[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist())]
        self.n_docs, self.n_terms, self.weights = 0, 0, np.zeros(len(self.vocabulary), np.int64)

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.floor(WEIGHT * np.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def corpus_statistics(postings: DataFrame, queries) -> tuple[int, int, np.ndarray]:
    """N, L, and the document frequency of each term of the (broadcast) queries; a task leaves one row a term at most."""

    def run(batches):
        vocabulary = queries.value.vocabulary
        total, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, terms, counts = (_column(batch, c, i) for c in ("lengths", "terms", "counts"))
                n_docs, n_terms = n_docs + int(np.count_nonzero(lengths)), n_terms + int(lengths.sum(dtype=np.int64))
                _, here, there = np.intersect1d(vocabulary, terms, assume_unique=True, return_indices=True)
                total[here] += counts[there]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([n_docs, n_terms, *total[at].tolist()], pa.int64())], ["term", "n"])

    sums = {r["term"]: r["n"] for r in postings.select("lengths", "terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(len(queries.value.vocabulary), np.int64)
    for term, n in sums.items():
        if term >= 0:
            df[term] = n
    return sums.get(-1, 0), sums.get(-2, 0), df


def slice_best(lists, n_docs: int, top: int, floor: int, short_share: float = SHORT_SHARE, range_docs: int = RANGE_DOCS):
    """Documents that may be among the ``top`` of a slice, with their whole scores.

    lists: (ascending documents, scores) of each term of the query. Scores under
    ``floor`` (at least 1) may be left out.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    n_short = int(np.searchsorted(np.cumsum([len(d) for d, _ in lists]), short_share * n_docs, "right"))
    iterators = [(d, s, int(s.max())) for d, s in lists[n_short:]]
    if n_short:  # term at a time
        docs, place = np.unique(np.concatenate([d for d, _ in lists[:n_short]]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, place, np.concatenate([s for _, s in lists[:n_short]]))
        iterators.append((docs, sums, int(sums.max())))
    iterators.sort(key=lambda x: x[2])
    upto = np.cumsum([b for _, _, b in iterators])  # what the iterators up to each one can give together
    floor, best, found = max(floor, 1), np.zeros(0, np.int64), []
    for low in range(0, n_docs, range_docs):  # document at a time, in ranges
        idle = int(np.searchsorted(upto, floor, "left"))
        if idle == len(iterators):
            break  # no document of this slice can reach the floor any more
        score = np.zeros(range_docs, np.int64)
        for d, s, _ in iterators[idle:]:
            a, b = np.searchsorted(d, (low, low + range_docs))
            score[d[a:b] - low] += s[a:b]
        open_ = np.flatnonzero(score)
        for j in range(idle - 1, -1, -1):
            open_ = open_[score[open_] + upto[j] >= floor]
            if not len(open_):
                break
            d, s, _ = iterators[j]
            at = np.minimum(np.searchsorted(d, open_ + low), len(d) - 1)
            hit = d[at] == open_ + low
            score[open_[hit]] += s[at[hit]]
        open_ = open_[score[open_] >= floor]
        if len(open_):
            found.append((open_ + low, score[open_]))
            best = np.sort(np.concatenate([best, score[open_]]))[-top:]
            if len(best) == top:
                floor = max(floor, int(best[0]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs, scores = (np.concatenate(x) for x in zip(*found))
    return docs[scores >= floor], scores[scores >= floor]


def block_best(postings: DataFrame, queries, item_type, top: int) -> DataFrame:
    """item, item_id, doc_id and score: at most ``top`` rows a task for each of the (broadcast) queries."""
    id_type = postings.schema["ids"].dataType.elementType

    def run(batches):
        q = queries.value
        best = [[] for _ in q.terms]  # (-score, order of the id, id), ascending
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, terms, counts, ords, tfs = (_column(batch, c, i) for c in ("lengths", "terms", "counts", "ords", "tfs"))
                if not len(terms) or not q.n_terms:
                    continue
                at = np.minimum(np.searchsorted(terms, q.vocabulary), len(terms) - 1)
                there = np.flatnonzero(terms[at] == q.vocabulary)
                if not len(there):
                    continue
                # the postings of all query terms and their scores, one list after another
                size = counts[at[there]].astype(np.int64)
                heads = (np.cumsum(counts, dtype=np.int64) - counts)[at[there]]
                ends = np.cumsum(size)
                pick = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(heads, size)
                doc, tf = ords[pick].astype(np.int64), tfs[pick].astype(np.int64)
                m = FLAT + SLOPE * lengths.astype(np.int64) * q.n_docs // q.n_terms
                score = np.repeat(q.weights[there], size) * (GAIN * tf // (TF * tf + LENGTH * m[doc]))
                place = np.full(len(q.vocabulary), -1)
                place[there] = np.arange(len(there))
                ids = batch.column("ids")[i].values
                for k, own in enumerate(q.terms):
                    own = place[own]
                    spans = [slice(ends[j] - size[j], ends[j]) for j in own[own >= 0].tolist()]
                    if not spans:
                        continue
                    floor = -best[k][-1][0] if len(best[k]) == top else 1
                    found, sums = slice_best([(doc[s], score[s]) for s in spans], len(lengths), top, floor)
                    if len(found):
                        names = ids.take(pa.array(found)).to_pylist()
                        best[k] = heapq.nsmallest(top, best[k] + [(-s, n is not None, n) for s, n in zip(sums.tolist(), names)])
        rows = [(q.numbers[k], q.ids[k], n, -s) for k, own in enumerate(best) for s, _, n in own]
        kinds = (pa.int64(), to_arrow_type(item_type), to_arrow_type(id_type), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["item", "item_id", "doc_id", "score"])

    return postings.mapInArrow(run, f"item long, item_id {item_type.simpleString()}, doc_id {id_type.simpleString()}, score long")


def search_postings(postings: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item."""
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    block, sc, best = F.pmod(F.xxhash64("text"), F.lit(n_blocks)), postings.sparkSession.sparkContext, None
    for b in range(n_blocks):
        rows = [(b << 32 | i, r["item_id"], r["text"]) for i, r in enumerate(asked.filter(block == b).collect())]
        queries = Queries(rows)
        bare = sc.broadcast(queries)
        queries.weigh(*corpus_statistics(postings, bare))
        bare.unpersist()
        found = block_best(postings, sc.broadcast(queries), asked.schema["item_id"].dataType, top)
        found = stored(found, "lexical-best") if n_blocks > 1 else found
        best = found if best is None else best.union(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    dealt = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """:func:`search_postings` over postings of ``docs``."""
    return search_postings(build_postings(docs, id_col, text_col), items, **kw)


def op13_lexical(spark, sf_dir):
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id,
        list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
q AS (SELECT item, item_id, unnest(w) AS t FROM b),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY rid, t),
f AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, docs),
m AS (SELECT rid, doc_id, 10 + (90 * len(w)::BIGINT * docs) // terms AS m FROM d, s WHERE len(w) > 0),
r AS (SELECT item, item_id, rid, doc_id, sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (rid) GROUP BY item, item_id, rid, doc_id HAVING score > 0)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM r
WINDOW o AS (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, rid) QUALIFY row_number() OVER o <= 10
"""
