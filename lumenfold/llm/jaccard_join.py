"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

Texts become sets of word 5-grams (48-bit hashes). Documents with equal sets
are one node. Each node's MinHash signature is cut into bands of rows; ``plan``
picks the numbers so that a pair at the threshold shares a band with the target
probability. Nodes meet in buckets by a shuffle on band hashes.

No bucket is ever expanded into all its pairs. A bucket's first node is
compared with each other one; verified pairs join components. Buckets whose
nodes then lie in several components are looked at again: every pair between
different components that has not been compared is compared now; in buckets of more than ``CROWD`` nodes these comparisons
are matrix products inside the tasks, of which only links come out. A pair inside one component needs no comparison to know its
class, so no link between different texts is lost to this saving.

``n_links`` is exact: inside each component, nodes are dealt into blocks of
about ``BLOCK`` and every pair of blocks is counted in its own task by one
matrix product, so that only counts are emitted. That count takes time with
the square of a group of different near copies; classes do not need it
(``count_links=False``).

Defined cases: texts of one to four words have one n-gram, all their words;
texts without words (null, empty, punctuation) equal only themselves (null as
empty); repeated rows are copies of each other; null ids take part, and
``class_id`` is the smallest id of the class, null if it has none; empty
tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD_TABLE, fits_broadcast, row_and, row_columns, small_batches, stored, table, text_slices

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Largest chance of comparing a pair of half the threshold's similarity.
FALSE_SHARE = 0.25
BLOCK = 512
#: n-grams of one matrix product.
SLAB = 4096
#: A node with more comparisons than this has them dealt over several tasks, each with a copy of its set.
STAR = 1000
#: Buckets of more nodes than this are compared inside tasks, block by block.
CROWD = 32
BITS = 48
#: Text of one slice of the numpy kernels.
SLICE_BYTES = 1 << 19
#: Bytes of a row of keys, in memory.
KEY_BYTES = 64

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x100000001B3 * 2 + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def plan(threshold: float = THRESHOLD, recall: float = RECALL, false_share: float = FALSE_SHARE) -> tuple[int, int]:
    """(bands, rows): the cheapest pair that reaches the recall at the threshold."""
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands <= 256 and 1 - (1 - (threshold / 2) ** rows) ** bands <= false_share and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    return best or (64, 4)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of each; the last table is kept."""
    if n not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[n] = tuple(made)
    return _POWERS[n]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each text."""
    data = b" ".join([b"", *[r.translate(WORD_TABLE) for r in raws], b""])
    chars = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], chars != 32, [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    up, down = _powers(max(2 * SLICE_BYTES, 1 << len(chars).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * up[: len(chars)], dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M1)
    begins = np.cumsum([1, *[len(r) + 1 for r in raws]])[:-1]
    first = np.searchsorted(starts, begins)
    return hashes, np.diff(np.append(first, len(starts)))


def ngram_sets(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sorted distinct n-gram hashes of all texts, the size of each text's set, and the raw texts."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, counts = word_hashes(raws)
    doc = np.repeat(np.arange(len(raws), dtype=np.int64), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place  # words from here to the end of the text
    h = np.zeros(len(words), np.uint64)
    for j in range(n):
        shifted = np.zeros_like(words)
        shifted[: len(words) - j] = words[j:]
        h = np.where(left > j, (h + shifted) * M1 + np.uint64(j + 1), h)  # short texts stop at their end
    whole = (left >= n) | (place == 0)
    key = (doc[whole].astype(np.uint64) << np.uint64(BITS)) | (mix(h[whole]) >> np.uint64(64 - BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    sizes = np.bincount((key >> np.uint64(BITS)).astype(np.int64), minlength=len(raws))
    return key & np.uint64((1 << BITS) - 1), sizes, raws


def band_hashes(values: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """int64 matrix (texts with a set, bands). values: the sets one after another."""
    starts = np.cumsum(sizes) - sizes
    starts = starts[sizes > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    if not len(starts):
        return out.astype(np.int64)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * M1)
    for b in range(bands):
        h = np.full(len(starts), b + 1, np.uint64)
        for r in range(rows):
            k = 2 * (b * rows + r)
            low = np.minimum.reduceat(values * (seeds[k] | np.uint64(1)) + seeds[k + 1], starts)
            h = mix(h * M1 + low)
        out[:, b] = h
    return out.view(np.int64)


def node_ids(values: np.ndarray, sizes: np.ndarray, raws: list[bytes]) -> list[bytes]:
    """16 bytes that are equal for equal sets; of a text without words, a digest of the text."""
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    if len(starts):
        a, b = np.add.reduceat(mix(values * M1 + M2), starts), np.add.reduceat(mix(values * M3 + M1), starts)
        pairs = np.stack([mix(a), mix(b + sizes[full].astype(np.uint64))], 1)
    out, k = [], 0
    for i, raw in enumerate(raws):
        if full[i]:
            out.append(pairs[k].tobytes())
            k += 1
        else:
            out.append(hashlib.blake2b(raw, digest_size=16, person=b"no words").digest())
    return out


def pack(values: np.ndarray) -> np.ndarray:
    """48-bit values as 6 bytes each."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6]


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def sketches(rows: DataFrame, bands: int, per_band: int) -> DataFrame:
    """rows: doc_id, key, text. One row each: doc_id, key, node, bands array<long>."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                values, sizes, raws = ngram_sets(piece.column("text").to_pylist())
                found = band_hashes(values, sizes, bands, per_band)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("key"), pa.array(node_ids(values, sizes, raws), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))],
                    ["doc_id", "key", "node", "bands"],
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, node binary, bands array<long>")


def set_table(rows: DataFrame) -> DataFrame:
    """rows: node, text. One row each: node and its packed set."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text", SLICE_BYTES):
                values, sizes, _ = ngram_sets(piece.column("text").to_pylist())
                data, ends = pack(values), np.cumsum(sizes)
                sets = [data[e - s : e].tobytes() for s, e in zip(sizes, ends)]
                yield pa.RecordBatch.from_arrays([piece.column("node"), pa.array(sets, pa.binary())], ["node", "ngrams"])

    return rows.mapInArrow(run, "node binary, ngrams binary")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) whose sets have Jaccard similarity of at least ``threshold``."""

    def run(batches):
        for batch in batches:
            keep, last, x = [], None, None
            for a, p, q in zip(batch.column("a").to_pylist(), batch.column("p").to_pylist(), batch.column("q").to_pylist()):
                if a != last:
                    last, x = a, unpack(p)
                y = unpack(q)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) < threshold * len(large):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hot = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > STAR).select("a", F.ceil(F.col("n") / STAR).cast("int").alias("parts")), "jaccard-hot")
    hint = F.broadcast if fits_broadcast(hot.count(), KEY_BYTES) else (lambda df: df)
    one = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hint(hot), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).cast("int").alias("part"))
    with_b = dealt.join(sets.select(F.col("node").alias("b"), F.col("ngrams").alias("q")), "b")
    own = sets.select(F.col("node").alias("a"), F.col("ngrams").alias("p")).join(hint(hot), "a", "left").select("a", "p", F.explode(F.sequence(F.lit(0), one - 1)).alias("part"))
    return with_b.join(own, ["a", "part"]).select("a", "b", "p", "q").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) for the nodes of ``edges`` (a, b).

    Alternating large-star and small-star steps; each result is written to the
    shared folder, which cuts the lineage.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "jaccard-edges")
    while not now.isEmpty():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "jaccard-large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "jaccard-small-star")
        # done when each node has one parent that has none itself: then every star is a component
        shape = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if shape.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _fetch(rows: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Rows of ``rows`` (doc_id, key, ...) that ``wanted`` (doc_id, key, node) names, with node."""
    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "node")
    hint = F.broadcast if fits_broadcast(n_wanted, KEY_BYTES) else (lambda df: df)
    return rows.join(hint(wanted), (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))


def near_matrix(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (left, right) of sets reach the threshold: one matrix product per slab of n-grams."""
    size = np.array([len(s) for s in sets])
    grams, col = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    both = np.zeros((len(left), len(right)))
    places = []
    for side in (left, right):
        back = np.full(len(sets), -1)
        back[side] = np.arange(len(side))
        places.append(back)
    for at in range(0, len(grams), SLAB):  # a slab at a time bounds the memory
        inside = (col >= at) & (col < at + SLAB)
        dense = []
        for side, back in zip((left, right), places):
            r, c = back[row[inside]], col[inside] - at
            m = np.zeros((len(side), SLAB), np.float32)
            m[r[r >= 0], c[r >= 0]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    return both >= threshold * (size[left][:, None] + size[right][None, :] - both)


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """Deal each group's nodes into blocks, and each block to its pairs of blocks: columns i, j, block."""
    sizes = nodes.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = nodes.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _sides(key: tuple, tab: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets of a pair of blocks, and the rows of its left and its right side."""
    block = tab.column("block").to_numpy()
    return [unpack(s) for s in tab.column("ngrams").to_pylist()], *(np.flatnonzero(block == b.as_py()) for b in key[1:])


def link_counts(labels: DataFrame, sets: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """node, links: documents of other nodes of its component at or above the threshold."""
    spread = _blocks(labels.join(copies, "node").join(sets, "node"), "comp")

    def count(key: tuple, tab: pa.Table) -> pa.Table:
        own, left, right = _sides(key, tab)
        near = near_matrix(own, left, right, threshold)
        weight = tab.column("copies").to_numpy()
        total = np.zeros(len(tab), np.int64)
        if key[1].as_py() == key[2].as_py():
            np.fill_diagonal(near, False)
            total[left] += near @ weight[right]
        else:
            total[left] += near @ weight[right]
            total[right] += near.T @ weight[left]
        return pa.table({"node": tab.column("node"), "links": pa.array(total)})

    counted = spread.groupBy("comp", "i", "j").applyInArrow(count, "node binary, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def links_across(open_: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """open_: bucket, node, comp. Of each bucket one link (a, b) for any two components that have one.

    Pairs are compared inside the tasks, block by block, and only links leave them.
    """
    spread = _blocks(open_.join(sets, "node"), "bucket")

    def find(key: tuple, tab: pa.Table) -> pa.Table:
        own, left, right = _sides(key, tab)
        comp = tab.column("comp").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        near = near_matrix(own, left, right, threshold)
        x, y = np.nonzero(near & (comp[left][:, None] != comp[right][None, :]))
        x, y = left[x], right[y]
        low, high = np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y])
        one = np.unique(low * len(tab) + high, return_index=True)[1]
        node = tab.column("node")
        return pa.table({"a": node.take(pa.array(x[one])), "b": node.take(pa.array(y[one]))})

    return spread.groupBy("bucket", "i", "j").applyInArrow(find, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """doc_id, key (hash of the text), class_id, n_links, first (bool: the row's text stands for its class)."""
    small_batches(docs.sparkSession)
    bands, per_band = plan(threshold, recall)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    found = stored(sketches(rows, bands, per_band), "jaccard-sketches")
    nodes = stored(
        found.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"), F.first("bands").alias("bands")), "jaccard-nodes")
    meet = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = meet.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("center")).filter("n > 1").drop("n")
    members = stored(meet.join(buckets, "bucket"), "jaccard-members")
    close = members.select("node").distinct()
    wanted = stored(nodes.join(close, "node").select("rep.doc_id", "rep.key", "node"), "jaccard-wanted")
    texts = _fetch(rows, wanted, wanted.count())
    # repeated rows would give a set twice
    sets = stored(set_table(texts.select("node", "text")).dropDuplicates(["node"]), "jaccard-sets")
    tested = stored(members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct(), "jaccard-pairs")
    edges = stored(verify(tested, sets, threshold), "jaccard-links")
    labels = stored(components(edges), "jaccard-labels")
    there = members.select("bucket", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = there.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low <> high").select("bucket", "n")
    open_ = stored(there.join(several, "bucket").select("bucket", "node", "comp", "n"), "jaccard-open")
    crowded = links_across(open_.filter(F.col("n") > CROWD).drop("n"), sets, threshold)
    left, right = (open_.filter(F.col("n") <= CROWD).select("bucket", F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab")
    pairs = left.join(right, "bucket").filter("comp_a < comp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    fresh = stored(verify(pairs.distinct().join(tested, ["a", "b"], "left_anti"), sets, threshold).union(crowded), "jaccard-more-links")
    if not fresh.isEmpty():
        labels = stored(components(labels.select(F.col("comp").alias("a"), F.col("node").alias("b")).union(fresh)), "jaccard-labels")
    reps = nodes.select("node", "copies", "rep")
    of_class = labels.join(reps, "node")
    heads = of_class.groupBy("comp").agg(F.min("rep").alias("head"))
    placed = of_class.select("comp", "node", "copies").join(heads, "comp").select("node", "copies", "head")
    if count_links:
        placed = placed.join(link_counts(labels, sets, reps.select("node", "copies"), threshold), "node", "left")
    else:
        placed = placed.withColumn("links", F.lit(None).cast("long"))
    alone = reps.join(labels.select("node"), "node", "left_anti").select("node", "copies", F.col("rep").alias("head"), F.lit(0).cast("long").alias("links"))
    result = stored(placed.unionByName(alone), "jaccard-classes")
    out = found.select("doc_id", "key", "node").join(result, "node")
    head = F.col("head")
    return out.select(
        "doc_id", "key", head["doc_id"].alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        (F.col("doc_id").eqNullSafe(head["doc_id"]) & (F.col("key") == head["key"])).alias("first"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stand for their class of near copies, one a class, with all their columns.

    Of rows with the same id and text, the one whose JSON has the least hash stays.
    """
    found = stored(near_duplicates(docs, id_col, text_col, count_links=False, **kw).filter("first").groupBy("doc_id", "key").agg(F.count("*").alias("n")), "jaccard-kept")
    hint = F.broadcast if fits_broadcast(found.count(), KEY_BYTES) else (lambda df: df)
    kept = found.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("n").alias("_n"))
    rows = row_and(docs, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_key"), F.col(id_col).alias("_id"))
    rows = rows.join(hint(kept), (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")))
    once = rows.filter("_n = 1").select("_row")
    if not found.filter("n > 1").isEmpty():
        several = rows.filter("_n > 1").groupBy("_d", "_k").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
        once = once.union(several.select("_row"))
    return once.select(*row_columns(docs))


def op3_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 4))) AS i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)
    UNION SELECT x.rid, y.rid FROM d x JOIN d y ON x.rid < y.rid AND x.text = y.text AND len(x.w) = 0 AND len(y.w) = 0),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid, rid AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.rid),
k AS (SELECT r.rid, min(d.doc_id) AS class_id FROM r JOIN d ON d.rid = r.c GROUP BY r.rid)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE l.a = d.rid) AS n_links FROM d JOIN k USING (rid)
"""
