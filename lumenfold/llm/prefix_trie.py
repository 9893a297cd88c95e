"""Conversation prefix trie, screened by a count-min sketch.

1. A turn becomes a digest of role and text and a number of code points; texts
   go no further. A prefix is named by two 64-bit lanes: the XOR of hashes of
   (depth, digest) over its turns, a running aggregate. So the key of the
   parent is the key of the node XOR its last turn's hashes. (Two prefixes of
   one depth and one 128-bit key would count as one.)
2. :func:`prefix_sketch` counts the keys of all prefixes in a count-min sketch:
   each task fills its own, cells stop at 2, and the blocks of all tasks are
   added up. Its size is fixed (``MAX_CELLS`` at most), whatever the input.
3. A cell that holds 1 proves that its prefix has one member, so every longer
   prefix of that conversation has one too: such tails are emitted where they
   stand, with one member, one leaf, nothing saved and no grouping. Only prefixes
   whose cells all hold 2 are shuffled and grouped exactly. A fuller sketch
   sends more prefixes there and changes no result.
4. Sums over subtrees: each node puts its own share (a leaf, saved tokens) on
   one of its members' paths; a running sum up each path gives what stands
   below, and a sum over the members of a node is the sum over its subtree. The
   work is linear in the number of turns, not in members times depth.
5. Conversations that end at a node are digested in chunks of id ranges, whose
   strings then stream through SHA-256 in order: no list of members is held.

Running sums go over blocks of ``BLOCK_TURNS`` turns first and over the blocks
afterwards, so one conversation with a great part of all turns is many tasks'
work (turns that share one number stay together).

Defined cases: a null role or text is an empty one; turns are in order of their
number, null first, ties by digest, and repeated rows are turns each; rows
without a conversation id belong to none; a conversation without turns is a
member of the root; an empty table has no nodes, not even a root; extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, stored, table

#: Turns of one block of a running sum.
BLOCK_TURNS = 1024
#: Rows of the sketch, and its largest and smallest number of cells a row.
SKETCH_ROWS, MAX_CELLS, MIN_CELLS = 4, 1 << 23, 1 << 12
#: Cells of one row of the stored sketch.
CELL_BLOCK = 1 << 16
#: Conversation ids of one chunk of a list that is digested.
CHUNK_IDS = 256
KEY = ["depth", "k1", "k2"]


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0), digest and chars of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    rows = stored(rows.filter("conv_id IS NOT NULL"), "turns")
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    several = not rows.filter(F.col("turn").isNull() | (block != 0)).isEmpty()
    out = running(rows, block, [F.col("turn").asc_nulls_first(), F.col("digest")], several, pos=("sum", F.lit(1).cast("long")))
    return out.select("conv_id", (F.col("pos") - 1).alias("pos"), "digest", "chars")


def running(rows: DataFrame, block: Column, order: list[Column], several: bool, **sums) -> DataFrame:
    """Add running totals, name=(``sum`` or ``bit_xor``, column), along each conversation.

    order: of the rows of a block; blocks follow each other ascending, null
    first. several: whether a conversation may have more than one block.
    """
    rows, total = rows.withColumn("_block", block), {"sum": F.sum, "bit_xor": F.bit_xor}
    inside = Window.partitionBy("conv_id", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[total[f](c).over(inside).alias(name) for name, (f, c) in sums.items()])
    if not several:
        return out.drop("_block")
    before = Window.partitionBy("conv_id").orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "_block").agg(*[total[f](c).alias(f"_{name}") for name, (f, c) in sums.items()])
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_own"), *[total[f](f"_{name}").over(before).alias(f"_{name}") for name, (f, _) in sums.items()])
    out = out.join(blocks, (F.col("conv_id") == F.col("_conv")) & F.col("_block").eqNullSafe(F.col("_own")))
    for name, (f, _) in sums.items():
        ahead = F.coalesce(F.col(f"_{name}"), F.lit(0).cast("long"))
        out = out.withColumn(name, F.col(name) + ahead if f == "sum" else F.col(name).bitwiseXOR(ahead))
    return out.drop("_block", "_conv", "_own", *[f"_{name}" for name in sums])


def splice(turns: DataFrame, period: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: c takes the first h turns of c - c % period, then its own after h; h = crc32(c) % (most + 1).

    Returns the turns (conv_id, depth from 1, digest, chars, n) and the
    conversations (conv_id, n). A base lends at most ``most`` turns to fewer
    than two periods of conversations.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    base = F.col("conv_id") - F.col("conv_id") % period
    heads = turns.filter((F.col("conv_id") % period == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("_base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "chars"))).alias("_head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    plan = own.join(heads, base == F.col("_base"), "left").withColumn("h", h)
    plan = plan.withColumn("head", F.coalesce(F.slice("_head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,digest:string,chars:bigint>>")))
    n = (F.size("head") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).cast("long")
    plan = stored(plan.select("conv_id", "h", "head", n.alias("n")), "splice")
    lent = plan.select("conv_id", F.explode("head").alias("t"), "n").select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.digest", "t.chars", "n")
    kept = turns.join(plan.select("conv_id", "h", F.size("head").alias("n_head"), "n"), "conv_id").filter("pos >= h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head") + 1).alias("depth"), "digest", "chars", "n")
    return lent.unionByName(kept), plan.select("conv_id", "n")


def prefix_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The stored prefixes of every conversation: conv_id, depth, chars, last, k1, k2 and the parent's p1, p2."""
    e1, e2 = (F.xxhash64(F.lit(seed), "depth", "digest") for seed in (1, 2))
    several = not convs.filter(F.col("n") > BLOCK_TURNS).isEmpty()
    rows = running(turns.withColumn("e1", e1).withColumn("e2", e2), F.floor((F.col("depth") - 1) / BLOCK_TURNS), [F.col("depth")], several, k1=("bit_xor", F.col("e1")), k2=("bit_xor", F.col("e2")))
    return stored(rows.select("conv_id", "depth", "chars", (F.col("depth") == F.col("n")).alias("last"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("e2")).alias("p2")), "prefixes")


def cells_of(k1: np.ndarray, k2: np.ndarray, cells: int):
    """The cell of each key in every row of a sketch of ``cells`` (a power of two) a row, as numbers over all rows."""
    a, step, shift = k1.astype(np.int64).view(np.uint64), k2.astype(np.int64).view(np.uint64) | np.uint64(1), np.uint64(65 - cells.bit_length())
    for r in range(SKETCH_ROWS):
        yield ((a + np.uint64(r) * step) >> shift).astype(np.int64) + r * cells


def prefix_sketch(prefixes: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell of the count-min sketch of all keys, set where the cell holds 2 or more."""
    size = min(CELL_BLOCK, cells)

    def count(batches):
        sketch = np.zeros(SKETCH_ROWS * cells, np.uint8)
        for batch in batches:
            for at in cells_of(*(batch.column(c).to_numpy() for c in ("k1", "k2")), cells):
                at, n = np.unique(at, return_counts=True)
                sketch[at] = np.minimum(2, sketch[at] + np.minimum(n, 2))
        for b in np.flatnonzero(sketch.reshape(-1, size).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([zlib.compress(sketch[b * size : (b + 1) * size].tobytes(), 1)])], ["block", "cells"])

    def add(batches):
        block, held = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([block]), pa.array([np.packbits(held >= 2).tobytes()])], ["block", "cells"])
        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
                own = np.frombuffer(zlib.decompress(packed), np.uint8)
                if b != block:
                    if block is not None:
                        yield out()
                    block, held = b, own
                else:
                    held = np.minimum(2, held + own)
        if block is not None:
            yield out()

    kind = "block long, cells binary"
    parts = prefixes.select("k1", "k2").mapInArrow(count, kind)
    bits = np.zeros(SKETCH_ROWS * cells // 8, np.uint8)
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(add, kind).collect():  # MAX_CELLS bounds it
        bits[r["block"] * size // 8 :][: size // 8] = np.frombuffer(r["cells"], np.uint8)
    return bits


def screened(prefixes: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """Add ``single`` and ``parent_single`` to stored prefixes: true only if the prefix (its parent) has one member."""
    rows = prefixes.count()
    cells = min(max_cells, max(MIN_CELLS, 1 << (4 * rows).bit_length()))
    sketch = prefixes.sparkSession.sparkContext.broadcast(prefix_sketch(prefixes, cells))

    @F.pandas_udf("boolean")
    def single(k1: pd.Series, k2: pd.Series) -> pd.Series:
        bits, shared = sketch.value, np.ones(len(k1), bool)
        for at in cells_of(k1.to_numpy(), k2.to_numpy(), cells):
            shared &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(~shared)

    out = prefixes.select("*", single("k1", "k2").alias("single"), ((F.col("depth") > 1) & single("p1", "p2")).alias("parent_single"))
    out = stored(out, "screened")
    sketch.unpersist()
    return out


def ends_digest(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """For each node of ``ends`` (KEY, conv_id), the SHA-256 of its ids, ascending and comma-joined."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ends.groupBy(*KEY, F.floor(F.col("conv_id") / chunk_ids).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def digest(batches):
        key, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in key], pa.array([sha.hexdigest()])], [*KEY, "ends_sha256"])
        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if own == key:
                    sha.update(b"," + ids.encode())
                else:
                    if key:
                        yield row()
                    key, sha = own, hashlib.sha256(ids.encode())
        if key:
            yield row()

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row a node of the trie of conversations.

    turns: conv_id, depth (from 1, gapless), digest, chars and n, the number of
    turns of the conversation; convs: conv_id and n of all of them.
    """
    prefixes = prefix_rows(turns, convs)
    rows = screened(prefixes, max_cells)
    discard(prefixes)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    # nodes that may be shared, and the root
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("chars"), (F.col("n") == 0).alias("last"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    open_ = rows.filter("NOT single").drop("single", "parent_single").unionByName(root)
    groups = open_.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("chars", "p1", "p2")])
    groups = stored(groups, "groups")
    tails = rows.filter("single")
    edge = tails.filter("NOT parent_single")
    children = groups.filter("depth > 0").select(*parent).union(edge.select(*parent)).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    nodes = groups.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stored(nodes.withColumn("leaf", F.col("n_children") == 0), "nodes")
    # what each node adds to its own and all higher subtrees, on the path of one member
    gains = nodes.select("conv_id", "depth", F.col("leaf").cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")).filter("leaves + saved > 0")
    gains = gains.unionByName(tails.filter("last").select("conv_id", "depth", one.alias("leaves"), zero.alias("saved")))
    empty = [F.lit(None).cast("long").alias(c) for c in ("k1", "k2")]
    path = gains.select("*", *empty, F.lit(0).alias("kind")).unionByName(open_.select("conv_id", "depth", zero.alias("leaves"), zero.alias("saved"), "k1", "k2", F.lit(1).alias("kind")))
    several = not convs.filter(F.col("n") >= BLOCK_TURNS).isEmpty()
    below = running(path, -F.floor(F.col("depth") / BLOCK_TURNS), [F.col("depth").desc(), F.col("kind")], several, below_leaves=("sum", F.col("leaves")), below_saved=("sum", F.col("saved")))
    below = below.filter("kind = 1").groupBy(*KEY).agg(F.sum("below_leaves").alias("n_leaves"), F.sum("below_saved").alias("saved_tokens"))
    ends = ends_digest(open_.filter("last").select(*KEY, "conv_id"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = F.sha2(F.lit("").cast("binary"), 256)
    up = ["depth", "p1", "p2"]
    # a parent that is proven single is a node of the same conversation
    found = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    shared = nodes.join(below, KEY).join(ends, KEY, "left").join(above, up, "left").withColumn("parent_conv_id", found).withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(*out)
    own = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none)
    rest = [one.alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256")]
    inner = tails.filter("parent_single").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), *rest)
    return shared.unionByName(inner).unionByName(edge.join(above, up, "left").select("conv_id", "depth", "parent_conv_id", *rest))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(*splice(stored(turn_rows(table(spark, sf_dir, "conversations")), "turn-places")))


#: The table of CRC-32 (polynomial of IEEE 802.3, reflected) is made bit by bit, the sums of the ids byte by byte.
SQL = r"""
WITH RECURSIVE tb(i, v, k) AS (SELECT range, range::BIGINT, 0 FROM range(256)
    UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM tb WHERE k < 8),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) - 1 AS pos FROM t),
c AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
crc(conv_id, s, v) AS (SELECT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM c
    UNION ALL SELECT conv_id, s[2:], xor(crc.v >> 8, tb.v) FROM crc JOIN tb ON k = 8 AND tb.i = xor(crc.v & 255, ascii(s[1])::BIGINT) WHERE s <> ''),
h AS (SELECT c.conv_id, c.n, c.conv_id - c.conv_id % 100 AS base, xor(v, 4294967295) % 6 AS h FROM c JOIN crc ON c.conv_id = crc.conv_id AND s = ''),
g AS (SELECT h.*, least(h, coalesce(b.n, 0)) AS n_head FROM h LEFT JOIN c AS b ON b.conv_id = base),
r AS (SELECT g.conv_id, pos + 1 AS d, role, text FROM g JOIN o ON o.conv_id = base AND pos < h
    UNION ALL SELECT g.conv_id, pos - h + n_head + 1, role, text FROM g JOIN o ON o.conv_id = g.conv_id AND pos >= h),
p AS (SELECT conv_id, d, length(text) AS chars, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER w AS path FROM r
    WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
q AS (SELECT conv_id, d, chars, path, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY d), '') AS up, d = max(d) OVER (PARTITION BY conv_id) AS last FROM p
    UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM p) FROM c),
n AS (SELECT d, path, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM q GROUP BY d, path),
k AS (SELECT a.*, (SELECT count(*) FROM n AS b WHERE b.d = a.d + 1 AND b.up = a.path) AS n_children FROM n AS a),
s AS (SELECT q.d, q.path, sum((k.n_children = 0)::BIGINT) AS n_leaves, sum((k.n_convs - 1) * k.chars) AS saved
    FROM k JOIN q ON q.conv_id = k.conv_id AND q.d <= k.d GROUP BY q.d, q.path)
SELECT k.conv_id, k.d::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, k.ends AS ends_sha256
FROM k JOIN s USING (d, path) LEFT JOIN n AS u ON u.d = k.d - 1 AND u.path = k.up
"""
