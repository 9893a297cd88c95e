"""Sharding by a minimax contiguous partition of ordered atomic groups.

Rows with equal texts form an atomic group (null texts form one group). Groups
are ordered by a 60-bit prefix of the SHA-256 of their text, an order that any
rerun and any cluster reproduces and that holds no hot range but a hot group.
The smallest capacity for which a greedy pass fills at most ``n_shards``
contiguous shards is found by binary search, and the order is cut there.

The search never sees all groups at once. It works on a summary of key ranges
(bytes, groups and largest group of each, counted by Spark) and asks Spark for
finer ranges only where a cut may fall, until every range that can hold a cut
is a single group. The summary holds ``MAX_RANGES`` rows at most, whatever the
input; a range of one group is never cut. All row work is DataFrame
operations: shards are assigned by comparing the key with the cuts, slots by
counts of (shard, part) and a row number inside each part.

Defined cases: a null text has 0 bytes, so size 1; empty tables give no rows;
repeated rows and null ids each get a slot of their own; with fewer groups
than shards some shards stay empty; a group larger than total / n_shards sets
the capacity. Extra columns of the input do not reach the assignment.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.common import inline_rows, stored, table

KEY_BITS = 60
FIRST_BITS = 12
MAX_RANGES = 1 << 16
N_SHARDS = 8


class _Range:
    """A key range: ``key`` is its first ``bits`` bits."""

    __slots__ = ("bits", "key", "size", "groups", "largest")

    def __init__(self, bits, key, size, groups, largest):
        self.bits, self.key, self.size, self.groups, self.largest = bits, key, size, groups, largest

    @property
    def atomic(self) -> bool:
        return self.groups == 1 or self.bits == KEY_BITS

    @property
    def first(self) -> int:
        return self.key << (KEY_BITS - self.bits)


def _cuts(ends: list[int], ranges: list[_Range], capacity: int, k: int, divide: bool) -> list[int] | None:
    """Greedy cut positions (byte offsets) of ``k`` shards, or None if they do not reach the end.

    divide: a range of many groups may be cut anywhere, which gives a bound
    from below; else never, which gives a partition that surely fits.
    """
    total, at, out = (ends[-1] if ends else 0), 0, []
    for _ in range(k):
        if at >= total:
            break
        if at + capacity >= total:
            at = total
        else:
            i = bisect_right(ends, at + capacity)  # the range that the shard cannot hold whole
            start = ends[i - 1] if i else 0
            stop = at + capacity if divide and not ranges[i].atomic else start
            if stop <= at:
                return None
            at = stop
        out.append(at)
    return out if at >= total else None


def _smallest(ends, ranges, low: int, k: int, divide: bool) -> int:
    high = max(ends[-1], low)
    while low < high:
        middle = (low + high) // 2
        if _cuts(ends, ranges, middle, k, divide) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the keys at which shards 1, 2, ... start.

    ``groups``: columns key (60-bit long) and size (long), one row a group.
    """

    def summary(df: DataFrame, bits: int) -> list[_Range]:
        part = F.shiftright("key", KEY_BITS - bits)
        rows = df.groupBy(part.alias("part")).agg(F.sum("size"), F.count("size"), F.max("size")).collect()
        return [_Range(bits, *r) for r in rows]

    ranges = summary(groups, FIRST_BITS)
    if not ranges:
        return 0, []
    total = sum(r.size for r in ranges)
    while True:
        ranges.sort(key=lambda r: r.first)
        ends = list(accumulate(r.size for r in ranges))
        least = max(-(-total // n_shards), max(r.largest for r in ranges))
        low = _smallest(ends, ranges, least, n_shards, True)
        high = _smallest(ends, ranges, least, n_shards, False)
        # heavy ranges first: once their large groups stand alone, the bounds are close
        open_ = [r for r in ranges if not r.atomic and r.size > 2 * total >> FIRST_BITS]
        if not open_:
            spans = []
            for capacity, divide in ((low, True), (high, True)):
                spans.append(_cuts(ends, ranges, capacity, n_shards, divide) or [])
            for near, far in zip(*spans):
                i, j = bisect_right(ends, max(0, near - (high - low))), bisect_right(ends, far)
                open_ += [r for r in ranges[i : j + 1] if not r.atomic]
            open_ = list({id(r): r for r in open_}.values())
        if not open_:
            break
        bits = min(r.bits for r in open_)
        open_ = [r for r in open_ if r.bits == bits]
        step = max(1, min(12, (MAX_RANGES // len(open_)).bit_length() - 1, KEY_BITS - bits))
        keys = [r.key for r in open_]
        finer = summary(groups.filter(F.shiftright("key", KEY_BITS - bits).isin(keys)), bits + step)
        gone = {id(r) for r in open_}
        ranges = [r for r in ranges if id(r) not in gone] + finer
    cuts = _cuts(ends, ranges, high, n_shards, False)
    starts = [ranges[bisect_right(ends, c)].first for c in cuts if c < total]
    return high, starts


def assign_shards(rows: DataFrame, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows of columns doc_id, key and size.

    The rows are read several times, so pass a stored table.
    """
    groups = stored(rows.groupBy("key").agg(F.sum("size").cast("long").alias("size")), "shard-groups")
    _, starts = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("key") >= start).cast("int")
    n = rows.count()
    parts = max(4, min(4096, n // 20_000))
    # a part is a slice of a shard that no group of copies can fill alone
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", "_part").count().collect()  # n_shards * parts rows at most
    offsets, last = {}, {}
    for s, p, c in sorted(tuple(r) for r in counts):
        offsets[(s, p)] = last.get(s, 0)
        last[s] = last.get(s, 0) + c
    spark = rows.sparkSession
    base = inline_rows(spark, [(s, p, o) for (s, p), o in offsets.items()], "shard int, _part int, _base long")
    order = Window.partitionBy("shard", "_part").orderBy(F.col("doc_id").asc_nulls_last(), "key", "size")
    return (
        placed.withColumn("_row", F.row_number().over(order))
        .join(F.broadcast(base), ["shard", "_part"])
        .withColumn("slot", (F.col("_base") + F.col("_row") - 1).cast("long"))
        .drop("_part", "_base", "_row")
    )


def text_key(text):
    """60-bit order key of a text; null has a key of its own, that of no text."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("\x00null")), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot, size and CRC-32 of each document; see the module for the law."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        text_key(text).alias("key"),
    )
    return assign_shards(stored(rows, "shard-rows"), n_shards)


def op2_sharding(spark, sf_dir):
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
