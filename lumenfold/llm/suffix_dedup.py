"""Removal of byte strings of 100 bytes or more that occur earlier in the corpus.

A byte is removed if a 100-byte string that covers it also starts earlier (in
a document of smaller id, or earlier in the same one). Positions:

1. Whole copies: of documents with equal texts (by SHA-256, all of it) all but
   the first go whole.
2. Anchors: the least hash of the 24-byte strings in a 100-byte window is its
   anchor, so equal windows have equal anchors. Neighbouring windows with one
   anchor form a run of at most ``RUN`` windows. A run whose anchor stands at
   one place in all documents cannot repeat; the others, with their bytes, are
   dealt into shards by anchor, so equal windows always meet in a shard,
   whichever document they come from.
3. Per shard, of segments with equal bytes all but the first repeat whole. Over
   the others a suffix array is refined as by Larsson and Sadakane: suffixes
   sorted by 8 bytes, then groups that are still open by the ranks 8, 16 and
   32 bytes further on; the ranks of a window's first 64 and last 64 bytes give
   the windows in order of their 100 bytes. Kasai's scan then finds the common
   prefix of neighbours in that order, in one lane a run, where their first 64
   bytes have one rank (shorter prefixes are not wanted): the prefix of a
   window is at least that of the window before it, less one. Windows are equal
   where it reaches 100 bytes. Runs lie in document order, so the first window
   of a class is the earliest.
4. Of the runs of an anchor with more than ``HOT`` runs, those with equal bytes
   stand for one, as in 3, whatever their number. The others are cut in two, by
   how far the anchor lies behind the start of a window: all windows with fewer
   than 40 bytes before it hold the same 61 bytes around it, and so do those
   with 40 or more. These bytes are a longer anchor: what stands at one place
   goes no further, as before, and what is still hot is cut in two again, by 81
   and by 91 bytes (``BLOCKS``). So a step makes two rows of a run, and only of
   one whose longer anchor is hot. An anchor of 91 bytes that is still hot is
   dealt into pieces. The sorted lists of first windows of its pieces are merged
   by binary search, comparing bytes, ``FAN`` pieces at a time, each in as many
   ranges (by a hash of the window) as the anchor has pieces. Its runs have at
   most 10 windows, so the lists, which hold each window's bytes, stay near the
   texts in size.

Shards and ranges have bounded size, no text leaves its row but the runs with
a repeated anchor, and every step that groups by a value counts it first.

Defined cases: null and empty texts have no bytes; texts under 100 bytes are
kept; ids are long integers, and null ids stand with the largest of them;
different texts under one id are ordered by a hash of the text; of identical rows one is the first; empty
tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, fits_broadcast, small_batches, stored, table, text_slices
from lumenfold.llm.jaccard_join import M1, mix

#: Hex digits of the text's hash that tell rows of one id apart and put them in order; copies are decided by all of it.
KEY_DIGITS = 15
LENGTH = 100
GRAM = 24
RUN = LENGTH - GRAM + 1
HOT = 1000
#: Windows whose anchors lie at so many neighbouring places share a longer anchor; each divides the one before.
BLOCKS = (40, 20, 10)
SHARD_BYTES = 2 << 20
FAN = 64
#: Where null ids stand in the order of documents.
LAST_ID = (1 << 63) - 1


def packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as big-endian numbers; zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))).view(">u8").ravel().astype(np.uint64)


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the position of its leftmost least value."""
    at, best, size = np.arange(len(values), dtype=np.int32), values, 1
    while size < width:
        step = min(size, width - size)
        n = len(at) - step
        left = best[:n] <= best[step : step + n]
        at, best = np.where(left, at[:n], at[step : step + n]), np.where(left, best[:n], best[step : step + n])
        size += step
    return at


def anchor_runs(raws: list[bytes], length: int = LENGTH, gram: int = GRAM, block: int | None = None):
    """Arrays text, anchor hash, first window, number of windows, places of the anchor: the runs of all texts.

    block: the anchor is the ``length - block + 1`` bytes that all windows share
    which have the same least string and the start of it in the same block of
    so many places.
    """
    sizes = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none.view(np.uint64), none, none, none
    k = mix(packed(data))
    n = len(data) - gram + 1
    h = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        h = (h + k[j : j + n]) * M1
    h = mix(h)
    at = least_positions(h, length - gram + 1)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(raws)), sizes)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + length <= ends[text])
    if not len(inside):
        return none, none.view(np.uint64), none, none, none
    at, text = at[inside], text[inside]
    least = h[at]
    if block:
        part, size = (at - inside) // block, length - block + 1
        at, least = at - part * block, least + part.astype(np.uint64)
        for j in [*range(0, size - 8, 8), size - 8]:
            least = (least + k[at + j]) * M1
        least = mix(least)
    new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.append(new, len(least)))
    parts = -(-n // RUN)  # a long run, of a periodic text, is cut
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    new, n = np.repeat(new, parts) + within * RUN, np.minimum(RUN, np.repeat(n, parts) - within * RUN)
    moves = np.cumsum(np.concatenate([[0], at[1:] != at[:-1]]))
    return text[new], least[new], inside[new] - (ends - sizes)[text[new]], n, moves[new + n - 1] - moves[new] + 1


def window_order(data: np.ndarray, windows: np.ndarray, length: int = LENGTH, beyond: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The window starts in order of their ``length`` bytes, equal ones as they come; and the rank of each one's first 64 bytes.

    The refined suffix array sorts by 64 bytes; length is 64 to 128. beyond:
    how far each position lies behind the last window start of its segment;
    ranks that no window asks for are then not refined.
    """
    n = len(data)
    key = packed(data)
    order = np.argsort(key)
    rank = np.empty(n + 128, np.int64)
    rank[n:] = -1

    def settle(place: np.ndarray, suffix: np.ndarray, differs: np.ndarray) -> np.ndarray:
        """Give each suffix the place of its group's first; which places are in groups of several."""
        head = np.where(differs, place, 0)
        np.maximum.accumulate(head, out=head)
        rank[suffix] = head
        alone = differs & np.append(differs[1:], True)
        return ~alone

    sorted_key = key[order]
    place = np.arange(n)
    open_ = settle(place, order, np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    for step in (8, 16, 32):
        place = place[open_]
        if beyond is not None:
            place = place[beyond[order[place]] <= length - 2 * step]
        suffix = order[place]
        both = rank[suffix] * (n + 2) + rank[suffix + step] + 1
        by = np.argsort(both)
        suffix, both = suffix[by], both[by]
        order[place] = suffix
        open_ = settle(place, suffix, np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.empty(0, bool))
    return np.argsort(rank[windows] * (n + 2) + rank[windows + length - 64] + 1, kind="stable"), rank[windows]


#: Numbers of 1, 2, ... 8 bytes begin here.
BYTE_BOUNDS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)


def common_prefixes(data: np.ndarray, windows: np.ndarray, seg: np.ndarray, order: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every place in ``order``, the common prefix (``length`` at most) with the place before; 0 if under 64 bytes.

    Kasai's scan, one lane a segment. windows: starts, consecutive inside a
    segment; seg: the segment of each; rank: equal for equal first 64 bytes.
    """
    n = len(windows)
    key = np.append(packed(data), np.zeros(length + 8, np.uint64))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)  # whom each window is compared with
    follows = np.append(seg[1:] == seg[:-1], False)  # the next window starts one byte further on
    within = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, ~follows[:-1]), np.arange(n), 0)) if n else np.empty(0, np.int64)
    near = np.flatnonzero((before >= 0) & (rank[before] == rank))
    near = near[np.argsort(within[near], kind="stable")]
    cuts = np.searchsorted(within[near], np.arange(int(within.max(initial=-1)) + 2))
    prefix = np.zeros(n, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        at = near[a:b]
        have = np.full(len(at), 64)
        if within[at[0]] if b > a else False:  # the pair before, one byte further on, holds for all windows between its two
            last = before[at - 1]
            sound = (prefix[at - 1] > 65) & follows[last]
            sound[sound] = place[last[sound] + 1] < place[at[sound]]
            have[sound] = prefix[at[sound] - 1] - 1
        mine, theirs = windows[at], windows[before[at]]
        open_ = np.arange(len(at))
        while len(open_):
            h = have[open_]
            same = 8 - np.searchsorted(BYTE_BOUNDS, key[mine[open_] + h] ^ key[theirs[open_] + h], "right")
            have[open_] = h + same
            open_ = open_[(same == 8) & (h + 8 < length)]
        prefix[at] = np.minimum(have, length)
    return prefix[order]


def later_windows(data: np.ndarray, windows: np.ndarray, seg: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have an equal one before them, and the first window of each class in order of its bytes."""
    order, rank = window_order(data, windows, LENGTH, beyond)
    new = common_prefixes(data, windows, seg, order, rank) < LENGTH
    later = np.ones(len(windows), bool)
    later[order[new]] = False
    return later, order[new]


INTERVALS = "doc_id long, key long, start int, stop int"


def _intervals(doc_id, key, start, later, seg) -> dict:
    """Runs of removed windows as byte intervals. start: window start in its document; seg: its segment."""
    at = np.flatnonzero(later)
    if not len(at):
        return {"doc_id": [], "key": [], "start": [], "stop": []}
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (seg[at[1:]] != seg[at[:-1]])]))
    last = at[np.append(new[1:], len(at)) - 1]
    one = at[new]
    return {"doc_id": doc_id[seg[one]], "key": key[seg[one]], "start": start[one].astype(np.int32), "stop": (start[last] + LENGTH).astype(np.int32)}


def _read(tab: pa.Table):
    """Segments of a shard in document order: ids, keys, starts, numbers of windows, bytes."""
    doc_id, key, start, n = (tab.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "key", "start", "n"))
    order = np.lexsort((start, key, doc_id))
    if len(order):  # identical rows give a segment twice
        same = (np.diff(doc_id[order]) == 0) & (np.diff(key[order]) == 0) & (np.diff(start[order]) == 0)
        order = order[np.concatenate([[True], ~same])]
    segments = tab.column("bytes").take(pa.array(order)).to_pylist()
    return doc_id[order], key[order], start[order], n[order], segments


def _found(out: dict, lists: list[tuple[int, int, bytes]] = ()) -> pa.Table:
    """Rows of FOUND: intervals, and lists of first windows (range, piece, bytes)."""
    names = (("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("range", pa.int64()), ("piece", pa.int64()), ("firsts", pa.binary()))
    own = [pa.array(out[c], t) if c in out else pa.nulls(len(out["start"]), t) for c, t in names]
    more = dict(zip(("range", "piece", "firsts"), zip(*lists))) if lists else {}
    return pa.concat_tables([pa.table(own, [c for c, _ in names]), pa.table([pa.array(more[c], t) if c in more else pa.nulls(len(lists), t) for c, t in names], [c for c, _ in names])])


FOUND = INTERVALS + ", range long, piece long, firsts binary"
#: A first window: its bytes and where it stands.
FIRST = np.dtype([("bytes", f"S{LENGTH}"), ("doc_id", np.int64), ("key", np.int64), ("start", np.int64)])


def scan_shard(key: tuple, tab: pa.Table) -> pa.Table:
    """Intervals of the shard; of a piece of a hot anchor also its first windows, range by range, in order of their bytes."""
    pieces = tab.column("pieces")[0].as_py()
    doc_id, doc_key, start, n, segments = _read(tab)
    # all windows of a segment whose bytes stand earlier as a segment occur earlier: only the first of each goes on
    place = {}
    alike = np.fromiter((place.setdefault(s, i) for i, s in enumerate(segments)), np.int64, len(segments))
    own = alike == np.arange(len(alike))
    again = {"doc_id": doc_id[~own], "key": doc_key[~own], "start": start[~own].astype(np.int32), "stop": (start + n - 1 + LENGTH)[~own].astype(np.int32)}
    doc_id, doc_key, start, n, segments = doc_id[own], doc_key[own], start[own], n[own], list(place)
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    offset = np.cumsum(sizes) - sizes
    seg = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    where = offset[seg] + within
    beyond = np.arange(len(data)) - np.repeat(offset + n - 1, sizes)
    later, first = later_windows(data, where, seg, beyond)
    out = _intervals(doc_id, doc_key, start[seg] + within, later, seg)
    out = {c: np.concatenate([np.asarray(out[c], again[c].dtype), again[c]]) for c in again}
    if key[1].as_py() < 0:
        return _found(out)
    k, at = packed(data), where[first]
    h = np.zeros(len(at), np.uint64)
    for j in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        h = mix((h + k[at + j]) * M1)
    part = (h % np.uint64(pieces)).astype(np.int64)
    made = np.empty(len(at), FIRST)
    made["bytes"] = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]).view(f"S{LENGTH}").ravel()
    s = seg[first]
    made["doc_id"], made["key"], made["start"] = doc_id[s], doc_key[s], start[s] + within[first]
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(pieces + 1))
    base = int(mix(np.array([key[0].as_py()], np.int64).view(np.uint64))[0] >> np.uint64(8))
    return _found(out, [(base + r, key[1].as_py(), made[order[cuts[r] : cuts[r + 1]]].tobytes()) for r in range(pieces) if cuts[r + 1] > cuts[r]])


def _later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a stands later than b."""
    return (a["doc_id"] > b["doc_id"]) | ((a["doc_id"] == b["doc_id"]) & ((a["key"] > b["key"]) | ((a["key"] == b["key"]) & (a["start"] > b["start"]))))


def merge_lists(key: tuple, tab: pa.Table) -> pa.Table:
    """Merge sorted lists of first windows of one range: of equal bytes all but the earliest place go."""
    lists = sorted((np.frombuffer(b, FIRST) for b in tab.column("firsts").to_pylist()), key=len, reverse=True)
    merged, gone = lists[0], []
    for other in lists[1:]:
        at = np.searchsorted(merged["bytes"], other["bytes"])
        hit = np.minimum(at, len(merged) - 1)
        same = merged["bytes"][hit] == other["bytes"]
        mine, theirs = merged[hit[same]], other[same]
        late = _later(theirs, mine)
        gone += [theirs[late], mine[~late]]
        merged = merged.copy()
        merged[hit[same]] = np.where(late, mine, theirs)
        merged = np.insert(merged, at[~same], other[~same])
    out = np.concatenate([merged[:0], *gone])
    out = out[np.lexsort((out["start"], out["key"], out["doc_id"]))]
    new = np.concatenate([[True], (np.diff(out["doc_id"]) != 0) | (np.diff(out["key"]) != 0) | (np.diff(out["start"]) != 1)]) if len(out) else np.empty(0, bool)
    first = np.flatnonzero(new)
    made = _intervals(out["doc_id"][first], out["key"][first], out["start"], np.ones(len(out), bool), np.cumsum(new) - 1)
    return _found(made, [(key[0].as_py(), key[1].as_py(), merged.tobytes())])


def _raw(batch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def find_runs(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key, text. Rows doc_id, key, anchor, start, n, places."""

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "text", 2 << 20):
                text, anchor, start, n, places = anchor_runs(_raw(piece))
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(at), piece.column("key").take(at), pa.array(anchor.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places.astype(np.int32))],
                    ["doc_id", "key", "anchor", "start", "n", "places"])

    return rows.mapInArrow(run, "doc_id long, key long, anchor long, start int, n int, places int")


def cut_segments(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key, text, runs (array<struct<anchor, start, n, pieces>>). One row a run, with its bytes."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                raws, runs = _raw(part), part.column("runs")
                flat = runs.flatten()
                text = np.repeat(np.arange(len(raws)), np.diff(runs.offsets.to_numpy()))
                start, n = flat.field("start").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
                got = [raws[t][s : s + m + LENGTH - 1] for t, s, m in zip(text.tolist(), start.tolist(), n.tolist())]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("key").take(at), *[flat.field(c) for c in ("anchor", "start", "n", "pieces")], pa.array(got, pa.binary())],
                    ["doc_id", "key", "anchor", "start", "n", "pieces", "bytes"])

    return rows.mapInArrow(run, "doc_id long, key long, anchor long, start int, n int, pieces int, bytes binary")


SEGMENTS = ["doc_id", "key", "anchor", "start", "n", "pieces", "bytes"]


def marked_copies(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """segments: doc_id, key, start, n, bytes. The same with copy: whether its bytes (by SHA-256, all of it) stand earlier as a segment; and the stored table of those that do."""
    rows = segments.select("doc_id", "key", "start", "n", "bytes", F.unhex(F.sha2("bytes", 256)).alias("digest"))
    first = F.min(F.struct("doc_id", "key", "start")).alias("_head")
    known = _kept(rows.groupBy(F.col("digest").alias("_digest")).agg(F.count("*").alias("m"), first).filter("m > 1").drop("m"), "suffix-equal")
    few = F.broadcast(known) if fits_broadcast(known.count(), 120) else known
    copy = F.col("_digest").isNotNull() & (F.struct("doc_id", "key", "start") != F.col("_head"))
    return rows.join(few, F.col("digest") == F.col("_digest"), "left").select("doc_id", "key", "start", "n", "bytes", F.coalesce(copy, F.lit(False)).alias("copy")), known


def split_segments(segments: DataFrame, block: int) -> DataFrame:
    """segments: doc_id, key, start, n, bytes, copy. Copies without their bytes; of others the runs by a longer anchor, with its places and their bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1 << 13):
                part = batch.slice(at, 1 << 13)
                copy = part.column("copy").to_numpy(zero_copy_only=False)
                gone, own = part.filter(pa.array(copy)), part.filter(pa.array(~copy))
                raws = own.column("bytes").to_pylist()
                text, anchor, first, n, places = anchor_runs(raws, block=block)
                got = [raws[t][s : s + m + LENGTH - 1] for t, s, m in zip(text.tolist(), first.tolist(), n.tolist())]
                row, none = pa.array(text), len(gone)
                start = own.column("start").to_numpy()[text] + first
                columns = [
                    [gone.column("doc_id"), own.column("doc_id").take(row)], [gone.column("key"), own.column("key").take(row)],
                    [pa.nulls(none, pa.int64()), pa.array(anchor.view(np.int64))], [gone.column("start"), pa.array(start.astype(np.int32))],
                    [gone.column("n"), pa.array(n.astype(np.int32))], [pa.nulls(none, pa.int32()), pa.array(places.astype(np.int32))], [pa.nulls(none, pa.binary()), pa.array(got, pa.binary())],
                ]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["doc_id", "key", "anchor", "start", "n", "places", "bytes"])

    return segments.mapInArrow(run, "doc_id long, key long, anchor long, start int, n int, places int, bytes binary")


def strip(rows: DataFrame) -> DataFrame:
    """rows: doc_id, key, copy (boolean), text, cuts (array<struct<start, stop>>). What is left of each text."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                removed, spans, digests, sizes = [], [], [], []
                copies, cuts = part.column("copy").to_pylist(), part.column("cuts")
                offsets, flat = cuts.offsets.to_numpy(), cuts.flatten()
                starts, stops = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                offsets = offsets - offsets[0]
                for i, raw in enumerate(_raw(part)):
                    size = len(raw)
                    if copies[i] and size >= LENGTH:
                        gone, n, left = size, 1, b""
                    else:
                        s, e = starts[offsets[i] : offsets[i + 1]], stops[offsets[i] : offsets[i + 1]]
                        gone, n, left = 0, 0, raw
                        if len(s):
                            order = np.argsort(s, kind="stable")
                            s, e = s[order], np.maximum.accumulate(e[order])
                            new = np.concatenate([[True], s[1:] > e[:-1]])
                            s, e = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                            gone, n = int((e - s).sum()), len(s)
                            left = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), size]))
                    sizes.append(size)
                    removed.append(gone)
                    spans.append(n)
                    digests.append(hashlib.sha256(left).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)],
                    ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """:func:`stored`, after which the shuffles that made the table are deleted, so that those of one step do not stay beside the next one's."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(key, before)


def repeated_anchors(runs: DataFrame, name: str) -> DataFrame:
    """anchor, m (its runs) and pieces, of anchors that stand at two places or more. runs: anchor, places."""
    pieces = F.when(F.col("m") > HOT, F.ceil(F.col("m") / max(1, HOT // 2))).otherwise(1).cast("int")
    return _kept(runs.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("places").alias("places")).filter("places > 1").select("anchor", "m", pieces.alias("pieces")), name)


def repeated_intervals(firsts: DataFrame) -> DataFrame:
    """firsts: doc_id, key, text, distinct texts only. Byte intervals (INTERVALS) that occur earlier."""
    runs = _kept(find_runs(firsts), "suffix-runs")
    often = repeated_anchors(runs, "suffix-anchors")
    by_doc = _kept(runs.join(often, "anchor").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "start", "n", "pieces")).alias("runs")), "suffix-flags")
    discard(runs)
    flags = by_doc.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "runs")
    with_runs = firsts.join(flags, (F.col("key") == F.col("_k")) & (F.col("doc_id") == F.col("_d"))).select("doc_id", "key", "text", "runs")
    cut = _kept(cut_segments(with_runs), "suffix-segments")
    discard(by_doc)
    totals = (F.count("*").alias("rows"), F.sum(F.when(F.col("pieces") == 1, F.col("m"))).alias("n"), F.max("pieces").alias("most"))
    sums = often.agg(*totals).first()
    n_runs, most = sums["n"] or 0, sums["most"] or 1
    segments, hot, copies, used = cut.filter("pieces = 1").select(SEGMENTS), cut.filter("pieces > 1"), [], [cut, often]
    for block in BLOCKS:
        if most == 1:
            break
        rows, known = marked_copies(hot)
        part = _kept(split_segments(rows, block), "suffix-split")
        copies.append(part.filter("bytes IS NULL").select("doc_id", "key", "start", (F.col("start") + F.col("n") - 1 + LENGTH).alias("stop")))
        part_runs = part.filter("bytes IS NOT NULL")
        twice = repeated_anchors(part_runs, "suffix-split-anchors")
        sums = twice.agg(*totals).first()
        n_runs, most = n_runs + (sums["n"] or 0), sums["most"] or 1
        few = F.broadcast(twice) if fits_broadcast(sums["rows"], 64) else twice
        again = part_runs.join(few, "anchor").select(SEGMENTS)
        segments, hot = segments.union(again.filter("pieces = 1")), again.filter("pieces > 1")
        used += [known, part, twice]
    if most > 1:
        segments = segments.union(hot)
    shards = max(1, n_runs * 140 // SHARD_BYTES)
    # a hot anchor is a shard of its own, in pieces; piece -1 means that it is whole
    dear = F.col("pieces") > 1
    piece = F.pmod(F.xxhash64("doc_id", "key", F.floor(F.col("start") / 4096)), F.col("pieces"))
    dealt = segments.select(
        "doc_id", "key", "start", "n", "bytes", "pieces",
        F.when(dear, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards))).alias("shard"), F.when(dear, piece).otherwise(-1).cast("long").alias("piece"),
    )
    scanned = dealt.groupBy("shard", "piece").applyInArrow(scan_shard, FOUND)
    for rows in copies:
        scanned = scanned.unionByName(rows, allowMissingColumns=True)
    found = _kept(scanned, "suffix-found")
    discard(*used)
    whole, lists = found.filter("range IS NULL").select("doc_id", "key", "start", "stop"), found.filter("range IS NOT NULL").select("range", "piece", "firsts")
    while most > 1:
        most = -(-most // FAN)
        found = _kept(lists.withColumn("piece", F.floor(F.col("piece") / FAN)).groupBy("range", "piece").applyInArrow(merge_lists, FOUND), "suffix-merged")
        whole, lists = whole.union(found.filter("range IS NULL").select("doc_id", "key", "start", "stop")), found.filter("range IS NOT NULL").select("range", "piece", "firsts")
    return whole


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    small_batches(docs.sparkSession)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("_sha"))
    rows = rows.select("doc_id", F.coalesce(F.conv(F.substring("_sha", 1, KEY_DIGITS), 16, 10).cast("long"), F.lit(0)).alias("key"), "text", F.unhex("_sha").alias("digest"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("head")
    known = _kept(rows.groupBy("digest").agg(F.count("*").alias("m"), first).filter("m > 1").select(F.col("digest").alias("_digest"), F.col("head.doc_id").alias("_head")), "suffix-copies")
    few = F.broadcast(known) if fits_broadcast(known.count(), 80) else known
    copy = F.col("_digest").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("_head"))
    marked = rows.join(few, F.col("digest") == F.col("_digest"), "left").select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("at"), "key", "text", copy.alias("copy"))
    cuts = repeated_intervals(marked.filter("NOT copy").select(F.col("at").alias("doc_id"), "key", "text"))
    by_doc = _kept(cuts.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("cuts")), "suffix-cuts")
    renamed = by_doc.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "cuts")
    ready = marked.join(renamed, (F.col("key") == F.col("_k")) & (F.col("at") == F.col("_d")) & ~F.col("copy"), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    done = strip(ready.select("doc_id", "key", "copy", "text", F.coalesce("cuts", none).alias("cuts")))
    # identical rows: all but one of them are copies
    done = done.groupBy("doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept_sha256").agg(F.count("*").cast("int").alias("m"))
    done = done.withColumn("_i", F.explode(F.sequence(F.lit(1), "m")))
    again = (F.col("_i") > 1) & (F.col("n_bytes") >= LENGTH)
    return done.select(
        "doc_id", "n_bytes",
        F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(again, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, sha256(coalesce(text, '')) AS key FROM documents),
o AS (SELECT row_number() OVER (ORDER BY coalesce(doc_id, 9223372036854775807), substr(key, 1, 15), rid) AS place, doc_id, h, len(h) // 2 AS n FROM d),
c AS (SELECT place, n, k, substr(h, 4000 * k + 1, 4198) AS h FROM o, LATERAL (SELECT unnest(generate_series(0, n // 2000)) AS k)),
w AS (SELECT place, k * 2000 + i AS i, md5(substr(h, 2 * i + 1, 200)) AS s FROM c, LATERAL (SELECT unnest(generate_series(0, least(1999, n - 100 - k * 2000))) AS i)),
x AS (SELECT place, i, row_number() OVER (PARTITION BY s ORDER BY place, i) AS m FROM w),
y AS (SELECT place, i, CASE WHEN i <= 100 + lag(i) OVER (PARTITION BY place ORDER BY i) THEN 0 ELSE 1 END AS new FROM x WHERE m > 1),
z AS (SELECT place, i, sum(new) OVER (PARTITION BY place ORDER BY i) AS run FROM y),
r AS (SELECT place, run, min(i) AS a, max(i) + 100 AS b FROM z GROUP BY place, run),
q AS (SELECT place, run, a, b, coalesce(lag(b) OVER (PARTITION BY place ORDER BY run), 0) AS before FROM r),
t AS (SELECT place, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM q JOIN o USING (place) GROUP BY place)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM o LEFT JOIN t USING (place)
"""
