"""Count windows, routed sums, lateness and drops over a stream of ticks.

Windows close by count, not by time, so they are custom state per burst: the
open sums and the number of ticks. A capture is complete after ``BURST_TICKS``
ticks; then its state is removed, and the next tick of that burst begins a new
capture. A capture that never fills holds a few numbers. Ticks of a micro-batch
are ordered by (ts, tick_id) before they are folded; the source delivers bursts
in order and bounds a micro-batch (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.storage import new_path

#: Ticks after which a capture is complete.
BURST_TICKS = 64
#: Microseconds between ticks beyond which the later one is late: one and a half periods of 50 ms.
LATE_US = 75_000
SCALES = (1, 2, 4)
PLAN = tuple((0 if t < 8 else 1 if t < 13 else 2, t not in (0, 1, 8, 9, 13, 14)) for t in range(16))

OUTPUT = "burst long, begun long, scale int, window long, total long, late int"
STATE = "begun long, n long, sum2 long, sum4 long, last_us long"


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a burst in a micro-batch by time, with ``us``: microseconds."""
    pdf = pd.concat(list(batches)).sort_values(["ts", "tick_id"])
    return pdf.assign(us=pdf["ts"].astype("datetime64[us]").astype("int64"))


def fold_windows(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Every tick at scale 1, every second at scale 2, every fourth at scale 4, as sums; open windows wait."""
    begun, n, sum2, sum4, last = state.get if state.exists else (0, 0, 0, 0, -1)
    rows = []
    pdf = in_order(batches)
    for us, v in zip(pdf["us"].tolist(), pdf["v"].tolist()):
        if n == 0:
            begun, last = us, us
        late = int(us - last >= LATE_US)
        n, sum2, sum4, last = n + 1, sum2 + v, sum4 + v, us
        rows.append((key[0], begun, 1, n - 1, v, late))
        if n % 2 == 0:
            rows.append((key[0], begun, 2, n // 2 - 1, sum2, 0))
            sum2 = 0
        if n % 4 == 0:
            rows.append((key[0], begun, 4, n // 4 - 1, sum4, 0))
            sum4 = 0
        if n == BURST_TICKS:
            n = 0
    if n:
        state.update((begun, n, sum2, sum4, last))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["burst", "begun", "scale", "window", "total", "late"])


def count_windows(ticks: DataFrame) -> DataFrame:
    """ticks: burst, ts, tick_id, v, streaming. Closed windows of 1, 2 and 4 ticks of each capture, and which ticks came late."""
    return ticks.groupBy("burst").applyInPandasWithState(fold_windows, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def route(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Owned ticks are added to their scale's running sum; settling ticks are counted; every fourth tick reports."""
    n, *rest = state.get if state.exists else (0,) * 7
    totals, counts = list(rest[:3]), list(rest[3:])
    rows = []
    for v in in_order(batches)["v"].tolist():
        scale, owned = PLAN[n % 16]
        n += 1
        if owned:
            totals[scale] += v
            counts[scale] += 1
        if n % 4 == 0:
            rows.append((key[0], n, *totals, *counts))
    state.update((n, *totals, *counts))
    yield pd.DataFrame(rows, columns=["burst", "tick", "t0", "t1", "t2", "n0", "n1", "n2"])


def routed_sums(ticks: DataFrame) -> DataFrame:
    """Snapshots every fourth tick of the sums and counts of three scales."""
    return ticks.groupBy("burst").applyInPandasWithState(
        route, "burst long, tick long, t0 long, t1 long, t2 long, n0 long, n1 long, n2 long", "n long, t0 long, t1 long, t2 long, n0 long, n1 long, n2 long", "append", GroupStateTimeout.NoTimeout)


def charge_drops(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Dropped ticks, each charged to the scale that the plan has live at its number; the last one holds beyond."""
    n, *skipped = state.get if state.exists else (0,) * 4
    for gone in in_order(batches)["dropped"].tolist():
        skipped[PLAN[min(n, len(PLAN) - 1)][0]] += bool(gone)
        n += 1
    state.update((n, *skipped))
    yield pd.DataFrame([(key[0], n, *skipped)], columns=["burst", "ticks", "s0", "s1", "s2"])


def drop_counts(ticks: DataFrame) -> DataFrame:
    """ticks: burst, ts, tick_id, dropped, streaming. After each micro-batch the drops of every burst it held, by scale."""
    return ticks.groupBy("burst").applyInPandasWithState(charge_drops, "burst long, ticks long, s0 long, s1 long, s2 long", "n long, s0 long, s1 long, s2 long", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there now into Parquet files of the shared folder, and read them."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, name: str) -> DataFrame:
    """The same for an update stream; each micro-batch is a folder ``batch=n`` of its own, so a repeated one replaces itself."""
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", path).parquet(path)


def fill_buffer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Readings are held until a capture is full, then reported at once and forgotten."""
    begun, held = state.get if state.exists else (0, [])
    held, rows = list(held), []
    pdf = in_order(batches)
    for us, v in zip(pdf["us"].tolist(), pdf["v"].tolist()):
        begun = begun if held else us
        held.append(v)
        if len(held) == BURST_TICKS:
            rows.append((key[0], begun, sum(held), max(held)))
            held = []
    if held:
        state.update((begun, held))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(rows, columns=["burst", "begun", "total", "high"])


def full_captures(ticks: DataFrame) -> DataFrame:
    """ticks: burst, ts, tick_id, v, streaming. One row for each full capture: when it began, its sum and its highest reading."""
    return ticks.groupBy("burst").applyInPandasWithState(fill_buffer, "burst long, begun long, total long, high long", "begun long, held array<bigint>", "append", GroupStateTimeout.NoTimeout)
