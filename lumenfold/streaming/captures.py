"""Routed sums and drops of captures, with state that ends: by count, by a timer, or by its time to live.

``transformWithState`` needs the RocksDB state store: start and read such
queries inside :func:`state_store`.

A capture of a burst ends in one of three ways, whatever the micro-batches:

* it is full: ``BURST_TICKS`` ticks;
* the next tick comes more than ``IDLE_MS`` after its last one;
* no tick comes, and the watermark passes its last tick by more than ``IDLE_MS``:
  an event-time timer ends it.

Then it is reported and its state is cleared. Timers are moved as ticks come,
one a burst. Ticks behind the watermark are dropped by Spark, and ticks of a
micro-batch are folded by (ts, tick_id).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.streaming.ticks import BURST_TICKS, PLAN

IDLE_MS = 60_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SUMS = "burst long, begun long, ended long, ticks long, reason string, t0 long, t1 long, t2 long, n0 long, n1 long, n2 long"
SUMS_STATE = "begun long, last long, ticks long, t0 long, t1 long, t2 long, n0 long, n1 long, n2 long"
DROPS = "burst long, ticks long, s0 long, s1 long, s2 long"
DROPS_STATE = "ticks long, s0 long, s1 long, s2 long"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that timers and state of several variables need, for queries started inside; afterwards the session's own holds again."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class RoutedCaptures(StatefulProcessor):
    """Sums and counts of owned ticks by scale, one row a capture."""

    def __init__(self, idle_ms: int = IDLE_MS, burst_ticks: int = BURST_TICKS):
        self.idle_ms, self.burst_ticks = idle_ms, burst_ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.capture = handle.getValueState("capture", SUMS_STATE)

    def _report(self, key, held: list, reason: str) -> Row:
        begun, last, ticks, *rest = held
        return Row(burst=key[0], begun=begun, ended=last, ticks=ticks, reason=reason, **dict(zip(("t0", "t1", "t2", "n0", "n1", "n2"), rest)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = list(self.capture.get()) if self.capture.exists() else None
        timer = held[1] + self.idle_ms if held else None
        for ms, _, v in sorted((r["ms"], r["tick_id"], r["v"]) for r in rows):
            if held and ms - held[1] > self.idle_ms:
                yield self._report(key, held, "gap")
                held = None
            held = held or [ms, ms, *[0] * 7]
            scale, owned = PLAN[held[2] % len(PLAN)]
            held[1], held[2] = ms, held[2] + 1
            if owned:
                held[3 + scale] += v
                held[6 + scale] += 1
            if held[2] == self.burst_ticks:
                yield self._report(key, held, "full")
                held = None
        if timer is not None:
            self.handle.deleteTimer(timer)
        if held:
            self.capture.update(tuple(held))
            self.handle.registerTimer(held[1] + self.idle_ms)
        elif self.capture.exists():
            self.capture.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.capture.exists():
            yield self._report(key, list(self.capture.get()), "idle")
            self.capture.clear()

    def close(self) -> None:
        pass


def routed_captures(ticks: DataFrame, delay: str = "0 seconds", **kw) -> DataFrame:
    """ticks: burst, ts, tick_id, v, streaming. One row (SUMS) for each capture that has ended."""
    at = F.col("ts").cast("timestamp")  # a watermark needs one
    rows = ticks.withColumn("ts", at).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("burst").transformWithState(RoutedCaptures(**kw), SUMS, "Append", "EventTime")


class Numbering(StatefulProcessor):
    """Each tick with its place in a cycle."""

    def __init__(self, cycle: int):
        self.cycle = cycle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "phase int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        phase = self.next.get()[0] if self.next.exists() else 0
        for _, _, v in sorted((r["ts"], r["tick_id"], r["v"]) for r in rows):
            yield Row(burst=key[0], phase=phase, v=v)
            phase = (phase + 1) % self.cycle
        self.next.update((phase,))

    def close(self) -> None:
        pass


def numbered_ticks(ticks: DataFrame, cycle: int) -> DataFrame:
    """ticks: burst, ts, tick_id, v, streaming. burst, phase and v of each tick; the state is one number a burst."""
    return ticks.groupBy("burst").transformWithState(Numbering(cycle), "burst long, phase int, v long", "Append", "None")


class LivingDrops(StatefulProcessor):
    """Drops by scale since a burst was last silent for the time to live."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", DROPS_STATE, self.live_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ticks, *skipped = self.counts.get() if self.counts.exists() else (0,) * 4
        for _, _, gone in sorted((r["ts"], r["tick_id"], r["dropped"]) for r in rows):
            skipped[PLAN[min(ticks, len(PLAN) - 1)][0]] += bool(gone)
            ticks += 1
        self.counts.update((ticks, *skipped))
        yield Row(burst=key[0], ticks=ticks, s0=skipped[0], s1=skipped[1], s2=skipped[2])

    def close(self) -> None:
        pass


def living_drops(ticks: DataFrame, live_ms: int) -> DataFrame:
    """ticks: burst, ts, tick_id, dropped, streaming. After each micro-batch the drops (DROPS) of every burst it held.

    A burst without ticks for ``live_ms`` of processing time is forgotten.
    """
    return ticks.groupBy("burst").transformWithState(LivingDrops(live_ms), DROPS, "Update", "ProcessingTime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What the state store of a query holds under a variable after its last micro-batch."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def timers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The timers of a query after its last micro-batch."""
    return spark.read.format("statestore").option("path", checkpoint).option("readRegisteredTimers", "true").load()
