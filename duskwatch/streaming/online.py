"""Streams with state per key whose rows come in any order within a delay.

Keys are dealt over ``buckets`` by their hash, as in ``stateful``. Rows of a bucket wait in the parts in
which they came, one for each micro-batch, and are never written again. One timer of the bucket wakes it
at the first edge of a slot of event time after the first row that waits; rows of all slots before the
horizon, the last slot edge at or before the watermark, are then worked off in order of time whatever
order their files came in, about ``ROWS`` at a time. A task holds the rows of one bucket that are due. All
rows of a key before the horizon are then known; what depends on silence is told against the horizon.
State of a key is dropped some time after its last row. What a batch costs besides its rows follows
the buckets alone, and neither slots nor delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from duskwatch.operators.runs import CALLS, RESULTS, is_event
from duskwatch.streaming import machines
from duskwatch.streaming.machines import STATE_AFTER, Machine, decoded, encoded
from duskwatch.streaming.stateful import BUCKETS, Held, bucketed

SLOT_S = 60
KEEP_S = 7 * 86_400
#: Rows of a bucket that are worked off together, but for the rest of the last slot among them.
ROWS = 200_000


class _Ordered(Held):
    """Keeps rows by slot and hands them over in order of time and sequence."""

    def __init__(self, machine: Machine, slot_s: int, keep_s: int) -> None:
        super().__init__(machine)
        machine.slot_us, machine.keep_us = slot_s * 1_000_000, keep_s * 1_000_000
        self.slot_us, self.keep_us = machine.slot_us, machine.keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # The key tells how many parts came before, and the times that a part spans.
        self.parts = handle.getMapState("parts", "part bigint, low bigint, high bigint", "rows binary")
        # How many parts came, the horizon that rows were released up to, and the timer that is set.
        self.at = handle.getValueState("at", "parts bigint, released bigint, due bigint")
        # Horizons that buckets were released up to by this task.
        self.done: dict[tuple, int] = {}

    def _wake(self, us: int, due: int | None) -> int:
        """Have the bucket looked at once all rows up to that time are known; returns the next timer."""
        ms = (us // self.slot_us + 1) * self.slot_us // 1000
        if due is not None and due <= ms:
            return due
        self.handle.registerTimer(ms)
        return ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, released, due = self.at.get() or (0, None, None)
        for frame in rows:
            frame = frame.drop(columns=["bucket", "ts"], errors="ignore")
            low, high = int(frame["us"].min()), int(frame["us"].max())
            self.parts.updateValue((parts, low, high), (encoded(frame),))
            parts, due = parts + 1, self._wake(low, due)
        self.at.update((parts, released, due))
        return iter(())

    def _due(self, released: int | None, horizon: int) -> tuple[list[pd.DataFrame], list[int]]:
        """Rows of whole slots from one horizon to the next in pieces in order of time, and the first
        time in each part that still waits."""
        frames, waiting = [], []
        for part, low, high in sorted(tuple(k) for k in self.parts.keys()):
            if low >= horizon:
                waiting.append(low)
                continue
            frame = decoded(self.parts.getValue((part, low, high))[0])
            us = frame["us"].to_numpy()
            now = us < horizon
            if high >= horizon:
                waiting.append(int(us[~now].min()))
            else:
                self.parts.removeKey((part, low, high))
            frames.append(frame[now if released is None else now & (us >= released)])
        frames = [f for f in frames if len(f)]
        if not frames:
            return [], waiting
        rows = pd.concat(frames, ignore_index=True)
        rows = rows.iloc[rows["us"].to_numpy().argsort(kind="stable")]
        slot = rows["us"].to_numpy() // self.slot_us
        pieces, start = [], 0
        while start < len(rows):
            last = slot[min(start + ROWS, len(rows)) - 1]
            end = int(slot.searchsorted(last, side="right"))
            pieces.append(rows.iloc[start:end].reset_index(drop=True))
            start = end
        return pieces, waiting

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        horizon = timerValues.getCurrentWatermarkInMs() * 1000 // self.slot_us * self.slot_us
        if self.done.get(key) == horizon:
            return
        self.done[key] = horizon
        parts, released, _ = self.at.get() or (0, None, None)
        held = self.load()
        pieces, waiting = self._due(released, horizon)
        for rows in pieces:
            out, held = self.machine.step(held, rows)
            if len(out):
                yield out
        if held is not None:
            # What was over just before the horizon: a row at it may still come.
            out, held = self.machine.silent(held, horizon - 1)
            if out is not None and len(out):
                yield out
            held = held[held["us"].to_numpy() + self.keep_us >= horizon]
            self.store(held)
            if len(held):
                waiting += [int(held["us"].min()) + self.keep_us, *self.machine.deadlines(held).tolist()]
        if waiting:
            self.at.update((parts, horizon, self._wake(min(waiting), None)))
        elif self.at.exists():
            self.at.clear()


def _watched(df: DataFrame, delay: str, machine: Machine, slot_s: int, keep_s: int, buckets: int, schema: str) -> DataFrame:
    return bucketed(df.withWatermark("ts", delay), machine.keys, buckets).transformWithStateInPandas(
        _Ordered(machine, slot_s, keep_s), schema, "append", "eventTime")


def run_states(audit: DataFrame, delay: str = "10 minutes", slot_s: int = SLOT_S, keep_s: int = KEEP_S,
               buckets: int = BUCKETS) -> DataFrame:
    """Every move of every run between its states before the horizon, illegal ones marked.

    Rows without a time are left out. A run that is silent for ``keep_s`` is forgotten; were it to
    go on, it would begin anew.
    """
    moves = audit.where(is_event(*STATE_AFTER, "run_end") & F.col("ts").isNotNull()).select(
        "run_id", "ts", F.unix_micros("ts").alias("us"), "seq", "event", "status")
    return _watched(moves, delay, machines.Moves(), slot_s, keep_s, buckets,
                    "run_id string, us bigint, event string, before string, state string, illegal boolean")


def call_results(audit: DataFrame, limit_s: int = 3600, delay: str = "10 minutes", slot_s: int = SLOT_S,
                 keep_s: int = KEEP_S, buckets: int = BUCKETS) -> DataFrame:
    """Calls as they are answered; those without a result in time become ``pending_late``.

    A call made again before its result leaves the earlier one ``pending``; a result without an
    open call is ``unmatched``. Rows without a time or a call id are left out.
    """
    rows = audit.where(is_event(*CALLS, *RESULTS) & F.col("tool_call_id").isNotNull() & F.col("ts").isNotNull()).select(
        "run_id", "tool_call_id", "ts", F.unix_micros("ts").alias("us"), "seq", is_event(*CALLS).alias("is_call"))
    return _watched(
        rows, delay, machines.Calls(limit_s * 1_000_000), slot_s, max(keep_s, limit_s + 1), buckets,
        "run_id string, tool_call_id string, call_us bigint, result_us bigint, status string")


def stall_watch(audit: DataFrame, budget_s: int, delay: str = "10 minutes", slot_s: int = SLOT_S,
                keep_s: int = KEEP_S, buckets: int = BUCKETS) -> DataFrame:
    """A row for every silence of a run that outlasts its budget, once; none after its end.

    Rows without a time are left out.
    """
    rows = audit.where(F.col("ts").isNotNull()).select("run_id", "ts", F.unix_micros("ts").alias("us"), "seq", "event")
    return _watched(rows, delay, machines.Stalls(budget_s * 1_000_000), slot_s, max(keep_s, budget_s + 1), buckets,
                    "run_id string, since_us bigint, event string")


def beacons(events: DataFrame, delay: str = "10 minutes", slot_s: int = SLOT_S, keep_s: int = KEEP_S,
            buckets: int = BUCKETS) -> DataFrame:
    """Running beacon sums of every flow tuple, one row whenever flows of it are released.

    ``stateful.beacon_scores`` scores the newest row of each tuple. Flows without a time are left
    out; those without a size count for the gaps alone.
    """
    flows = events.where((F.col("event_type") == "flow") & F.col("event_ts").isNotNull()).select(
        "src_ip", "dest_ip", F.col("dest_port").cast("bigint").alias("dest_port"), "proto",
        F.col("event_ts").alias("ts"), F.unix_micros("event_ts").alias("us"), F.col("flow_id").alias("seq"),
        F.col("flow.bytes_toserver").alias("sent"))
    return _watched(
        flows, delay, machines.Beacons(), slot_s, keep_s, buckets,
        "src_ip string, dest_ip string, dest_port bigint, proto string, us bigint, gaps bigint, "
        "mean_gap double, m2_gap double, events bigint, mean_sent double, m2_sent double")
