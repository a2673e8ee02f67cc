"""Streams with state of their own per key: runs, calls, silences, beacons.

Rows of a key come unordered within a micro-batch and are ordered by time there; between batches
files must arrive in order of time, as logs that grow do. Keys are dealt over ``buckets`` by their
hash; a bucket keeps one row for each of its keys, together in one value of state, and works on all its
new rows at once (``machines``), since a call into Python for each key costs far more than its rows. What
one task holds is the share of a bucket in one micro-batch, which the source bounds by bytes or by
files per trigger, and its state. The number of buckets is fixed by the first start, like that of partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duskwatch.operators.runs import CALLS, RESULTS, is_event
from duskwatch.streaming import machines
from duskwatch.streaming.machines import ENDS, ILLEGAL, STATE_AFTER, Machine, decoded, encoded  # noqa: F401

BUCKETS = 256


def _ms(us: int) -> int:
    """Milliseconds, rounded up, as timers count."""
    return -(-us // 1000)


class Held(StatefulProcessor):
    """A bucket's held rows, in one value."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", "rows binary")

    def load(self) -> pd.DataFrame | None:
        value = self.value.get()
        return decoded(value[0]) if value else None

    def store(self, held: pd.DataFrame) -> None:
        if len(held):
            self.value.update((encoded(held),))
        elif self.value.exists():
            self.value.clear()

    def close(self) -> None:
        pass


class _AsTheyCome(Held):
    def __init__(self, machine: Machine, ttl_ms: int | None = None) -> None:
        super().__init__(machine)
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.due = handle.getValueState("due", "ms bigint")

    def _keep(self, held: pd.DataFrame) -> None:
        """Store what is held and wait for the first time at which silence tells something."""
        self.store(held)
        times = self.machine.deadlines(held)
        ms = _ms(int(times.min())) if len(times) else None
        was = self.due.get()
        was = was[0] if was else None
        if ms == was:
            return
        if was is not None:
            self.handle.deleteTimer(was)
        if ms is None:
            self.due.clear()
        else:
            self.due.update((ms,))
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.load()
        batch = pd.concat(list(rows), ignore_index=True).drop(columns="bucket", errors="ignore")
        if self.ttl_ms is None:
            out, held = self.machine.step(held, batch)
        else:
            now = timerValues.getCurrentProcessingTimeInMs()
            fresh = held[held["seen_ms"] + self.ttl_ms > now] if held is not None else None
            seen = fresh[[*self.machine.keys, "seen_ms"]] if fresh is not None else None
            out, held = self.machine.step(None if fresh is None else fresh.drop(columns="seen_ms"), batch)
            held = _seen(held, seen, out, self.machine.keys, now)
        self._keep(held)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        held = self.load()
        if held is None:
            return
        out, held = self.machine.silent(held, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(held)
        if out is not None and len(out):
            yield out


def _seen(held: pd.DataFrame, before: pd.DataFrame | None, out: pd.DataFrame, keys: list[str], now: int) -> pd.DataFrame:
    """Held rows with the time their key last had rows."""
    times = out[keys].drop_duplicates().assign(seen_ms=now)
    if before is not None:
        times = pd.concat([times, before], ignore_index=True).drop_duplicates(keys)
    return held.merge(times, on=keys)


def bucketed(df: DataFrame, keys: list[str], buckets: int):
    """Rows grouped by the bucket of their key."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


def run_states(audit: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every move of every run between its states, illegal ones marked."""
    moves = audit.where(is_event(*STATE_AFTER, "run_end")).select(
        "run_id", F.unix_micros("ts").alias("us"), "seq", "event", "status")
    return bucketed(moves, ["run_id"], buckets).transformWithStateInPandas(
        _AsTheyCome(machines.Moves()),
        "run_id string, us bigint, event string, before string, state string, illegal boolean",
        "append", "none")


def call_results(audit: DataFrame, limit_s: int = 3600, delay: str = "10 minutes",
                 buckets: int = BUCKETS) -> DataFrame:
    """Calls as they are answered; those without a result in time become ``pending_late``.

    A call made again before its result leaves the earlier one ``pending``; a result without an
    open call is ``unmatched``. Rows without a time or a call id are left out.
    """
    rows = audit.where(is_event(*CALLS, *RESULTS) & F.col("tool_call_id").isNotNull() & F.col("ts").isNotNull()).select(
        "run_id", "tool_call_id", "ts", F.unix_micros("ts").alias("us"), "seq",
        is_event(*CALLS).alias("is_call"))
    return bucketed(rows.withWatermark("ts", delay), ["run_id", "tool_call_id"], buckets).transformWithStateInPandas(
        _AsTheyCome(machines.Calls(limit_s * 1_000_000)),
        "run_id string, tool_call_id string, call_us bigint, result_us bigint, status string",
        "append", "eventTime")


def stall_watch(audit: DataFrame, budget_s: int, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """A row for every silence of a run that outlasts its budget, once; none after its end.

    Rows without a time are left out.
    """
    rows = audit.where(F.col("ts").isNotNull()).select(
        "run_id", "ts", F.unix_micros("ts").alias("us"), "seq", "event")
    return bucketed(rows.withWatermark("ts", delay), ["run_id"], buckets).transformWithStateInPandas(
        _AsTheyCome(machines.Stalls(budget_s * 1_000_000)), "run_id string, since_us bigint, event string",
        "append", "eventTime")


_BEACON_COLUMNS = ["src_ip", "dest_ip", "dest_port", "proto", "us", "gaps", "mean_gap", "m2_gap",
                   "events", "mean_sent", "m2_sent"]


def beacons(events: DataFrame, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Running beacon sums of every flow tuple, one row per tuple and micro-batch.

    Flows without a time are left out; those without a size count for the gaps alone.
    """
    flows = events.where((F.col("event_type") == "flow") & F.col("event_ts").isNotNull()).select(
        "src_ip", "dest_ip", F.col("dest_port").cast("bigint").alias("dest_port"), "proto",
        F.unix_micros("event_ts").alias("us"), F.col("flow_id").alias("seq"),
        F.col("flow.bytes_toserver").alias("sent"))
    # State that expires needs the clock; without expiry there is no timer to keep.
    return bucketed(flows, _BEACON_COLUMNS[:4], buckets).transformWithStateInPandas(
        _AsTheyCome(machines.Beacons(), ttl_ms),
        "src_ip string, dest_ip string, dest_port bigint, proto string, us bigint, gaps bigint, "
        "mean_gap double, m2_gap double, events bigint, mean_sent double, m2_sent double",
        "append", "processingTime" if ttl_ms else "none")


def beacon_scores(running: DataFrame, min_gaps: int = 5) -> DataFrame:
    """Scores from the newest running sums of each tuple; the formula is that of the batch form."""
    rest = [c for c in _BEACON_COLUMNS[4:]]
    newest = running.groupBy(*_BEACON_COLUMNS[:4]).agg(
        F.max_by(F.struct(*rest), F.struct("events", "us")).alias("r")).select(
        *_BEACON_COLUMNS[:4], "r.*")
    cv_gap = F.try_divide(F.sqrt(F.try_divide("m2_gap", "gaps")), F.col("mean_gap"))
    cv_sent = F.try_divide(F.sqrt(F.try_divide("m2_sent", "events")), F.col("mean_sent"))
    score = F.when(cv_gap.isNotNull() & cv_sent.isNotNull(),
                   F.lit(1.0) - F.least(F.lit(1.0), (cv_gap + cv_sent) / 2))
    return newest.where(F.col("gaps") >= min_gaps).withColumns(
        {"cv_gap": cv_gap, "cv_bytes": cv_sent, "score": score})
