"""What the streams with keyed state do with rows of many keys at once.

A machine gets what it holds of its keys, one row for each, and new rows of any of them. It lays both in
order of key, time and sequence, held rows first, and works on whole columns: a row's neighbours are the
rows beside it. It returns results and what it holds from then on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

# The state a run is in after each kind of event, and the moves it may not make.
STATE_AFTER = {
    "run_start": "ready", "prompt": "running", "model_text": "active", "error": "failed",
    "setup_error": "failed", "interrupted": "interrupted",
}
ILLEGAL = {
    "prompt": ("running", "completed", "interrupted"),
    "model_text": ("none", "ready", "completed", "failed", "interrupted"),
    "run_start": ("ready", "running", "active", "completed", "failed", "interrupted"),
}
# Events after which a run is not waited for.
ENDS = ("run_end", "interrupted")


def encoded(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def decoded(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Laid:
    """Held and new rows in order, and where the rows of a key begin and end."""

    def __init__(self, held: pd.DataFrame | None, rows: pd.DataFrame, keys: list[str]) -> None:
        parts = [rows.assign(_new=True)]
        if held is not None and len(held):
            parts.insert(0, held.assign(_new=False, seq=0))
        both = pd.concat(parts, ignore_index=True)
        key = both.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((both["seq"], both["us"], both["_new"], key))
        self.rows, key = both.iloc[order].reset_index(drop=True), key[order]
        self.new = self.rows["_new"].to_numpy(dtype=bool)
        self.us = self.rows["us"].to_numpy()
        edge = key[1:] != key[:-1]
        self.first, self.last = np.r_[True, edge], np.r_[edge, True]

    def before(self, values: np.ndarray) -> np.ndarray:
        """Values of the row before; those of first rows mean nothing."""
        return np.r_[values[:1], values[:-1]]

    def after(self, values: np.ndarray) -> np.ndarray:
        return np.r_[values[1:], values[-1:]]

    def forgotten(self, slot_us: int, keep_us: int | None) -> np.ndarray:
        """Rows whose key was silent for so long before their slot that it begins anew."""
        if keep_us is None:
            return np.zeros(len(self.us), dtype=bool)
        return ~self.first & (self.before(self.us) + keep_us < self.us // slot_us * slot_us)


class Machine:
    """``slot_us`` and ``keep_us`` tell when a key is forgotten; it never is without them."""

    keys: list[str]
    slot_us: int = 1
    keep_us: int | None = None

    def step(self, held: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Results of new rows, and what is held after them."""
        raise NotImplementedError

    def silent(self, held: pd.DataFrame, over_us: int) -> tuple[pd.DataFrame | None, pd.DataFrame]:
        """Results of there being no rows up to a time of keys that waited until then, and what is held."""
        return None, held

    def deadlines(self, held: pd.DataFrame) -> np.ndarray:
        """Times at which silence of the held keys tells something."""
        return np.empty(0, dtype="int64")


class Moves(Machine):
    """Moves of runs between their states; holds the state of each."""

    keys = ["run_id"]

    def step(self, held, rows):
        laid = Laid(held, rows.assign(state=None), self.keys)
        event = laid.rows["event"].to_numpy(object) if held is None else laid.rows["event"].where(laid.new).to_numpy(object)
        after = laid.rows["event"].map(STATE_AFTER).to_numpy(object)
        state = np.where(event == "run_end", laid.rows["status"].to_numpy(object), after)
        state = np.where(laid.new, state, laid.rows["state"].to_numpy(object))
        before = laid.before(state)
        begins = laid.first | laid.forgotten(self.slot_us, self.keep_us) | pd.isna(before)
        before = np.where(begins, "none", before)
        illegal = np.zeros(len(state), dtype=bool)
        for kind, wrong in ILLEGAL.items():
            illegal |= (event == kind) & np.isin(before.astype(str), wrong)
        out = laid.rows[["run_id", "us", "event"]].assign(before=before, state=state, illegal=illegal)[laid.new]
        return out, laid.rows[["run_id", "us"]].assign(state=state)[laid.last]


class Calls(Machine):
    """What becomes of calls; holds the time of the open call of each id."""

    keys = ["run_id", "tool_call_id"]

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def _told(self, rows: pd.DataFrame, call_us, result_us, status) -> pd.DataFrame:
        return pd.DataFrame({
            "run_id": rows["run_id"].to_numpy(object), "tool_call_id": rows["tool_call_id"].to_numpy(object),
            "call_us": pd.array(call_us, dtype="Int64"), "result_us": pd.array(result_us, dtype="Int64"),
            "status": status})

    def step(self, held, rows):
        held = None if held is None else held.assign(is_call=True)
        laid = Laid(held, rows, self.keys)
        us, is_call = laid.us, laid.rows["is_call"].to_numpy(dtype=bool)
        p_us, n_us = laid.before(us), laid.after(us)
        answers = ~laid.first & laid.before(is_call) & (us - p_us <= self.limit_us)
        late = ~laid.last & (n_us - us > self.limit_us)
        again = ~laid.last & laid.after(is_call)
        results, calls = laid.new & ~is_call, is_call & (late | again)
        call_us = pd.array(p_us[results], dtype="Int64")
        call_us[~answers[results]] = pd.NA
        out = pd.concat([
            self._told(laid.rows[results], call_us, us[results], np.where(answers[results], "answered", "unmatched")),
            self._told(laid.rows[calls], us[calls], [pd.NA] * int(calls.sum()),
                       np.where(late[calls], "pending_late", "pending"))], ignore_index=True)
        return out, laid.rows[[*self.keys, "us"]][laid.last & is_call]

    def silent(self, held, over_us):
        over = held["us"].to_numpy() + self.limit_us <= over_us
        gone = held[over]
        return self._told(gone, gone["us"].to_numpy(), [pd.NA] * len(gone), "pending_late"), held[~over]

    def deadlines(self, held):
        return held["us"].to_numpy() + self.limit_us


class Stalls(Machine):
    """Silences that outlast their budget; holds the last event of a run and whether it was told."""

    keys = ["run_id"]

    def __init__(self, budget_us: int) -> None:
        self.budget_us = budget_us

    def _waits(self, rows: pd.DataFrame) -> np.ndarray:
        return ~rows["event"].isin(ENDS).to_numpy() & ~rows["told"].to_numpy(dtype=bool)

    def _told(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[["run_id", "us", "event"]].rename(columns={"us": "since_us"})

    def step(self, held, rows):
        laid = Laid(held, rows.assign(told=False), self.keys)
        over = ~laid.last & (laid.after(laid.us) - laid.us > self.budget_us)
        return (self._told(laid.rows[over & self._waits(laid.rows)]),
                laid.rows[["run_id", "us", "event", "told"]][laid.last])

    def silent(self, held, over_us):
        over = self._waits(held) & (held["us"].to_numpy() + self.budget_us <= over_us)
        return self._told(held[over]), held.assign(told=held["told"].to_numpy(dtype=bool) | over)

    def deadlines(self, held):
        return held["us"].to_numpy()[self._waits(held)] + self.budget_us


SUMS = ["gaps", "mean_gap", "m2_gap", "events", "mean_sent", "m2_sent"]


def _folded(n, mean, m2, values: np.ndarray, part: np.ndarray):
    """Running number, mean and squared deviation of each part with its values folded in."""
    k = np.bincount(part, minlength=len(n))
    some = np.maximum(k, 1)
    mean_k = np.bincount(part, values, len(n)) / some
    m2_k = np.bincount(part, (values - mean_k[part]) ** 2, len(n))
    total, d = n + k, mean_k - mean
    whole = np.maximum(total, 1)
    return total, np.where(k > 0, mean + d * k / whole, mean), np.where(k > 0, m2 + m2_k + d * d * n * k / whole, m2)


class Beacons(Machine):
    """Running number, mean and squared deviation of gaps and of sizes, for each flow tuple."""

    keys = ["src_ip", "dest_ip", "dest_port", "proto"]

    def step(self, held, rows):
        laid = Laid(held, rows, self.keys)
        begins = laid.first | laid.forgotten(self.slot_us, self.keep_us)
        part = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        sums = [np.zeros(len(at)) for _ in SUMS]
        if held is not None and len(held):
            sums = [laid.rows[c].to_numpy("float64")[at] for c in SUMS]
            sums = [np.where(laid.new[at], 0.0, c) for c in sums]
        gap = ~begins
        gaps = (laid.us - laid.before(laid.us))[gap] / 1e6
        sent = laid.rows["sent"].to_numpy("float64", na_value=np.nan)
        known = laid.new & ~np.isnan(sent)
        sums = [*_folded(*sums[:3], gaps, part[gap]), *_folded(*sums[3:], sent[known], part[known])]
        ends = np.r_[at[1:], len(part)] - 1
        out = laid.rows[[*self.keys, "us"]].iloc[ends].assign(**dict(zip(SUMS, sums)))
        out = out.astype({"us": "int64", "gaps": "int64", "events": "int64"})
        return out[laid.new[ends]], out[laid.last[ends]]
