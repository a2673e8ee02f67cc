"""Scalars of the run records: ids, stamps, delays, sizes, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a task id, the names it may not take, the stamp of a run.
TASK_ID = r"^[a-z0-9][a-z0-9_-]{0,63}$"
RESERVED_TASKS = ("default", "data", "logs", "memory")
STAMP = "yy-MM-dd_HH-mm-ss"
DELAY_BOUNDS = (0.1, 30.0)


def valid_task_id(task: Column) -> Column:
    """A well-formed task id that is not reserved; false for null."""
    return F.coalesce(task.rlike(TASK_ID) & ~task.isin(*RESERVED_TASKS), F.lit(False))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, STAMP)


def parse_stamp(stamp: Column) -> Column:
    """Inverse of ``run_stamp``; null for other text."""
    return F.try_to_timestamp(stamp, F.lit(STAMP))


def parse_eve_ts(text: Column) -> Column:
    """Event time with an offset such as ``+0000``; null for other text."""
    return text.try_cast("timestamp")


def parse_osquery_time(unix_time: Column, calendar_time: Column) -> Column:
    """Epoch seconds, else the readable time without its weekday."""
    readable = F.try_to_timestamp(
        F.regexp_replace(F.substring(calendar_time, 5, 40), r"\s+", " "),
        F.lit("MMM d HH:mm:ss yyyy z"),
    )
    return F.coalesce(F.timestamp_seconds(unix_time), readable)


def clamp_delay(wait: Column) -> Column:
    """Seconds to wait from text or number: 1 when unusable, else within the bounds."""
    seconds = F.regexp_replace(wait.cast("string"), r"^\s+|\s+$", "").try_cast("double")
    usable = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    low, high = DELAY_BOUNDS
    return F.least(F.greatest(F.when(usable, seconds).otherwise(1.0), F.lit(low)), F.lit(high))


def provider_of(model: Column) -> Column:
    """Text before the first colon of a model id, else empty."""
    return F.when(F.instr(model, ":") > 0, F.substring_index(model, ":", 1)).otherwise("")


def string_keys(result: Column) -> Column:
    """The same map with its keys as text."""
    return F.transform_keys(result, lambda key, _: key.cast("string"))


def duration_s(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def bytes_label(size: Column) -> Column:
    """Size in decimal and in binary units, one decimal place each."""
    return F.struct(
        F.round(size / F.lit(1e6), 1).alias("mb"),
        F.round(size / F.lit(1048576.0), 1).alias("mib"),
    )
