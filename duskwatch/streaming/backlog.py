"""Streams that lose nothing when a backlog comes in many batches, in any order of files.

Every batch writes what it adds to a folder of its own, so that a repeated batch leaves one copy;
tables are merged on reading. Nothing depends on the order of batches: counts and sums add up,
copies are found among what is stored, and rows of a run are ordered when they are read. Rows
that come after the delay is over take part like all others and are also written apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import net, ordered
from duskwatch.operators.runs import CALLS, ORDER, RESULTS, is_event
from duskwatch.session import scratch
from duskwatch.streaming.stateful import ENDS, ILLEGAL, STATE_AFTER
from duskwatch.streaming.streams import drain


def _work_off(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str | None) -> None:
    query = (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or scratch(df.sparkSession, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches at a path with their number; no rows before the first."""
    with_batch = spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long")).schema
    try:
        return spark.read.schema(with_batch).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], with_batch)


def merged(
    events: DataFrame, partial: Callable[[DataFrame], DataFrame], path: str, delay_s: int = 600,
    ts: str = "event_ts", checkpoint: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Work off a stream into partial results of each batch.

    Returns the partial results with their batch, the late rows (older than ``delay_s`` before
    the newest row of earlier batches), and one row for each batch with its newest time.
    """
    spark = events.sparkSession

    def add(batch: DataFrame, number: int) -> None:
        batch.persist()
        clock = _stored(spark, f"{path}/clock", f"newest {dict(events.dtypes)[ts]}")
        before = clock.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        partial(batch).write.mode("overwrite").parquet(f"{path}/partial/batch={number}")
        late = F.lit(False) if before is None else F.col(ts) < F.lit(before) - F.make_dt_interval(secs=F.lit(delay_s))
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        batch.unpersist()

    _work_off(events, add, checkpoint)
    return (_stored(spark, f"{path}/partial", partial(events).schema),
            _stored(spark, f"{path}/late", events.schema),
            _stored(spark, f"{path}/clock", f"newest {dict(events.dtypes)[ts]}"))


def event_counts(events: DataFrame, path: str, window: str = "1 hour", delay_s: int = 600):
    """Records per type in tumbling windows, from all rows, and the late rows.

    ``closed`` tells whether the newest row of all is past the window and the delay.
    """
    def partial(batch):
        return batch.groupBy(F.window("event_ts", window).alias("w"), "event_type").agg(
            F.count(F.lit(1)).alias("n"))

    parts, late, clock = merged(events, partial, path, delay_s)
    newest = clock.agg(F.max("newest").alias("t")).scalar()
    counts = parts.groupBy("w", "event_type").agg(F.sum("n").alias("n")).select(
        F.col("w.start").alias("start_ts"), "event_type", "n",
        (F.col("w.end") <= newest - F.make_dt_interval(secs=F.lit(delay_s))).alias("closed"))
    return counts, late


def egress(events: DataFrame, path: str, limit: int, window: str = "1 hour", slide: str = "10 minutes",
           delay_s: int = 600):
    """Bytes sent outside per source in sliding windows, where they pass a limit; and late rows."""
    flows = net.external_dest(net.of_type(events, "flow")).select(
        "event_ts", "src_ip", F.col("flow.bytes_toserver").alias("sent"))

    def partial(batch):
        return batch.groupBy(F.window("event_ts", window, slide).alias("w"), "src_ip").agg(
            F.sum("sent").alias("up"))

    parts, late, _ = merged(flows, partial, path, delay_s)
    sums = parts.groupBy("w", "src_ip").agg(F.sum("up").alias("up")).where(F.col("up") > limit)
    return sums.select(F.col("w.start").alias("start_ts"), "src_ip", "up"), late


def dedupe(events: DataFrame, keys: list[str], path: str, ts: str = "event_ts",
           checkpoint: str | None = None) -> DataFrame:
    """Each record once, however far apart its copies come.

    The keys that were seen are state, spread over partitions by their hash and kept in RocksDB with
    its filters, so a batch looks up and writes its own keys and nothing of what is stored is
    read again. Null keys equal each other. Rows are stored by day.
    """
    days = events.withColumn("day", F.coalesce(F.to_date(ts), F.lit("0001-01-01").cast("date")))
    return drain(days.dropDuplicates(keys), path, checkpoint, partition_by=("day",))[0].drop("day")


def keep(rows: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Store the rows of a stream and return all that are stored."""
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _work_off(rows, add, checkpoint)
    return _stored(rows.sparkSession, path, rows.schema).drop("batch")


# --- the moves of runs and calls, from rows in any order ------------------------------------------

def _lookup(table: dict, event: Column, other: Column) -> Column:
    out = other
    for name, value in table.items():
        out = F.when(event == name, value).otherwise(out)
    return out


def run_moves(audit: DataFrame) -> DataFrame:
    """Every move of every run between its states, illegal ones marked."""
    moves = audit.where(is_event(*STATE_AFTER, "run_end")).select("run_id", *ORDER, "event", "status")
    state = _lookup(STATE_AFTER, F.col("event"), F.col("status"))
    out = ordered.neighbours(moves.withColumn("state", state), ["run_id"], ORDER,
                             prev={"before": "state"})
    before = F.coalesce("before", F.lit("none"))
    illegal = _lookup({k: before.isin(*v) for k, v in ILLEGAL.items()}, F.col("event"), F.lit(False))
    return out.select("run_id", F.unix_micros("ts").alias("us"), "event", before.alias("before"), "state",
                      illegal.alias("illegal"))


def _newest(df: DataFrame, delay_s: int) -> Column:
    return df.agg((F.max(F.unix_micros("ts")) - delay_s * 1_000_000).alias("t")).scalar()


def call_moves(audit: DataFrame, limit_s: int = 3600, delay_s: int = 600) -> DataFrame:
    """Calls with what became of them, as the stream with state reports them."""
    rows = audit.where(is_event(*CALLS, *RESULTS) & F.col("tool_call_id").isNotNull()).select(
        "run_id", "tool_call_id", *ORDER, F.unix_micros("ts").alias("us"), is_event(*CALLS).alias("is_call"))
    limit, newest = limit_s * 1_000_000, _newest(rows, delay_s)
    out = ordered.neighbours(rows, ["run_id", "tool_call_id"], ORDER,
                             prev={"p_us": "us", "p_call": "is_call"}, following={"n_us": "us", "n_call": "is_call"})
    held = F.coalesce(F.col("p_call") & (F.col("us") - F.col("p_us") <= limit), F.lit(False))
    results = out.where(~F.col("is_call")).select(
        "run_id", "tool_call_id", F.when(held, F.col("p_us")).alias("call_us"), F.col("us").alias("result_us"),
        F.when(held, "answered").otherwise("unmatched").alias("status"))
    over = F.when(F.col("n_us").isNull(), F.col("us") + limit <= newest).otherwise(
        F.col("n_us") - F.col("us") > limit)
    calls = out.where(F.col("is_call") & (over | F.coalesce("n_call", F.lit(False)))).select(
        "run_id", "tool_call_id", F.col("us").alias("call_us"), F.lit(None).cast("bigint").alias("result_us"),
        F.when(over, "pending_late").otherwise("pending").alias("status"))
    return results.unionByName(calls)


def stall_moves(audit: DataFrame, budget_s: int, delay_s: int = 600) -> DataFrame:
    """A row for every silence of a run that outlasts its budget; none after its end."""
    rows = audit.select("run_id", *ORDER, F.unix_micros("ts").alias("us"), "event")
    budget, newest = budget_s * 1_000_000, _newest(rows, delay_s)
    out = ordered.neighbours(rows, ["run_id"], ORDER, following={"n_us": "us"})
    over = F.when(F.col("n_us").isNull(), F.col("us") + budget <= newest).otherwise(
        F.col("n_us") - F.col("us") > budget)
    return out.where(~is_event(*ENDS) & over).select("run_id", F.col("us").alias("since_us"), "event")
