"""Streams over growing logs that need no code of their own per key."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from duskwatch.operators import host, net
from duskwatch.session import scratch
from duskwatch.sources import eve
from duskwatch.sources.lines import parsed

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A batch uploads what it changed in the state, not whole files of it.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


_PARTITIONS = "spark.sql.shuffle.partitions"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a new stream's state: those of the session, but no more than two for each core.

    Every batch opens and commits each of them, and starts a worker where state is in Python, whatever
    it holds. A stream that is taken up again keeps the number of its first start.
    """
    return min(int(spark.conf.get(_PARTITIONS)), max(2 * spark.sparkContext.defaultParallelism, 16))


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state lives in RocksDB, in few partitions; the settings are read when a stream starts."""
    settings = {**_STATE, _PARTITIONS: str(state_partitions(spark))}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LateRows(StreamingQueryListener):
    """Adds up the rows that come after their watermark, by query run, over all its progress reports.

    A query itself keeps its newest reports only.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def _end(self, run: str) -> threading.Event:
        return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(str(event.runId))

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.rows[run] = self.rows.get(run, 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(str(event.runId)).set()

    def of(self, query: StreamingQuery, timeout_s: float = 60) -> int:
        """Late rows of a query that has ended; reports arrive in order, the end last."""
        run = str(query.runId)
        if not self._end(run).wait(timeout_s):
            raise TimeoutError(f"the end of {run} was not reported")
        return self.rows.get(run, 0)


_LATE: dict[str, int] = {}


def drain(
    df: DataFrame, path: str | None = None, checkpoint: str | None = None, mode: str = "append",
    partition_by: tuple = (),
) -> tuple[DataFrame, StreamingQuery]:
    """Process what is there now into a table and stop; returns the table and the query.

    With the same path and checkpoint a later call takes up where this one stopped.
    """
    spark = df.sparkSession
    path = path or scratch(spark, "stream")
    checkpoint = checkpoint or scratch(spark, "checkpoint")
    reports = LateRows()
    spark.streams.addListener(reports)
    try:
        with _rocks(spark):
            query = (
                df.writeStream.format("parquet").outputMode(mode).partitionBy(*partition_by)
                .option("path", path).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start()
            )
            query.awaitTermination()
        _LATE[str(query.runId)] = reports.of(query)
    finally:
        spark.streams.removeListener(reports)
    return spark.read.schema(df.schema).parquet(path), query


def late_rows(query: StreamingQuery) -> int:
    """Rows of a drained query that came after their watermark, over all its batches."""
    return _LATE[str(query.runId)]


def event_counts(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Records per type in tumbling windows; a window appears once it is closed."""
    return (
        events.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", window), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start_ts"), "event_type", "n")
    )


def egress(
    events: DataFrame, limit: int, window: str = "1 hour", slide: str = "10 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Bytes sent outside per source in sliding windows, where they pass a limit."""
    flows = net.external_dest(net.of_type(events, "flow")).select(
        "event_ts", "src_ip", F.col("flow.bytes_toserver").alias("sent"))
    return (
        flows.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", window, slide), "src_ip")
        .agg(F.sum("sent").alias("up"))
        .where(F.col("up") > limit)
        .select(F.col("window.start").alias("start_ts"), "src_ip", "up")
    )


def drain_updates(df: DataFrame, keys: list[str], path: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is there now in update mode; returns the newest row of each key.

    Every batch overwrites its own folder, so that a repeated batch leaves one copy.
    """
    spark = df.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _rocks(spark):
        query = (
            df.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint or scratch(spark, "checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def dedupe(events: DataFrame, keys: list[str], delay: str = "1 day", *more: DataFrame) -> DataFrame:
    """Each record once, for copies that come within the delay.

    Streams that run beside each other are given apart: each has a clock of its own, and the slowest one
    tells what is late, so that a stream which is ahead does not make the others' rows late.
    """
    both = events.withWatermark("event_ts", delay)
    for other in more:
        both = both.unionByName(other.withWatermark("event_ts", delay))
    return both.dropDuplicatesWithinWatermark(keys)


def with_quarantine(lines: DataFrame) -> DataFrame:
    """Non-blank lines marked good or bad from one parse, to be stored partitioned by the mark."""
    return parsed(lines, eve.FIELDS).select(
        F.col("_bad").alias("bad"), F.col("_o.event_type").alias("event_type"), "_raw", "_file")


def drain_quarantine(lines: DataFrame, path: str, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Store good and malformed lines apart; returns both tables."""
    spark = lines.sparkSession
    marked = with_quarantine(lines)
    query = (
        marked.writeStream.format("parquet").partitionBy("bad").option("path", path)
        .option("checkpointLocation", checkpoint or scratch(spark, "checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.schema(marked.schema).parquet(path)
    return rows.where("not bad").drop("bad"), rows.where("bad").drop("bad")


def net_rules(events: DataFrame) -> DataFrame:
    """Alerts and deprecated protocol versions as they arrive."""
    rule = F.when(F.col("event_type") == "alert", "alert").when(
        F.col("tls.version").isin(*net.OLD_TLS), "old_tls")
    return events.withColumn("rule", rule).where("rule is not null").select(
        "event_ts", "flow_id", "src_ip", "rule",
        F.coalesce("alert.signature", "tls.version").alias("detail"))


def host_rules(records: DataFrame) -> DataFrame:
    """Suspicious commands and library-path variables as they arrive."""
    command, key = F.col("columns")["command"], F.col("columns")["key"]
    hits = F.when(F.col("name") == "shell_history", host.rule_hits(command)).when(
        (F.col("name") == "suspicious_process_envs") & key.isin(*host.HIJACK_KEYS),
        F.array(F.lit("env_hijack")))
    return records.select(
        "host", "seen_ts", F.coalesce(command, key).alias("detail"),
        F.explode_outer(hits).alias("rule")).where("rule is not null")
