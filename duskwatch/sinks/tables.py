"""Tables that outlive a question: derived caches, results of a task's run, audit appends."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.values import RESERVED_TASKS, TASK_ID
from duskwatch.sinks import appends


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table can be read at the path."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def fingerprint(spark: SparkSession, inputs: str | list[str]) -> str:
    """Names, sizes and times of the input files as one number, from their listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs)
    mark = F.xxhash64("_metadata.file_path", "length", "modificationTime")
    row = files.agg(F.bit_xor(mark).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{(row.x or 0) & (2**64 - 1):016x}-{row.n}"


def cached(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    inputs: str | list[str],
    partition_by: tuple = (),
) -> DataFrame:
    """A derived table, built once for each state of its inputs and read back from then on.

    A marker is written after the data, so that a broken build is not taken for a cache.
    """
    place = f"{path}/{fingerprint(spark, inputs)}"
    if not exists(spark, f"{place}/done"):
        table = build()
        if partition_by:
            # Rows of a value meet in few writers, and a value that holds most rows is split.
            table = table.hint("rebalance", *partition_by)
        table.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{place}/data")
        spark.range(1).write.mode("overwrite").parquet(f"{place}/done")
    return spark.read.parquet(f"{place}/data")


def save(df: DataFrame, base: str, task: str, run: str, fresh: bool = False) -> str:
    """Write results under task and run; returns the path.

    A known task gains a run; with ``fresh`` the task must not exist yet. Task ids that are
    malformed or reserved are refused.
    """
    if not re.match(TASK_ID, task) or task.endswith("\n"):
        raise ValueError(f"task names must match {TASK_ID}")
    if task in RESERVED_TASKS:
        raise ValueError(f"{task!r} is a reserved task name")
    if fresh and exists(df.sparkSession, f"{base}/task_id={task}"):
        raise ValueError(f"task {task!r} exists already")
    path = f"{base}/task_id={task}/run_id={run}"
    df.write.mode("errorifexists" if fresh else "append").parquet(path)
    return path


TASK_BUCKETS = 16


def _task_bucket(task) -> Column:
    return F.pmod(F.xxhash64(task), F.lit(TASK_BUCKETS)).cast("int")


def save_all(df: DataFrame, base: str) -> int:
    """Append rows that carry their own ``task_id`` and ``run_id``; bad task ids fail the job.

    Task and run are columns, and rows lie in buckets by task, so that neither folders nor files
    follow the number of runs. All rows are seen at once, or none. ``results`` reads them.
    """
    from duskwatch.functions.values import valid_task_id

    checked = df.where(
        F.assert_true(valid_task_id(F.col("task_id")), "malformed or reserved task name").isNull())
    return appends.append(checked.withColumn("bucket", _task_bucket(F.col("task_id"))), base, ["bucket"])


def results(spark: SparkSession, base: str, task: str | None = None, run: str | None = None) -> DataFrame:
    """Rows of ``save_all``: of all tasks, or of one, whose bucket alone is read, and of one run."""
    rows = appends.read(spark, base)
    if task is not None:
        rows = rows.where((F.col("bucket") == _task_bucket(F.lit(task))) & (F.col("task_id") == task))
    if run is not None:
        rows = rows.where(F.col("run_id") == run)
    return rows.drop("bucket")


def append_events(df: DataFrame, path: str) -> int:
    """Append audit events by day, all or none; what is there is never changed. ``events`` reads them."""
    return appends.append(df.withColumn("day", F.to_date("ts")), path, ["day"])


def events(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``append_events``, with their day."""
    return appends.read(spark, path)


def stream_events(df: DataFrame, path: str, checkpoint: str):
    """The same for a stream; the checkpoint makes each event appear once."""
    days = df.withColumn("day", F.to_date("ts"))
    return (
        days.writeStream.outputMode("append").partitionBy("day").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def write_reports(pages: DataFrame, path: str) -> None:
    """Store report pages in order of run and page."""
    pages.repartitionByRange("run_id", "page").sortWithinPartitions("run_id", "page").write.mode(
        "overwrite").parquet(path)
