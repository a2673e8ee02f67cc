"""Audit trails: the append-only JSON lines of one run per file, or of many runs collected into one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sources.lines import collected, parsed, read_lines, stream_lines

FIELDS = """ts STRING, event STRING, mode STRING, skill STRING, model STRING, workspace STRING,
interactive BOOLEAN, thinking STRING, max_tokens BIGINT, max_turns BIGINT, memory_enabled BOOLEAN,
memory_scope STRING, prompt STRING, content STRING, tool_call_id STRING, tool_name STRING,
code STRING, args STRING, overflow_handle STRING, overflow_bytes BIGINT,
overflow_content_handle STRING, reason STRING, status_code INT, retry_attempt INT,
max_retries INT, delay_seconds STRING, error STRING, error_type STRING, status STRING"""

# Fixed value: the name of a run's file; task names may hold dashes.
FILE_NAME = r"(?:^|[/=])runner-([^/]+)-([0-9a-f]{32})[.]jsonl(?:/|$)"


def _ddl(only: tuple) -> str:
    fields = {field.split()[0]: field for field in FIELDS.split(",")}
    return ", ".join(fields[name] for name in dict.fromkeys(("ts", *only))) if only else FIELDS


def events(lines: DataFrame, only: tuple = ()) -> DataFrame:
    """Lines as audit events; task and run come from the file name, which alone has them all.

    Content and arguments of any JSON type are kept as text. ``seq`` breaks ties of one time: the place
    of a collected line in its trail, for others a hash of the line. With ``only``, no fields but these
    and the time are made of the lines, which the engine does not find out by itself.
    """
    place = [F.col("_place")] if "_place" in lines.columns else []
    # Told before the parse, so that the line need not pass through it.
    lines = lines.withColumn("_seq", F.coalesce(*place, F.xxhash64("_raw")))
    good = parsed(lines, _ddl(only)).where("not _bad").select("_o.*", "_raw", "_file", "_seq")
    return good.select(
        F.regexp_extract("_file", FILE_NAME, 1).alias("task_id"),
        F.regexp_extract("_file", FILE_NAME, 2).alias("run_id"),
        F.col("ts").try_cast("timestamp").alias("ts"),
        F.col("_seq").alias("seq"),
        *[c for c in good.columns if c not in ("ts", "_raw", "_file", "_seq")],
        "_raw", "_file",
    )


def read_audit(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of trails in files of their own."""
    return events(read_lines(spark, paths))


def read_collected(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of many trails in few files (``lines.collected``): the way to keep very many runs."""
    return events(collected(read_lines(spark, paths)))


def stream_audit(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, newest_first: bool = False,
) -> DataFrame:
    return events(stream_lines(spark, path, files_per_trigger, newest_first=newest_first))


def stream_collected(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, newest_first: bool = False, only: tuple = (),
) -> DataFrame:
    return events(collected(stream_lines(spark, path, files_per_trigger, newest_first=newest_first)), only)
