"""Host telemetry: one query result per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.json import default_if_absent
from duskwatch.functions.values import parse_osquery_time
from duskwatch.sources.lines import parsed, read_lines, stream_lines

FIELDS = """name STRING, hostIdentifier STRING, calendarTime STRING, unixTime STRING,
action STRING, decorations MAP<STRING, STRING>, columns MAP<STRING, STRING>"""

# The logged queries and their columns.
QUERIES = {
    "active_processes": {"name": "string", "path": "string", "pid": "bigint", "port": "int",
                         "address": "string"},
    "all_processes": {"pid": "bigint", "parent": "bigint", "name": "string", "path": "string",
                      "cmdline": "string", "cwd": "string", "uid": "bigint", "gid": "bigint",
                      "euid": "bigint", "egid": "bigint", "start_time": "bigint",
                      "state": "string"},
    "net_processes": {"pid": "bigint", "name": "string", "local_address": "string",
                      "local_port": "int", "remote_address": "string", "remote_port": "int",
                      "state": "string"},
    "shell_history": {"command": "string", "history_file": "string", "uid": "bigint"},
    "suspicious_process_envs": {"name": "string", "path": "string", "pid": "bigint",
                                "key": "string", "value": "string"},
    "installed_packages": {"name": "string", "version": "string", "source": "string"},
    "system_info": {"hostname": "string", "cpu_brand": "string", "physical_memory": "bigint"},
}


def records(lines: DataFrame) -> DataFrame:
    """Lines as the common envelope: query name, host, time, action, tags, columns."""
    good = parsed(lines, FIELDS).where("not _bad").select("_o.*", "_raw", "_file")
    unix = F.col("unixTime").try_cast("bigint")
    return good.select(
        default_if_absent(F.col("_raw"), F.col("name"), "name", "unknown").alias("name"),
        F.col("hostIdentifier").alias("host"),
        parse_osquery_time(unix, F.col("calendarTime")).alias("seen_ts"),
        "action", "decorations", "columns",
        F.xxhash64("_raw").alias("seq"), "_raw", "_file",
    )


def read_osquery(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return records(read_lines(spark, paths))


def stream_osquery(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return records(stream_lines(spark, path, files_per_trigger))


def typed(df: DataFrame, query: str) -> DataFrame:
    """Rows of one query with its columns typed; a value of another type becomes null.

    ``seq`` breaks ties between rows of one time; it comes from the line itself.
    """
    columns = [F.col("columns")[c].try_cast(kind).alias(c) for c, kind in QUERIES[query].items()]
    out = df.where(F.col("name") == query).select(
        "host", "seen_ts", "action", "seq", *columns)
    if query == "all_processes":
        out = out.withColumn("start_time", F.timestamp_seconds("start_time"))
    return out


def other_queries(df: DataFrame) -> DataFrame:
    """Rows of queries that are not listed, kept as they are."""
    return df.where(~F.coalesce(F.col("name").isin(*QUERIES), F.lit(False)))
