"""Network events: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.json import default_if_absent
from duskwatch.functions.values import parse_eve_ts
from duskwatch.sources.lines import parsed, read_lines, stream_lines

FIELDS = """timestamp STRING, flow_id BIGINT, event_type STRING, src_ip STRING, src_port INT,
dest_ip STRING, dest_port INT, proto STRING, app_proto STRING,
flow STRUCT<bytes_toserver: BIGINT, bytes_toclient: BIGINT, start: STRING, end: STRING, age: BIGINT>,
tls STRUCT<sni: STRING, version: STRING, ja3: STRUCT<hash: STRING>>,
quic STRUCT<sni: STRING>,
dns STRUCT<rrname: STRING, rcode: STRING>,
http STRUCT<hostname: STRING, url: STRING, user_agent: STRING>,
alert STRUCT<signature: STRING, severity: INT>,
stats VARIANT"""


def events(lines: DataFrame) -> DataFrame:
    """Lines as events in the canonical columns, with the raw line and its file.

    Malformed lines are left out here; ``quarantine`` gives them. A record without the key
    ``event_type`` has the type ``unknown``; one with an explicit null keeps the null.
    """
    good = parsed(lines, FIELDS).where("not _bad").select("_o.*", "_raw", "_file")
    return good.select(
        parse_eve_ts(F.col("timestamp")).alias("event_ts"),
        "flow_id",
        default_if_absent(F.col("_raw"), F.col("event_type"), "event_type", "unknown")
        .alias("event_type"),
        "src_ip", "src_port", "dest_ip", "dest_port", "proto", "app_proto",
        "flow", "tls", "quic", "dns", "http", "alert", "stats", "_raw", "_file",
    )


def read_eve(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Events of one or many files, under any name, rotated parts included."""
    return events(read_lines(spark, paths))


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that hold a record, as they are, for work that takes them apart itself."""
    return parsed(read_lines(spark, paths), "_any STRING").where("not _bad").select("_raw", "_file")


def stream_eve(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, newest_first: bool = False,
) -> DataFrame:
    return events(stream_lines(spark, path, files_per_trigger, newest_first=newest_first))
