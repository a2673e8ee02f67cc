"""Rows stored in generations under a manifest that is replaced by one rename.

A manifest says what lies in which generation: one row for each input file or append, with its
size. Small generations are merged as in a log-structured tree: eight of about one size become one
of the next, so their number, and with it that of small files, grows with the logarithm of what was
added, and each row is rewritten as often.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duskwatch.sinks import commits

MERGE = 8
STATE = "file string, length long, modified timestamp, generation string, alive boolean, layout string"


def known(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """The manifest of a version; no rows before the first."""
    if version is None:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(commits.place(f"{path}/manifest", version))


def latest(spark: SparkSession, path: str) -> int | None:
    return commits.latest(spark, f"{path}/manifest")


def publish(spark: SparkSession, path: str, version: int, state: DataFrame, layout: StructType) -> None:
    """Make ``state`` the manifest of that version; the columns of the rows go along."""
    note = spark.createDataFrame([(None, None, None, None, False, layout.json())], STATE)
    whole = state.unionByName(note)
    commits.publish(spark, f"{path}/manifest", version, lambda place: whole.coalesce(1).write.parquet(place))


def layout_of(text: str | None) -> StructType | None:
    return StructType.fromJson(json.loads(text)) if text else None


def check_layout(stored: StructType | None, rows: DataFrame) -> StructType:
    """The columns of the stored rows, which new ones must have, too."""
    kinds = lambda schema: [(f.name, f.dataType) for f in schema]
    if stored is not None and kinds(stored) != kinds(rows.schema):
        raise ValueError("columns are not those of the stored rows; take another path")
    return stored or rows.schema


def place(path: str, generation: str) -> str:
    return f"{path}/data/generation={generation}"


def store(rows: DataFrame, at: str, partition_by: Sequence[str]) -> None:
    # Rows of a value meet in few writers, a value that holds most rows is split, and few rows make
    # one file.
    rows = rows.hint("rebalance", *partition_by)
    rows.write.partitionBy(*partition_by).parquet(at)


def merged(spark: SparkSession, path: str, state: DataFrame, layout: StructType, partition_by: Sequence[str],
           name: str) -> DataFrame:
    """Merge generations of about one size once there are ``MERGE`` of them."""
    sizes = state.where("alive").groupBy("generation").agg(F.sum("length").alias("size")).collect()
    classes: dict[int, list[str]] = {}
    for row in sizes:
        classes.setdefault(int(math.log(max(row["size"], 1), MERGE)), []).append(row.generation)
    small = [g for group in classes.values() if len(group) >= MERGE for g in group]
    if not small:
        return state
    chosen = F.col("generation").isin(small)
    store(rows_of(spark, path, state.where(chosen), layout), place(path, name), partition_by)
    moved = F.when(chosen, F.lit(name)).otherwise(F.col("generation"))
    return state.where(~chosen | F.col("alive")).withColumn("generation", moved)


def rows_of(spark: SparkSession, path: str, state: DataFrame, layout: StructType | None) -> DataFrame:
    """Rows of the generations in ``state``, without those of files that are dead in them."""
    each = state.groupBy("generation").agg(F.count_if(~F.col("alive")).alias("dead")).collect()
    if not each:
        return spark.createDataFrame([], layout)
    schema = StructType([*layout.fields, StructField("generation", StringType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(
        *[place(path, r.generation) for r in each])
    if any(r.dead for r in each):
        dead = state.where("not alive").select(F.col("file").alias("_file"), "generation").distinct()
        rows = rows.join(dead, ["_file", "generation"], "left_anti")
    return rows.select(*layout.names)


def read(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """All rows as of a version."""
    found = known(spark, path, version)
    row = found.where("layout is not null").select("layout").first()
    if row is None:
        raise ValueError(f"nothing is stored at {path}")
    return rows_of(spark, path, found.where("file is not null"), layout_of(row.layout))
