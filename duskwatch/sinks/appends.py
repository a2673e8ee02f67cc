"""Tables that only gain rows: an append is seen whole or not at all.

An append writes its rows aside and then publishes a manifest that names them, so what a broken one
leaves is never read, and readers between two appends see the first alone. Small appends are
merged (``generations``), so the number of files does not follow that of the appends.
"""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.sinks import commits, generations


def append(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Add rows; returns the version that has them. They must have the columns of those before."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    stored = None
    while True:
        version = generations.latest(spark, path)
        known = generations.known(spark, path, version)
        layout = generations.check_layout(generations.layout_of(known.agg(F.max("layout")).first()[0]), rows)
        if stored is None:
            generations.store(rows, generations.place(path, name), partition_by)
            stored = spark.read.schema(layout).parquet(generations.place(path, name)).count()
        mine = spark.createDataFrame([(name, stored, name)], "file string, length long, generation string").select(
            "file", "length", F.current_timestamp().alias("modified"), "generation", F.lit(True).alias("alive"),
            F.lit(None).cast("string").alias("layout"))
        state = known.where("alive").unionByName(mine)
        following = (version or 0) + 1
        state = generations.merged(spark, path, state, layout, partition_by, f"{following:012d}-{uuid.uuid4().hex}")
        try:
            generations.publish(spark, path, following, state, layout)
            return following
        except commits.Conflict:
            continue


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All rows appended so far, or up to a version."""
    return generations.read(spark, path, version or generations.latest(spark, path))


def exists(spark: SparkSession, path: str) -> bool:
    return generations.latest(spark, path) is not None
