"""Large results: the whole is stored, a preview and a handle are returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.runs import OVERFLOW_CHARS, PREVIEW_CHARS
from duskwatch.operators.texts import lines


def previews(
    df: DataFrame, key: str, text: str = "text", over: int = OVERFLOW_CHARS,
    shown: int = PREVIEW_CHARS,
) -> DataFrame:
    """Per result: its size, whether it is stored apart, and the text or its beginning."""
    size = F.length(text)
    return df.select(
        F.col(key).alias("handle"), size.cast("bigint").alias("chars"),
        (size >= over).alias("stored"),
        F.when(size >= over, F.substring(text, 1, shown)).otherwise(F.col(text)).alias("shown"))


def bounded(
    df: DataFrame, path: str, key: str, text: str = "text", over: int = OVERFLOW_CHARS,
    shown: int = PREVIEW_CHARS, run: str = "0",
) -> DataFrame:
    """Store the oversized results of a run line by line below ``path``; return the previews.

    Storing a run again replaces what it had stored. A store that fails raises, as a preview
    must not be the only copy.
    """
    large = df.where(F.length(text) >= over)
    stored = lines(large, key, text).withColumnRenamed(key, "handle")
    stored.sortWithinPartitions("handle", "line_no").write.mode("overwrite").parquet(f"{path}/run={run}")
    return previews(df, key, text, over, shown)


def read_slice(
    spark: SparkSession, path: str, handle: int | str | None, start: int, n: int
) -> DataFrame:
    """``n`` lines of a stored result from line ``start``; of every result without a handle."""
    rows = spark.read.parquet(path).drop("run").where(F.col("line_no").between(start, start + n - 1))
    if handle is not None:
        rows = rows.where(F.col("handle") == handle)
    return rows.orderBy("handle", "line_no")
