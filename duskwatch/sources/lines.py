"""Raw lines with the file they come from, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.json import with_object
from duskwatch.session import utc


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every line of the files, folders or globs as ``_raw``, with its file as ``_file``.

    Plain files are split over tasks; a gzip file is one task, so keep large logs unpacked or
    in a codec that splits.
    """
    reader = utc(spark).read.option("recursiveFileLookup", "true")
    return _named(reader.text(paths))


def stream_lines(
    spark: SparkSession, path: str, files_per_trigger: int | None = None,
    bytes_per_trigger: int = 2 << 30, newest_first: bool = False,
) -> DataFrame:
    """The same as a stream over a folder that gains files.

    A micro-batch is bounded by files or, by default, by bytes, so that a backlog is worked off
    in pieces and no key's share of a batch outgrows a task. ``newest_first`` works it off from
    its end.
    """
    reader = utc(spark).readStream.option("recursiveFileLookup", "true")
    reader = reader.option("latestFirst", str(newest_first).lower())
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return _named(reader.text(path))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("_file"))


def collected(lines: DataFrame) -> DataFrame:
    """Lines of many small logs that were collected into large files.

    Such a line is the name of its log, its place there (a number that grows, such as an offset) and
    the line itself, with tabs between. They become ``_file``, ``_place`` and ``_raw``; lines of another
    form keep their file and have no place.
    """
    # What stands before the second tab, if there is one; the pattern sees no more of a long line.
    head = F.substring_index("_raw", "\t", 2)
    label = F.when(F.octet_length(head) < F.octet_length("_raw"), F.regexp_extract(
        F.concat(head, F.lit("\t")), r"^([^\t{]+\t-?\d+\t)", 1)).otherwise("")
    name, place = F.split_part("_label", F.lit("\t"), F.lit(1)), F.split_part("_label", F.lit("\t"), F.lit(2))
    held = F.length("_label") > 0
    # A column of its own, so that the expression is not put in place of each use.
    return lines.withColumn("_label", label).select(
        F.substr(F.col("_raw"), F.length("_label") + 1).alias("_raw"),
        F.when(held, name).otherwise(F.col("_file")).alias("_file"),
        F.when(held, place.try_cast("bigint")).alias("_place"))


def parsed(lines: DataFrame, ddl: str) -> DataFrame:
    """Lines that are not blank, with their record as ``_o`` and ``_bad`` where there is none."""
    solid = lines.where(F.col("_raw").startswith("{") | F.col("_raw").rlike(r"\S"))
    return with_object(solid, "_raw", ddl, "_o").withColumn("_bad", F.col("_o").isNull())


def quarantine(lines: DataFrame) -> DataFrame:
    """The malformed lines."""
    return parsed(lines, "_any STRING").where("_bad").select("_file", "_raw")


def line_stats(lines: DataFrame) -> DataFrame:
    """Lines, blank, malformed and parsed lines of each file."""
    seen = with_object(lines, "_raw", "_any STRING", "_o")
    blank = F.col("_raw").rlike(r"^\s*$")
    return seen.groupBy("_file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(blank).alias("blank"),
        F.count_if(~blank & F.col("_o").isNull()).alias("malformed"),
        F.count_if(F.col("_o").isNotNull()).alias("parsed"),
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Input files by name, with size, time and number of lines; contents are not loaded."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_name").alias("name"), "length", "modificationTime")
    )
    counted = read_lines(spark, path).groupBy("_file").agg(F.count(F.lit(1)).alias("lines"))
    return files.join(counted, "_file", "left").withColumn(
        "lines", F.coalesce("lines", F.lit(0).cast("bigint"))).orderBy("name", "_file")
