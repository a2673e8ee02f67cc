"""Reports and programs as one row per file, from files of their own or collected into Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.values import parse_stamp
from duskwatch.session import utc

_STAMP = r"(\d{2}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})"

# Names of reports and of generated programs.
REPORT_NAME = rf"(?:^|[/=])analyst_log-{_STAMP}[.]md(?:/|$)"
PROGRAM_NAME = rf"(?:^|[/=]){_STAMP}-(\d{{2,}})[.]py(?:/|$)"


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, stamp, sequence number and whole text of each file."""
    files = utc(spark).read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    return _known(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def read_collected(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same of very many files that were collected into Parquet: ``path`` and ``text``, a row each."""
    paths = [paths] if isinstance(paths, str) else paths
    return _known(utc(spark).read.schema("path string, text string").parquet(*paths))


def _known(named: DataFrame) -> DataFrame:
    stamp = F.concat(F.regexp_extract("path", REPORT_NAME, 1),
                     F.regexp_extract("path", PROGRAM_NAME, 1))
    return named.select(
        "path",
        F.when(F.col("path").rlike(REPORT_NAME), "report").when(
            F.col("path").rlike(PROGRAM_NAME), "program").otherwise("other").alias("kind"),
        parse_stamp(stamp).alias("stamp"),
        F.regexp_extract("path", PROGRAM_NAME, 2).try_cast("int").alias("seq"),
        "text",
    )
