"""A derived table that follows its input files: only new and changed ones are read again.

Rows are stored in ``generations``, one for each time that files had to be read. The manifest says
which file, in which size and of which time, lies in which generation, so readers see either the
old or the new state. Rows of files that have changed or gone since stay in their generation and
are left out when it is read, until it is merged with others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.sinks import commits, generations

_SAME = ["file", "length", "modified"]


def files_of(spark: SparkSession, inputs: str | Sequence[str]) -> DataFrame:
    """The input files as they are now, from their listing alone; ``source`` is what readers take."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inputs)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("path").alias("source"), "length",
                        F.col("modificationTime").alias("modified"))


def follow(
    spark: SparkSession,
    build: Callable[[list[str]], DataFrame],
    path: str,
    inputs: str | Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """The rows of all input files as they are now, read from ``path`` once they are stored there.

    ``build`` gets the new and changed files only and gives their rows, each with its file in
    ``_file`` as the readers name it. Each row must depend on its own file alone; tables that do
    not are for ``tables.cached``. Files that are gone take their rows with them. Writers at the
    same time are safe: the later one starts over on what the first has stored. If ``build`` gives
    other columns than before, ``path`` must be another, too.
    """
    files = files_of(spark, inputs)
    while True:
        version = generations.latest(spark, path)
        try:
            version = _followed(spark, build, path, version, files, partition_by)
        except commits.Conflict:
            continue
        return generations.read(spark, path, version)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The files that the stored table holds now: file, length, modified, generation."""
    found = generations.known(spark, path, generations.latest(spark, path))
    return found.where("alive").select(*_SAME, "generation")


def _followed(spark, build, path, version, files, partition_by) -> int:
    """The version after the files have been followed, which is the same if nothing has changed."""
    known = generations.known(spark, path, version)
    # One pass over both lists tells what is new, what has stayed and what is dead.
    both = known.where("alive or layout is not null").select(*_SAME, "generation", "layout").unionByName(
        files.select(*_SAME, "source"), allowMissingColumns=True)
    met = both.groupBy(*_SAME).agg(*[F.max(c).alias(c) for c in ("generation", "source", "layout")])
    new, dead = (F.col(c).isNull() & F.col("file").isNotNull() for c in ("generation", "source"))
    changes = met.select(F.count_if(new).alias("new"), F.count_if(dead).alias("dead"), F.max("layout").alias("layout"),
                         F.collect_list(F.when(new, F.col("source"))).alias("sources")).first()
    layout = generations.layout_of(changes.layout)
    if not changes.new and not changes.dead:
        if layout is None:
            raise ValueError("there are no input files, and no table of earlier ones")
        return version
    following = (version or 0) + 1
    name = f"{following:012d}-{uuid.uuid4().hex}"
    if changes.new:
        rows = build(sorted(changes.sources))
        if "_file" not in rows.columns:
            raise ValueError("rows must name their file in _file")
        layout = generations.check_layout(layout, rows)
        generations.store(rows, generations.place(path, name), partition_by)
    state = met.where("file is not null").select(
        *_SAME, F.coalesce("generation", F.lit(name)).alias("generation"),
        F.col("source").isNotNull().alias("alive"), F.lit(None).cast("string").alias("layout"),
    ).unionByName(known.where("not alive and file is not null"))
    # A generation without a file that is alive is given up.
    used = F.max(F.col("alive").cast("int")).over(Window.partitionBy("generation")) == 1
    state = state.withColumn("used", used).where("used").drop("used")
    state = generations.merged(spark, path, state, layout, partition_by, f"{name}-merged")
    generations.publish(spark, path, following, state, layout)
    return following
