"""Versions of a table's manifest: each is written aside and appears by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(Exception):
    """Somebody else has published that version first."""


def _store(spark: SparkSession, path: str):
    """The Hadoop file context of a path, and a maker of its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    base = hadoop.Path(path)
    return hadoop.FileContext.getFileContext(base.getFileSystem(conf).getUri(), conf), hadoop.Path


def latest(spark: SparkSession, folder: str) -> int | None:
    """The highest published version, from the folder's listing."""
    store, path = _store(spark, folder)
    if not store.util().exists(path(folder)):
        return None
    names = [s.getPath().getName() for s in store.util().listStatus(path(folder))]
    return max((int(n) for n in names if n.isdigit()), default=None)


def place(folder: str, version: int) -> str:
    return f"{folder}/{version:012d}"


def publish(spark: SparkSession, folder: str, version: int, write: Callable[[str], None]) -> None:
    """Have ``write`` fill a folder, then give it the version's name.

    The rename fails if the version is there already, so of two writers one gets ``Conflict``.
    What a broken writer leaves behind has no version's name and is never read.
    """
    store, path = _store(spark, folder)
    aside = f"{folder}/_pending-{uuid.uuid4().hex}"
    write(aside)
    if store.util().exists(path(place(folder, version))):
        raise Conflict(place(folder, version))
    try:
        store.rename(path(aside), path(place(folder, version)),
                     spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Py4JJavaError as error:
        if store.util().exists(path(place(folder, version))):
            raise Conflict(place(folder, version)) from error
        raise
