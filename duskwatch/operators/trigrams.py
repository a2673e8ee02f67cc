"""Search of stored texts by regular expression, through an index of their trigrams.

Every line that a pattern matches holds the literals that the pattern cannot do without, and so their
runs of three characters. Texts without one of these are not read. Patterns without such a run, and
those this module cannot take apart, are looked for in all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from re import IGNORECASE, VERBOSE, _constants, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.texts import lines
from duskwatch.session import materialize

SIZE = 3
#: Up to so many candidates are also named to the scan, which then skips stretches of a file.
NAMED = 1_000


def required(pattern: str) -> set[str]:
    """Runs of three characters that every match of the pattern holds.

    Only what all matches must pass counts: literals outside of choices, of optional parts and of
    anything that ignores case.
    """
    try:
        parsed = _parser.parse(pattern)
    except Exception:  # the engine's syntax has more than this parser knows
        return set()
    if parsed.state.flags & (IGNORECASE | VERBOSE):
        return set()
    runs = [""]

    def walk(nodes) -> None:
        for kind, value in nodes:
            if kind is _constants.LITERAL:
                runs[-1] += chr(value)
            elif kind is _constants.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif kind is _constants.MAX_REPEAT and value[0] >= 1:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif kind is not _constants.AT:
                runs.append("")

    walk(parsed)
    return {run[i : i + SIZE] for run in runs for i in range(len(run) - SIZE + 1) if "\n" not in run[i : i + SIZE]}


def _own(text: str) -> np.ndarray:
    """The distinct runs of three characters in the lines of a text, as numbers of 21 bits a character."""
    chars = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    one, two, three = chars[:-2], chars[1:-1], chars[2:]
    inside = (one != 10) & (two != 10) & (three != 10)
    return np.unique((one << np.uint64(42) | two << np.uint64(21) | three)[inside])


def _spelled(grams: np.ndarray) -> list[str]:
    bits = np.uint64((1 << 21) - 1)
    chars = np.stack([grams >> np.uint64(42), grams >> np.uint64(21) & bits, grams & bits], axis=1)
    text = chars.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + SIZE] for i in range(0, len(text), SIZE)]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each trigram of a batch, with the keys of all texts there that hold it; a row is
    made for each part in the batch."""
    for batch in batches:
        part_of = batch.column("part").to_numpy()
        edges = np.flatnonzero(np.r_[True, part_of[1:] != part_of[:-1], True]) if len(part_of) else np.empty(0, int)
        for start, end in zip(edges[:-1], edges[1:]):
            texts = batch.column("text").slice(start, end - start).to_pylist()
            own = [_own(text or "") for text in texts]
            grams, at = np.concatenate(own), np.repeat(np.arange(start, end), [len(g) for g in own])
            order = grams.argsort(kind="stable")
            grams, first = np.unique(grams[order], return_index=True)
            keys = batch.column("key").take(pa.array(at[order], pa.int64()))
            offsets = pa.array(np.r_[first, len(keys)].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spelled(grams), pa.string()), pa.array(np.full(len(grams), part_of[start], np.int32)),
                 pa.ListArray.from_arrays(offsets, keys)],
                ["gram", "part", "keys"])


def build(texts: DataFrame, path: str, key: str = "doc_id", parts: int = 64) -> None:
    """Store texts in ``parts`` by the hash of their key, and which trigram occurs in which text.

    The texts of a part lie together, so a trigram is told once for many of them, with their keys.
    """
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    rows = texts.select(F.col(key).alias("key"), part.alias("part"), "text")
    rows.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(f"{path}/texts")
    kind = rows.schema["key"].dataType.simpleString()
    stored = texts.sparkSession.read.schema(rows.schema).parquet(f"{path}/texts")
    grams = stored.mapInArrow(_grams, f"gram string, part int, keys array<{kind}>")
    grams.repartition("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """part and key of the texts that hold all trigrams the pattern requires; nothing if it has none."""
    wanted = sorted(required(pattern))
    if not wanted:
        return None
    held = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted))
    held = held.select("gram", "part", F.explode("keys").alias("key"))
    return held.groupBy("part", "key").agg(F.count_distinct("gram").alias("n")).where(
        F.col("n") == len(wanted)).select("part", "key")


def candidate_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """key and text of the candidates; only the parts they lie in are read."""
    rows = spark.read.parquet(f"{path}/texts")
    found = candidates(spark, path, pattern)
    if found is None:
        return rows.select("key", "text")
    found = materialize(found, "candidates")
    named = [r.key for r in found.select("key").limit(NAMED + 1).collect()]
    parts = [r.part for r in found.select("part").distinct().collect()]
    rows = rows.where(F.col("part").isin(parts))
    if len(named) <= NAMED:
        rows = rows.where(F.col("key").isin(named))
    return rows.join(found, ["part", "key"], "left_semi").select("key", "text")


def search(spark: SparkSession, path: str, pattern: str, limit: int, key: str = "doc_id") -> DataFrame:
    """The first matching lines, in order of text and line, each with the number of all of them."""
    texts = candidate_texts(spark, path, pattern).where(F.col("text").rlike(pattern))
    hits = lines(texts, "key").where(F.col("line").rlike(pattern))
    page = hits.orderBy("key", "line_no").limit(limit)
    return page.select(F.col("key").alias(key), "line_no", "line", hits.agg(F.count(F.lit(1))).scalar().alias("total"))
