"""Helpers the training-data operators share: words, Arrow batches, groups in sorted streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word is a run of characters other than space and the five ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8. bytes.split knows exactly the six separators of ``WORD``."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
               0xFF51AFD7ED558CCD], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, in order; of the whole text if it has fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = mix(out + hashes[i : n - size + 1 + i] * _K[i % len(_K)])
    return out


SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that size, so that Python holds few texts at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column with nulls as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str):
    """Map Arrow batches one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def keyed_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from a stream sorted by them, one table for each run.

    Only the run at hand is held. Null keys equal each other.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        starts = [0] + [i for i in range(1, len(rows)) if rows[i] != rows[i - 1]] + [len(rows)]
        for a, b in zip(starts, starts[1:]):
            if held and rows[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = rows[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def row_and(df: DataFrame, **columns) -> DataFrame:
    """The whole row as one struct beside named inputs, so that no two names can clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"),
                     *[c.alias(n) for n, c in columns.items()])
