"""Exact top-k search by inner product, with MaxScore over the dimensions of vectors.

A dimension of a query is a term; its postings are the vectors of a shard that have a component
of the same sign there, strongest first. The postings' extremes bound what a term can add. For
each query and shard:

1. the heads of the strongest postings are scored in full, which gives a first threshold;
2. the terms that together cannot reach it are non-essential; a vector in no essential posting
   cannot either, and is never looked at;
3. the vectors of the essential postings are scored over the essential terms, and the other
   terms are probed from the strongest bound down for those that can still reach the threshold.

Shards are merged by a ranking that keeps k rows of a query in each task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import keyed_runs
from duskwatch.session import materialize

ROWS_PER_SHARD = 16_384
QUERIES_PER_BLOCK = 1024
_HEAD = 16  # vectors scored at the head of a posting for the first threshold
_PROBE = 8  # terms probed between two looks at the threshold


def quantized(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double; null where a component is not finite."""
    infinite = F.lit(float("inf"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != infinite))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists as the rows of a matrix; shorter ones are filled up with zeros, to one at least."""
    column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = max(1, int(lengths.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


class Shard:
    """Vectors of a shard, sorted by id, with the bounds and the heads of their postings."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        self.high, self.low = self.x.max(axis=0), self.x.min(axis=0)
        n, head = len(self.ids), min(_HEAD, len(self.ids))
        self.strongest = np.argpartition(-self.x, head - 1, axis=0)[:head] if n else None
        self.weakest = np.argpartition(self.x, head - 1, axis=0)[:head] if n else None
        self.by_term = np.ascontiguousarray(self.x.T)

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the k best, ties to the smaller id."""
        bounds = np.maximum(q * self.high, q * self.low)
        terms = np.argsort(-bounds, kind="stable")
        lead = terms[: max(1, len(terms) // 8)]
        seeds = np.unique(np.where((q[lead] > 0)[None], self.strongest[:, lead], self.weakest[:, lead]))
        seeds = seeds[self.ids[seeds] != query_id]
        threshold = None
        if len(seeds) >= k:
            threshold = np.sort(self.x[seeds] @ q)[-k]
        rows, partial, used = self._essential(q, bounds, terms, threshold)
        other = self.ids[rows] != query_id
        rows, partial = rows[other], partial[other]
        rest = terms[used:]
        for at in range(0, len(rest), _PROBE):
            if threshold is not None:
                left = bounds[rest[at:]].sum()
                keep = partial + left >= threshold
                rows, partial = rows[keep], partial[keep]
            probe = rest[at : at + _PROBE]
            partial = partial + self.x[np.ix_(rows, probe)] @ q[probe]
        best = np.lexsort((self.ids[rows], -partial))[:k]
        return rows[best], partial[best]

    def _essential(self, q, bounds, terms, threshold):
        """Vectors in an essential posting, their scores over the essential terms, and how many
        terms those are. Without a positive threshold no term can be left out."""
        n = len(self.ids)
        if threshold is None or threshold <= 0:
            return np.arange(n), np.zeros(n, np.int64), 0
        tail = np.cumsum(np.maximum(bounds[terms], 0)[::-1])[::-1]
        used = max(1, int((tail >= threshold).sum()))
        chosen = terms[:used]
        found = np.zeros(n, bool)
        partial = np.zeros(n, np.int64)
        for t in chosen:
            added = self.by_term[t] * q[t]
            found |= added > 0
            partial += added
        rows = np.flatnonzero(found)
        return rows, partial[rows], used


def _search(table: pa.Table, k: int) -> pa.RecordBatch | None:
    asks = np.array(table.column("asks").to_pylist())
    if asks.all() or not asks.any():
        return None
    matrix = _matrix(table.column("codes"))
    ids, keys = table.column("vec_id").to_numpy(), table.column("key").to_numpy()
    largest = float(np.abs(matrix.astype(np.float64)).max(initial=0))
    if largest**2 * matrix.shape[1] >= 2.0**62:
        matrix = matrix.astype(object)  # whole numbers of any size; the result is cut to a long
    shard = Shard(ids[~asks], matrix[~asks])
    out = []
    for query_id, key, q in zip(ids[asks], keys[asks], matrix[asks]):
        rows, scores = shard.top(query_id, q, k)
        out += [(int(query_id), int(key), int(shard.ids[r]), int(np.clip(s, -(2**63), 2**63 - 1)))
                for r, s in zip(rows, scores)]
    if not out:
        return None
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "key", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 5, rows_per_shard: int = ROWS_PER_SHARD,
           queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """The k best rows for every query: query_id, rank (from 1), vec_id, score.

    ``vectors`` holds vec_id and embedding; candidates are all rows with another vec_id. Rows
    with a null vec_id, a null vector, or null or non-finite components take no part. A shorter
    vector counts as filled up with zeros; scores beyond 64 bits are cut to their range. Ties go
    to the smaller vec_id. Repeated query rows are asked once; repeated candidates count singly.
    Other columns are not read.

    Every block of queries meets every shard of rows once, each in a task of its own, so a task
    holds a bounded number of either; rows are dealt to shards by their place, not their values.
    """
    codes = materialize(
        vectors.select("vec_id", quantized(F.col("embedding")).alias("codes"), is_query.alias("asks"))
        .where("vec_id is not null and codes is not null")
        .withColumn("key", F.xxhash64("codes")), "codes")
    asked = codes.where("asks").dropDuplicates(["vec_id", "key"])
    counts = codes.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    shards = max(1, -(-counts["n"] // rows_per_shard))
    blocks = max(1, -(-counts["q"] // queries_per_block))

    def each(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    place = F.xxhash64(F.monotonically_increasing_id())
    rows = codes.select("vec_id", "codes", "key", F.lit(False).alias("asks"),
                        F.pmod(place, F.lit(shards)).cast("int").alias("shard"), each(blocks).alias("block"))
    asked = asked.select("vec_id", "codes", "key", F.lit(True).alias("asks"), each(shards).alias("shard"),
                         F.pmod(F.xxhash64("vec_id", "key"), F.lit(blocks)).cast("int").alias("block"))

    def run(batches):
        for table in keyed_runs(batches, ["shard", "block"]):
            found = _search(table, k)
            if found is not None:
                yield found

    keys = ["shard", "block"]
    best = rows.unionByName(asked).repartition(shards * blocks, *keys).sortWithinPartitions(*keys).mapInArrow(
        run, "query_id long, key long, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
