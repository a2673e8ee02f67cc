"""Whitening of embeddings with distributed block matrices.

Centred rows are indexed and cut into the blocks of a ``BlockMatrix``; its transpose times itself is
the scatter. Only that square of the number of dimensions reaches the driver, where its
eigenvectors are found; a second block product with the whitening matrix projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.session import materialize

COMPONENTS = 32
ROWS_PER_BLOCK = 4096
COLUMNS_PER_BLOCK = 1024
#: Components with less than this share of the largest eigenvalue are taken for zero.
ZERO = 1e-12
_LARGEST = float(1 << 62)


def scaled(c: Column) -> Column:
    """floor(64 c) + 1000000 as a long; beyond 2^62 the floor stays there."""
    floor = F.floor(F.least(F.greatest(c.cast("double") * 64, F.lit(-_LARGEST)), F.lit(_LARGEST)))
    return floor + F.lit(1_000_000).cast("bigint")


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    plain = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, plain)


def indexed(df: DataFrame) -> DataFrame:
    """The rows, stored, with ``index`` counting from 0 without gaps.

    Numbers inside a partition come from Spark; only one count for each partition is added up.
    """
    number = F.monotonically_increasing_id()
    rows = materialize(df.withColumn("index", number), "whitening-rows")
    part, inside = F.shiftright("index", 33), F.col("index").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    if not sizes:
        return rows
    starts = np.cumsum([0, *(r["count"] for r in sizes)]).tolist()
    start_of = rows.sparkSession.createDataFrame(
        [(r["part"], s) for r, s in zip(sizes, starts)], "part long, start long")
    return (rows.withColumn("part", part).join(start_of, "part")
            .withColumn("index", F.col("start") + inside).drop("part", "start"))


def block_matrix(rows: DataFrame, n: int, dims: int, rows_per_block: int = ROWS_PER_BLOCK) -> BlockMatrix:
    """A block matrix of ``rows`` (index long, values array of doubles)."""
    vectors = rows.select("index", array_to_vector("values").alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    java = callMLlibFunc("createIndexedRowMatrix", old, n, dims)
    return IndexedRowMatrix(java, n, dims).toBlockMatrix(rows_per_block, COLUMNS_PER_BLOCK)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. The inner dimension is split, so that no task gets all blocks."""
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    splits = max(1, min(blocks, 1024))
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits)
    square = BlockMatrix(product, COLUMNS_PER_BLOCK, COLUMNS_PER_BLOCK).toLocalMatrix().toArray()
    return (square + square.T) / 2


def product(matrix: BlockMatrix, right: np.ndarray) -> DataFrame:
    """Rows of matrix times ``right``: index and values."""
    context = matrix._java_matrix_wrapper._sc
    blocks = []
    for j in range(0, right.shape[0], COLUMNS_PER_BLOCK):
        part = right[j : j + COLUMNS_PER_BLOCK]
        blocks.append(((j // COLUMNS_PER_BLOCK, 0),
                       DenseMatrix(part.shape[0], part.shape[1], part.ravel(order="F").tolist())))
    other = BlockMatrix(context.parallelize(blocks, 1), COLUMNS_PER_BLOCK, COLUMNS_PER_BLOCK,
                        right.shape[0], right.shape[1])
    rows = matrix.multiply(other).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("values"))


@dataclass
class Whitening:
    """What is fitted: count, exact sums, components as columns (rising index, falling eigenvalue)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """Centred rows times this have unit covariance; components without variance give 0."""
        kept = self.eigenvalues > ZERO * max(float(self.eigenvalues[0]), 0.0)
        scale = np.where(kept, 1 / np.sqrt(np.where(kept, self.eigenvalues, 1.0)), 0.0)
        return self.components * scale


def _sums(rows: DataFrame, dims: int) -> list[int]:
    each = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    found = {r["at"]: int(r["s"]) for r in each.collect()}
    return [found[i] for i in range(dims)]


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``values`` x - S/n, each from the exact n x - S, and ``deviation``, the sum of its squares.

    The deviation is null where it does not fit into a long.
    """
    fits = [s if abs(s) < 1 << 63 else None for s in sums]
    total = F.array(*[F.lit(s).cast("bigint") for s in fits])
    mean = F.array(*[F.lit(s / n) for s in sums])
    exact = F.zip_with("x", total, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("bigint"), x), s))
    rows = rows.withColumn("exact", exact)
    square = F.aggregate("exact", F.lit(0).cast("bigint"), lambda a, e: F.try_add(a, F.try_multiply(e, e)))
    plain = F.zip_with("x", mean, lambda x, m: x - m)
    values = F.zip_with("exact", plain, lambda e, p: F.coalesce(e / F.lit(float(n)), p))
    return rows.select(*[c for c in rows.columns if c not in ("x", "exact")],
                       square.alias("deviation"), values.alias("values"))


def fit(centred: BlockMatrix, n: int, sums: list[int], components: int = COMPONENTS) -> Whitening:
    e, v = np.linalg.eigh(scatter(centred) / n)
    order = np.argsort(-e, kind="stable")
    e, v = np.maximum(e[order], 0.0), v[:, order]
    trace = float(e.sum())
    k = min(components, len(e))
    share = e[:k] / trace if trace > 0 else np.zeros(k)
    return Whitening(n, sums, e[:k], v[:, :k], share)


def _identity_error(whitened: DataFrame, n: int, kept: int, rows_per_block: int) -> float:
    """Largest entry of the whitened covariance minus the identity, over components with variance."""
    if not kept:
        return 0.0
    means = whitened.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m"))
    mean = [r["m"] for r in means.orderBy("at").collect()][:kept]
    at = F.array(*[F.lit(float(m)) for m in mean])
    rows = whitened.select("index", F.zip_with(F.slice("values", 1, kept), at, lambda v, m: v - m).alias("values"))
    covariance = scatter(block_matrix(rows, n, kept, rows_per_block)) / n
    return float(np.abs(covariance - np.eye(kept)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Whitened coordinates of every usable vector, one row for each of its components.

    ``vectors`` has vec_id and embedding. Rows whose vector is null or holds null, infinite or
    undefined entries are left out of fit and result; repeated rows and null ids stay, once each.
    Entries that a vector lacks against the longest one count as 0. Components are numbered from
    1 by falling eigenvalue; those without variance (all, for a single row) have ``whitened`` and
    ``explained`` 0 and are left out of ``identity_error``. Other columns are not read. An empty
    table, or one without usable vectors, gives no rows.

    The driver gets the scatter (dimensions squared), a count for each partition of the stored
    rows, and, as block products do, the keys of the blocks, one for ``rows_per_block`` rows.
    """
    schema = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = vectors.where(usable(F.col("embedding"))).select(
        "vec_id", F.transform("embedding", scaled).alias("x"))
    rows = indexed(kept)
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dims:
        kinds = "long int long long double double double".split()
        return vectors.sparkSession.createDataFrame([], ", ".join(map(" ".join, zip(schema, kinds))))
    absent = F.array_repeat(F.lit(1_000_000).cast("bigint"), F.lit(dims) - F.size("x"))
    rows = rows.withColumn("x", F.concat("x", absent))
    sums = _sums(rows, dims)
    centred = _centred(rows, n, sums)
    matrix = block_matrix(centred, n, dims, rows_per_block)
    model = fit(matrix, n, sums, components)
    projected = materialize(product(matrix, model.matrix), "whitened")
    error = _identity_error(projected, n, int((model.matrix != 0).any(axis=0).sum()), rows_per_block)
    shares = F.array(*[F.lit(float(x)) for x in model.explained])
    found = centred.select("index", "vec_id", "deviation").join(projected, "index").select(
        "vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
