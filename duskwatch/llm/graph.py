"""Connected components by contraction, over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (a, b).

    Each round points every node at its smallest neighbour, follows that pointer's pointer, and
    contracts the edges to the nodes pointed at, so at least half of the nodes leave. A round
    writes its pointers and the remaining edges to the shared folder and folds the edges of a
    node before they are shuffled; nothing is gathered by node.
    """
    rounds = []
    rest = materialize(_tidy(edges, "a", "b"), "edges")
    while not rest.isEmpty():
        both = rest.union(rest.select("b", "a"))
        pointer = materialize(
            both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
            .select(F.col("a").alias("node"), "p"), "pointers")
        further = pointer.select(F.col("node").alias("at"), F.col("p").alias("root"))
        step = materialize(
            pointer.join(further, pointer["p"] == further["at"]).select("node", "root"), "steps")
        rounds.append(step)
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        rest = materialize(_tidy(rest.join(left, "a").join(right, "b"), "ra", "rb"), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    found = rounds[0]
    for step in rounds[1:]:
        found = found.join(step.toDF("root", "further"), "root", "left").select(
            "node", F.coalesce("further", "root").alias("root"))
    return found


def _tidy(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
