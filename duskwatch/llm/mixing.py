"""Mixing sources to target shares of words, with copies chosen by pivotal rounding.

Every document of a source asks for the same number of copies, target over source size. The
whole part is given; the fractions are rounded in pairs. A step moves words between two
documents of a source until the fraction of one of them is 0 or 1, up or down at random so that
each keeps its expectation. As words move, not copies, the sum of words stays exact in every
step; only the last document left over in a source is rounded by itself, to the nearer side.
Large documents are settled first, against as many smaller ones as it takes, so the last one is
small.

The pairing is a reduction tree. Documents of a source are dealt into buckets by a hash of their
own values, each bucket is reduced to at most one undecided document, and those are dealt into
fewer buckets, until a source has one. Buckets follow from the data, not from partitions or
attempts, and so do the random numbers: reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import WORD, keyed_runs
from duskwatch.session import materialize

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
PER_BUCKET = 50_000
SEED = "mix-1"
_EXACT = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of sources from their sizes: source, source_size, target.

    Sources take the weights in turn, by code point and null last, and share the sum of all
    sizes. A target above ``most`` times its source is set to that, and the rest is shared out
    again by weight until none is above. Only sums over sources go through the driver; each round
    fixes at least one further source.
    """
    ranked = _ranked(sizes).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = materialize(ranked, "sources")
    limit = F.col("source_size") * float(most)
    level, fixed = 0.0, -1
    while True:
        full = (F.col("weight") * F.lit(level) > limit) & (fixed >= 0)
        got = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, limit)).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n"),
        ).first()
        if not got["open"] or got["n"] == fixed:
            break
        level, fixed = ((got["total"] or 0) - (got["full"] or 0.0)) / got["open"], got["n"]
    return ranked.select(
        "source", "source_size",
        F.least(F.col("weight") * F.lit(level), limit).alias("target"))


def _ranked(sizes: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, null last, without one task for all of them."""
    parts = max(1, -(-sizes.count() // 100_000))
    order = [F.col("source").isNull(), F.col("source")]
    spread = materialize(
        sizes.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "rank")
    counts = {r["part"]: r["n"]
              for r in spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, at = [], 0
    for part in range(max(counts, default=0) + 1):
        before.append(F.lit(at))
        at += counts.get(part, 0)
    start = F.element_at(F.array(*before), F.col("part") + 1)
    inside = Window.partitionBy("part").orderBy(*order)
    return spread.select("source", "source_size",
                         (start + F.row_number().over(inside) - 1).alias("rank"))


def decide(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED,
           per_bucket: int = PER_BUCKET) -> DataFrame:
    """Copies for each distinct (doc_id, source, size).

    Columns: doc_id, source, size, same (rows that agree in the three), source_size, target,
    copies (of all ``same`` rows together). Null texts have size 0; rows of size 0 get no copies
    beyond the whole part, as they hold no words.
    """
    items = docs.select("doc_id", F.col("source").alias("source"), n_words(F.col("text")).alias("size"))
    items = materialize(
        items.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("same")), "sizes")
    sizes = items.groupBy("source").agg(
        F.sum(F.col("size") * F.col("same")).alias("source_size"), F.count("*").alias("items"))
    targets = source_targets(sizes.drop("items"), weights, most).alias("t")
    sources = materialize(
        targets.join(sizes.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
        .select("t.source", "t.source_size", "target", "items"), "targets")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    wished = F.when(F.col("size") > 0, rate * F.col("same")).otherwise(F.lit(0.0))
    whole = F.floor(wished + _EXACT).cast("long")
    joined = items.alias("i").join(
        sources.alias("s"), F.col("i.source").eqNullSafe(F.col("s.source"))
    ).select("doc_id", "i.source", "size", "same", "source_size", "target", "items",
             whole.alias("whole"), F.greatest(wished - whole, F.lit(0.0)).alias("part"))
    buckets = F.ceil(F.col("items") / per_bucket)
    level = joined.withColumns({
        "bucket": F.pmod(F.xxhash64("doc_id", "size", "same"), buckets), "buckets": buckets})
    pending, done = materialize(_round(level, seed), "pivot"), []
    while True:
        done.append(pending.where("not open"))
        left = pending.where("open")
        most_buckets = left.agg(F.max("buckets")).first()[0]
        if most_buckets is None:
            break
        fewer = F.ceil(F.col("buckets") / 1000)
        # The residue of a source that has one bucket left is rounded alone.
        left = left.withColumns({"last": F.col("buckets") <= 1, "buckets": fewer,
                                 "bucket": F.pmod(F.xxhash64("doc_id", "size", "same"), fewer)})
        pending = materialize(_round(left, seed), "pivot")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "same", "source_size", "target",
                      (F.col("whole") + F.round("part").cast("long")).alias("copies"))


_COLUMNS = ("doc_id long, source string, size long, same long, source_size long, target double, "
            "whole long, part double, bucket long, buckets long, open boolean")


def _round(level: DataFrame, seed: str) -> DataFrame:
    """Reduce each (source, bucket) to at most one open document, in a stream sorted by size."""
    if "last" not in level.columns:
        level = level.withColumn("last", F.lit(False))
    keys = ["source", "bucket"]
    level = level.select("doc_id", "source", "size", "same", "source_size", "target", "whole",
                         "part", F.col("bucket").cast("long").alias("bucket"),
                         F.col("buckets").cast("long").alias("buckets"), "last")

    def run(batches):
        for table in keyed_runs(batches, keys):
            columns = [table.column(n).to_pylist() for n in ("doc_id", "size", "part", "last")]
            part, is_open = _pivot(*columns, seed)
            names = [n for n in table.column_names if n not in ("part", "last")]
            out = pa.table({n: table.column(n) for n in names} | {
                "part": pa.array(part, pa.float64()), "open": pa.array(is_open, pa.bool_())})
            yield from out.select([c.split()[0] for c in _COLUMNS.split(", ")]).to_batches()

    order = [*keys, F.desc("size"), "doc_id", "same"]
    return level.repartition(*keys).sortWithinPartitions(*order).mapInArrow(run, _COLUMNS)


def _pivot(doc_ids, sizes, parts, last, seed) -> tuple[list[float], list[bool]]:
    """Fractions after pairing, and which of them are still open: one at most."""
    parts = list(parts)
    _settle(doc_ids, sizes, parts, seed)
    held = -1
    for i, p in enumerate(parts):
        if not 0 < p < 1:
            continue
        if held < 0:
            held = i
            continue
        # Words that can move from i to held (up), or from held to i (down).
        up = min((1 - parts[held]) * sizes[held], parts[i] * sizes[i])
        down = min(parts[held] * sizes[held], (1 - parts[i]) * sizes[i])
        draw = _draw(seed, doc_ids[held], sizes[held], doc_ids[i], sizes[i])
        move = up if draw * (up + down) < down else -down
        for j, words in ((held, move), (i, -move)):
            parts[j] = _clean(parts[j] + words / sizes[j])
        open_ones = [j for j in (held, i) if 0 < parts[j] < 1]
        held = open_ones[-1] if open_ones else -1
    if held >= 0 and last[held]:
        parts[held], held = float(parts[held] >= 0.5), -1
    return parts, [i == held for i in range(len(parts))]


def _clean(p: float) -> float:
    return 0.0 if p <= _EXACT else 1.0 if p >= 1 - _EXACT else p


def _settle(doc_ids, sizes, parts, seed) -> None:
    """Make each document integral in turn, from large to small, at the cost of smaller ones.

    The direction is drawn once, up with the document's own fraction. Each partner gives as many
    words upwards, or takes as many in proportion downwards, as it can in either case, until the
    document is whole. A document whose partners are too small together is left as it is.
    """
    for i, p in enumerate(parts):
        parts[i] = _clean(p)
    open_after = list(range(1, len(parts) + 1)) + [len(parts)]

    def following(i):
        """The next open one; the way there is shortened for later calls."""
        at = open_after[i]
        while at < len(parts) and not 0 < parts[at] < 1:
            at = open_after[at]
        open_after[i] = at
        return at

    for i, p in enumerate(parts):
        if not 0 < parts[i] < 1:
            continue
        p, need, partners = parts[i], (1 - parts[i]) * sizes[i], []
        back = p / (1 - p)
        at = following(i)
        while at < len(parts) and need > 0:
            words = min(parts[at] * sizes[at], (1 - parts[at]) * sizes[at] / back, need)
            partners.append((at, words))
            need -= words
            at = following(at)
        if need > _EXACT:
            continue
        up = _draw(seed, doc_ids[i], sizes[i]) < p
        parts[i] = 1.0 if up else 0.0
        for at, words in partners:
            parts[at] = _clean(parts[at] + (-words if up else words * back) / sizes[at])


def _draw(seed, *values) -> float:
    """A number in [0, 1) that depends on nothing but the values."""
    return xxhash.xxh3_64_intdigest(repr((seed, *values)).encode()) / 2.0**64


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """How much of each document the mix takes.

    One row for each row of ``docs``: doc_id, size (words), source_size, target (words of its
    source in the mix), copies, taken (words, repeats counted). No document is taken more than
    ``most`` times. Null texts have size 0. Repeated rows share their copies as evenly as whole
    numbers allow. Other columns are not read.
    """
    n = F.col("same")
    chunk = 65_536
    copies = F.floor(F.col("copies") / n) + F.when(F.col("at") < F.col("copies") % n, 1).otherwise(0)
    return (
        decide(docs, weights, most, seed)
        .withColumn("from", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))))
        .withColumn("at", F.explode(F.sequence("from", F.least(F.col("from") + chunk, n) - 1)))
        .select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns.

    Rows that agree in doc_id, source and size are numbered to share their copies; all others
    need no number and are found by an equi join alone.
    """
    chosen = decide(docs, weights, most, seed).where("copies > 0").select(
        *[F.col(c).alias(f"_mix_{c}") for c in ("doc_id", "source", "size", "same", "copies")])
    size = n_words(docs["text"])
    key = (docs["doc_id"].eqNullSafe(chosen["_mix_doc_id"]) & (size == chosen["_mix_size"])
           & docs["source"].eqNullSafe(chosen["_mix_source"]))
    rows = docs.join(chosen, key).withColumn(
        "_mix_at", F.row_number().over(Window.partitionBy(
            "_mix_doc_id", "_mix_size", "_mix_source").orderBy(F.xxhash64("text"))) - 1)
    n = F.col("_mix_same")
    copies = F.floor(F.col("_mix_copies") / n) + F.when(
        F.col("_mix_at") < F.col("_mix_copies") % n, 1).otherwise(0)
    return (
        rows.withColumn("_mix_n", copies.cast("int")).where("_mix_n > 0")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
        .select(*[F.col(c) for c in docs.columns])
    )
