"""Jaccard join of texts on their word n-grams, by MinHash banding and exact verification.

1. Texts with one n-gram set are one class; only classes go on.
2. Classes that agree in a whole band of their signature share a bucket. Rows per band and the
   number of bands follow from the demanded recall at the threshold. A bucket is never expanded:
   it links each of its classes to its smallest one, and the components of those links are the
   candidate groups. Whatever shares a band is in one group.
3. Inside a group all pairs are verified on the full sets, as sparse matrix products in tasks.
   A large group is cut into blocks, and each pair of blocks is a task of its own. Links are
   counted where they are found; a task returns one row per class, never one per pair.
4. The components of the verified links are the classes of near copies.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import keyed_runs, mix, shingles, slices, texts, word_hashes, words_of
from duskwatch.llm.graph import components
from duskwatch.session import materialize

WORDS = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9999  # of a pair at the threshold; of closer pairs it is higher
MOST_HASHES = 192
BLOCK_SHINGLES = 400_000
BLOCK_CLASSES = 1_500
_CHUNK = 4096


def choose_bands(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall within ``most`` hashes.

    A pair of similarity s agrees in a band of r rows with probability s^r.
    """
    for rows in range(most, 0, -1):
        agree = threshold**rows
        bands = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-agree))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding reaches that recall within that many hashes")


def ngram_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; a shorter text is one n-gram."""
    return np.unique(shingles(word_hashes(words_of(text)), words))


def fingerprint(ngrams: np.ndarray) -> bytes:
    return hashlib.blake2b(ngrams.astype("<u8").tobytes(), digest_size=16).digest()


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return base[:n], base[n:] | np.uint64(1)


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each of the (not empty) sets."""
    xor, times = _salts(bands * rows)
    out = np.empty((len(sets), bands * rows), np.uint64)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        if end == at + 1:  # a long set, in slices
            out[at] = np.minimum.reduce([
                ((sets[at][i : i + _CHUNK, None] ^ xor) * times).min(axis=0)
                for i in range(0, len(sets[at]), _CHUNK)])
        else:
            flat = np.concatenate(sets[at:end])
            starts = np.cumsum([0, *map(len, sets[at : end - 1])])
            out[at:end] = np.minimum.reduceat((flat[:, None] ^ xor) * times, starts, axis=0)
        at = end
    out = mix(out).reshape(len(sets), bands, rows)
    folded = np.broadcast_to(np.arange(bands, dtype=np.uint64), out.shape[:2]).copy()
    for r in range(rows):
        folded = mix(folded + out[:, :, r])
    return folded.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, fp (fingerprint of the n-gram set; null without words), n, bands."""

    def run(batches):
        for batch in slices(batches):
            sets = [ngram_set(t, words) for t in texts(batch, "text")]
            full = [s for s in sets if len(s)]
            hashes = band_hashes(full, bands, rows) if full else np.zeros((0, bands), np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *[bands if len(s) else 0 for s in sets]]), pa.int32()),
                pa.array(hashes.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()), lists],
                names=["doc_id", "fp", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, fp binary, n long, bands array<long>")


def _shared(rows_a, cols_a, n_a, rows_b, cols_b, n_b, n_cols) -> np.ndarray:
    """Sizes of all intersections between two blocks of sets, given as (row, column) entries.

    Columns held by many sets are multiplied densely, the others entry by entry.
    """
    out = np.zeros((n_a, n_b), np.float32)
    in_a, in_b = np.bincount(cols_a, minlength=n_cols), np.bincount(cols_b, minlength=n_cols)
    weight = in_a.astype(np.int64) * in_b
    dense = weight * 64 > n_a * n_b
    number = np.cumsum(dense) - 1
    for at in range(0, int(dense.sum()), 1024):
        sides = []
        for rows, cols, n in ((rows_a, cols_a, n_a), (rows_b, cols_b, n_b)):
            of = number[cols]
            mine = dense[cols] & (of >= at) & (of < at + 1024)
            x = np.zeros((n, 1024), np.float32)
            x[rows[mine], of[mine] - at] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    keep = (~dense & (weight > 0))[cols_a]
    rows_a, cols_a = rows_a[keep], cols_a[keep]
    order = np.argsort(cols_b, kind="stable")
    by_col = rows_b[order]
    start = np.cumsum(in_b) - in_b
    flat = out.reshape(-1)
    for i in range(0, len(cols_a), 100_000):
        cols, rows = cols_a[i : i + 100_000], rows_a[i : i + 100_000]
        n = in_b[cols]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(start[cols], n)
        np.add.at(flat, np.repeat(rows, n).astype(np.int64) * n_b + by_col[at], np.float32(1))
    return out


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Which pairs of two lists of sets are at least that similar, exactly."""
    flat = np.concatenate([*sets_a, *sets_b])
    _, cols = np.unique(flat, return_inverse=True)
    sizes_a = np.array([len(s) for s in sets_a], np.int64)
    sizes_b = np.array([len(s) for s in sets_b], np.int64)
    cut = int(sizes_a.sum())
    shared = _shared(
        np.repeat(np.arange(len(sets_a)), sizes_a), cols[:cut], len(sets_a),
        np.repeat(np.arange(len(sets_b)), sizes_b), cols[cut:], len(sets_b), int(cols.max()) + 1)
    p, q = threshold.numerator, threshold.denominator
    # shared / (a + b - shared) >= p / q
    return shared.astype(np.int64) * (p + q) >= p * (sizes_a[:, None] + sizes_b[None, :])


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


_VERIFIED = pa.schema([("fp", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _verify(table: pa.Table, threshold: Fraction) -> pa.RecordBatch:
    """Links of each class inside one block or between two, counted in documents."""
    found = {}
    for fp, block, same, ngrams in zip(*(table.column(c).to_pylist()
                                         for c in ("fp", "block", "same", "ngrams"))):
        found[fp] = (block, same, np.frombuffer(ngrams, "<u8"))
    fps = sorted(found)
    one = table.column("low")[0].as_py() == table.column("high")[0].as_py()
    low = table.column("low")[0].as_py()
    left = [i for i, fp in enumerate(fps) if one or found[fp][0] == low]
    right = left if one else [i for i, fp in enumerate(fps) if found[fp][0] != low]
    links, pairs = np.zeros(len(fps), np.int64), np.zeros((0, 2), np.int64)
    if left and right:
        near = linked([found[fps[i]][2] for i in left], [found[fps[i]][2] for i in right], threshold)
        if one:
            np.fill_diagonal(near, False)
        same = np.array([found[fp][1] for fp in fps], np.int64)
        links[left] += near @ same[right]
        if not one:
            links[right] += near.T @ same[left]
        a, b = np.nonzero(near)
        pairs = np.stack([np.array(left)[a], np.array(right)[b]], axis=1)
    roots = _roots(len(fps), pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array(fps, pa.binary()), pa.array(links), pa.array([fps[r] for r in roots], pa.binary())],
        schema=_VERIFIED)


def near_classes(docs: DataFrame, threshold: Fraction = THRESHOLD, words: int = WORDS,
                 recall: float = RECALL, block_shingles: int = BLOCK_SHINGLES,
                 block_classes: int = BLOCK_CLASSES) -> tuple[DataFrame, DataFrame]:
    """Documents with their sets' fingerprints, and the classes of those.

    The first has doc_id, fp. The second has a row for each distinct n-gram set: fp, rep (its
    smallest doc_id), same (its documents), near (common to all classes that links connect),
    class_id (the smallest doc_id there) and n_links (other documents at least that similar).
    """
    bands, rows = choose_bands(float(threshold), recall)
    signed = materialize(signatures(docs, bands, rows, words), "signatures")
    reps = materialize(
        signed.where("fp is not null").groupBy("fp").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("same"),
            F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    banded = reps.select("fp", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("k"))
    edges = banded.join(buckets.where("k > 1").drop("k"), "band").select(
        F.col("fp").alias("a"), F.col("least").alias("b"))
    groups = components(edges).select(F.col("node").alias("fp"), F.col("root").alias("group"))

    members = reps.drop("bands").join(groups, "fp")
    blocks = members.groupBy("group").agg(F.greatest(
        F.ceil(F.sum("n") / block_shingles), F.ceil(F.count(F.lit(1)) / block_classes)).alias("blocks"))
    members = members.join(blocks, "group").withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    verified = materialize(_verified(docs, members, threshold, words), "verified")

    near = components(verified.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("fp").agg(F.sum("links").alias("links"))
    told = reps.drop("bands", "n").join(links, "fp", "left").join(
        near.select(F.col("node").alias("fp"), F.col("root").alias("near")), "fp", "left")
    told = materialize(told.withColumn("near", F.coalesce("near", "fp")), "near-classes")
    least = told.groupBy("near").agg(F.min("rep").alias("class_id"))
    classes = told.join(least, "near").select(
        "fp", "rep", "same", "near", "class_id",
        (F.col("same") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "fp"), classes


def _verified(docs: DataFrame, members: DataFrame, threshold: Fraction, words: int) -> DataFrame:
    """Verify the groups' pairs on full sets, made again from the texts of the representatives."""
    wanted = members.select(
        F.col("rep").alias("_rep"), F.col("fp").alias("_fp"), "group", "blocks", "block", "same")
    asked = docs.select("doc_id", "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))
    ).select("text", F.col("_fp").alias("fp"), "group", "blocks", "block", "same")

    def sets(batches):
        for batch in slices(batches):
            keep, ngrams, seen = [], [], set()
            for i, (fp, text) in enumerate(zip(batch.column("fp").to_pylist(), texts(batch, "text"))):
                found = ngram_set(text, words)
                # Another row may carry the same doc_id; equal rows are wanted once.
                if fp not in seen and len(found) and fingerprint(found) == fp:
                    seen.add(fp)
                    keep.append(i)
                    ngrams.append(found.astype("<u8").tobytes())
            kept = batch.drop_columns(["text"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(ngrams, pa.binary())], names=[*kept.schema.names, "ngrams"])

    full = asked.mapInArrow(
        sets, "fp binary, group binary, blocks long, block long, same long, ngrams binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    paired = full.select("fp", "group", "block", "same", "ngrams", other).select(
        "fp", "group", "block", "same", "ngrams",
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def verify(batches):
        for table in keyed_runs(batches, ["group", "low", "high"]):
            yield _verify(table, threshold)

    keys = ["group", "low", "high"]
    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        verify, "fp binary, links long, root binary")


def near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, words: int = WORDS,
                    recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links.

    class_id is the smallest doc_id among the documents that links connect; n_links counts the
    other documents at least that similar, copies included. A null text, or one without words, is
    like no other: it has its own doc_id and no links. A text of fewer words than an n-gram is
    one n-gram. Repeated rows are copies of each other. Other columns are not read; an empty
    table gives no rows.
    """
    signed, classes = near_classes(docs, threshold, words, recall)
    told = signed.where("fp is not null").join(classes, "fp").select("doc_id", "class_id", "n_links")
    return told.union(signed.where("fp is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def one_of_each(docs: DataFrame, threshold: Fraction = THRESHOLD, words: int = WORDS,
                recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their class, with all their columns.

    Of repeated rows one stays. Documents without words all stay.
    """
    signed, classes = near_classes(docs, threshold, words, recall)
    # Of a class's documents, the smallest (doc_id, fp).
    lasting = classes.where(F.col("rep").eqNullSafe(F.col("class_id"))).groupBy("near").agg(
        F.first("class_id").alias("class_id"), F.min("fp").alias("fp"))

    def mark(batches):
        for batch in slices(batches):
            sets = [ngram_set(t, words) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([fingerprint(s) if len(s) else None for s in sets],
                                               pa.binary())], names=["row", "fp"])

    rows = docs.select(F.struct("*").alias("row"), "text")
    schema = rows.select("row", F.lit(None).cast("binary").alias("fp")).schema
    marked = rows.mapInArrow(mark, schema)
    key = [F.col("row.doc_id").eqNullSafe(lasting["class_id"]), marked["fp"] == lasting["fp"]]
    kept = marked.join(lasting, key, "left_semi")
    first = Window.partitionBy("row.doc_id", "fp").orderBy(F.xxhash64("row.text"))
    kept = kept.withColumn("at", F.row_number().over(first)).where("at = 1").select("row.*")
    return kept.unionByName(marked.where("fp is null").select("row.*"))
