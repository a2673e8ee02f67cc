"""Quality rules: fixed limits on rule statistics, and an isolation forest for the odd rest.

The forest is a set of random binary trees over the statistics, which are scaled by their quantiles
among good documents. Documents that few random splits set apart have short paths and are
anomalous. How short is too short is calibrated on labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import (
    SPACES, per_batch, record_batch, row_and, shingles, slices, texts, word_hashes, words_of)
from duskwatch.session import materialize

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
WINDOW = 8

TREES = 300
TREE_ROWS = 1024
#: Of the rows of a tree, those labelled bad: anomalies have to be rare to be isolated early.
TREE_BAD = 4
#: The forest is fitted on at most this many labelled rows of either kind, those whose ids hash lowest.
FIT_ROWS = 4096
#: Share of the good labelled rows that the threshold may reject.
MOST_GOOD_LOST = 0.005
#: Quantiles that scale a statistic; width of what lies between the outermost; how far beyond them,
#: in distances from the median to the outermost, values still count as near; how steep the scale is
#: from there, and its end.
KNOTS = 128
INSIDE = 0.05
WIDER = 0.5
BEYOND = 30.0
FARTHEST = 4.0
_BINS = 2000
#: Whole rows are filtered in slices of about that size: a text is in its row and beside it.
_ROW_BYTES = 4 << 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_upper", "n_lower", "n_digits", "n_shouts", "n_points", "n_echoes"]

_OTHER, _SPACE, _SYMBOL, _UPPER, _LOWER, _DIGIT, _SHOUT, _POINT = range(8)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _characters in ((_POINT, ".,;:'\"()-_/\\[]{}@^~`+="), (_SPACE, SPACES),
                           (_SYMBOL, "#*$%&|<>"), (_SHOUT, "!")):
    _KIND[list(_characters.encode())] = _kind
for _code in range(256):
    if chr(_code).isupper():
        _KIND[_code] = _UPPER
    elif chr(_code).islower():
        _KIND[_code] = _LOWER
    elif chr(_code) in "0123456789":
        _KIND[_code] = _DIGIT


def repeated_words(windows: np.ndarray, size: int) -> int:
    """Words inside windows that occur twice or more, each word counted once."""
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(windows, twice)
    covered = np.zeros(len(windows) + size, np.int32)
    np.add.at(covered, np.flatnonzero(starts), 1)
    np.add.at(covered, np.flatnonzero(starts) + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def rule_counts(text: str) -> list[int]:
    """The statistics of one whole text, in the order of ``COUNTS``."""
    words = words_of(text)
    n = len(words)
    # One byte for each code point; those beyond Latin-1 turn into a question mark.
    kinds = _KIND[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    of = np.bincount(kinds, minlength=8).tolist()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    hashes = word_hashes(words)
    repeats = repeated_words(shingles(hashes, WINDOW), WINDOW) if n > WINDOW else 0
    echoes = int((hashes[1:] == hashes[:-1]).sum())
    return [n, len(text) - of[_SPACE], of[_SYMBOL], len(lines) - len(set(lines)), repeats,
            len(lines), of[_UPPER], of[_LOWER], of[_DIGIT], of[_SHOUT], of[_POINT], echoes]


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeats = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
    return (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)


def features(counts: np.ndarray) -> np.ndarray:
    """Shares, so that they compare across lengths."""
    c = dict(zip(COUNTS, counts.astype(np.float64).T))
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines, letters = np.maximum(c["n_lines"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
        c["n_shouts"] / words, c["n_points"] / words, letters / chars,
        c["n_echoes"] / words,
    ], axis=1)


class Scale:
    """Statistics by their rank among good rows, so that no long tail of a harmless one stands out.

    Ranks lie evenly in an interval of length ``INSIDE``. Values beyond the outermost good ones keep
    their order and distance, up to a bound, so that random splits fall between them and the rest.
    """

    def __init__(self, good: np.ndarray):
        self.columns = []
        for knots in np.quantile(good, np.linspace(0, 1, KNOTS + 1), axis=0).T:
            values = np.unique(knots)
            rank = (np.searchsorted(knots, values) + np.searchsorted(knots, values, "right") - 1) / 2 / KNOTS
            low, middle, high = knots[0], knots[KNOTS // 2], knots[-1]
            self.columns.append((values, rank if len(values) > 1 else rank * 0 + 0.5, low, high,
                                 max(middle - low, 0.02 * abs(middle), 1e-6), max(high - middle, 0.02 * abs(high), 1e-6)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for j, (values, rank, low, high, under, over) in enumerate(self.columns):
            beyond = np.maximum(x[:, j] - high, 0) / over - np.maximum(low - x[:, j], 0) / under
            far = np.sign(beyond) * np.maximum(np.abs(beyond) - WIDER, 0)
            out[:, j] = INSIDE * (np.interp(x[:, j], values, rank) - 0.5) + np.clip(BEYOND * far, -FARTHEST, FARTHEST)
        return out


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), cut, and place of the left child, by node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    length: np.ndarray
    scale: Scale
    limit: float = 0.0

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path over the trees, with the usual correction for the rows left in a leaf."""
        x = self.scale(x)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, length in zip(self.feature, self.cut, self.left, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, left[node] + right, node)
            total += length[node]
        return total / len(self.feature)


def _expected(n: float) -> float:
    """Mean path of an unsuccessful search in a random binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit_forest(good: np.ndarray, bad: np.ndarray, trees=TREES, rows=TREE_ROWS, rare=TREE_BAD,
               seed=5) -> Forest:
    """Each tree splits a random sample, with few bad rows in it, at random places."""
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(rows)))
    scale = Scale(good)
    good, bad = scale(good), scale(bad)
    grown = []
    for _ in range(trees):
        parts = [a[rng.choice(len(a), min(n, len(a)), replace=False)]
                 for a, n in ((good, rows - min(rare, len(bad))), (bad, rare)) if len(a)]
        nodes, queue = [[-1, 0.0, 0, 0.0]], [(0, np.concatenate(parts), 0)]
        while queue:
            at, x, level = queue.pop()
            low, high = x.min(axis=0), x.max(axis=0)
            usable = np.flatnonzero(high > low)
            if level >= depth or len(x) <= 1 or not len(usable):
                nodes[at][3] = level + _expected(len(x))
                continue
            f = rng.choice(usable)
            cut = rng.uniform(low[f], high[f])
            right = x[:, f] >= cut
            nodes[at] = [f, cut, len(nodes), 0.0]
            queue += [(len(nodes), x[~right], level + 1), (len(nodes) + 1, x[right], level + 1)]
            nodes += [[-1, 0.0, 0, level + 1.0], [-1, 0.0, 0, level + 1.0]]
        grown.append(nodes)
    most = max(map(len, grown))
    filled = np.array([n + [[-1, 0.0, 0, 0.0]] * (most - len(n)) for n in grown])
    return Forest(filled[..., 0].astype(np.int64), filled[..., 1], filled[..., 2].astype(np.int64),
                  filled[..., 3], scale)


_STATS = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS]])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row, over whole texts; a null text counts as empty."""

    def run(batch):
        counts = np.array([rule_counts(t) for t in texts(batch, "text")], np.int64)
        return record_batch(_STATS, doc_id=batch.column("doc_id"), **dict(zip(COUNTS, counts.T)))

    return per_batch(docs.select("doc_id", "text"), run,
                     ", ".join(f"{n} long" for n in _STATS.names))


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
        most_good_lost: float = MOST_GOOD_LOST) -> Forest | None:
    """A forest from labelled rows, and its limit from all of them.

    ``stats`` must be stored. Rows that fail the fixed limits take no part; neither do documents
    with no label or with both. The forest sees at most ``fit_rows`` rows of either quality. The
    limit rests on the histograms of path lengths of all labelled rows: the largest at which at
    most that share of good rows is lost. Without labelled rows of both kinds there is no forest.
    """
    agreed = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    known = materialize(
        stats.join(agreed.select("doc_id", "quality"), "doc_id")
        .where(f"n_words >= {LEAST_WORDS} and 100 * n_repeat_words <= {MOST_REPEATED} * n_words"),
        "labelled")
    numbers = {r["quality"]: r["count"] for r in known.where("quality in (0, 1)")
               .groupBy("quality").count().collect()}
    sample = {q: _sample(known.where(F.col("quality") == q), numbers.get(q, 0), fit_rows) for q in (0, 1)}
    if not len(sample[0]) or not len(sample[1]):
        return None
    forest = fit_forest(features(sample[1]), features(sample[0]))
    scored = per_batch(known.select("quality", *COUNTS), lambda b: _scores(forest, b),
                       "quality int, bin int")
    found = np.zeros((2, _BINS), np.int64)
    for r in scored.groupBy("quality", "bin").count().collect():
        if r["quality"] in (0, 1):
            found[r["quality"], r["bin"]] = r["count"]
    lost = np.concatenate([[0], np.cumsum(found[1])])
    # Rejected are the bins below the limit. Among equal losses, stay as far from the good as can be.
    most = np.flatnonzero(lost <= most_good_lost * found[1].sum())[-1]
    caught = np.concatenate([[0], np.cumsum(found[0])])
    least = np.flatnonzero(caught == caught[most])[0]
    forest.limit = (least + most) / 2 / _BINS * _most_path()
    return forest


def _sample(known: DataFrame, n: int, fit_rows: int) -> np.ndarray:
    """Counts of about ``fit_rows`` of ``n`` rows, never more: those with the lowest hashes.

    Tasks send no other rows, so what reaches the driver does not grow with their number.
    """
    range_ = 1 << 31
    place = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(range_))
    limit = range_ if n <= fit_rows else range_ * fit_rows // n
    rows = known.select(place.alias("place"), *COUNTS).where(F.col("place") < limit).collect()
    return np.array([r[1:] for r in sorted(map(tuple, rows))[:fit_rows]], np.int64)


def _most_path() -> float:
    return np.ceil(np.log2(TREE_ROWS)) + _expected(TREE_ROWS) + 1


def _counts_of(batch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS], axis=1)


def _scores(forest: Forest, batch):
    paths = forest.path_lengths(features(_counts_of(batch)))
    return record_batch(
        pa.schema([("quality", pa.int32()), ("bin", pa.int32())]),
        quality=batch.column("quality"), bin=np.minimum(paths / _most_path() * _BINS, _BINS - 1).astype(np.int32))


def verdicts(counts: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of rows of counts."""
    failed = base_failed(counts)
    if forest is None:
        return failed, ~failed
    return failed, ~failed & (forest.path_lengths(features(counts)) >= forest.limit)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, ``COUNTS``, base_failed and kept.

    A null or empty text has no words and fails. Repeated rows are judged alike. Other columns
    of ``docs`` are not read. An empty table gives no rows.
    """
    stats = materialize(statistics(docs), "rule-statistics")
    forest = fit(stats, labels)

    def run(batch):
        failed, kept = verdicts(_counts_of(batch), forest)
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(failed), pa.array(kept)],
            names=[*batch.schema.names, "base_failed", "kept"])

    return per_batch(stats, run, ", ".join(f"{n} long" for n in _STATS.names)
                     + ", base_failed boolean, kept boolean")


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    forest = fit(materialize(statistics(docs), "rule-statistics"), labels)

    def run(batches):
        for batch in slices(batches, _ROW_BYTES):
            counts = np.array([rule_counts(t) for t in texts(batch, "text")], np.int64)
            yield batch.filter(pa.array(verdicts(counts, forest)[1])).select(["row"])

    rows = row_and(docs, text=F.col("text"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
