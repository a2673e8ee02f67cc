"""Removal of word sequences that repeat anywhere in a corpus, by fixed-block anchors.

Reference blocks are cut from every text at multiples of the block length, without overlap, and
indexed. A window of ``window`` words always holds one whole block when a block has
(window + 1) / 2 words, so every repeat that long is met when all rolling windows of block length
are probed against the index. Hits are extended to all windows around them; those whose words
also start elsewhere are exact repeats, and where they touch they form the maximal ones.

Words are compared as hashes: 64 bits of a block decide only what is looked at further, 96 bits of
a window decide. Rows are never paired. Hashes travel in runs: one binary value for the hashes
that a chunk of texts sends to a bucket, and the answers come back by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import mix, slices, texts, word_hashes, words_of
from duskwatch.session import materialize

WINDOW = 35
#: Words whose hashes one run of a task holds, and characters of text for each bucket.
WORDS_A_CHUNK = 2_000_000
CHARS_A_BUCKET = 24_000_000

INDEX, PROBES, DIRECTORY = 0, 1, 2
RUN = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
ANSWER = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary())])
MARKS = pa.schema([("key", pa.binary()), ("marks", pa.binary())])
_RUN, _ANSWER, _MARKS = ("bucket int, kind int, chunk long, payload binary",
                         "kind int, chunk long, payload binary", "key binary, marks binary")

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, size: int, base: int = _BASES[0]) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words: polynomials from prefix sums, then mixed."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(base, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _powers(pow(base, -1, 1 << 64), n - size + 1))


def block_size(window: int) -> int:
    """The largest block of which every window holds a whole one, wherever it starts."""
    return (window + 1) // 2


# --- chunks and runs -------------------------------------------------------------------------


@dataclass
class Chunk:
    """Words of several texts in a row, with what is known about them."""

    keys: list[bytes]
    lengths: np.ndarray
    words: np.ndarray
    marks: np.ndarray | None

    def __post_init__(self):
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        # The name follows from the content, so that a repeated task gives the same one.
        self.name = np.uint64(xxhash.xxh3_64_intdigest(b"".join(self.keys))).astype(np.int64).item()

    def inside(self, size: int) -> np.ndarray:
        """Does the run of ``size`` words at each place end inside its text?"""
        room = np.repeat(self.ends, self.lengths) - np.arange(len(self.words))
        return room >= size

    def directory(self, marks: np.ndarray) -> tuple[int, int, int, bytes]:
        head = np.array([len(self.keys)], "<i8").tobytes() + self.lengths.astype("<i8").tobytes()
        body = head + b"".join(self.keys) + np.packbits(marks).tobytes()
        return self.name % (1 << 31), DIRECTORY, self.name, zstandard.compress(body, 1)


def chunks(batches: Iterator[pa.RecordBatch], least: int, size: int) -> Iterator[Chunk]:
    """Texts of ``least`` words and more, by about ``size`` words; texts are never cut."""
    keys, lengths, hashes, marks, held = [], [], [], [], 0
    for batch in slices(batches):
        has_marks = "marks" in batch.schema.names
        marked = batch.column("marks").to_pylist() if has_marks else [None] * batch.num_rows
        words = []
        for key, text, mark in zip(batch.column("key").to_pylist(), texts(batch, "text"), marked):
            own = words_of(text)
            if len(own) < least:
                continue
            keys.append(key)
            lengths.append(len(own))
            words += own
            if has_marks:
                marks.append(_unpack(mark, len(own)))
        hashes.append(word_hashes(words))
        held += len(words)
        if held >= size:
            yield Chunk(keys, np.array(lengths), np.concatenate(hashes), np.concatenate(marks) if marks else None)
            keys, lengths, hashes, marks, held = [], [], [], [], 0
    if keys:
        yield Chunk(keys, np.array(lengths), np.concatenate(hashes), np.concatenate(marks) if marks else None)


def _unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def _planes(numbers: np.ndarray) -> bytes:
    """Rising numbers as zstd-compressed byte planes of their differences."""
    steps = np.diff(numbers, prepend=0).astype("<u8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel()).astype(np.int64)


def _encode(places: np.ndarray, *columns: tuple[np.ndarray, int]) -> bytes:
    """The low bytes of hash columns, as many as asked for, and the places they stand at."""
    parts = [np.array([len(places)], "<i8").tobytes()]
    for values, width in columns:
        parts.append(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes())
    return b"".join(parts) + _planes(places)


def _decode(payload: bytes, *widths: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n, at, columns = int(np.frombuffer(payload, "<i8", 1)[0]), 8, []
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(payload, np.uint8, n * width, at).reshape(n, width)
        columns.append(wide.view("<u8").ravel())
        at += n * width
    return _numbers(payload[at:]), columns


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n < 1 << 16 else np.int64)


def _runs(chunk: Chunk, kind: int, n: int, places: np.ndarray, bucket_of: np.ndarray, *columns):
    """One row for each bucket that gets any of the hashes; places rise inside a run."""
    buckets = _buckets(bucket_of, n)
    order = np.argsort(buckets, kind="stable")
    sizes = np.bincount(buckets, minlength=n)
    for bucket, rows in zip(np.flatnonzero(sizes).tolist(), np.split(order, np.cumsum(sizes[sizes > 0])[:-1])):
        yield bucket, kind, chunk.name, _encode(places[rows], *[(c[rows], w) for c, w in columns])


# --- anchors: reference blocks are indexed, rolling windows probe them --------------------------

_ANCHOR_BYTES = 5
_ANCHOR_MASK = np.uint64((1 << 39) - 1)


def _groups(order_key: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values meet, and the number of the group at each place of it."""
    order = np.lexsort(order_key) if len(order_key) > 1 else np.argsort(order_key[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in order_key:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def anchor_runs(chunk: Chunk, window: int, n: int) -> Iterator[tuple]:
    """Index and probe runs of a chunk. Hits inside the chunk are found at once and not sent."""
    size = block_size(window)
    places = np.flatnonzero(chunk.inside(size))
    hashes = rolling(chunk.words, size)[places]
    aligned = (places - np.repeat(chunk.starts, chunk.lengths)[places]) % size == 0
    order, group = _groups((hashes,))
    blocks = np.bincount(group, weights=aligned[order])
    hit = np.zeros(len(places), bool)
    hit[order] = blocks[group] - aligned[order] > 0
    marks = np.zeros(len(chunk.words), bool)
    marks[places[hit]] = True
    yield chunk.directory(marks)
    index = np.unique(hashes[aligned])
    yield from _runs(chunk, INDEX, n, np.zeros(len(index), np.int64), index, (index & _ANCHOR_MASK, _ANCHOR_BYTES))
    rest = ~hit
    code = ((hashes & _ANCHOR_MASK) << np.uint64(1)) | aligned.astype(np.uint64)
    yield from _runs(chunk, PROBES, n, places[rest], hashes[rest], (code[rest], _ANCHOR_BYTES))


class Anchors:
    """The index of one bucket; probes stream past it."""

    def __init__(self):
        self.parts, self.keys = [], None

    def add(self, kind: int, chunk: int, payload: bytes) -> Iterator[tuple]:
        if kind == INDEX:
            self.parts.append(_decode(payload, _ANCHOR_BYTES)[1][0])
            return
        if self.keys is None:
            self.keys, self.counts = np.unique(np.concatenate(self.parts or [np.zeros(0, np.uint64)]), return_counts=True)
            self.parts = []
        if not len(self.keys):
            return
        places, (code,) = _decode(payload, _ANCHOR_BYTES)
        wanted = code >> np.uint64(1)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        # A block of the index finds itself; only a second one is a hit for it.
        hit = (self.keys[at] == wanted) & (self.counts[at] > (code & np.uint64(1)))
        if hit.any():
            yield PROBES, chunk, _planes(places[hit])

    def end(self) -> Iterator[tuple]:
        return iter(())


# --- windows: hits are extended, equal windows meet ---------------------------------------------

_WINDOW_BYTES = (8, 4)


def around(hits: np.ndarray, chunk: Chunk, window: int) -> np.ndarray:
    """Starts of all windows that hold a hit block whole and end inside their text."""
    reach = window - block_size(window) + 1
    sums = np.concatenate(([0], np.cumsum(hits)))
    after = np.minimum(np.arange(len(hits)) + reach, np.repeat(chunk.ends, chunk.lengths))
    return np.flatnonzero((sums[after] > sums[:-1]) & chunk.inside(window))


def window_runs(chunk: Chunk, window: int, n: int) -> Iterator[tuple]:
    """Runs of the windows around hits. What repeats inside the chunk is settled; one is sent on."""
    places = around(chunk.marks, chunk, window)
    one, two = (rolling(chunk.words, window, b)[places] for b in _BASES)
    two &= np.uint64(0xFFFFFFFF)
    order, group = _groups((two, one)) if len(places) else (np.zeros(0, int), np.zeros(0, int))
    many = np.zeros(len(places), bool)
    many[order] = np.bincount(group)[group] > 1 if len(places) else False
    marks = np.zeros(len(chunk.words), bool)
    marks[places[many]] = True
    yield chunk.directory(marks)
    first = np.zeros(len(places), bool)
    if len(places):
        first[order[np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1))]] = True
    for kind, rows in ((INDEX, np.flatnonzero(many & first)), (PROBES, np.flatnonzero(~many))):
        yield from _runs(chunk, kind, n, places[rows], one[rows], *zip((one[rows], two[rows]), _WINDOW_BYTES))


class Windows:
    """All windows that chunks sent to one bucket; each chunk sends a window once."""

    def __init__(self):
        self.rows = []

    def add(self, kind: int, chunk: int, payload: bytes) -> Iterator[tuple]:
        self.rows.append((kind, chunk, *_decode(payload, *_WINDOW_BYTES)))
        return iter(())

    def end(self) -> Iterator[tuple]:
        if not self.rows:
            return
        one, two = (np.concatenate([c[i] for *_, c in self.rows]) for i in (0, 1))
        order, group = _groups((two, one))
        many = np.zeros(len(one), bool)
        many[order] = np.bincount(group)[group] > 1
        at = 0
        for kind, chunk, places, _ in self.rows:
            found = many[at : at + len(places)]
            at += len(places)
            if kind == PROBES and found.any():
                yield PROBES, chunk, _planes(places[found])


# --- the passes on Spark ---------------------------------------------------------------------------


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, bytes_held = [], 0
    for row in rows:
        held.append(row)
        bytes_held += len(row[-1])
        if bytes_held > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, bytes_held = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _answers(rows: Iterator[tuple], collector: type) -> Iterator[tuple]:
    """Directories pass; each bucket's runs, in order of kind, go to one collector."""
    bucket, held = None, None
    for b, kind, chunk, payload in rows:
        if kind == DIRECTORY:
            yield kind, chunk, payload
            continue
        if held is None or b != bucket:
            if held is not None:
                yield from held.end()
            bucket, held = b, collector()
        yield from held.add(kind, chunk, payload)
    if held is not None:
        yield from held.end()


def _by_text(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Marks of every text that has any, from the directory of each chunk and its answers."""
    name, keys, lengths, marks = None, [], None, None

    def texts_of():
        ends = np.cumsum(lengths) if name is not None else []
        for key, a, b in zip(keys, ends - lengths if name is not None else [], ends):
            if marks[a:b].any():
                yield key, np.packbits(marks[a:b]).tobytes()

    for kind, chunk, payload in rows:
        if kind == DIRECTORY:
            if chunk == name:
                continue  # equal rows made an equal chunk
            yield from texts_of()
            data = zstandard.decompress(payload)
            n = int(np.frombuffer(data, "<i8", 1)[0])
            name, lengths = chunk, np.frombuffer(data, "<i8", n, 8)
            at = 8 + 8 * n
            keys = [data[at + 16 * i : at + 16 * (i + 1)] for i in range(n)]
            marks = _unpack(data[at + 16 * n :], int(lengths.sum()))
        else:
            marks[_numbers(payload)] = True
    yield from texts_of()


def _pass(rows: DataFrame, emit: Callable, collector: type, window: int, buckets: int, chunk_words: int) -> DataFrame:
    """Chunks of ``rows`` send runs to buckets, answers return to chunks: (key, marks)."""

    def send(batches):
        found = (row for c in chunks(batches, window, chunk_words) for row in emit(c, window, buckets))
        yield from _batches(found, RUN)

    def answer(batches):
        yield from _batches(_answers(_rows(batches), collector), ANSWER)

    def gather(batches):
        yield from _batches(_by_text(_rows(batches)), MARKS)

    sent = rows.mapInArrow(send, _RUN).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    back = sent.mapInArrow(answer, _ANSWER).repartition(buckets, "chunk").sortWithinPartitions(
        "chunk", F.desc("kind"))
    marks = back.mapInArrow(gather, _MARKS)
    return marks.groupBy("key").agg(F.first("marks").alias("marks"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both; rows with one key are copies with equal results."""
    text, doc = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(F.concat(doc, F.lit(" "), text))).alias("key"))


def repeated_windows(docs: DataFrame, window: int, buckets: int, chunk_words: int) -> DataFrame:
    """(key, marks): one bit for each word, set where a window starts that also starts elsewhere."""
    keyed = _keyed(docs)
    hits = _pass(keyed.select("key", "text"), anchor_runs, Anchors, window, buckets, chunk_words)
    near = keyed.select("key", "text").join(materialize(hits, "anchor-hits"), "key")
    return _pass(near, window_runs, Windows, window, buckets, chunk_words)


def covered(marks: bytes | None, n: int, window: int) -> np.ndarray:
    """Words inside any of the marked windows."""
    if marks is None:
        return np.zeros(n, bool)
    edges = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(_unpack(marks, n))
    edges[starts] += 1
    np.subtract.at(edges, np.minimum(starts + window, n), 1)
    return np.cumsum(edges[:-1]) > 0


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
                    ("kept", pa.string())])
_KINDS = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string",
          "starts": "array<long>", "ends": "array<long>", "kept": "string"}


def removed(docs: DataFrame, window: int = WINDOW, columns: tuple = tuple(_KINDS),
            chunk_words: int = WORDS_A_CHUNK, buckets: int | None = None) -> DataFrame:
    """Every document without the words that a window repeated anywhere covers.

    Columns, of which ``columns`` picks: doc_id, n_words, n_removed, kept_sha256 and kept (kept
    words joined by one space), starts and ends (the maximal repeats as word numbers, end
    exclusive). Windows are judged on the input. A null text counts as empty; texts of fewer than
    ``window`` words lose nothing; repeated rows lose all that windows cover, each of them.
    Other columns are not read. An empty table gives no rows.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(least, -(-chars // CHARS_A_BUCKET))
    found = repeated_windows(docs.select("doc_id", "text"), window, buckets, chunk_words)
    joined = _keyed(docs.select("doc_id", "text")).join(materialize(found, "repeats"), "key", "left").select(
        "doc_id", "text", "marks")
    schema = pa.schema([RESULT.field(c) for c in columns])

    def cut(batches):
        for batch in slices(batches):
            out = {c: [] for c in RESULT.names}
            for text, marks in zip(texts(batch, "text"), batch.column("marks").to_pylist()):
                words = words_of(text)
                gone = covered(marks, len(words), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["starts"].append(edges[::2])
                out["ends"].append(edges[1::2])
                out["kept"].append(kept.decode("utf-8", "surrogatepass") if "kept" in columns else None)
            out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return joined.mapInArrow(cut, ", ".join(f"{c} {_KINDS[c]}" for c in columns))
