"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked ids.

Tokens of both sides are laid over the bytes of a text; two tokens are linked where their byte
ranges overlap, and places where both sides end cut a text into groups.

Counting spills: a task folds its links to records of (pair, document, times), sorts them, and
writes them to the shared folder as a zstd-compressed run. What leaves a run for the shuffle is one
total for each pair, radix-partitioned by the id of side B. A k-way heap merge adds the runs of
a partition up in order of (B, A), which has all pairs of a B id side by side and so yields its
highest count. The counts stream back to the runs they came from, and each run adds its
records up by document. A frequent pair is thus one number for each run, never a group of rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import slices, texts
from duskwatch.llm.tokens import byte_level, entry_bytes, parts_of, plain
from duskwatch.session import materialize

#: Links that a run holds, distinct parts of texts that a worker remembers, bytes of text that are
#: cut into parts at a time, pairs in a block.
LINKS_A_RUN = 3_000_000
PARTS_KEPT = 300_000
SLICE_BYTES = 1 << 20
PARTS_AT_ONCE = 4_000
PAIRS_A_BLOCK = 1 << 15
CHARS_A_BUCKET = 64_000_000

TOTALS, COUNTS, RECORDS = 0, 1, 2
_A_BITS = np.uint64(16)


# --- tokens and links --------------------------------------------------------------------------


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: <0xHH> is a byte, U+2581 is a space."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


@dataclass
class Parts:
    """Several stretches of text after each other, at whose ends both sides end.

    ``sizes`` has tokens of A, tokens of B, groups and links of each, ``groups`` its groups as
    text, and ``pairs`` the links of all, B id times 65,536 plus A id.
    """

    sizes: np.ndarray
    groups: list[str]
    pairs: np.ndarray


class Aligner:
    """Tokenizes and aligns texts, and remembers the parts it has seen.

    In texts whose white space is single spaces and line breaks between other characters, both
    tokenizers end a token before each space and on either side of each line break, so such texts
    are cut there. All others are taken whole.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.encode_a, entries = byte_level(path_a)
        self.b = SentencePieceProcessor(model_file=path_b)
        self.a_bytes = entry_bytes(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.a_length, self.b_length = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        # Every id with each mark that can follow it: inside a group, at the end of its side, of a part.
        ids = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.written = [i + mark for mark in ",|;\n" for i in ids]
        self.marks = len(ids)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.uint64)
        self.new_sizes: list[np.ndarray] = []
        self.new_pairs: list[np.ndarray] = []

    def align(self, ids_a: list[int], ids_b: list[int], parts: list[bytes]) -> Parts | None:
        """Groups and links of two id lists, or nothing if either does not spell the parts, or has a
        token across two of them."""
        raw = b"".join(parts)
        if (b"".join(map(self.a_bytes.__getitem__, ids_a)) != raw
                or b"".join(map(self.b_bytes.__getitem__, ids_b)) != raw):
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.cumsum([len(p) for p in parts])
        if not (np.isin(ends, ends_a, assume_unique=True).all() and np.isin(ends, ends_b, assume_unique=True).all()):
            return None
        # Between two neighbouring ends of either side lie the bytes of one link.
        edges = np.union1d(ends_a, ends_b)
        pairs = (b[np.searchsorted(ends_b, edges)] << 16 | a[np.searchsorted(ends_a, edges)]).astype(np.uint64)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        sizes = np.stack([np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b, cuts, edges)], 1)
        groups = np.concatenate([np.searchsorted(cuts, ends_a) * 2, np.searchsorted(cuts, ends_b) * 2 + 1])
        mark = np.concatenate([np.isin(ends_a, cuts) * 1, np.isin(ends_b, cuts) * 2 + np.isin(ends_b, ends)])
        words = (np.concatenate([a, b]) + mark * self.marks)[np.argsort(groups, kind="stable")]
        text = "".join(map(self.written.__getitem__, words.tolist()))
        return Parts(sizes, text.split("\n")[:-1], pairs)

    def whole(self, text: str) -> Parts | None:
        return self.align(self.encode_a(" " + text), self.b.encode(text), [(" " + text).encode()])

    def learn(self, parts: list[str]) -> None:
        """Remember new parts; those that cannot be spelled have the size -1.

        Parts that begin with a space follow each other as in a text, all others follow a line break.
        """
        row = [p for p in parts if p[0] == " "]
        for part in parts:
            if part[0] != " ":
                row += ["\n", part] if part != "\n" else ["\n", " a"]
        for at in range(0, len(row), PARTS_AT_ONCE):
            own = row[at : at + PARTS_AT_ONCE]
            if own[0][0] != " ":
                own = [" a", *own]
            found = self.spelled(own)
            if found:
                self.remember(own, found)
            else:
                for part in own:
                    alone = [part] if part[0] == " " else [" a", "\n"] if part == "\n" else [" a", "\n", part]
                    found = self.spelled(alone)
                    if found:
                        self.remember(alone, found)
                    elif part not in self.index:
                        self.remember([part], Parts(np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.uint64)))
        for part in parts:
            if part not in self.index:
                self.remember([part], Parts(np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.uint64)))
        self.sizes = np.concatenate([self.sizes, *self.new_sizes])
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes[:, 3])))
        self.pairs = np.concatenate([self.pairs, *self.new_pairs])
        self.new_sizes, self.new_pairs = [], []

    def spelled(self, parts: list[str]) -> Parts | None:
        """Parts that make up a text which begins with a space."""
        text = "".join(parts)
        return self.align(self.encode_a(text), self.b.encode(text[1:]), [p.encode() for p in parts])

    def remember(self, parts: list[str], found: Parts) -> None:
        for part, groups in zip(parts, found.groups):
            self.index[part] = len(self.strings)
            self.strings.append(groups)
        self.new_sizes.append(found.sizes)
        self.new_pairs.append(found.pairs)


# --- runs ------------------------------------------------------------------------------------------


def _planes(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(
        numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _pack(*blobs: bytes) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], "<i8").tobytes() + b"".join(blobs)


def _unpack(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8)) + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def totals_run(pairs: np.ndarray, totals: np.ndarray) -> bytes:
    """Rising pairs with their totals, as blocks that are read one at a time."""
    blocks = []
    for at in range(0, len(pairs), PAIRS_A_BLOCK):
        own = pairs[at : at + PAIRS_A_BLOCK]
        blocks += [_planes(np.diff(own, prepend=np.uint64(0))), _planes(totals[at : at + PAIRS_A_BLOCK])]
    return _pack(*blocks)


def run_blocks(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    blobs = _unpack(run)
    for steps, totals in zip(blobs[::2], blobs[1::2]):
        yield np.cumsum(_from_planes(steps)), _from_planes(totals)


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A k-way heap merge: rising pairs, each once, with the sum of its totals.

    The heap holds the last pair of every run's block at hand; up to the smallest of them, all
    runs are known, and those stretches are added up together.
    """
    blocks = [run_blocks(r) for r in runs]
    hand: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def load(i: int) -> None:
        block = next(blocks[i], None)
        if block is None:
            hand.pop(i, None)
        else:
            hand[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        bound, known = np.uint64(heap[0][0]), []
        for i, (pairs, totals) in list(hand.items()):
            cut = int(np.searchsorted(pairs, bound, "right"))
            known.append((pairs[:cut], totals[:cut]))
            hand[i] = pairs[cut:], totals[cut:]
        while heap and heap[0][0] == int(bound):
            load(heapq.heappop(heap)[1])
        pairs, at = np.unique(np.concatenate([p for p, _ in known]), return_inverse=True)
        sums = np.zeros(len(pairs), np.uint64)
        np.add.at(sums, at, np.concatenate([t for _, t in known]))
        yield pairs, sums


def with_best(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Has a pair the highest count of its B id? Pairs come in order of (B, A)."""
    b = pairs >> _A_BITS
    starts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    highest = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(highest, np.diff(np.append(starts, len(b))))


@dataclass
class Run:
    """Links of the documents of a task, until they are written."""

    buckets: int
    doc_ids: list = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    digests: list[str] = field(default_factory=list)
    docs: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    links: int = 0

    def add(self, doc_ids, sizes: np.ndarray, digests: list[str], docs, pairs, times) -> None:
        """Documents, and (document, pair, times); ``docs`` counts from 0 in this addition."""
        self.docs.append(docs + len(self.doc_ids))
        self.pairs.append(pairs)
        self.times.append(times)
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.digests += digests
        self.links += int(sizes[:, 3].sum())

    def rows(self) -> Iterator[tuple]:
        """One row of records, and one of totals for each bucket it has pairs of."""
        n = len(self.doc_ids)
        pairs, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
        bucket = ((pairs >> _A_BITS) % np.uint64(self.buckets)).astype(np.int64)
        order = np.lexsort((pairs, bucket))
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        codes, times = place[at] * n + np.concatenate(self.docs), np.concatenate(self.times)
        by_code = np.argsort(codes, kind="stable")
        codes, times = codes[by_code], times[by_code]
        totals = np.zeros(len(pairs), np.uint64)
        np.add.at(totals, codes // n, times.astype(np.uint64))
        sizes = np.concatenate(self.sizes)
        docs = pa.RecordBatch.from_arrays(
            [pa.array(self.doc_ids, pa.int64()), *[pa.array(sizes[:, i]) for i in range(4)], pa.array(self.digests)],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_batch(docs)
        head = zstandard.compress(sink.getvalue().to_pybytes(), 1)
        body = _pack(head, _planes(np.diff(codes, prepend=0)), _planes(times))
        name = np.uint64(xxhash.xxh3_64_intdigest(body)).astype(np.int64).item()
        yield RECORDS, 0, name, body
        pairs, bucket = pairs[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(pairs)]
        for a, b in zip(edges, edges[1:]):
            yield TOTALS, int(bucket[a]), name, totals_run(pairs[a:b], totals[a:b])


def _add_texts(run: Run, aligner: Aligner, doc_ids: list, own_texts: list[str]) -> None:
    """Tokenize, align, and fold links to (document, pair, times)."""
    n = len(own_texts)
    sizes, digests = np.zeros((n, 4), np.int64), [""] * n
    docs, pairs, times = [], [], []
    whole, cut, counts, parts = [], [], [], []
    for d, text in enumerate(own_texts):
        if not text:
            continue
        if aligner.cuts and plain(text):
            own = parts_of(text)
            own[0] = " " + own[0]
            cut.append(d)
            counts.append(len(own))
            parts += own
        else:
            whole.append(d)
    if parts:
        at = np.fromiter(map(aligner.index.get, parts, repeat(-1)), np.int64, len(parts))
        missing = [parts[i] for i in np.flatnonzero(at < 0).tolist()]
        if missing:
            aligner.learn(list(dict.fromkeys(missing)))
            at[at < 0] = np.fromiter(map(aligner.index.__getitem__, missing), np.int64, len(missing))
        starts = np.cumsum([0, *counts[:-1]])
        own = np.add.reduceat(aligner.sizes[at], starts)
        odd = np.minimum.reduceat(aligner.sizes[at, 0], starts) < 0
        owner = np.repeat(np.array(cut), counts)
        for d, size, bad, a, n in zip(cut, own, odd.tolist(), starts.tolist(), counts):
            if bad:
                whole.append(d)
                continue
            sizes[d] = size
            text = ";".join(map(aligner.strings.__getitem__, at[a : a + n].tolist()))
            digests[d] = hashlib.sha256(text.encode()).hexdigest()
        good = ~np.repeat(odd, counts)
        known = len(aligner.strings)
        codes, often = np.unique(owner[good] * known + at[good], return_counts=True)
        part, doc = codes % known, codes // known
        links = aligner.sizes[part, 3]
        within = np.arange(links.sum()) - np.repeat(np.cumsum(links) - links, links)
        pairs.append(aligner.pairs[np.repeat(aligner.offsets[part], links) + within])
        docs.append(np.repeat(doc, links))
        times.append(np.repeat(often, links))
    for d in whole:
        part = aligner.whole(own_texts[d])
        if part is None:
            continue
        sizes[d] = part.sizes[0]
        digests[d] = hashlib.sha256(part.groups[0].encode()).hexdigest()
        linked, often = np.unique(part.pairs, return_counts=True)
        pairs.append(linked)
        docs.append(np.full(len(linked), d))
        times.append(often)
    empty = np.zeros(0, np.int64)
    doc, pair, often = (np.concatenate(x) if x else empty for x in (docs, pairs, times))
    codes, at = np.unique(pair.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64), return_inverse=True)
    folded = np.zeros(len(codes), np.int64)
    np.add.at(folded, at, often)
    run.add(doc_ids, sizes, digests, (codes & np.uint64(0xFFFFFFFF)).astype(np.int64), codes >> np.uint64(32), folded)


# --- on Spark ----------------------------------------------------------------------------------------

_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("run", pa.int64()), ("payload", pa.binary())])
_ROWS_DDL = "kind int, bucket int, run long, payload binary"
_ALIGNERS: dict[tuple, Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, so that its tasks share the parts that are known."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def _by_size(rows: Iterator[tuple], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[-1])
        if n > size:
            yield _batch(held)
            held, n = [], 0
    if held:
        yield _batch(held)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _counted(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of a bucket after each other: merge them, and answer each with its pairs' counts."""

    def answers(bucket: int, runs: list[tuple[int, bytes]]) -> Iterator[tuple]:
        steps = list(merged([r for _, r in runs]))
        pairs, counts = (np.concatenate(x) for x in zip(*steps))
        best = with_best(pairs, counts)
        for name, run in runs:
            own = np.concatenate([p for p, _ in run_blocks(run)])
            at = np.searchsorted(pairs, own)
            yield COUNTS, bucket, name, _pack(_planes(counts[at]), np.packbits(best[at]).tobytes())

    held, bucket = [], None
    for _, b, name, payload in rows:
        if held and b != bucket:
            yield from answers(bucket, held)
            held = []
        bucket = b
        held.append((name, payload))
    if held:
        yield from answers(bucket, held)


def _results(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Counts of a run by bucket, then its records: add up by document."""
    name, counts, best = None, {}, {}
    for kind, bucket, run, payload in rows:
        if run != name:
            name, counts, best = run, {}, {}
        blobs = _unpack(payload)
        if kind == COUNTS:
            counts[bucket] = _from_planes(blobs[0]).astype(np.int64)
            best[bucket] = np.unpackbits(np.frombuffer(blobs[1], np.uint8), count=len(counts[bucket])).astype(np.int64)
            continue
        docs = pa.ipc.open_stream(zstandard.decompress(blobs[0])).read_all().combine_chunks().to_batches()
        if not docs:
            continue
        docs, codes = docs[0], np.cumsum(_from_planes(blobs[1])).astype(np.int64)
        n, times = docs.num_rows, _from_planes(blobs[2]).astype(np.int64)
        total, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(codes):
            of_pair = [np.concatenate([x[b] for b in sorted(x)]) for x in (counts, best)]
            np.add.at(total, codes % n, times * of_pair[0][codes // n])
            np.add.at(n_best, codes % n, times * of_pair[1][codes // n])
        columns = dict(zip(docs.schema.names, docs.columns))
        yield pa.RecordBatch.from_arrays(
            [*[columns[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
             pa.array(n_best), pa.array(total), columns["groups_sha256"]],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def spilled(docs: DataFrame, path_a: str, path_b: str, links_a_run: int = LINKS_A_RUN,
            buckets: int | None = None) -> DataFrame:
    """The runs of all tasks, stored: one row of records each, and its totals by bucket."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = buckets or max(least, -(-chars // CHARS_A_BUCKET))

    def rows(batches):
        aligner, run = aligner_of(path_a, path_b), Run(parts)
        for batch in slices(batches, SLICE_BYTES):
            if len(aligner.strings) > PARTS_KEPT:
                aligner.forget()
            _add_texts(run, aligner, batch.column("doc_id").to_pylist(), texts(batch, "text"))
            if run.links > links_a_run:
                yield from run.rows()
                run = Run(parts)
        if run.doc_ids:
            yield from run.rows()

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _by_size(rows(batches)), _ROWS_DDL)
    return materialize(sent, "alignment-runs")


def align(docs: DataFrame, path_a: str, path_b: str, links_a_run: int = LINKS_A_RUN,
          buckets: int | None = None) -> DataFrame:
    """Tokens, groups, links and corpus-wide counts of every document.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of
    its B id, ties included), count_sum (counts of all links added up), groups_sha256. A null or empty
    text, or one that either side does not spell byte for byte, has zeros and an empty digest.
    Repeated rows count and appear each time. Other columns are not read. An empty table gives no
    rows.
    """
    runs = spilled(docs, path_a, path_b, links_a_run, buckets)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = runs.where(F.col("kind") == TOTALS).repartition(partitions, "bucket").sortWithinPartitions("bucket", "run")
    counts = totals.mapInArrow(lambda batches: _by_size(_counted(_stream(batches))), _ROWS_DDL)
    met = runs.where(F.col("kind") == RECORDS).unionByName(counts).repartition(
        partitions, "run").sortWithinPartitions("run", "kind", "bucket")
    return met.mapInArrow(
        lambda batches: _results(_stream(batches)),
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def links(docs: DataFrame, path_a: str, path_b: str, buckets: int | None = None) -> DataFrame:
    """All linked pairs of the corpus: a_id, b_id, count, best."""
    runs = spilled(docs, path_a, path_b, LINKS_A_RUN, buckets)
    totals = runs.where(F.col("kind") == TOTALS).repartition("bucket").sortWithinPartitions("bucket", "run")

    def rows(batches):
        held: dict[int, list[bytes]] = {}
        for _, bucket, _, payload in _stream(batches):
            held.setdefault(bucket, []).append(payload)
        for own in held.values():
            pairs, counts = (np.concatenate(x) for x in zip(*merged(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((pairs & np.uint64(0xFFFF)).astype(np.int64)), pa.array((pairs >> _A_BITS).astype(np.int64)),
                 pa.array(counts.astype(np.int64)), pa.array(with_best(pairs, counts))], ["a_id", "b_id", "count", "best"])

    return totals.mapInArrow(rows, "a_id long, b_id long, count long, best boolean")
