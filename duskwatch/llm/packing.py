"""Packing token sequences of documents into windows of a fixed length, best fit decreasing.

Overlong documents are first cut into full windows. The remaining pieces are packed by length,
longest first, each into the open window with the tightest sufficient room; a segment tree over
room, whose leaves are stacks of open windows, finds it in log2(window) steps.
"""

from __future__ import annotations

import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import slices, texts
from duskwatch.llm.tokens import byte_level, entry_bytes, parts_of, plain
from duskwatch.session import materialize

WINDOW = 2048
END = 1
_END_BYTES = END.to_bytes(4, "little")
PIECES_PER_GROUP = 50_000
PIECES_WITH_IDS_PER_GROUP = 5_000
_PARTS_KEPT = 200_000
_PARTS_AT_ONCE = 4_000
_TOKENS_PER_BATCH = 4_000_000
_SLICE_BYTES = 2 << 20


class Tokens:
    """Ids of whole texts as little-endian 32-bit numbers, with those of recurring parts kept.

    Plain texts are cut where no token spans, and parts seen before are not encoded again. Other
    texts are encoded whole, and those with the string of a special token by ``tokenizers`` itself.
    A bounded number of parts is kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode, entries = byte_level(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.length = np.array([len(x) for x in entry_bytes(entries)])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _learn(self, parts: list[str]) -> None:
        """Remember new parts. Those with a space in front are encoded as texts of many of them."""
        spaced = [p for p in parts if p[0] == " "]
        others = [p for p in parts if p[0] != " "]
        ids, sizes = [self.ids], [self.sizes]
        for at in range(0, len(spaced), _PARTS_AT_ONCE):
            own = spaced[at : at + _PARTS_AT_ONCE]
            found = np.array(self.encode("".join(own)), "<u4")
            ends, wanted = np.cumsum(self.length[found]), np.cumsum([len(p.encode()) for p in own])
            if not np.isin(wanted, ends).all():
                others += own
                continue
            self.index.update(zip(own, range(len(self.index), len(self.index) + len(own))))
            ids.append(found)
            sizes.append(np.diff(np.searchsorted(ends, wanted, "right"), prepend=0))
        alone = [np.array(self.encode(p), "<u4") for p in others]
        self.index.update(zip(others, range(len(self.index), len(self.index) + len(others))))
        self.ids = np.concatenate([*ids, *alone])
        self.sizes = np.concatenate([*sizes, [len(x) for x in alone]]).astype(np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def many(self, own_texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, cut, counts, parts = [b""] * len(own_texts), [], [], []
        for i, text in enumerate(own_texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
            elif not plain(text):
                out[i] = np.array(self.encode(text), "<u4").tobytes()
            else:
                own = parts_of(text)
                cut.append(i)
                counts.append(len(own))
                parts += own
        if not parts:
            return out
        if len(self.index) > _PARTS_KEPT:
            self.forget()
        at = np.fromiter(map(self.index.get, parts, repeat(-1)), np.int64, len(parts))
        missing = [parts[i] for i in np.flatnonzero(at < 0).tolist()]
        if missing:
            self._learn(list(dict.fromkeys(missing)))
            at[at < 0] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        whole = self.ids[np.repeat(self.offsets[at] - before, sizes) + np.arange(sizes.sum())].tobytes()
        starts = before[np.cumsum([0, *counts[:-1]])] * 4
        for i, a, b in zip(cut, starts.tolist(), [*starts[1:].tolist(), len(whole)]):
            out[i] = whole[a:b]
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One for each worker process, so that the parts that tasks share are encoded once."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, ids: bool = True) -> DataFrame:
    """Pieces of documents, each at most a window long.

    A document's ids are those of its text (null: empty) and ``END``. Columns: doc_id, start,
    length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens and, if
    asked for, ids.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def batch_of(rows, pieces):
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
        if ids:
            ends = np.cumsum([0, *map(len, pieces)]) // 4
            columns.append(pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(pieces), "<i4"))))
        return pa.RecordBatch.from_arrays(columns, names + ["ids"] * ids)

    def run(batches):
        tokens = tokens_of(path)
        for batch in slices(batches, _SLICE_BYTES):
            rows, pieces, held = [], [], 0
            for doc, own in zip(batch.column("doc_id").to_pylist(), tokens.many(texts(batch, "text"))):
                whole = own + _END_BYTES
                total = len(whole) // 4
                for at in range(0, total, window):
                    piece = whole[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(piece) // 4, zlib.crc32(piece), total))
                    if ids:
                        pieces.append(piece)
                held += total
                if held > _TOKENS_PER_BATCH:
                    yield batch_of(rows, pieces)
                    rows, pieces, held = [], [], 0
            if rows:
                yield batch_of(rows, pieces)

    return docs.select("doc_id", "text").mapInArrow(
        run, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * ids)


class _Room:
    """Open windows by their room: a binary tree of counts over the rooms 0 to ``window``."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return the tightest window with at least that room, and the room."""
        at = least + self.size
        if not self.count[at]:
            while not (at & 1 == 0 and self.count[at + 1]):
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; ``lengths`` must not increase."""
    rooms, placed, sequences = _Room(window), [], 0
    for length in lengths:
        found = rooms.take(length)
        if found is None:
            sequence, room = sequences, window
            sequences += 1
        else:
            sequence, room = found
        placed.append((sequence, window - room))
        if room > length:
            rooms.put(room - length, sequence)
    return placed


def place(pieces: DataFrame, window: int = WINDOW, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Give every piece its ``sequence_id`` and its ``offset`` there.

    ``pieces`` must be stored (its rows and their places may not change between attempts) and
    hold ``length`` from 1 to ``window``. They are dealt out evenly over as many groups as their
    count asks for, and each group is packed by itself. Inside a group, the order is length,
    then all other columns, so that equal pieces are the only ones that can trade places.
    Sequence ids are unique: group number times 2^32, plus a number inside the group.
    """
    groups = max(1, -(-pieces.count() // per_group))
    rest = [f.name for f in pieces.schema if f.name != "length" and f.dataType.typeName() != "array"]
    order = [("length", "descending"), *[(c, "ascending") for c in rest]]

    def run(batches):
        held = list(batches)
        if not held:
            return
        group = TaskContext.get().partitionId()
        table = pa.Table.from_batches(held).sort_by(order)
        placed = best_fit_decreasing(table.column("length").to_pylist(), window)
        sequence, offset = zip(*placed)
        table = table.append_column(
            "sequence_id", pa.array(np.array(sequence, np.int64) + (group << 32)))
        yield from table.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.repartition(groups).mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pack all documents; one row for each piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. An empty or null
    text has one piece, of the end id alone. Repeated rows are packed once each. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    return place(materialize(token_pieces(docs, path, window, ids=False), "pieces"), window)


def sequences(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (not padded), parts.

    ``parts`` holds doc_id, start, length and offset of each piece in order of offset. A sequence
    is a window long at most, so the lists are bounded.
    """
    placed = place(materialize(token_pieces(docs, path, window), "pieces"), window,
                   PIECES_WITH_IDS_PER_GROUP)
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("p"),
    ).select(
        "sequence_id", "n_tokens", F.flatten("p.ids").alias("ids"),
        F.transform("p", lambda x: F.struct(
            x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"),
            x["offset"].alias("offset"))).alias("parts"))
