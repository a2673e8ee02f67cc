"""Chat formatting that can be read back: rendered turns are parsed again and compared.

Grammar: a conversation is ``<s>``, its turns, ``</s>``. A turn is an opening mark, a blank, its
body, a blank, and the closing mark of the same name: ``[INST] ... [/INST]`` for the user,
``[ANS] ... [/ANS]`` for the assistant, ``[SYS] ... [/SYS]`` for the system, and
``[ROLE=name] ... [/ROLE]`` for any other role. No body holds a control string. An opening mark
with a star, as ``[INST*]``, says that the body is escaped: a backslash is doubled, and ``\\.``
stands behind a bracket that would open a control string.
"""

from __future__ import annotations

import hashlib
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import slices

START, END = "<s>", "</s>"
_NAMES = {"user": "INST", "assistant": "ANS", "system": "SYS"}
_ROLES = {name: role for role, name in _NAMES.items()}
_LOSS = "assistant"
_CONTROL = re.compile(r"</?s>|\[(/?)(INST|ANS|SYS|ROLE)(?:=([^\]\s*]*))?(\*?)\]")
_ESCAPED = re.compile(r"\\(\\|\.)")


def escape(text: str, level: int) -> str:
    """Level 0 leaves the text alone, 1 breaks its control strings, 2 breaks every bracket."""
    if level == 0:
        return text
    text = text.replace("\\", "\\\\")
    pattern = _CONTROL if level == 1 else re.compile(r"[\[<]")
    return pattern.sub(lambda m: m.group()[0] + "\\." + m.group()[1:], text)


def unescape(body: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", body)


def render(role: str, text: str) -> str:
    """One turn that reads back as exactly this role and text; escaped as far as that takes."""
    for level in (0, 1, 2):
        name = _NAMES.get(role)
        mark = name or f"ROLE={quote(role, safe='')}"
        turn = f"[{mark}{'*' if level else ''}] {escape(text, level)} [/{name or 'ROLE'}]"
        reader = Reader()
        try:
            if reader.feed(START + turn + END) == [(role, text)] and reader.done():
                return turn
        except ValueError:
            continue
    raise ValueError("no escaping makes this turn readable")


class Reader:
    """Parses a conversation that comes in pieces; holds no more than one unfinished turn."""

    def __init__(self):
        self.rest, self.state = "", "before"

    def done(self) -> bool:
        return self.state == "after" and not self.rest

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that this piece completes, unescaped."""
        self.rest += piece
        out, at = [], 0
        while True:
            m = _CONTROL.match(self.rest, at)
            if self.state == "after" or m is None:
                if len(self.rest) > at and (self.state == "after" or "]" in self.rest[at : at + 4096]):
                    raise ValueError("text outside of turns")
                break
            if m.group() == START:
                if self.state != "before":
                    raise ValueError("a second start")
                self.state, at = "turns", m.end()
            elif m.group() == END:
                if self.state != "turns":
                    raise ValueError("an end before the start")
                self.state, at = "after", m.end()
            else:
                close = _CONTROL.search(self.rest, m.end())
                if close is None:
                    break
                body = self.rest[m.end() : close.start()]
                if (self.state != "turns" or m[1] or close[1] != "/" or close[2] != m[2] or close[4]
                        or len(body) < 2 or body[0] != " " or body[-1] != " "):
                    raise ValueError("a control string where none may stand")
                role = unquote(m[3] or "") if m[2] == "ROLE" else _ROLES[m[2]]
                text = body[1:-1]
                out.append((role, unescape(text) if m[4] else text))
                at = close.end()
        self.rest = self.rest[at:]
        return out


def rendered(turns: DataFrame) -> DataFrame:
    """Every turn in the template: conv_id, turn, role, text (nulls as empty) and piece.

    The pieces of a conversation, in order of turn, then role and text, between ``START`` and
    ``END``, are its formatted text. One row for each turn, however long a conversation is.
    """

    def run(batches):
        for batch in slices(batches):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            said = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()),
                 pa.array(said, pa.string()),
                 pa.array([render(*rt) for rt in zip(roles, said)], pa.string())],
                names=["conv_id", "turn", "role", "text", "piece"])

    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        "role", "text",
    ).mapInArrow(run, "conv_id long, turn long, role string, text string, piece string")


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from the pieces alone.

    Columns: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A task
    reads its conversations as one sorted stream and holds a turn at a time, so a conversation
    may be of any length. Turns with a null number come first; a null conv_id is a conversation
    of its own.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        now, state, rows = None, None, []
        for batch in batches:
            for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        rows.append((now, *state.finish()))
                    now, state = conv, _Digest()
                state.add(piece)
            if len(rows) > 1000:
                yield batch_of(rows)
                rows = []
        if state is not None:
            rows.append((now, *state.finish()))
        if rows:
            yield batch_of(rows)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    return pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")


class _Digest:
    def __init__(self):
        self.reader, self.turns, self.loss = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self._read(START)

    def _read(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text in self.reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == _LOSS:
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))

    def add(self, piece: str) -> None:
        self._read(piece)

    def finish(self):
        self._read(END)
        if not self.reader.done():
            raise ValueError("an unfinished conversation")
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def round_trip(turns: DataFrame) -> DataFrame:
    """Format all conversations and read them back; one row for each conversation.

    Null roles and texts count as empty. Repeated turns are kept and ordered by role and text.
    Other columns are not read; an empty table gives no rows.
    """
    return read_back(rendered(turns))
