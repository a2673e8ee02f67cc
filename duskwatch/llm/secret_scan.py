"""Secret scans: fixed patterns, and a character convolutional network over other candidates.

The patterns always count. Beside them every long run of key-like characters with a letter and a
digit is a candidate, also one that touches a pattern, and so is every value of at least 8 characters
after words that announce a credential; the
network reads it with the text around it, a longer run in overlapping windows of which the highest
score counts. It is trained on labelled findings that
``labelled_findings`` writes (credentials of common forms in their usual surroundings, and
look-alikes such as checksums in URLs, identifiers, numbers, file names and encoded pictures),
its outputs are calibrated on a held-out part, and the threshold is the highest that keeps the
demanded recall there.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import row_and, slices, texts

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KEY_CHARACTERS = string.ascii_letters + string.digits + "+/_=-"
LEAST_CANDIDATE = 16
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")

# One byte for each code point; those beyond Latin-1 turn into a question mark.
_HEX_RUN = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_KEY_RUN = bytes(1 if chr(c) in KEY_CHARACTERS else 0 for c in range(256))

SIDE, INSIDE = 24, 48  # characters read on either side of a candidate, and of the candidate
_LENGTH = 2 * SIDE + INSIDE
TRAIN_FINDINGS = 12_000
RECALL = 0.99
REDACTED = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in code points, end exclusive."""
    out = []
    lowered = text.lower()
    if any(h in lowered for h in _HINTS):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    single = text.encode("latin-1", "replace")
    if b"\x01" * 24 in single.translate(_HEX_RUN):
        out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Words that announce a credential, and the value after them, which may hold marks.
LEAST_VALUE = 8
_LEADS = ("pwd", "pass", "login", "credential", "auth", "key", "secret", "token", "bearer", "signature", "pin")
_VALUE = re.compile(
    r"""(?ai)(?:pwd|pass(?:word|wd|phrase|code)?|log[ -]?in(?:\x20with)?|credentials?|auth(?:orization)?|bearer|signature"""
    r"""|(?:[a-z]+[ _-]?)?key|secret|token|pin)-*["']?(?:\x20+is)?[\x20\t]*[:=]*[\x20\t]*["']?(?=([^\s"'<>]{8,}))""")


def _values(text: str) -> list[tuple[int, int]]:
    lowered = text.lower()
    if not any(lead in lowered for lead in _LEADS):
        return []
    found = []
    for m in _VALUE.finditer(text):
        end = m.start(1) + len(m[1].rstrip(".,;:!?)]}"))
        # The rest of the word that announces is no value.
        if m.end() > 0 and text[m.end() - 1].isalnum() or end - m.start(1) < LEAST_VALUE:
            continue
        found.append((m.start(1), end))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of at least 16 key-like characters with both a letter and a digit among them, and
    values of at least 8 characters of any kind after words that announce a credential."""
    found = set(_values(text))
    if b"\x01" * LEAST_CANDIDATE in text.encode("latin-1", "replace").translate(_KEY_RUN):
        for m in _CANDIDATE.finditer(text):
            run = m.group()
            if re.search("[0-9]", run) and re.search("[A-Za-z]", run):
                found.add((m.start(), m.end()))
    return sorted(found)


# --- the network -------------------------------------------------------------------------------

_CODES = {c: i + 2 for i, c in enumerate(chr(k) for k in range(32, 127))}  # 0 nothing, 1 other
_WIDE, _DIM, _FILTERS, _DENSE = 5, 8, 32, 24
_AT_ONCE = 8192  # windows that are encoded at once


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping parts of a candidate that the network reads one by one; no character is left out."""
    if end - start <= INSIDE:
        return [(start, end)]
    places = [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE]
    return [(a, a + INSIDE) for a in places]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Codes of a candidate or window and its surroundings; of a longer one both of its ends."""
    run = text[start:end]
    if len(run) > INSIDE:
        run = run[: INSIDE // 2] + run[-INSIDE // 2 :]
    before, after = text[max(0, start - SIDE) : start], text[end : end + SIDE]
    out = np.zeros(_LENGTH, np.uint8)
    for at, part in ((SIDE - len(before), before), (SIDE, run), (SIDE + INSIDE, after)):
        out[at : at + len(part)] = [_CODES.get(c, 1) for c in part]
    return out


@dataclass
class Network:
    """Embedding, one convolution, maxima over left side, candidate and right side, two layers."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, codes):
        w = self.weights
        e = w["embed"][codes]
        n, length = len(codes), _LENGTH - _WIDE + 1
        windows = np.concatenate([e[:, i : i + length] for i in range(_WIDE)], axis=2)
        conv = np.maximum(windows @ w["conv"] + w["conv_b"], 0)
        cuts = ((0, SIDE - 2), (SIDE - 2, SIDE + INSIDE - 2), (SIDE + INSIDE - 2, length))
        pooled, where = [], []
        for a, b in cuts:
            at = conv[:, a:b].argmax(axis=1) + a
            where.append(at)
            pooled.append(np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0])
        inside = conv[:, cuts[1][0] : cuts[1][1]].mean(axis=1)
        seen = np.concatenate([*pooled, inside], axis=1)
        hidden = np.maximum(seen @ w["dense"] + w["dense_b"], 0)
        return windows, conv, where, seen, hidden, hidden @ w["out"] + w["out_b"]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Calibrated probabilities that candidates are secrets."""
        raw = np.concatenate([self._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)])
        return 1 / (1 + np.exp(-(self.scale * raw + self.shift)))

    def highest(self, asked: list[tuple[str, int, int]]) -> np.ndarray:
        """The highest score over the windows of each candidate (text, start, end)."""
        best, of, codes = np.zeros(len(asked)), [], []

        def read():
            np.maximum.at(best, of, self.scores(np.stack(codes)))
            of.clear(), codes.clear()

        for i, (text, start, end) in enumerate(asked):
            for a, b in windows(start, end):
                of.append(i)
                codes.append(encode(text, a, b))
                if len(codes) == _AT_ONCE:
                    read()
        if codes:
            read()
        return best

    def gradients(self, codes, y):
        w = self.weights
        windows, conv, where, seen, hidden, raw = self._forward(codes)
        n = len(codes)
        d_raw = (1 / (1 + np.exp(-raw)) - y) / n
        g = {"out": hidden.T @ d_raw, "out_b": d_raw.sum(keepdims=True)}
        d_hidden = np.outer(d_raw, w["out"]) * (hidden > 0)
        g["dense"], g["dense_b"] = seen.T @ d_hidden, d_hidden.sum(axis=0)
        d_seen = d_hidden @ w["dense"].T
        d_conv = np.zeros_like(conv)
        rows, filters = np.arange(n)[:, None], np.arange(_FILTERS)[None]
        for k, at in enumerate(where):
            d_conv[rows, at, filters] += d_seen[:, k * _FILTERS : (k + 1) * _FILTERS]
        d_conv[:, SIDE - 2 : SIDE + INSIDE - 2] += d_seen[:, None, 3 * _FILTERS :] / INSIDE
        d_conv *= conv > 0
        flat = d_conv.reshape(-1, _FILTERS)
        g["conv"], g["conv_b"] = windows.reshape(-1, _WIDE * _DIM).T @ flat, flat.sum(axis=0)
        d_windows = d_conv @ w["conv"].T
        d_e = np.zeros((n, _LENGTH, _DIM))
        for i in range(_WIDE):
            d_e[:, i : i + conv.shape[1]] += d_windows[:, :, i * _DIM : (i + 1) * _DIM]
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], codes.ravel(), d_e.reshape(-1, _DIM))
        return g


def train(codes: np.ndarray, y: np.ndarray, recall: float = RECALL, epochs: int = 8, seed: int = 10):
    """Fit on four fifths of the findings; calibrate and set the threshold on the rest."""
    rng = np.random.default_rng(seed)
    shapes = {"embed": (97, _DIM), "conv": (_WIDE * _DIM, _FILTERS), "conv_b": (_FILTERS,),
              "dense": (4 * _FILTERS, _DENSE), "dense_b": (_DENSE,), "out": (_DENSE,), "out_b": (1,)}
    net = Network({k: rng.normal(0, (2 / max(s[0], 8)) ** 0.5, s) if "_b" not in k else np.zeros(s)
                   for k, s in shapes.items()})
    m = {k: np.zeros(s) for k, s in shapes.items()}
    v = {k: np.zeros(s) for k, s in shapes.items()}
    held = len(y) // 5
    fit, step = np.arange(held, len(y)), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), 64):
            rows = fit[i : i + 64]
            step += 1
            for k, g in net.gradients(codes[rows], y[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] -= 0.004 * (m[k] / (1 - 0.9**step)) / (
                    np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    _calibrate(net, codes[:held], y[:held], recall)
    return net


def _calibrate(net: Network, codes, y, recall: float) -> None:
    """Two-parameter logistic fit, then the highest threshold with that recall."""
    raw = np.concatenate([net._forward(codes[i : i + 512])[-1] for i in range(0, len(codes), 512)])
    a, b = 1.0, 0.0
    for _ in range(200):
        d = 1 / (1 + np.exp(-(a * raw + b))) - y
        a, b = max(a - 0.05 * (d * raw).mean(), 0.05), b - 0.05 * d.mean()
    net.scale, net.shift = float(a), float(b)
    secrets = np.sort(net.scores(codes)[y == 1])
    net.threshold = float(secrets[int((1 - recall) * len(secrets) + 1e-9)]) if len(secrets) else 0.5


def _calibrate_runs(net: Network, rows, y, recall: float) -> None:
    """The same over whole candidates: the window with the highest raw output stands for each."""
    net.scale, net.shift = 1.0, 0.0
    best = [max(windows(a, b), key=lambda w: net.scores(encode(text, *w)[None])[0]) if b - a > INSIDE else (a, b)
            for text, a, b in rows]
    _calibrate(net, np.stack([encode(r[0], *w) for r, w in zip(rows, best)]), y, recall)


_LETTERS, _DIGITS, _HEXES = string.ascii_letters, string.digits, "0123456789abcdef"
_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
_MARKS = "!@#$%^&*+?-_"
_SECRET_NAMES = ["key", "api-key", "auth", "pwd", "pass", "access_key", "sig", "signature", "credential", "bearer", "client_key",
                 "login", "private_key", "session", "ACCESS_KEY", "AUTH"]
_PLAIN_NAMES = ["id", "ref", "name", "page", "q", "file", "path", "class", "src", "see", "title", "version", "build", "item",
                "request", "link", "user", "order", "state", "next", "code", "host", "lang", "theme"]


class _Writer:
    """Random texts from a seed."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def some(self, alphabet: str, least: int, most: int | None = None) -> str:
        k = int(self.rng.integers(least, (most or least) + 1))
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), k))

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def words(self, least: int, most: int) -> list[str]:
        return [self.some(_LOWER, 2, 9) for _ in range(int(self.rng.integers(least, most + 1)))]

    def prose(self, least: int = 1, most: int = 5) -> str:
        return " ".join(self.words(least, most))

    def key(self) -> str:
        """A credential that looks like one wherever it stands."""
        some, mixed = self.some, _LETTERS + _DIGITS
        value = (
            lambda: some(mixed, 20, 44), lambda: some(mixed + "+/", 40, 64), lambda: "ghp_" + some(mixed, 36),
            lambda: self.one(["sk_live_", "rk_live_", "pk_live_"]) + some(mixed, 24), lambda: some(_HEXES.upper(), 32, 40),
            lambda: "xox" + self.one("bp") + "-" + some(_DIGITS, 10, 12) + "-" + some(mixed, 24),
            lambda: "eyJ" + some(mixed + "_-", 40, 90), lambda: some(mixed + "_-", 18, 32), lambda: some(mixed + "/", 40),
            lambda: self.one(["live", "test", "prod", "key"]) + "-" + some(_HEXES, 24, 40) + "-" + some(mixed, 8, 16),
        )[int(self.rng.integers(10))]()
        return value if re.search("[0-9]", value) and re.search("[A-Za-z]", value) else value + "7x"

    def short(self) -> str:
        """A password; only what announces it tells."""
        some, mixed = self.some, _LETTERS + _DIGITS
        return (lambda: some(_LETTERS, 6, 9) + some(_DIGITS, 1, 3) + some(_MARKS, 1, 2) + some(mixed, 0, 4),
                lambda: some(mixed, 8, 15), lambda: some(_LETTERS, 16, 32),
                lambda: some(mixed + _MARKS, 8, 20))[int(self.rng.integers(4))]()

    def lookalike(self) -> str:
        """A long run that is no secret."""
        some, one, words, d = self.some, self.one, self.words, _DIGITS
        if self.rng.random() < 0.2:  # the look-alike that stands nearest to keys
            return "-".join(some(_HEXES, k) for k in (8, 4, 4, 4, 12))
        return (
            lambda: "-".join(words(3, 5)) + "-" + some(d, 2, 4), lambda: "_".join(words(2, 4)) + some(d, 1, 3),
            lambda: "".join(w.title() for w in words(2, 4)) + some(d, 1, 2),
            lambda: one(words(1, 1)) + "-" + "-".join(some(_HEXES, k) for k in (8, 4, 4, 4, 12)),
            lambda: "/".join(words(2, 6)) + "/" + one(words(1, 1)) + some(d, 1, 3) + "/" + one(words(1, 1)).title(),
            lambda: one(["src/", "lib/", "docs/", "app/", ""]) + "/".join(words(1, 4)) + "/" + some(d, 2, 4) + "/" + some(_LOWER, 3, 8),
            lambda: "iVBORw0KGgo" + some(_LETTERS + d + "+/", 60, 120),
            lambda: one(["sha256-", "sha384-", "sha512-"]) + some(_LETTERS + d + "+/", 43, 86),
            lambda: "20" + some(d, 2) + "-" + some("01", 1) + some(d, 1) + "-" + some("012", 1) + some(d, 1) + "T" + some(d, 6) + "Z",
            lambda: "/".join("-".join(some("12", 1) + some(d, 3) for _ in range(2)) for _ in range(2)) + "-" + some(_LOWER, 3, 8),
            lambda: some(_LOWER, 12, 22) + some(d, 1, 3), lambda: "=" * int(self.rng.integers(14, 30)) + some(d, 1) + some(_LOWER, 2),
            lambda: "_".join(["YOUR", *[w.upper() for w in words(1, 2)], "KEY", one(["HERE", "1", "V2"])]) + one(["", "_" + some(d, 1, 2)]),
            lambda: "".join(w.upper() for w in words(1, 1)) + "-20" + some(d, 2) + "-" + some(d, 5, 8) + "-" + some(_UPPER, 1, 3),
            lambda: "".join(w.title() for w in words(3, 4)) + one(["Exception", "Handler", "Test", "Factory"]) + one(["", "V2", "2"]),
            lambda: "-".join(words(2, 3)) + "_" + one(["v", "r", "rev"]) + some(d, 1) + "-" + some(d, 4, 8),
        )[int(self.rng.integers(16))]()

    def word(self) -> str:
        """Plain words as they follow the same leads."""
        some, one = self.some, self.one
        return (lambda: some(_LOWER, 8, 16), lambda: some(_LOWER, 8, 14).title(), lambda: one(["username/", "user/", "name-"]) + some(_LOWER, 5, 9),
                lambda: some(_LOWER, 3, 8) + one(["-", "/", "_", "..."]) + some(_LOWER, 5, 9),
                lambda: "".join(w.title() for w in self.words(2, 3)) + "Exception")[int(self.rng.integers(5))]()

    def around(self, make, names: list[str]) -> tuple[str, str, str]:
        """A value of ``make`` in one of the usual surroundings: before, value, after."""
        one, prose, value = self.one, self.prose, make()
        name, host = one(names), "https://" + ".".join(self.words(1, 2)) + one([".com/", ".org/", ".io/"])
        quote, same = one(["\"", "'", ""]), lambda: make()
        return (
            lambda: (prose() + " ", value, one([" ", ", ", ". "]) + prose()),
            lambda: (prose(0, 3) + "\n", value, "\n" + prose(0, 3)),
            lambda: (prose(0, 2) + "\n" + one(["export ", ""]) + name.upper().replace("-", "_") + "=" + quote, value, quote + "\n" + prose(0, 2)),
            lambda: ("{\"" + name + "\": \"", value, "\", \"" + prose(1, 1) + "\": " + self.some(_DIGITS, 1, 3) + "}"),
            lambda: (prose(0, 2) + ": " + same() + ", ", value, ", " + same() + one(["", ", " + same()])),
            lambda: ("- " + same() + "\n- ", value, "\n- " + same() + "\n"),
            lambda: (host + prose(1, 1) + "?" + name + "=", value, one(["", "&" + prose(1, 1) + "=" + self.some(_DIGITS, 1, 3)]) + " " + prose(0, 2)),
            lambda: (host + one(["hooks/", "v1/", "files/", ""]), value, one(["/", "/" + prose(1, 1), "", ".html"]) + " " + prose(0, 2)),
            lambda: (name.replace("-", "_") + " = \"", value, "\"\n" + prose(0, 2)),
            lambda: (name.title() + ": " + one(["", "Bearer "] if names is _SECRET_NAMES else [""]), value, "\n" + prose(0, 3)),
            lambda: ("<" + prose(1, 1) + " " + one([name, "integrity", "src", "href"] if names is _PLAIN_NAMES else [name]) + "=\"", value, "\">" + prose(0, 2)),
            lambda: (prose(0, 3) + " (", value, ") " + prose(0, 3)),
        )[int(self.rng.integers(12))]()

    def led(self, value: str) -> tuple[str, str, str]:
        """A value after words that announce a credential."""
        lead = self.one(["pwd ", "password ", "login with ", "credential: ", "key: ", "the key ", "token ", "access key ", "auth=",
                         "signature \"", "secret ", "bearer ", "Authorization: Bearer ", "private key ", "client_key = \"", "pass is "])
        return self.prose(0, 4) + self.one([" ", "\n", ", "]) + lead, value, self.one(["", "\"", " ", "\n", ";", " " + self.prose(1, 2)])


def labelled_findings(n: int = TRAIN_FINDINGS, seed: int = 7) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) of candidates, and whether each is a secret; half of them are.

    Every kind of value, secret or not, meets every kind of surroundings: prose, lines, settings, JSON,
    lists of its like, queries and paths of URLs, code, headers, attributes. Short passwords and plain
    words come after announcing words only. A candidate is what a scan would offer for the value.
    """
    w, found, y = _Writer(seed), [], np.zeros(n)
    for i in range(n):
        y[i] = i % 2
        announced = w.rng.random() < 0.2
        if i % 2:
            before, value, after = w.led(w.short()) if announced else w.around(w.key, w.one([_SECRET_NAMES, _PLAIN_NAMES]))
        else:
            before, value, after = w.led(w.word()) if announced else w.around(
                w.lookalike, _PLAIN_NAMES if w.rng.random() < 0.8 else _SECRET_NAMES)
        text, start, end = before + value + after, len(before), len(before) + len(value)
        offered = [c for c in candidates(text) if c[0] < end and c[1] > start]
        found.append((text, *max(offered, key=lambda c: min(c[1], end) - max(c[0], start), default=(start, end))))
    order = w.rng.permutation(n)
    return [found[i] for i in order], y[order]


@lru_cache(maxsize=4)
def trained(findings: int = TRAIN_FINDINGS, recall: float = RECALL) -> Network:
    """The network, the same for the same arguments; it is fitted once a driver.

    It learns from the windows of four fifths of the findings and from both ends of long ones; the
    rest, by highest score as in a scan, calibrates it.
    """
    rows, y = labelled_findings(findings)
    held = len(y) // 5
    parts = [(text, a, b, label) for (text, start, end), label in zip(rows[held:], y[held:])
             for a, b in sorted({(start, end), *windows(start, end)})]
    net = train(np.stack([encode(*part[:3]) for part in parts]), np.array([part[3] for part in parts]), recall)
    _calibrate_runs(net, rows[:held], y[:held], recall)
    return net


# --- over tables -------------------------------------------------------------------------------

def scan(batch_texts: list[str], net: Network) -> list[list[tuple[int, int, int]]]:
    """All spans of each text, by start, then kind. Spans of the network may overlap others."""
    found, asked = [], []
    for i, text in enumerate(batch_texts):
        spans = base_spans(text)
        found.append(spans)
        for a, b in candidates(text):
            asked.append((i, a, b))
    if asked:
        for (i, a, b), score in zip(asked, net.highest([(batch_texts[i], a, b) for i, a, b in asked])):
            if score >= net.threshold:
                found[i] = sorted([*found[i], (a, b, 3)], key=lambda s: (s[0], s[2]))
    return found


def findings(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """The spans of secrets in every whole text, one row for each document.

    Columns: doc_id, spans (kind, start, end; code points, end exclusive; by start, then kind).
    A null or empty text has none. Repeated rows are scanned alike, other columns are not read,
    and an empty table gives no rows.
    """
    net = net or trained()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in slices(batches):
            found = scan(texts(batch, "text"), net)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(
                    [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
                     for spans in found], pa.list_(span))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``REDACTED`` and n_chars, if there, set anew.

    Null texts stay null; no row is dropped.
    """
    net = net or trained()

    def run(batches):
        for batch in slices(batches):
            raw = batch.column("text").to_pylist()
            found = scan([t or "" for t in raw], net)
            new = [t if t is None or not s else redact(t, s) for t, s in zip(raw, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(new, pa.string())], names=["row", "clean"])

    rows = row_and(docs, text=F.col("text"))
    schema = rows.select("row", F.col("text").alias("clean")).schema
    clean = rows.mapInArrow(run, schema)
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.length("clean"), F.col("row.n_chars"))
           if "n_chars" in docs.columns else None}
    return clean.select(*[
        new[c].cast(docs.schema[c].dataType).alias(c) if new.get(c) is not None
        else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts of base kinds, a digest of the base spans, and all spans as one text."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"),
        number("hex").alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"))
