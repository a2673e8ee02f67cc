"""Main text of web pages: a recurrent labeller over the blocks of a page.

A page is cut into leaf blocks (text between block-level tags) in page order. Each block is
described by its tag path (names, classes and ids of the elements around it, hashed), its words
(hashed) and a few numbers. A bidirectional LSTM reads the whole sequence, so that every block is
classified with the document around it. It is trained on pages that ``labelled_pages`` lays out
in many ways from named parts, of which only the article is main text.
"""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from duskwatch.llm.common import slices, texts

PATH_BUCKETS, WORD_BUCKETS = 4096, 4096
_DIM, _HIDDEN, _NUMBERS = 12, 20, 6
TRAIN_PAGES = 900
_CELLS = 16_384  # blocks, padding included, that are read at once

_INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark
    nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose
    msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics
    annotation annotation-xml""".split())
_VOID = frozenset("""area base basefont br col embed frame hr img input keygen link meta param source
    track wbr""".split())
# What HTML reads as raw text up to the closing tag.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "iframe", "title", "textarea")}
# An open element of these names ends where one of the named elements begins.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(?:\b)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _path_tokens(name: str, attributes: str) -> list[str]:
    tokens = [name]
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        tokens += [f".{t.lower()}" for t in _TOKEN.findall(value) if not t.isdigit()]
    return tokens


class Block:
    """A leaf block: its text, the tokens of its path (outermost first), characters in links."""

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: list[list[str]], linked: int):
        self.text, self.path, self.linked = text, path, linked


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with references decoded and white space single."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    parts: list[str] = []
    state = {"linked": 0, "path": None}

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, state["path"], state["linked"]))
        parts.clear()
        state["linked"], state["path"] = 0, None

    def say(raw: str):
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if state["path"] is None and not text.isspace():
            state["path"] = [tokens for _, tokens in stack]
        if any(name == "a" for name, _ in stack[-3:]):
            state["linked"] += len(text)

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if closing:
            if name not in _INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in _RAW and not attributes.rstrip().endswith("/"):
            flush()
            end = _RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in _INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                # A paragraph ends where the next block begins, with what is open inside it.
                if stack[i][0] == "p" or name in _ENDED_BY.get(stack[i][0], ()):
                    del stack[i:]
                    break
                if stack[i][0] not in _INLINE:
                    break
        if name not in _VOID and not attributes.endswith("/"):
            stack.append((name, _path_tokens(name, attributes)))
    say(page[at:])
    flush()
    return out


@lru_cache(maxsize=100_000)
def _bucket_of_path(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) % PATH_BUCKETS


def describe(found: list[Block]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Buckets of the whole path, of its innermost part, of the words, and numbers, by block."""
    whole, inner, words, numbers = [], [], [], np.empty((len(found), _NUMBERS))
    for i, block in enumerate(found):
        path = block.path or []
        whole.append(np.array([_bucket_of_path(t) for tokens in path for t in tokens] or [0]))
        inner.append(np.array([_bucket_of_path(t) for tokens in path[-2:] for t in tokens] or [0]))
        split = block.text.lower().split()
        words.append(np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
                     .astype(np.int64) % WORD_BUCKETS)
        n = len(block.text)
        numbers[i] = (np.log1p(len(split)) / 4, block.linked / n, block.text[-1] in ".!?",
                      sum(map(block.text.count, ",.;")) / len(split), i / len(found), len(path) / 10)
    return whole, inner, words, numbers


def _mean(table: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    lengths = np.array([len(x) for x in lists])
    starts = np.cumsum(lengths) - lengths
    return np.add.reduceat(table[np.concatenate(lists)], starts, axis=0) / lengths[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Labeller:
    """Embeddings, an LSTM in each direction, and one output for each block."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, h = 3 * _DIM + _NUMBERS, _HIDDEN
        self.w = {"path": rng.normal(0, 0.3, (PATH_BUCKETS, _DIM)),
                  "word": rng.normal(0, 0.3, (WORD_BUCKETS, _DIM)),
                  "out": rng.normal(0, 0.3, 2 * h), "out_b": np.zeros(1)}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, d**-0.5, (d, 4 * h))
            self.w[f"h{side}"] = rng.normal(0, h**-0.5, (h, 4 * h))
            self.w[f"c{side}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])

    def _inputs(self, pages):
        """Inputs (pages, blocks, features), padded with zeros, and which are real."""
        longest = max(len(p[3]) for p in pages)
        x = np.zeros((len(pages), longest, 3 * _DIM + _NUMBERS))
        real = np.zeros((len(pages), longest), bool)
        for i, (whole, inner, words, numbers) in enumerate(pages):
            n = len(numbers)
            x[i, :n] = np.concatenate([_mean(self.w["path"], whole), _mean(self.w["path"], inner),
                                       _mean(self.w["word"], words), numbers], axis=1)
            real[i, :n] = True
        return x, real

    def _run(self, x, real, side):
        """One direction; padding leaves the state as it is."""
        h_n = _HIDDEN
        order = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        inner = x @ self.w[f"x{side}"] + self.w[f"c{side}"]
        h = np.zeros((len(x), h_n))
        c = np.zeros((len(x), h_n))
        hs, kept = np.zeros((*x.shape[:2], h_n)), {}
        for t in order:
            z = inner[:, t] + h @ self.w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * h_n])
            i, f, o = gates[:, :h_n], gates[:, h_n : 2 * h_n], gates[:, 2 * h_n :]
            g = np.tanh(z[:, 3 * h_n :])
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            m = real[:, t, None]
            kept[t] = (h, c, i, f, o, g, squashed)
            h, c = np.where(m, o * squashed, h), np.where(m, new_c, c)
            hs[:, t] = h
        return hs, kept

    def _back(self, x, real, side, kept, d_hs, grads):
        h_n = _HIDDEN
        order = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        d_h, d_c = np.zeros((len(x), h_n)), np.zeros((len(x), h_n))
        d_z = np.zeros((*x.shape[:2], 4 * h_n))
        grads[f"h{side}"] = np.zeros_like(self.w[f"h{side}"])
        for t in reversed(list(order)):
            h, c, i, f, o, g, squashed = kept[t]
            m = real[:, t, None]
            d_out = d_h + d_hs[:, t]
            d_new = d_c + d_out * o * (1 - squashed**2)
            dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f),
                                 d_out * squashed * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
            dz = np.where(m, dz, 0)
            d_z[:, t] = dz
            grads[f"h{side}"] += h.T @ dz
            d_h = np.where(m, dz @ self.w[f"h{side}"].T, d_out)
            d_c = np.where(m, d_new * f, d_c)
        flat = d_z.reshape(-1, 4 * h_n)
        grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[f"c{side}"] = flat.sum(axis=0)
        return d_z @ self.w[f"x{side}"].T

    def _forward(self, pages):
        x, real = self._inputs(pages)
        forward, kept_f = self._run(x, real, "f")
        backward, kept_b = self._run(x, real, "b")
        both = np.concatenate([forward, backward], axis=2)
        return x, real, kept_f, kept_b, both, both @ self.w["out"] + self.w["out_b"]

    def gradients(self, pages, labels):
        x, real, kept_f, kept_b, both, raw = self._forward(pages)
        y = np.zeros_like(raw)
        for i, row in enumerate(labels):
            y[i, : len(row)] = row
        d = np.where(real, _sigmoid(raw) - y, 0) / real.sum()
        grads = {"out": np.einsum("ijk,ij->k", both, d), "out_b": d.sum(keepdims=True)[0]}
        d_both = d[:, :, None] * self.w["out"]
        d_x = (self._back(x, real, "f", kept_f, d_both[:, :, :_HIDDEN], grads)
               + self._back(x, real, "b", kept_b, d_both[:, :, _HIDDEN:], grads))
        grads["path"], grads["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        d_real = d_x[real]
        for k, table in ((0, "path"), (1, "path"), (2, "word")):
            lists = [ids for page in pages for ids in page[k]]
            lengths = np.array([len(ids) for ids in lists])
            share = d_real[:, k * _DIM : (k + 1) * _DIM] / lengths[:, None]
            np.add.at(grads[table], np.concatenate(lists), np.repeat(share, lengths, axis=0))
        return grads

    def main(self, pages: list) -> list[np.ndarray]:
        """For each described page, which of its blocks are main text."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p[3])), key=lambda i: len(pages[i][3]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]][3]) <= _CELLS:
                end += 1
            chosen = order[at:end]
            raw = self._forward([pages[i] for i in chosen])[-1]
            for row, i in zip(raw, chosen):
                out[i] = row[: len(pages[i][3])] > 0
            at = end
        return out


# --- labelled pages ------------------------------------------------------------------------------

# Names that page authors give to parts, and words that stand in them. Fixed values.
_ARTICLE = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"),
            ("div", "entry-content"), ("div", "post-content"), ("section", "story"), ("div", "main-text"),
            ("article", "entry hentry"), ("div", "page-content"), ("article", "blog-post")]
_PARTS = {
    "nav": ([("nav", ""), ("div", "menu"), ("ul", "nav navbar"), ("div", "navigation"), ("div", "breadcrumbs"),
             ("nav", "main-menu"), ("div", "topbar-menu")], "home about contact products blog login search shop"),
    "header": ([("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"),
                ("div", "site-title")], "welcome official site menu daily news"),
    "footer": ([("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer"),
                ("div", "bottom-bar")], "copyright © · all rights reserved privacy terms imprint powered"),
    "sidebar": ([("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "related"),
                 ("div", "related-posts"), ("div", "popular"), ("section", "recommended")],
                "related popular recent posts archive tags categories follow trending"),
    "notice": ([("div", "cookie-notice"), ("div", "notice"), ("div", "banner alert"), ("div", "consent"),
                ("section", "cookie-banner"), ("div", "popup modal"), ("div", "newsletter")],
               "cookies accept consent privacy policy we use settings subscribe newsletter"),
    "ad": ([("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "ad"), ("div", "sponsored"),
            ("div", "promo"), ("section", "advertisement"), ("div", "ad-slot")],
           "buy now sale offer sponsored discount advertisement deal"),
    "form": ([("form", ""), ("form", "search-form"), ("form", "login"), ("form", "subscribe"),
              ("form", "contact")], "email name submit search password send sign"),
    "comments": ([("div", "comments"), ("section", "comments"), ("div", "comment-list"), ("ol", "commentlist"),
                  ("div", "discussion"), ("div", "responses")], "reply says comment ago report like great thanks"),
}


class _Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.alphabet = "eeaaiioutnrshldcmfpgbvkwyz"
        self.html: list[str] = []
        self.labels: list[tuple[str, bool]] = []
        self.n = 0

    def chance(self, p):
        return self.rng.random() < p

    def one(self, options):
        return self.rng.choice(options)

    def word(self):
        extra = "éüñçßáöèêó" if self.chance(0.2) else ""
        letters = self.alphabet + extra
        word = "".join(self.rng.choices(letters, k=self.rng.randrange(2, 10)))
        return word + self.one(["***", "###", "&amp;&amp;", "$$", "!!", " |"]) if self.odd and self.chance(0.6) else word

    def words(self, least, most, pool=(), share=0.0):
        n = self.rng.randint(least, most)
        return [self.one(pool) if pool and self.chance(share) else self.word() for _ in range(n)]

    def sentence(self, least, most):
        return " ".join(self.words(least, most)).capitalize() + "."

    def block(self, text, main):
        """Text with an own first word, by which its label is found again."""
        self.n += 1
        mark = f"q{self.n}q"
        self.labels.append((mark, main))
        return f"{mark} {text}"

    def open(self, name, css):
        if not css:
            return f"<{name}>"
        if self.chance(0.3):
            return f'<{name} id="{css.replace(" ", "-")}">'
        return f'<{name} class="{css}">' if self.chance(0.8) else f"<{name} data-x='1' class='{css}'>"

    def part(self, kind):
        options, known = _PARTS[kind]
        name, css = self.one(options)
        pool = known.split()
        share = self.one([0.0, 0.3, 0.8])
        self.html.append(self.open(name, css))
        long = kind in ("comments", "notice", "ad", "sidebar") and self.chance(0.5)
        for _ in range(self.rng.randrange(1, 7 if kind in ("nav", "sidebar", "comments") else 3)):
            text = " ".join(self.words(8, 40, pool, share / 3)) + "." if long else " ".join(
                self.words(1, 8, pool, share))
            text = self.block(text, False)
            link = kind in ("nav", "sidebar") or self.chance(0.2)
            inner = f'<a href="/{self.n}">{text}</a>' if link else text
            tag = self.one({"nav": ["li", "li", "div"], "form": ["label", "button", "div"],
                            "comments": ["li", "p", "div"]}.get(kind, ["p", "div", "li", "", "h3"]))
            self.html.append(f"<{tag}>{inner}</{tag}>" if tag else f"{inner}<hr>")
        self.html.append(f"</{name}>")

    def article(self):
        name, css = self.one(_ARTICLE)
        self.html.append(self.open(name, css))
        if self.chance(0.8):
            self.html.append(f"<h1>{self.block(self.sentence(1, 12), True)}</h1>")
        for _ in range(self.rng.randrange(1, 14)):
            kind = self.rng.random()
            text = " ".join(self.sentence(1, 18) for _ in range(self.rng.randrange(1, 6)))
            if kind < 0.12:
                self.html.append(f"<p><b>{self.block(text, True)}<br>")
            elif kind < 0.2:
                items = "".join(f"<li>{self.block(self.sentence(1, 12), True)}</li>" for _ in range(3))
                self.html.append(f"<ul>{items}</ul>")
            elif kind < 0.27:
                self.html.append(f"<h2>{self.block(' '.join(self.words(1, 6)), True)}</h2>")
            elif kind < 0.33:
                self.html.append(f"<blockquote><p>{self.block(text, True)}</p></blockquote>")
            elif kind < 0.38:
                cells = "".join(f"<td>{self.block(' '.join(self.words(1, 4)), True)}</td>" for _ in range(3))
                self.html.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.45:
                self.part(self.one(["ad", "notice", "form", "sidebar", "ad"]))
            elif kind < 0.52:
                self.html.append(f"<div>{self.block(text, True)}</div>")
            else:
                self.html.append(f"<p>{self.block(text, True)}</p>")
        if self.chance(0.15):
            self.part("comments")
        self.html.append(f"</{name}>")

    def page(self):
        self.html, self.labels, self.odd = [], [], self.chance(0.15)
        for kind, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("form", 0.2), ("ad", 0.5),
                        ("sidebar", 0.3)):
            if self.chance(p):
                self.part(kind)
        wrapped = self.chance(0.4)
        if wrapped:
            self.html.append(self.open("div", self.one(["wrapper", "container", "page", "row", "site"])))
        self.article()
        if wrapped and self.chance(0.7):
            self.html.append("</div>")
        for kind, p in (("comments", 0.4), ("sidebar", 0.4), ("ad", 0.3), ("form", 0.2), ("nav", 0.15),
                        ("footer", 0.85), ("notice", 0.1)):
            if self.chance(p):
                self.part(kind)
        body = "".join(self.html)
        return f"<html><head><title>x</title></head><body>{body}</body></html>", dict(self.labels)


def labelled_pages(n: int, seed: int = 3) -> list[tuple[list[Block], np.ndarray]]:
    """Blocks of made-up pages, and which of them are main text."""
    writer, out = _Writer(seed), []
    for _ in range(n):
        page, labels = writer.page()
        found = blocks(page)
        marks = [b.text.split(" ", 1) for b in found]
        for b, m in zip(found, marks):
            b.text = m[1] if len(m) > 1 else m[0]
        out.append((found, np.array([labels[m[0]] for m in marks], float)))
    return out


def train(pages: list[tuple[list[Block], np.ndarray]], epochs: int = 5, seed: int = 1) -> Labeller:
    rng = np.random.default_rng(seed)
    net = Labeller(seed)
    inputs, labels = [describe(b) for b, _ in pages], [y for _, y in pages]
    m = {k: np.zeros_like(w) for k, w in net.w.items()}
    v = {k: np.zeros_like(w) for k, w in net.w.items()}
    order, step, size = np.arange(len(pages)), 0, 24
    for epoch in range(epochs):
        # Pages of a batch are of like length, so that little is padding.
        order = np.array(sorted(rng.permutation(len(pages)), key=lambda i: len(labels[i]) // 6))
        for at in rng.permutation(len(order) // size) * size:
            rows = order[at : at + size]
            step += 1
            rate = 0.01 if epoch < epochs - 2 else 0.003
            for k, g in net.gradients([inputs[i] for i in rows], [labels[i] for i in rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


@lru_cache(maxsize=4)
def trained(pages: int = TRAIN_PAGES) -> Labeller:
    """The labeller, the same for the same number of training pages; fitted once a driver."""
    return train(labelled_pages(pages))


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    chosen = net.main([describe(b) for b in found])
    return [" ".join(b.text for b, keep in zip(bs, kept) if keep) for bs, kept in zip(found, chosen)]


def main_text(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars.

    The whole html is read. A null or empty html, and a page without main blocks, give an empty
    text. Repeated rows are read alike, other columns are not read, and an empty table gives no
    rows. Pages are labelled in batches of a bounded number of blocks; a longer page is a batch.
    """
    net = net or trained()

    def run(batches):
        for batch in slices(batches):
            found = main_texts(texts(batch, "html"), net)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()),
                 pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
