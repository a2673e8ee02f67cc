"""Alignment, repeat removal and whitening against plain Python, and on odd tables."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from duskwatch.llm import alignment, packing, repeats, tokens, whitening
from duskwatch.llm.queries import PIECES, TOKENIZER
from duskwatch.session import utc
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASH = ["key", "marks", "kind", "chunk", "bucket", "run", "payload", "index", "x", "n", "values", "n_words"]


def with_clashes(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH})


# --- op11 -------------------------------------------------------------------------------------

ODD = ["", None, "a\n\nb", " lead", "trail ", "x  y", "tab\there", "▁under", "<s> hi </s> <|endoftext|> </s>",
       "é ü 你好 \U0001f600 z", "line\nbreak\nagain, ok.", "(hi), 'tis a-b.c", " nb sp　x", "\n", " ",
       "é ﬁ ①", "<0x41> q", "a\rb", "\x00z", "cut\nhere 's it's", "\x01 a\x01b", "it's\n's"]


def plainly_aligned(rows):
    """The contract word by word, with both tokenizers over whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    side_a = Tokenizer.from_file(TOKENIZER)
    side_a.encode_special_tokens = True
    side_b = SentencePieceProcessor(model_file=PIECES)
    letters, entry = tokens.byte_alphabet(), {i: e for e, i in side_a.get_vocab().items()}
    counts, docs = Counter(), []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = side_a.encode(raw.decode(), add_special_tokens=False).ids if text else []
        ids_b = side_b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in entry[i]) for i in ids_a]
        bytes_b = [alignment.piece_bytes(side_b.id_to_piece(i)) for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append((doc, 0, 0, 0, [], ""))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in b]).tolist() for b in (bytes_a, bytes_b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = bisect.bisect_right(ends_a, cut), bisect.bisect_right(ends_b, cut)
            groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
            i, j = to_i, to_j
        linked = [(a, ids_b[j]) for i, a in enumerate(ids_a)
                  for j in range(bisect.bisect_right(ends_b, ends_a[i] - len(bytes_a[i])), len(ids_b))
                  if ends_b[j] - len(bytes_b[j]) < ends_a[i]] if len(ids_a) < 3000 else None
        docs.append((doc, len(ids_a), len(ids_b), len(groups), linked,
                     hashlib.sha256(";".join(groups).encode()).hexdigest()))
        counts.update(linked)
    highest = defaultdict(int)
    for (_, b), c in counts.items():
        highest[b] = max(highest[b], c)
    return counts, sorted(((d, na, nb, ng, len(own), sum(counts[p] == highest[p[1]] for p in own),
                           sum(counts[p] for p in own), digest) for d, na, nb, ng, own, digest in docs), key=repr)


@pytest.fixture(scope="module")
def aligned_rows(spark):
    utc(spark)
    given = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 3000).select("doc_id", "text")
    rows = [tuple(r) for r in given.collect()]
    rows += [(900_000 + i, t) for i, t in enumerate(ODD)] + [(None, "a null id"), (900_003, " lead")] + rows[:3]
    return rows, plainly_aligned(rows)


@pytest.mark.parametrize("size", [(alignment.LINKS_A_RUN, None), (2_000, 3), (1, 1)])
def test_alignment(spark, aligned_rows, size):
    rows, (_, expected) = aligned_rows
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = alignment.align(docs, TOKENIZER, PIECES, *size)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected
    assert alignment.align(docs.limit(0), TOKENIZER, PIECES).count() == 0


def test_alignment_pairs(spark, aligned_rows):
    rows, (counts, _) = aligned_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = alignment.links(docs, TOKENIZER, PIECES).collect()
    assert {(r.a_id, r.b_id): r["count"] for r in found} == dict(counts)
    top = {b: max(c for (_, y), c in counts.items() if y == b) for _, b in counts}
    assert all(r.best == (counts[r.a_id, r.b_id] == top[r.b_id]) for r in found)


def test_parts_are_aligned_as_whole_texts():
    """Cutting at spaces and line breaks gives the tokens of whole texts, on random strings."""
    rng, aligner = random.Random(5), alignment.Aligner(TOKENIZER, PIECES)
    letters = "abcXYZ .,'-_/()09é你ß\U0001f600\n"
    whole = [t for t in ("".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4000))]
    run, plain = alignment.Run(1), [t for t in whole if tokens.plain(t)]
    assert len(plain) > 500
    alignment._add_texts(run, aligner, list(range(len(plain))), plain)
    for text, size, digest in zip(plain, np.concatenate(run.sizes), run.digests):
        part = aligner.whole(text)
        assert size.tolist() == part.sizes[0].tolist(), text
        assert digest == hashlib.sha256(part.groups[0].encode()).hexdigest()


def test_ids_are_those_of_the_tokenizer(spark):
    """Parts, whole texts and special strings, against ``tokenizers`` over whole texts."""
    from tokenizers import Tokenizer

    plainly, rng, own = Tokenizer.from_file(TOKENIZER), random.Random(9), packing.Tokens(TOKENIZER)
    given = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    letters = "abcXYZ .,'-_/()09é你ß\U0001f600\n\t\u00a0"
    given += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    given += [t or "" for t in ODD] + ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny z"]
    for at in range(0, len(given), 500):
        texts = given[at : at + 500]
        for text, ids in zip(texts, own.many(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == plainly.encode(text, add_special_tokens=False).ids, text


def test_heap_merge():
    rng = np.random.default_rng(3)
    runs, counts = [], Counter()
    for size in (1, 10, 70_000, 40_000, 0, 33_000):
        pairs = np.unique(rng.integers(0, 200_000, size)).astype(np.uint64)
        totals = rng.integers(1, 9, len(pairs)).astype(np.uint64)
        runs.append(alignment.totals_run(pairs, totals))
        counts.update(dict(zip(pairs.tolist(), totals.tolist())))
    pairs, sums = (np.concatenate(x) for x in zip(*alignment.merged(runs)))
    assert pairs.tolist() == sorted(counts) and dict(zip(pairs.tolist(), sums.tolist())) == counts


# --- op12 -------------------------------------------------------------------------------------


def plainly_removed(rows, window):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeating_rows(seed):
    """Few words, passages of many lengths at all offsets, copies, and texts that repeat themselves."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [[word() for _ in range(n)] for n in (9, 10, 11, 17, 40, 90)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "a " * 500), (4, "a b " * 30 + "c"), (None, "a b " * 30), (5, "short one")]
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += [word() for _ in range(rng.randint(0, 25))]
            if rng.random() < 0.6:
                words += rng.choice(shared)
        rows.append((10 + i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows + rows[20:30] + [(500 + i, rows[40][1]) for i in range(20)]


@pytest.mark.parametrize("window", [10, 11, 35])
@pytest.mark.parametrize("size", [(2_000_000, None), (300, 5), (1, 1)])
def test_repeats(spark, window, size):
    utc(spark)
    rows = repeating_rows(window)
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    found = repeats.removed(docs, window, chunk_words=size[0], buckets=size[1]).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr)
    assert got == plainly_removed(rows, window)
    for r in found:
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed
        assert all(b - a >= window for a, b in zip(r.starts, r.ends))
    assert repeats.removed(docs.limit(0), window).count() == 0


def test_repeats_of_a_very_long_text(spark):
    words = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x"] * 7 + words[70_000:70_035] + ["y"])), (3, " ".join(words[5:39]))]
    found = repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.starts, r.ends) for r in found} == {1: ([70_000], [70_035]), 2: ([7], [42]), 3: ([], [])}


def test_every_window_holds_a_block():
    for window in range(1, 80):
        size = repeats.block_size(window)
        assert all((-start) % size + size <= window for start in range(size))


# --- op13 -------------------------------------------------------------------------------------


def check_whitening(vectors, found, components):
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    n, x = len(x), np.array(x, dtype=object)
    centred = x * n - x.sum(axis=0)
    deviation = (centred * centred).sum(axis=1)
    flat = centred.astype(float) / n
    e, v = np.linalg.eigh(flat.T @ flat / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, len(e))
    assert len(found) == n * k and {r.n for r in found} == {n}
    by = defaultdict(dict)
    for r in found:
        by[r.vec_id][r.component] = r
    got = np.array([[by[i][c + 1].whitened for c in range(k)] for i, _ in rows])
    assert [by[i][1].deviation for i, _ in rows] == deviation.tolist()
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-8)
    want = flat @ v[:, :k] / np.sqrt(e[:k])
    assert np.allclose(np.abs((got * want).sum(axis=0)) / n, 1, atol=1e-8)
    assert np.allclose([by[rows[0][0]][c + 1].explained for c in range(k)], e[:k] / e.sum(), rtol=1e-8)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("rows_per_block", [4096, 7])
def test_whitening(spark, rows_per_block):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    found = whitening.whitened(with_clashes(given.repartition(3)), rows_per_block=rows_per_block).collect()
    check_whitening([tuple(r) for r in given.collect()], found, 32)


def test_whitening_of_few_dimensions_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=3).astype(np.float32)]) for i in range(50)]
    rows += [(60, None), (61, [None, 1.0, 1.0]), (62, [float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check_whitening(rows, whitening.whitened(vectors, rows_per_block=8).collect(), 32)
    more = spark.createDataFrame(rows[:5] + rows[:5] + [(None, [1.0, 2.0, 3.0]), (70, [1.0])], vectors.schema)
    found = whitening.whitened(more, components=2).collect()
    assert len(found) == 24 and found[0].n == 12 and found[0].identity_error < 1e-9
    assert sum(r.vec_id == 0 for r in found) == 4 and sum(r.vec_id is None for r in found) == 2


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whitened(one).collect()
            } == {(2, 0, 0.0, 0.0, 0.0)}
    huge = spark.createDataFrame([(1, [3e38]), (2, [-3e38])], "vec_id long, embedding array<float>")
    assert {r.deviation for r in whitening.whitened(huge).collect()} == {None}
    flat = spark.createDataFrame([(i, [float(i), float(-i), 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    found = whitening.whitened(flat).collect()
    assert {r.component for r in found if r.whitened} == {1} and found[0].identity_error < 1e-9
    none = one.where("vec_id is null")
    assert whitening.whitened(none).collect() == [] and len(whitening.whitened(none).columns) == 7


def test_paths():
    assert PIECES == public_tokenizers.path("piece_bpe_32k.model")
