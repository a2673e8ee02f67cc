"""The trigram index: what it requires of a text, what it reads, and what it finds."""

import random
import re

import pytest

from duskwatch.operators import texts, trigrams


@pytest.mark.parametrize("pattern, wanted", [
    ("hello", {"hel", "ell", "llo"}), (r"\bthe of\b", {"the", "he ", "e o", " of"}), ("ab", set()), ("(?i)hello", set()),
    ("hello|world", set()), ("abc(x|y)def", {"abc", "def"}), ("abc?def", {"def"}), ("abcd*efg", {"abc", "efg"}),
    ("(abc)+d", {"abc"}), ("(?:abc)def", {"abc", "bcd", "cde", "def"}), ("abc.def", {"abc", "def"}), (r"a\.b\.c", {"a.b", ".b.", "b.c"}),
    ("[abc]def", {"def"}), (r"\p{L}abc", set()), ("abc{2}def", {"def"}), ("(?!abc)xyz", {"xyz"}), ("a(bc", set()), ("", set()),
    ("abc\nabc", {"abc"}), ("x{0}abcd", {"abc", "bcd"}), ("(abc){0,3}xyz", {"xyz"})])
def test_required(pattern, wanted):
    assert trigrams.required(pattern) == wanted


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "abc", "def", "the", "of", "x.y", "é你好"]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 6))))
            for i in range(300)] + [(900, None), (901, ""), (902, "rare needle here\nneedle again")]
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    trigrams.build(df, path, parts=16)
    return df, rows, path


@pytest.mark.parametrize("pattern", ["gamma delta", r"alpha|beta of", r"x\.y", "the( of)+ the", "(?i)GAMMA DEL", "é你好 abc", "nothing here", "a"])
def test_the_same_lines_are_found(spark, stored, pattern):
    df, rows, path = stored
    got = [tuple(r) for r in trigrams.search(spark, path, pattern, 7).collect()]
    hits = [(d, n, line) for d, t in sorted(rows, key=lambda r: r[0]) for n, line in enumerate((t or "").split("\n"), 1)
            if t is not None and re.search(pattern, line)]
    assert got == [(*h, len(hits)) for h in hits[:7]]
    assert [g[:3] for g in got] == [tuple(r) for r in texts.search(df, pattern, 7).collect()]


def test_only_candidates_are_read(spark, stored):
    _, rows, path = stored
    found = trigrams.candidate_texts(spark, path, "needle")
    assert [r.key for r in found.collect()] == [902] and len(found.inputFiles()) >= 1
    assert len({f.split("part=")[1].split("/")[0] for f in found.inputFiles() if "/texts/" in f}) >= 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(key), EqualTo(key,902)" in plan
    assert trigrams.candidate_texts(spark, path, "ab").count() == len(rows)
    assert trigrams.candidates(spark, path, "needle zzz").count() == 0


def test_a_trigram_is_told_once_for_many_texts(spark, stored):
    _, rows, path = stored
    index = spark.read.parquet(f"{path}/grams")
    # A row for each text and trigram before.
    assert index.count() == index.select("gram", "part").distinct().count()
    want = {(line[i : i + 3], d) for d, t in rows for line in (t or "").split("\n") for i in range(len(line) - 2)}
    got = [(r.gram, k) for r in index.collect() for k in r["keys"]]
    assert len(got) == len(set(got)) and set(got) == want


def test_trigrams_of_odd_texts(spark, tmp_path):
    rows = [("x", "a😀b\r\nc"), ("y", "\x00ab\n\n\n"), ("z", "ab\nc"), ("x", "a😀b again"), (None, "a😀b")]
    trigrams.build(spark.createDataFrame(rows, "doc_id string, text string").coalesce(1), str(tmp_path / "index"), parts=2)
    got = sorted((r.gram, k or "") for r in spark.read.parquet(str(tmp_path / "index/grams")).collect() for k in r["keys"])
    want = [(line[i : i + 3], d or "") for d, t in rows for line in [{*t.split("\n")}] for line in line for i in range(len(line) - 2)]
    assert got == sorted(want)
    assert trigrams.search(spark, str(tmp_path / "index"), "a😀b", 9).count() == 2
    trigrams.build(spark.createDataFrame([], "doc_id string, text string"), str(tmp_path / "none"))
    assert trigrams.candidates(spark, str(tmp_path / "none"), "abc").count() == 0
