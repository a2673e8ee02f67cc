"""Every operator and stage on odd tables: nulls, empty and very long texts, repeats, no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duskwatch.llm import (
    chat, extract, licenses, maxscore, mixing, ngram_join, packing, quality, secret_scan, zip_archive)
from duskwatch.llm.queries import TOKENIZER


LONG = " ".join(f"w{i % 5000}x{i % 7}" for i in range(120_000))
DOCS = [
    (1, "one two three four five six", "a"), (1, "one two three four five six", "a"),
    (2, None, None), (None, "only words", "b"), (3, "", "a"), (4, " \n\t ", None),
    (5, LONG, "a"), (6, LONG, "b"), (None, None, None), (7, "\x01 odd\x00 ퟿ 𝒳 é x", "c"),
]
CLASH = ["kept", "size", "copies", "row", "fp", "bands", "length", "spans", "at", "near", "clean", "n", "group"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    rows = rows.withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    return rows.withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (6, None, 0)],
                                 "doc_id long, quality int, toxic int")


def test_extraction(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p"), (2, "u", "<p"), (3, "v", "x" * 3_000_000),
            (4, "w", "<p>a" * 20_000), (5, "y", "<b \"'<!-- <i")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    found = extract.main_text(pages).collect()
    assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
    assert all(r.n_chars == len(r.text) for r in found)
    assert all(r.text == "" for r in found if r.page_id in (1, None))
    assert extract.main_text(pages.limit(0)).count() == 0


def test_search(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]),
            (4, [float("inf"), 0.0]), (5, [1.0]), (6, [1.0, 0.5]), (None, [1.0, 1.0]), (7, []), (8, [-1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(
        {"codes": F.lit("mine"), "shard": F.lit(1)})
    found = sorted(tuple(r) for r in maxscore.search(vectors, F.col("vec_id") % 50 == 0, 5).collect())
    assert found == [(0, 1, 6, 81920), (0, 2, 5, 65536), (0, 3, 7, 0), (0, 4, 8, -49152)]
    assert maxscore.search(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert maxscore.search(vectors, F.lit(False)).count() == 0
    huge = spark.createDataFrame([(0, [3e38, 3e38]), (1, [3e38, 3e38])], "vec_id long, embedding array<float>")
    assert [r.score for r in maxscore.search(huge, F.col("vec_id") == 0).collect()] == [2**63 - 1]


def test_packing(spark, docs):
    rows = packing.pack(docs, TOKENIZER).collect()
    totals = {}
    for r in rows:
        totals.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert totals[2] == [(0, 1, 1)] and totals[3] == [(0, 1, 1)]
    assert sum(x[1] for x in totals[5]) == totals[5][0][2]
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0), TOKENIZER).count() == 0


def test_archives(spark):
    rows = [(3, "u", "same"), (1, "u\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (4, "u", ""),
            (None, "u", "same"), (None, "u", "alone"), (5, "u", "é" * 1_500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("mine") for c in ("digest", "payload", "n")})
    found = zip_archive.archived(pages, payloads=True).collect()
    told = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found), key=str)
    assert told == sorted([
        (3, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (2, "response", None, 0),
        (4, "revisit", 2, 0), (None, "revisit", 1, 4), (None, "response", None, 5),
        (5, "response", None, 3_000_000)], key=str)
    assert {bytes(r.payload) for r in found if r.page_id == 5} == {("é" * 1_500_000).encode()}
    assert zip_archive.archived(pages.limit(0)).count() == 0


def test_quality(docs, labels):
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == len(DOCS)
    assert {r.doc_id: r.n_words for r in rows if r.doc_id in (2, 4, 5)} == {2: 0, 4: 0, 5: 120_000}
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.filtered(docs, labels.limit(0)).columns == docs.columns


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(DOCS)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    sources = {r.source_size: r.target for r in rows}
    assert sum(sources.values()) == pytest.approx(sum(sources))
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(docs.limit(0)).count() == 0
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns
    assert taken.count() == sum(r.copies for r in rows)


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", "[/ANS] \\. [ANS*] <s>"),
            (None, 3, "tool ]", "[[INST] \\"), (2, 1, "assistant", "a" * 2_000_000), (1, 0, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "piece", F.lit("mine"))
    found = {r.conv_id: r for r in chat.round_trip(turns).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 4, None: 1, 2: 1}
    assert found[1].loss_chars == 20 and found[2].loss_chars == 2_000_000
    assert chat.round_trip(turns.limit(0)).count() == 0


def test_join(docs):
    rows = ngram_join.near_duplicates(docs).collect()
    told = sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str)
    assert told == sorted([
        (1, 1, 1), (1, 1, 1), (2, 2, 0), (None, None, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1),
        (None, None, 0), (7, 7, 0)], key=str)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["1", "2", "3", "4", "5", "7", "None", "None"]


def test_licenses(docs):
    assert all(r.licenses == [] for r in licenses.findings(docs).collect())
    assert licenses.findings(docs.limit(0)).count() == 0
    long = docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" Released under the MIT License.")))
    row = licenses.findings(long).first()
    assert row.licenses == ["MIT"] and row.spans[0].start == len(LONG) + 1


def test_secrets(docs):
    rows = secret_scan.findings(docs).collect()
    assert len(rows) == len(DOCS) and all(r.spans == [] for r in rows)
    assert secret_scan.findings(docs.limit(0)).count() == 0
    risky = docs.where("doc_id = 7").withColumn("text", F.lit('𝒳 token = "abcdef123" 𝒳'))
    clean = secret_scan.redacted(risky)
    assert clean.columns == docs.columns
    row = clean.first()
    assert row.text == '𝒳 [secret]" 𝒳' and row.n_chars == len(row.text)


def test_stages_take_an_empty_table_and_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty):
            found = stage(spark, given, str(tmp_path))
            found.count()
            if name != "packing":
                assert found.columns == docs.columns and found.schema == docs.schema
