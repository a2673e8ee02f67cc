"""Registered queries of the training-data operators, and the oracle's SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from duskwatch.llm import (
    alignment, chat, extract, licenses, maxscore, mixing, ngram_join, packing, quality, repeats,
    secret_scan, whitening, zip_archive)
from duskwatch.plans.adapters import table
from duskwatch.plans.registry import query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_extraction")
def op1_extraction(spark, sf_dir):
    return extract.main_text(table(spark, sf_dir, "pages"))


OP2 = """
with coded as (
    select vec_id, [floor(256 * x::double)::bigint for x in embedding] as c
    from embeddings
    where vec_id is not null and embedding is not null
      and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select q.vec_id as query_id, v.vec_id,
           list_sum([p[1] * p[2] for p in list_zip(q.c, v.c)])::bigint as score
    from coded q join coded v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
), ranked as (
    select query_id, row_number() over (partition by query_id order by score desc, vec_id) as n,
           vec_id, score
    from scored
)
select query_id, n::int as rank, vec_id, score from ranked where n <= 5
"""


@query("op2_maxscore", OP2)
def op2_maxscore(spark, sf_dir):
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op3_packing")
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op4_zip_archive")
def op4_zip_archive(spark, sf_dir):
    return zip_archive.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


@query("op6_mixing")
def op6_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op7_chat")
def op7_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.round_trip(turns.unionByName(added))


OP8 = r"""
with recursive words as (
    select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), grams as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from grams group by doc_id
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as shared
    from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
    select p.a, p.b from pairs p join sizes x on p.a = x.doc_id join sizes y on p.b = y.doc_id
    where 9 * p.shared >= 4 * (x.n + y.n)
), reach(a, b) as (
    select doc_id, doc_id from documents
    union
    select r.a, l.b from reach r join links l on r.b = l.a
)
select d.doc_id, (select min(r.b) from reach r where r.a = d.doc_id) as class_id,
       (select count(*) from links l where l.a = d.doc_id) as n_links
from documents d
"""


@query("op8_ngram_join", OP8)
def op8_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_licenses", licenses.oracle_sql())
def op9_licenses(spark, sf_dir):
    found = licenses.findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"),
                        F.size("licenses").cast("long").alias("n_licenses"))


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.findings(table(spark, sf_dir, "documents")))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), TOKENIZER, PIECES)


OP12 = r"""
with words as (
    select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
    from documents
), windows as (
    select r, i, array_to_string(w[i : i + 34], ' ') as g
    from (select r, w, unnest(range(1, len(w) - 33)) as i from words where len(w) >= 35)
), repeated as (
    select r, i from (select r, i, count(*) over (partition by g) as c from windows) where c > 1
), each as (
    select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from words
), judged as (
    select e.r, e.i, e.word, coalesce(max(p.i) over (partition by e.r order by e.i) > e.i - 35, false) as gone
    from each e left join repeated p on e.r = p.r and e.i = p.i
), kept as (
    select r, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by i) filter (not gone) as text
    from judged group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from words left join kept k using (r)
"""


@query("op12_repeats", OP12)
def op12_repeats(spark, sf_dir):
    return repeats.removed(table(spark, sf_dir, "documents"),
                           columns=("doc_id", "n_words", "n_removed", "kept_sha256"))


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
