import hashlib
import re

import pytest
from docs import ODD, SHAPE, clashing, corpus, frame
from test_bpe import want
from test_neardup import brute as near_brute
from test_substring import brute as sub_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BY = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: tuple(map(str, r)))


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "source_mix", "byte_bpe"]


@pytest.mark.parametrize("stage", list(BY))
def test_every_stage_takes_odd_clashing_and_empty_tables(spark, sf_dir, stage):
    for df in (frame(spark, ODD), clashing(frame(spark, corpus() + ODD)), spark.createDataFrame([], SHAPE)):
        out = BY[stage](spark, df, sf_dir)
        if stage != "byte_bpe":
            assert out.columns == COLUMNS
        out.collect()


def test_language_stage_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in BY["language_id"](spark, docs, sf_dir).collect()}
    clean = {r.doc_id for r in docs.where("lang is not null and n_chars >= 100").collect()}
    assert len(clean - kept) <= 0.02 * len(clean)


def test_near_stage_keeps_one_of_each_group(spark, sf_dir):
    rows = corpus() + ODD
    got = rows_of(BY["near_duplicates"](spark, frame(spark, rows), sf_dir))
    kept = {r[0] for r in near_brute(rows, 5) if r[3]}
    assert got == rows_of(frame(spark, [r for r in rows if r[0] in kept]))


def test_substring_stage_equals_brute_force(spark, sf_dir):
    rows = corpus() + ODD
    want_rows = []
    for old, (d, _, gone, _, kept) in zip(rows, sub_brute(rows), strict=True):
        if not gone:
            want_rows.append(old)
        elif kept:
            want_rows.append((d, kept, old[2], old[3], len(kept)))
    assert rows_of(BY["substring_dedup"](spark, frame(spark, rows), sf_dir)) == rows_of(frame(spark, want_rows))


def test_mix_stage_repeats_whole_documents(spark, sf_dir):
    rows = corpus()
    out = rows_of(BY["source_mix"](spark, frame(spark, rows), sf_dir))
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert set(out) <= set(rows_of(frame(spark, rows)))
    assert all(out.count(r) <= 2 for r in set(out))
    assert abs(sum(words(r[1]) for r in out) / (1.5 * sum(words(r[1]) for r in rows)) - 1) < 0.1


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert 0 < len({r.doc_id for r in out}) <= len(text)
    for r in out:  # documents that lost no passage are encoded as they came
        if r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest():
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(text[r.doc_id])
    assert sum(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out) >= 0.5 * len(out)
