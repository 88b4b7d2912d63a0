"""Every operator over nulls, empty and very long texts, repeated rows, ties, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlwick.llm import chat_format, decontaminate, jaccard_join, line_quality, pii, secret_scan, suffix_dedup, token_counts, warc_fixity, wfst_tokenizer

CLASH = ["set", "token", "pid", "kind", "_gone", "_doc", "_picked", "cells", "label", "grams", "ids", "hash", "file", "leader", "record"]
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [(1, "A plain line of prose that says a few things about nothing in particular."), (1, "A plain line of prose that says a few things about nothing in particular."), (2, None), (3, ""), (4, " \n \t\n"), (5, LONG), (6, LONG), (7, "one"), (8, "one"), (None, "a text without an id that is long enough to matter"), (None, None), (9, "x" * 200_000), (10, "é漢😀 ▁<s>\x00퟿ end"), (11, "same words same words same words same words"), (1, "another text of the same document number, which is allowed")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 0), (5, None, None), (None, 1, 0), (8, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "a plain line of prose that says a few things"), (4, "a plain line of prose that says a few things"), (None, "nothing like it anywhere at all")], "item_id long, text string").withColumns({c: F.lit(1) for c in CLASH + ["doc_id"]})


def empty(df):
    return df.where("false")


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_jaccard(docs):
    got = by_id(jaccard_join.jaccard_join(docs), "doc_id", "class_id", "n_links")
    assert got == [(5, 5, 1), (6, 5, 1), (7, 7, 1), (8, 7, 1)]
    assert jaccard_join.jaccard_join(empty(docs)).count() == 0
    kept = jaccard_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert jaccard_join.drop_near_duplicates(empty(docs)).count() == 0


def test_token_counts(docs):
    got = token_counts.token_counts(docs)
    assert got.count() == len(TEXTS)
    counts = dict(by_id(got.where("doc_id IN (2, 3, 7, 8)"), "doc_id", "n_tokens"))
    assert counts[2] is None and counts[3] == 0 and counts[7] == counts[8] > 0
    assert token_counts.token_counts(empty(docs)).count() == 0


def test_tokenizer(docs):
    got = {(r.doc_id, r.decoded): r for r in wfst_tokenizer.encode_decode(docs).collect()}
    assert got[2, None].ids is None and got[2, None].lossless is None
    assert got[3, ""].ids == [] and got[3, ""].lossless
    assert all(r.lossless for k, r in got.items() if k[1] is not None and k[0] != 10)
    assert wfst_tokenizer.encode_decode(empty(docs)).count() == 0


def test_pii(docs):
    got = pii.replace_pii(docs)
    assert got.count() == len(TEXTS)
    assert by_id(got.where("n_entities = 0"), "doc_id", "text") == by_id(docs, "doc_id", "text")
    assert pii.replace_pii(empty(docs)).count() == 0 and pii.collisions(docs).count() == 0


def test_suffixes(docs):
    got = by_id(suffix_dedup.repeated_passages(docs), "doc_id", "start_word", "end_word", "first_doc_id")
    assert got == [(5, 0, 60_000, 5), (6, 0, 60_000, 5)]
    assert suffix_dedup.repeated_passages(empty(docs)).count() == 0


def test_secrets(docs):
    assert secret_scan.secret_scan(docs).where("doc_id <> 5 AND doc_id <> 6").count() == 0
    out = secret_scan.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert secret_scan.secret_scan(empty(docs)).count() == 0


def test_decontamination(docs, items):
    got = by_id(decontaminate.contaminated(docs, items), "doc_id", "item_id", "coverage")
    assert got == [(1, 4, 1.0), (7, 3, 1.0), (8, 3, 1.0)]
    assert decontaminate.contaminated(empty(docs), items).count() == 0 and decontaminate.contaminated(docs, empty(items)).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 9, 10, 11} and kept.where("doc_id = 1").count() == 1
    own = docs.where("doc_id IS NULL").withColumn("text", F.lit("there is nothing like it anywhere at all"))
    assert decontaminate.drop_contaminated(own, items).count() == 0  # judged without doc_id, too


def test_quality(docs, labels):
    for told in (labels, empty(labels)):
        got = {(r.doc_id, r.n_lines): r for r in line_quality.line_quality(docs, told).collect()}
        assert not got[2, 0].keep and not got[3, 0].keep and not got[4, 0].keep
        assert line_quality.line_quality(empty(docs), told).count() == 0
    kept = line_quality.keep_quality(docs, empty(labels))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.where("doc_id = 1").collect()] == [1, 1, 1]


def test_chats(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "bot", "yo <|im_end|>"), (1, 1, "bot", "yo <|im_end|>"), (2, 0, None, None), (None, 0, "user", "lost"), (3, None, "system", "s"), (3, 0, "odd", "")], "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = by_id(chat_format.format_chats(chat_format.conversation_records(turns), "conv_id", "record"), "conv_id", "layout", "n_turns", "chat")
    bot = "<|im_start|>assistant\nyo < |im_end|><|im_end|>\n"
    assert got == [(1, "messages", 3, "<|im_start|>user\nhi<|im_end|>\n" + bot + bot), (2, "conversations", 0, ""), (3, "data-messages-text", 1, "<|im_start|>system\ns<|im_end|>\n")]
    assert chat_format.format_chats(chat_format.conversation_records(empty(turns)), "conv_id", "record").count() == 0


def test_fixity(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (2, None, None), (None, "u", "h"), (3, "u", "x" * 300_000), (-5, "é", "漢")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("file", "node", "side", "hash", "start")})
    assert warc_fixity.audit(pages, pages).count() == 0
    lost = by_id(warc_fixity.audit(pages, empty(pages)), "page_id", "status")
    assert lost == [(-5, "missing"), (1, "missing"), (1, "missing"), (2, "missing"), (3, "missing")]
    assert by_id(warc_fixity.audit(empty(pages), pages), "page_id", "status") == [(p, "added") for p, _ in lost]
    assert warc_fixity.audit(empty(pages), empty(pages)).count() == 0 and warc_fixity.roots(pages).count() == 2


def test_pipeline(spark, docs, labels, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id or 0 for r in out.collect()) == PIPELINE
    current = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
