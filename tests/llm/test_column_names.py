"""Columns that carry the names of added columns or of those that operators use inside."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayline.llm import bpe, html, jaccard, mixing, quality_classifier, quality_rules, secrets, token_counts, urls
from assayline.llm.columns import given_back, number_of, numbered
from assayline.session import fresh_path

INSIDE = ["__host", "__path", "h", "s", "shape", "given", "__source", "__rows", "__kept", "__least", "__given", "__assign", "__secrets", "__clean", "__text", "__score", "__lang", "__l", "c0", "c1", "e0", "digest", "id", "class", "n", "use", "clean"]
TEXTS = ["one two three four five six", "one two three four five six", "api_key = abcdef12345 and more words", None, "", "seven eight"]


def table(spark, added):
    """Six documents with a column of every name that operators use, each holding its own name."""
    rows = [(i, t, "en", "a" if i % 2 else None, 7) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return frame.withColumns({n: F.lit(n) for n in [*INSIDE, *added]})


def checked(frame, found, added, gone=()):
    """Every column of the table is there as it was, but for those that others replace; returns the rows by id."""
    kept = [c for c in frame.columns if c not in added and c not in gone]
    assert found.columns == [*kept, *added]
    rows = {r["doc_id"]: r.asDict() for r in found.collect()}
    assert all(r[c] == c for r in rows.values() for c in INSIDE)
    assert not any(r[a] == a for r in rows.values() for a in added)
    assert found.limit(0).columns == found.columns
    return rows


def test_names_are_numbered_and_given_back(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "C1 int, Kept int, c0 int")
    inner = numbered(frame, F.col("Kept") + 1)
    assert inner.columns == ["c0", "c1", "c2", "e0"] and number_of(frame, "Kept") == "c1"
    back = given_back(inner, frame.columns, {"KEPT": "e0"}, ["c0"])
    assert back.columns == ["C1", "KEPT"] and back.first() == (1, 3)


def test_operators_that_add_columns(spark, tmp_path):
    encoder = bpe.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
    frame = table(spark, ["ids", "decoded"])
    encoded = bpe.encode(frame, encoder)
    assert checked(frame, encoded, ["ids"])[3]["ids"] == b""
    assert checked(encoded, bpe.decode(encoded, encoder), ["decoded"])[0]["decoded"] == TEXTS[0]
    words = bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))
    frame = table(spark, ["n_tokens", "counted"])
    rows = checked(frame, token_counts.count_tokens(frame, words, fresh_path(spark, "counts")), ["n_tokens"])
    assert rows[0]["n_tokens"] == 6 and rows[0]["counted"] == "counted" and rows[3]["n_tokens"] == 0
    frame = table(spark, ["secrets"])
    assert checked(frame, secrets.scan(frame), ["secrets"])[2]["secrets"][0]["kind"] == "assign"
    frame = table(spark, ["copies"])
    mixed = mixing.mix(frame, mixing.Target(repetition=2.0))
    assert {r["copies"] for r in checked(frame, mixed, ["copies"]).values()} <= {1, 2}
    assert mixing.repeat(mixed).columns == [c for c in frame.columns if c != "copies"]
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", "kept"]
    frame = table(spark, added)
    assert checked(frame, quality_rules.judge(frame), added, ["text"])[0]["n_words"] == 6


def test_operators_that_keep_or_replace_columns(spark):
    frame = table(spark, [])
    kept = jaccard.keep_one(frame)
    assert sorted(checked(frame, kept, [])) == [0, 2, 3, 4, 5]
    clean = checked(frame, secrets.redact_documents(frame), [])
    assert "[SECRET]" in clean[2]["text"] and clean[2]["n_chars"] == len(clean[2]["text"]) and clean[3]["text"] is None
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert set(checked(frame, quality_classifier.filter_documents(frame, labels, limit=0.0), [])) == set(range(6))


def test_pages(spark):
    added = ["host", "path", "rule", "verdict", "template", "purity"]
    rows = [(i, f"http://a.example.org/x{i}/y", "<p>some words of a page that say a little</p>") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, url string, html string").withColumns({n: F.lit(n) for n in [*INSIDE, *added, "text"]})
    assert checked(frame, urls.classify(frame), added)[0]["host"] == "a.example.org"
    assert all(r["text"] != "text" for r in checked(frame, html.extract(frame), ["text"], ["html"]).values())


@pytest.mark.parametrize("run", [
    lambda s, f: mixing.mix(f, mixing.Target()), lambda s, f: secrets.scan(f), lambda s, f: secrets.redact_documents(f), lambda s, f: jaccard.keep_one(f),
    lambda s, f: quality_rules.judge(f), lambda s, f: urls.classify(f.withColumn("url", F.lit("x"))), lambda s, f: html.extract(f.withColumn("html", F.lit("x"))),
    lambda s, f: token_counts.count_tokens(f, bpe.read_definition(public_tokenizers.path("word_bpe_49k.json")), fresh_path(s, "counts")),
    lambda s, f: bpe.encode(f, bpe.read_definition(public_tokenizers.path("byte_bpe_50k.json"))),
    lambda s, f: quality_classifier.filter_documents(f, s.createDataFrame([], "doc_id long, quality int, toxic int")),
])
def test_empty_tables(spark, run):
    assert run(spark, table(spark, []).limit(0)).collect() == []
