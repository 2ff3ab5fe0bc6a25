"""BPE encoding and token counts against the tokenizers library itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayline.llm import bpe, token_counts
from assayline.llm.bpe import Node, concatenate, join_leaves, join_tokens, tree
from assayline.llm.tokenizer import ByteLevel, WordCounter
from assayline.session import fresh_path

BYTE = bpe.read_definition(public_tokenizers.path("byte_bpe_50k.json"))
WORD = bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))
PIECES = ["a", "aaaa", "ab", "the", " ", "  ", "\n", "'", "'re", "<|endoftext|>", "<|endof", "text|>", "1", "12", "!", "é", "日本", "́", "\t", "\x1c", "😀", "​"]


@pytest.fixture(scope="module")
def codec():
    return ByteLevel(BYTE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def made(rng, most):
    chosen = rng.sample(PIECES, rng.randint(1, 6))
    return "".join(rng.choice(chosen) for _ in range(rng.randint(0, most)))


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_units_encode_as_the_library_does(codec, library):
    rng = random.Random(1)
    for _ in range(1500):
        text = made(rng, 60)
        expected = library.encode(text, add_special_tokens=False).ids
        data = codec.encode_many([text])[0]
        assert ids_of(data) == expected
        assert codec.decode(data) == library.decode(expected, skip_special_tokens=False)


def test_tree_equals_the_whole_wherever_it_is_cut(codec, library):
    rng = random.Random(2)
    for _ in range(1500):
        text = made(rng, 80)
        if len(text) < 2:
            continue
        places = sorted(rng.sample(range(1, len(text)), min(rng.randint(1, 7), len(text) - 1)))
        parts = [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]
        node = tree([Node.of(p, codec) for p in parts], codec)
        assert [t for w in node.ids for t in w] == library.encode(text, add_special_tokens=False).ids
        assert node.text == text


def test_halves_of_one_word_without_any_split(codec, library):
    rng = random.Random(3)
    for letters in ("a", "ab", "etaoinsr", "日本語"):
        text = "".join(rng.choice(letters) for _ in range(3000))
        joined = concatenate(Node.of(text[:1501], codec), Node.of(text[1501:], codec), codec)
        assert joined.ids[0] == library.encode(text, add_special_tokens=False).ids
    left, right = codec.word("x", "aaaaaaa"), codec.word("x", "aaaaaaaaaaaa")
    assert join_tokens(left, right, codec) == codec.word("x", "a" * 19)


def test_cuts_cover_the_text(codec):
    text = "word " * 40 + "x" * 400 + " tail" * 30
    cuts = codec.cuts(text, 50)
    assert [c for c, _ in cuts] == sorted({c for c, _ in cuts})
    assert any(certain for _, certain in cuts) and any(not certain for _, certain in cuts)
    assert join_leaves([], codec) == b""


def test_tables_keep_rows_columns_and_long_texts(spark, library):
    rng = random.Random(4)
    long = "".join(rng.choice("abc'12!é") for _ in range(700)) + " plain words " * 40 + " " * 300 + "<|endoftext|>" * 20
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello  world\n", None), (4, long, "c"), (4, long, "c"), (None, long + "x", "d"), (5, "x" * 999, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    encoded = bpe.encode(frame, BYTE, leaf_chars=64)
    back = bpe.decode(encoded, BYTE).collect()
    assert encoded.columns == ["doc_id", "text", "digest", "ids"]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in back) == sorted((a or 0, t or "") for a, t, _ in rows)
    for r in back:
        expected = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids_of(r["ids"]) == expected
        assert r["decoded"] == (r["text"] or "")
    assert bpe.encode(frame.limit(0), BYTE).collect() == []


def test_definitions_that_are_not_covered_are_refused():
    with pytest.raises(ValueError):
        ByteLevel(WORD)
    with pytest.raises(ValueError):
        WordCounter(BYTE)


def test_counts_use_and_fill_the_cache(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = [None, "", "  \n ", "Hello  WORLD", "hello world", " hello world\t", "<|startoftext|> x<|endoftext|>y", *[made(rng, 50) for _ in range(200)]]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens_ int")
    cache = fresh_path(spark, "cache")
    counted = token_counts.count_tokens(frame, WORD, cache)
    assert counted.columns == ["doc_id", "text", "n_tokens_", "n_tokens"]
    for r in counted.collect():
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids), repr(r["text"])
    stored = spark.read.parquet(cache)
    before = stored.count()
    assert before == stored.select("digest").distinct().count() < len(texts)
    more = frame.union(spark.createDataFrame([(999, "something quite new", 1), (1000, "hello world", 1)], frame.schema))
    assert token_counts.count_tokens(more, WORD, cache).where("doc_id >= 999").count() == 2
    assert spark.read.parquet(cache).count() == before + 1
    # Counts of another tokenizer version are not used.
    assert token_counts.stored_counts(frame, cache, "other").count() == 0
    assert token_counts.count_tokens(frame.limit(0), WORD, fresh_path(spark, "cache")).collect() == []
