"""Files of token planes: exact round trips, and documents against the tokenizers library itself."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayline.llm import bpe, id_files
from assayline.llm.tokenizer import WordEncoder
from assayline.session import fresh_path

WORD = bpe.read_definition(public_tokenizers.path("word_bpe_49k.json"))
PIECES = [
    "a", "Ab", "the", "École", "straße", " ", "  ", "\n", "'", "'re", "'S", "don't", "<|endoftext|>", "<|endof", "text|>", "<", "̸", "1", "12", "!", ",", ".",
    "...", "#$", "_", "²", "é", "日本", "́", "\t", "\x1c", "\xa0", "😀", "​", "ß", "İ", "Σ", "ς", "ſ", "ﬁ", "x" * 70,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def made(rng, most):
    chosen = rng.sample(PIECES, rng.randint(1, 7))
    return "".join(rng.choice(chosen) for _ in range(rng.randint(0, most)))


def test_encoder_equals_the_library(library):
    rng, encoder = random.Random(5), WordEncoder(WORD)
    texts = [made(rng, 25) for _ in range(3000)] + ["one, two. Three; four", "", " ", "(a-b) \"c\": d!"]
    for some in (texts[:1], texts, texts[::-1]):
        found = encoder.encode_many(some)
        expected = library.encode_batch(some, add_special_tokens=False)
        assert [np.frombuffer(f, encoder.dtype).tolist() for f in found] == [e.ids for e in expected]


def test_encoder_forgets_and_learns_again(library, monkeypatch):
    monkeypatch.setattr("assayline.llm.tokenizer.GENERATION", 20)
    rng, encoder = random.Random(6), WordEncoder(WORD)
    for _ in range(30):
        texts = [made(rng, 12) for _ in range(10)]
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(f, encoder.dtype).tolist() for f in encoder.encode_many(texts)] == expected
        assert not any(len(u) > 64 for u in encoder.memo) and len(encoder.memo.older) < 400


@pytest.mark.parametrize("kind", id_files.KINDS)
@pytest.mark.parametrize("dtype", ["<u1", "<u2", "<u4", "<u8"])
def test_planes_round_trip(kind, dtype):
    rng = np.random.default_rng(4)
    top = np.iinfo(dtype).max
    for n in (1, 7, 8, 1000):
        for most in (0, 1, top):
            values = rng.integers(0, most, n, dtype=np.dtype(dtype).newbyteorder("="), endpoint=True).astype(dtype)
            planes = id_files.to_planes(values, kind)
            assert len(planes) == np.dtype(dtype).itemsize * (1 if kind == "byte" else 8)
            assert most or not any(planes)
            assert (id_files.from_planes(planes, n, dtype, kind) == values).all()


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("kind", id_files.KINDS)
@pytest.mark.parametrize("width", [2, 4])
def test_file_of_documents_and_stretches(kind, width):
    rng = np.random.default_rng(width)
    documents = [(None if i < 2 else i - 30, rng.integers(0, 2 ** (8 * width) - 1, int(rng.choice([0, 1, 5, 40, 1000])), dtype=f"u{width}")) for i in range(60)]
    file = Memory()
    writer = id_files.FileWriter(file, width, kind, block_ids=64)
    for name, ids in documents:
        writer.add(name, ids)
    writer.close()
    reader = id_files.FileReader(file)
    places = np.cumsum([0] + [len(i) for _, i in documents]).tolist()
    found = list(reader.documents())
    assert [(n, p, i.tolist()) for n, p, i in found] == [(n, p, i.tolist()) for (n, i), p in zip(documents, places, strict=False)]
    whole = np.concatenate([i for _, i in documents])
    for _ in range(30):
        start = int(rng.integers(0, len(whole)))
        count = int(rng.integers(0, min(300, len(whole) - start) + 1))
        fresh = id_files.FileReader(file)
        assert fresh.ids(start, count).tolist() == whole[start : start + count].tolist()
        # The index leads to the blocks of the stretch and to no others.
        assert fresh.blocks_read == (len(range(start // 64, -(-(start + count) // 64))) if count else 0)
    with pytest.raises(ValueError):
        id_files.FileReader(Memory(file.getvalue()[:-3]))


def expected_rows(library, rows):
    out, start = [], 0
    def order(row):
        return (row[0] is not None, row[0] or 0)

    for name, ids in sorted(((n, library.encode(t or "", add_special_tokens=False).ids + [2]) for n, t in rows), key=order):
        out.append((name, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("planes", "file_bytes"), [("byte", 2_000), ("bit", 1 << 30)])
def test_documents_through_files(spark, library, planes, file_bytes):
    rng = random.Random(planes)
    rows = [(i * 3 - 40, made(rng, 40)) for i in range(300)] + [(10_000, None), (10_001, ""), (10_002, "One more word, " * 20_000), (None, "no id")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, ids string").repartition(4)
    path = fresh_path(spark, "ids")
    id_files.write_documents(frame, WORD, path, 2, planes=planes, block_ids=1000, file_bytes=file_bytes)
    found = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in id_files.read_documents(spark, path).collect()]
    expected = expected_rows(library, rows)
    assert sorted(found, key=lambda r: r[1]) == expected
    listed = id_files.manifest(path)
    assert (len(listed["files"]) > 10) == (planes == "byte")
    assert listed["ids"] == sum(r[2] for r in expected) and sum(f["docs"] for f in listed["files"]) == len(rows)
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in id_files.read_documents(spark, path).orderBy("start").collect()])
    for start, count in ((0, 5), (37, 4_000), (len(whole) - 2_500, 2_500), (8, 0)):
        assert id_files.ids_at(path, start, count).tolist() == whole[start : start + count].tolist()
    with pytest.raises(ValueError):
        id_files.ids_at(path, len(whole) - 1, 2)
    with pytest.raises(Exception, match="holds ids already"):
        id_files.write_documents(frame, WORD, path, 2)


def test_repeated_ids_and_no_rows(spark, library):
    frame = spark.createDataFrame([(4, "b c"), (4, "a"), (4, "a"), (2, "z")], "doc_id long, text string").repartition(3)
    path = fresh_path(spark, "ids")
    id_files.write_documents(frame, WORD, path, 2, file_bytes=2)
    found = sorted((r["start"], r["doc_id"], len(r["ids"]) // 4) for r in id_files.read_documents(spark, path).collect())
    assert [(d, n) for _, d, n in found] == [(2, 2), (4, 2), (4, 2), (4, 3)] and [s for s, _, _ in found] == [0, 2, 4, 6]
    path = fresh_path(spark, "ids")
    id_files.write_documents(frame.limit(0), WORD, path, 2)
    assert id_files.read_documents(spark, path).collect() == [] and id_files.manifest(path) == {"ids": 0, "files": []}
