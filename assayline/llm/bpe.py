"""BPE encoding and decoding.

Texts of moderate length are encoded where they lie. A longer text is cut into leaves that
are encoded in parallel; the encodings are then put together pairwise, as in a tree. Where a
cut certainly starts a split, the two sides agree as they are. Everywhere else a window
around the join is encoded anew, and grown, until both sides agree with it exactly: first on
where splits start, then, inside a split that spans the join, on the tokens next to it.

Defined results: NULL text is an empty text; an empty text has no ids; equal rows give equal
results, once per row; an empty table gives an empty one. Extra columns pass through, whatever their names; an
 added column takes the place of one of its name.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.llm.columns import given_back, numbered
from assayline.llm.tokenizer import ByteLevel, decoded
from assayline.llm.workers import held

# Characters above which a text is cut. Bounds the work and memory of one encoding step.
LEAF_CHARS = 32_768
# Texts of one batch that are held as Python objects at a time.
CHUNK = 256


def read_definition(path: str) -> str:
    """A tokenizer file; it is small (a vocabulary) and goes to the tasks by value."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _codec(shared) -> ByteLevel:
    return held(("bytes", shared.id), lambda: ByteLevel(shared.value))


class _Shared:
    """A broadcast definition with a key for the worker's cache."""

    def __init__(self, df: DataFrame, definition: str):
        ByteLevel(definition)
        self.value_of = df.sparkSession.sparkContext.broadcast(definition)
        self.id = hash(definition)

    @property
    def value(self) -> str:
        return self.value_of.value


def encode(df: DataFrame, definition: str, text: str = "text", ids: str = "ids", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Add column ``ids``: token ids as packed little-endian unsigned 32-bit integers (binary).

    ``definition`` is the JSON of a byte-level BPE tokenizer. Added tokens found in a text are
    encoded as such and none is put around it, which is what the tokenizers library does with
    ``add_special_tokens=False``.
    """
    shared = _Shared(df, definition)
    source = numbered(df)
    own = f"c{df.columns.index(text)}"
    whole = F.coalesce(F.col(own), F.lit(""))
    short = source.where(F.length(whole) <= leaf_chars)
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.BinaryType())])
    position = source.columns.index(own)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                texts = [t or "" for t in part.column(position).to_pylist()]
                found = pa.array(codec.encode_many(texts), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=schema.fieldNames())

    long = source.where(F.length(whole) > leaf_chars).withColumn("digest", F.unhex(F.sha2(own, 256)))
    joined = _encode_long(long.select("digest", F.col(own).alias("text")), shared, leaf_chars)
    rest = long.join(joined, "digest").select(*source.columns, "ids")
    return given_back(short.mapInArrow(direct, schema).unionByName(rest), df.columns, {ids: "ids"})


def _encode_long(texts: DataFrame, shared: _Shared, leaf: int) -> DataFrame:
    """(digest, ids) of each distinct long text."""
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    leaves = distinct.mapInArrow(
        lambda batches: _cut(batches, _codec(shared), leaf), "digest binary, seq int, certain boolean, tied boolean, text string"
    )
    encoded = leaves.repartition(_partitions(texts), "digest", "seq").mapInArrow(
        lambda batches: _leaves(batches, _codec(shared)),
        "digest binary, seq int, certain boolean, text string, starts binary, sizes binary, ids binary",
    )

    def together(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
        return pa.table({"digest": [key[0].as_py()], "ids": [join_leaves(rows, _codec(shared))]}, schema=pa.schema([("digest", pa.binary()), ("ids", pa.binary())]))

    return encoded.groupBy("digest").applyInArrow(together, "digest binary, ids binary")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cut(batches: Iterator[pa.RecordBatch], codec: ByteLevel, leaf: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cuts = codec.cuts(text, leaf)
            places = [0, *[c for c, _ in cuts], len(text)]
            certain = [True, *[c for _, c in cuts], True]
            n = len(places) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(certain[:-1]),
                    pa.array([not (certain[i] and certain[i + 1]) for i in range(n)]),
                    pa.array([text[places[i] : places[i + 1]] for i in range(n)]),
                ],
                names=["digest", "seq", "certain", "tied", "text"],
            )


class Node:
    """Exact encoding of a stretch of text, split by split."""

    def __init__(self, text: str, starts: list[int], ids: list[list[int]]):
        self.text, self.starts, self.ids = text, starts, ids

    @classmethod
    def of(cls, text: str, codec: ByteLevel) -> Node:
        spans = codec.spans(text)
        return cls(text, [s for s, _, _ in spans], [codec.word(text[s:e], form) for s, e, form in spans])


def _leaves(batches: Iterator[pa.RecordBatch], codec: ByteLevel) -> Iterator[pa.RecordBatch]:
    """Encode leaves; those at an uncertain cut keep their text and the place of each split."""
    for batch in batches:
        digests, seqs, certain, tied, texts = (c.to_pylist() for c in batch.columns)
        for i in range(0, len(texts), 8):
            rows = range(i, min(i + 8, len(texts)))
            plain = iter(codec.encode_many([texts[r] for r in rows if not tied[r]]))
            out = []
            for r in rows:
                if not tied[r]:
                    out.append((digests[r], seqs[r], certain[r], "", b"", b"", next(plain)))
                    continue
                node = Node.of(texts[r], codec)
                out.append((
                    digests[r], seqs[r], certain[r], texts[r], np.array(node.starts, "<u4").tobytes(),
                    np.array([len(w) for w in node.ids], "<u4").tobytes(), np.array([t for w in node.ids for t in w], "<u4").tobytes(),
                ))
            kinds = [pa.binary(), pa.int32(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            names = ["digest", "seq", "certain", "text", "starts", "sizes", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def join_leaves(rows: list[dict], codec: ByteLevel) -> bytes:
    """Ids of a text from its leaves in order."""
    parts: list[bytes] = []
    run: list[Node] = []

    def close() -> None:
        if run:
            parts.append(np.array([t for w in tree(run, codec).ids for t in w], "<u4").tobytes())
            run.clear()

    for row in rows:
        if row["certain"]:
            close()
        if row["text"]:
            ids = np.frombuffer(row["ids"], "<u4").tolist()
            ends = np.cumsum(np.frombuffer(row["sizes"], "<u4"), dtype=np.int64).tolist()
            words = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            run.append(Node(row["text"], np.frombuffer(row["starts"], "<u4").tolist(), words))
        else:
            parts.append(row["ids"])
    close()
    return b"".join(parts)


def tree(nodes: list[Node], codec: ByteLevel) -> Node:
    """Put neighbouring nodes together, level by level."""
    level = list(nodes)
    while len(level) > 1:
        paired = [concatenate(a, b, codec) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def concatenate(left: Node, right: Node, codec: ByteLevel, window: int = 64) -> Node:
    """Exact encoding of two neighbouring stretches.

    The window starts at a split of the left side that no following text can move, and grows
    to the right until one of its own certain splits is one of the right side's as well.
    From there on both scans read the same text from the same place.
    """
    join = len(left.text)
    first = max(0, bisect_right(left.starts, join - codec.margin) - 1)
    begin = left.starts[first]
    known = set(right.starts)
    while True:
        taken = min(window, len(right.text))
        complete = taken == len(right.text)
        text = left.text[begin:] + right.text[:taken]
        spans = codec.spans(text)
        limit = len(text) if complete else len(text) - codec.margin
        meets = next((s for s, _, _ in spans if s > join - begin and s <= limit and s - (join - begin) in known), None)
        if meets is not None or complete:
            break
        window *= 2
    end = len(text) if meets is None else meets
    starts, ids = left.starts[:first], left.ids[:first]
    for s, e, form in spans:
        if s >= end:
            break
        at, to = begin + s, begin + e
        starts.append(at)
        ids.append(_word(left, right, at, to, text[s:e], form, codec))
    if meets is not None:
        rest = bisect_left(right.starts, meets - (join - begin))
        starts += [join + s for s in right.starts[rest:]]
        ids += right.ids[rest:]
    return Node(left.text + right.text, starts, ids)


def _word(left: Node, right: Node, at: int, to: int, text: str, form: str | None, codec: ByteLevel) -> list[int]:
    """Ids of one split near the join, from either side's ids where it has them."""
    join = len(left.text)
    i = bisect_left(left.starts, at)
    mine = i < len(left.starts) and left.starts[i] == at
    stop = (left.starts[i + 1] if i + 1 < len(left.starts) else join) if mine else -1
    if mine and stop == to:
        return left.ids[i]
    first_end = right.starts[1] if len(right.starts) > 1 else len(right.text)
    if form is not None and mine and stop == join and to - join == first_end and not codec.added.keys() & {left.text[at:], right.text[:first_end]}:
        return join_tokens(left.ids[i], right.ids[0], codec)
    return codec.word(text, form)


def join_tokens(left: list[int], right: list[int], codec: ByteLevel, width: int = 4) -> list[int]:
    """Ids of one split from the exact ids of its two parts.

    A sequence of tokens is the encoding of its text exactly if each neighbouring pair is;
    so it is enough that the window's outer tokens are the ones they replace.
    """
    while True:
        a, b = left[-width:], right[:width]
        form = "".join(codec.symbols[t] for t in a + b)
        middle = [t.id for t in codec.tokenizer.model.tokenize(form)]
        agrees_left = len(a) == len(left) or middle[:2] == a[:2]
        agrees_right = len(b) == len(right) or middle[-2:] == b[-2:]
        if agrees_left and agrees_right:
            return left[: len(left) - len(a)] + middle + right[len(b) :]
        width *= 2


def decode(df: DataFrame, definition: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add column ``text``: the text of packed ids, added tokens included; NULL ids give NULL."""
    # Tasks get the bytes of each token, a few hundred kilobytes, and load no tokenizer.
    pieces = df.sparkSession.sparkContext.broadcast(ByteLevel(definition).pieces)
    position = df.columns.index(ids)
    source = numbered(df)
    schema = T.StructType([*source.schema.fields, T.StructField("text", T.StringType())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                texts = [None if v is None else decoded(known, v) for v in part.column(position).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=schema.fieldNames())

    return given_back(source.mapInArrow(back, schema), df.columns, {text: "text"})
