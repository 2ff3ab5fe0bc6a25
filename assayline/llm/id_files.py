"""Token ids in binary files of bit or byte planes.

A file holds the ids of consecutive documents, one after another. They are cut into blocks of a fixed number
of ids, whatever the documents' ends. A block is transposed: plane i holds byte i (or bit i) of every id,
so that bytes of one significance lie together, and each plane is compressed by itself with
zstandard; a plane of zeros takes no space. Ids and lengths of the documents follow in planes of their own. The footer is the
chunk index: place, number of values and size of each plane of every block. So any stretch of ids is read by its
blocks alone. A manifest lists the files in order with the number of ids before each.

Tables are written and read as the data source ``token_planes``. A task writes under a name that no other attempt has, and the
manifest, which names the files of the attempts that Spark committed, comes last: a lost executor
leaves at most a file that nothing names. A writer holds one block and one document at a time.

Defined results: documents come in ascending order of their ids, NULL ids first; rows with equal ids lie in one
file, ordered by their token ids. NULL text is an empty text, which has the end id alone. An empty table has
a manifest without files and reads as no rows. Long texts are one document, over as many blocks as they
need. Other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from assayline.llm.tokenizer import WordEncoder
from assayline.llm.workers import held

FORMAT, MAGIC, MANIFEST = "token_planes", b"IDPLANE1", "manifest.json"
# Ids of a block and documents of a block of the document index.
BLOCK_IDS, BLOCK_DOCS = 65_536, 8_192
# Bytes of text whose ids make one file.
FILE_BYTES = 128 << 20
# Texts that are held as Python objects, and bytes of ids that are handed to Spark, at a time.
CHUNK, BATCH_BYTES = 256, 2 << 20
LEVEL = 3
KINDS = ("byte", "bit")
SCHEMA = "doc_id long, start long, ids binary"


# -- planes ---------------------------------------------------------------------------------


def to_planes(values: np.ndarray, kind: str) -> list[bytes]:
    """Planes of unsigned integers, least significant first; empty where all is zero."""
    if kind == "byte":
        rows = np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(len(values), -1).T)
    else:
        rows = (np.packbits((values >> values.dtype.type(i)) & values.dtype.type(1) != 0, bitorder="little") for i in range(8 * values.dtype.itemsize))
    return [row.tobytes() if row.any() else b"" for row in rows]


def from_planes(planes: Sequence[bytes], n: int, dtype: str, kind: str) -> np.ndarray:
    """The unsigned integers that ``to_planes`` took apart."""
    kept = np.dtype(dtype).newbyteorder("<")
    if kind == "byte":
        rows = np.zeros((n, kept.itemsize), dtype=np.uint8)
        for i, plane in enumerate(planes):
            if plane:
                rows[:, i] = np.frombuffer(plane, dtype=np.uint8)
        return rows.reshape(-1).view(kept)
    values = np.zeros(n, dtype=kept)
    for i, plane in enumerate(planes):
        if plane:
            values |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little").astype(kept) << kept.type(i)
    return values


# -- files ----------------------------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """Writes documents one after another; holds less than a block and the document at hand."""

    def __init__(self, stream, width: int, kind: str, block_ids: int = BLOCK_IDS):
        import zstandard

        self.stream, self.kind, self.block_ids = stream, kind, block_ids
        self.dtype = f"<u{width}"
        self._compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self._index: dict[str, list] = {"ids": [], "docs": []}
        self._at, self.n_ids, self.n_docs = len(MAGIC), 0, 0
        self._waiting, self._held = [], 0
        self._doc_ids, self._lengths, self._known = [], [], []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._doc_ids.append(doc_id or 0)
        self._known.append(doc_id is not None)
        self._lengths.append(len(ids))
        self.n_docs += 1
        self.n_ids += len(ids)
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self.block_ids:
            joined = np.concatenate(self._waiting)
            whole = len(joined) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._index["ids"].append(self._block(joined[at : at + self.block_ids]))
            self._waiting, self._held = [joined[whole:].copy()], len(joined) - whole
        if len(self._doc_ids) == BLOCK_DOCS:
            self._documents()

    def _block(self, values: np.ndarray, kind: str | None = None) -> list:
        """Write the planes of a block; returns its entry of the index: place, values, size of each plane."""
        place, sizes = self._at, []
        for plane in to_planes(values, kind or self.kind):
            data = self._compress(plane) if plane else b""
            self.stream.write(data)
            sizes.append(len(data))
        self._at += sum(sizes)
        return [place, len(values), sizes]

    def _documents(self) -> None:
        columns = (np.array(self._doc_ids, dtype="<i8").view("<u8"), np.array(self._lengths, dtype="<u8"), np.array(self._known, dtype="<u1"))
        self._index["docs"].append([self._block(c, "byte") for c in columns])
        self._doc_ids, self._lengths, self._known = [], [], []

    def close(self) -> None:
        if self._held:
            self._index["ids"].append(self._block(np.concatenate(self._waiting)))
        if self._doc_ids:
            self._documents()
        footer = self._compress(json.dumps({"dtype": self.dtype, "kind": self.kind, "block": self.block_ids, **self._index}).encode())
        self.stream.write(footer + struct.pack("<QQ", self._at, len(footer)) + MAGIC)


class FileReader:
    """Reads documents in order, or any stretch of ids, of one file; holds the last blocks used."""

    def __init__(self, file):
        import zstandard

        self.file = file
        self._decompress = zstandard.ZstdDecompressor().decompress
        end = 16 + len(MAGIC)
        size = file.size()
        tail = self._read(size - end, end) if size >= end + len(MAGIC) else b""
        if tail[16:] != MAGIC:
            raise ValueError("not a finished file of token planes")
        place, length = struct.unpack("<QQ", tail[:16])
        footer = json.loads(self._decompress(self._read(place, length)))
        self.dtype, self.kind, self.block_ids = footer["dtype"], footer["kind"], footer["block"]
        self._ids, self._docs = footer["ids"], footer["docs"]
        self.blocks_read, self._held = 0, (-1, np.zeros(0, dtype=self.dtype))

    def _read(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def _values(self, entry: list, dtype: str, kind: str) -> np.ndarray:
        place, n, sizes = entry
        data, planes, at = self._read(place, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self._decompress(data[at : at + size]) if size else b"")
            at += size
        return from_planes(planes, n, dtype, kind)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of this file; only their blocks are read."""
        parts, stop = [], start + count
        while start < stop:
            number = start // self.block_ids
            if self._held[0] != number:
                self._held = number, self._values(self._ids[number], self.dtype, self.kind)
                self.blocks_read += 1
            first = number * self.block_ids
            part = self._held[1][start - first : stop - first]
            if not len(part):
                raise ValueError("the file ends before these ids")
            parts.append(part)
            start += len(part)
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, dtype="<u4")

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in this file, ids) in order."""
        at = 0
        for block in self._docs:
            names, lengths, known = (self._values(e, d, "byte") for e, d in zip(block, ("<u8", "<u8", "<u1"), strict=True))
            for name, length, is_known in zip(names.view("<i8").tolist(), lengths.tolist(), known.tolist(), strict=True):
                yield (name if is_known else None), at, self.ids(at, length)
                at += length


# -- data source ----------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote."""

    order: int
    name: str | None
    docs: int
    ids: int


class PlaneWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind = options["path"], options.get("planes", "byte")
        self.width, self.block_ids = int(options.get("width", 4)), int(options.get("block_ids", BLOCK_IDS))
        if self.kind not in KINDS or self.width not in (2, 4):
            raise ValueError(f"planes are of kind {' or '.join(KINDS)}, ids of width 2 or 4")
        system, path = _place(self.path)
        if not overwrite and system.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} holds ids already")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _place(self.path)
        system.create_dir(path)
        order = TaskContext.get().partitionId()
        name, writer = f"part-{order:07d}-{uuid.uuid4().hex}.planes", None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    writer = FileWriter(system.open_output_stream(f"{path}/{name}"), self.width, self.kind, self.block_ids)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype=f"<u{self.width}"))
        if writer is None:
            return Written(order, None, 0, 0)
        writer.close()
        writer.stream.close()
        return Written(order, name, writer.n_docs, writer.n_ids)

    def commit(self, messages: list) -> None:
        system, path = _place(self.path)
        system.create_dir(path)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.order):
            files.append({"name": m.name, "docs": m.docs, "ids": m.ids, "start": start})
            start += m.ids
        made = f"{path}/{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(made) as out:
            out.write(json.dumps({"ids": start, "files": files}).encode())
        system.move(made, f"{path}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        system, path = _place(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{path}/{m.name}")


@dataclass
class PlaneFile(InputPartition):
    name: str
    start: int


class PlaneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[PlaneFile]:
        return [PlaneFile(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [PlaneFile("", 0)]

    def read(self, partition: PlaneFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, path = _place(self.path)
        with system.open_input_file(f"{path}/{partition.name}") as file:
            rows, size = ([], [], []), 0
            for doc_id, start, ids in FileReader(file).documents():
                for column, value in zip(rows, (doc_id, partition.start + start, ids.tobytes()), strict=True):
                    column.append(value)
                size += 4 * len(ids) + 16
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = ([], [], []), 0
            if rows[0]:
                yield _batch(rows)


def _batch(rows: tuple[list, list, list]) -> pa.RecordBatch:
    arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "ids"])


class TokenPlanes(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PlaneReader:
        return PlaneReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PlaneWriter:
        return PlaneWriter(dict(self.options), overwrite)


def manifest(path: str) -> dict:
    """Number of ids, and the files in order: name, documents, ids, ids before it."""
    system, place = _place(path)
    with system.open_input_stream(f"{place}/{MANIFEST}") as file:
        return json.loads(file.read())


def ids_at(path: str, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of all ids, as a loader of training windows reads them."""
    found = manifest(path)
    if start < 0 or start + count > found["ids"]:
        raise ValueError(f"there are {found['ids']} ids")
    system, place = _place(path)
    files, parts, stop = found["files"], [], start + count
    at = bisect_right([f["start"] for f in files], start) - 1
    while start < stop:
        here = files[at]
        with system.open_input_file(f"{place}/{here['name']}") as file:
            parts.append(FileReader(file).ids(start - here["start"], min(stop, here["start"] + here["ids"]) - start))
        start += len(parts[-1])
        at += 1
    return np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")


# -- documents to files ---------------------------------------------------------------------


def file_bounds(docs: DataFrame, id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> list[int]:
    """Greatest id of each file but the last, for files of about ``file_bytes`` of text."""
    named = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.octet_length(F.col(f"`{text}`")).alias("size"))
    files = -(-(named.agg(F.sum("size")).first()[0] or 0) // file_bytes)
    if files < 2:
        return []
    shares = [i / files for i in range(1, files)]
    return sorted(set(named.agg(F.percentile_approx("id", shares, max(10_000, 20 * files))).first()[0] or []))


def encode(docs: DataFrame, definition: str, end_id: int, bounds: Sequence[int] = (), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(file, id, ids) of each document: packed ids of its text and the end id, and the number of its file."""
    width = WordEncoder(definition).width
    if end_id >= 1 << 8 * width:
        raise ValueError("the end id is wider than the vocabulary's")
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key, end = hash(definition), np.array([end_id], dtype=f"<u{width}").tobytes()
    limits = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", key), lambda: WordEncoder(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = encoder.encode_many([t or "" for t in part.column(1).to_pylist()])
                names = part.column(0).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                file = pa.array(np.searchsorted(limits, names).astype(np.int32))
                yield pa.RecordBatch.from_arrays([file, part.column(0), pa.array([f + end for f in found], pa.binary())], names=["file", "id", "ids"])

    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`")).mapInArrow(run, "file int, id long, ids binary")


def write_documents(docs: DataFrame, definition: str, path: str, end_id: int, id: str = "doc_id", text: str = "text", planes: str = "byte",
                    block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the token ids of all documents under ``path`` in ascending order of ``id``.

    Texts are encoded where they lie and only their ids travel, to the file of their range of ``id``.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenPlanes)
    bounds = file_bounds(docs, id, text, file_bytes)
    ordered = encode(docs, definition, end_id, bounds, id, text).repartitionById(len(bounds) + 1, "file").sortWithinPartitions("id", "ids")
    options = {"planes": planes, "block_ids": block_ids, "width": WordEncoder(definition).width}
    ordered.select("id", "ids").write.format(FORMAT).mode("append").options(**options).save(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the documents under ``path``; ids are packed little-endian unsigned 32-bit integers."""
    spark.dataSource.register(TokenPlanes)
    return spark.read.format(FORMAT).load(path)
