"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a sequence of zstandard frames, one for each document (more for one of over FRAME_IDS ids), of little-endian
unsigned 32-bit ids; then a skippable frame with the index of documents; then the skippable seek-table frame of the
public zstandard seekable format, with each frame's compressed and decompressed size and the low 32 bits of its
content's XXH64. A reader opens the end of a file, and then reads and decompresses only the frames it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

#: Fixed values of the public seekable format.
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 20
#: Documents that a reading task hands on at once.
READ_DOCS = 8192
LEVEL = 1
SHARD_ROWS = "shard long, path string, n_docs long, n_tokens long"
READ_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Writer:
    """Frames to a binary stream; close() adds the index and the seek table."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.packer = out, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames, self.docs, self.n_frames = array("I"), array("q"), 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        import xxhash

        self.docs.extend((-(1 << 63) if doc_id is None else doc_id, len(raw) // 4, self.n_frames))
        for at in range(0, len(raw) or 1, 4 * FRAME_IDS):
            part = raw[at : at + 4 * FRAME_IDS]
            packed = self.packer.compress(part)
            self.out.write(packed)
            self.frames.extend((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            self.n_frames += 1

    def close(self) -> None:
        index = np.array(self.docs, dtype="<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = np.array(self.frames, dtype="<u4").tobytes()
        foot = struct.pack("<IBI", self.n_frames, HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_SKIPPABLE, len(table) + len(foot)) + table + foot)


class Reader:
    """Random access by position of a document in the file; doc_ids, n_tokens and first_frame are arrays."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table_at = size - 9 - 12 * n
        source.seek(table_at)
        self.frames = np.frombuffer(source.read(12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        index_at = int(self.starts[-1])
        source.seek(index_at)
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE or index_at + 8 + length != table_at - 8:
            raise ValueError("the index of documents is damaged")
        docs = np.frombuffer(source.read(length), dtype="<i8").reshape(-1, 3)
        self.doc_ids, self.n_tokens, self.first_frame = docs[:, 0], docs[:, 1], docs[:, 2]

    def raw(self, which: int) -> bytes:
        """The ids of one document, from its frames alone; a wrong checksum raises ValueError."""
        import xxhash

        first = int(self.first_frame[which])
        last = int(self.first_frame[which + 1]) if which + 1 < len(self.first_frame) else len(self.frames)
        out = []
        for frame in range(first, last):
            self.source.seek(int(self.starts[frame]))
            part = self.unpacker.decompress(self.source.read(int(self.frames[frame, 0])), max_output_size=int(self.frames[frame, 1]) or 1)
            if xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames[frame, 2]:
                raise ValueError(f"checksum of frame {frame} differs")
            out.append(part)
        return b"".join(out)


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, shards: int | None = None) -> list[dict]:
    """Writes docs in ascending doc_id order to files in folder; returns a row for each file, in order.

    folder is a URI that executors share. Null texts are empty, a null doc_id comes first; rows that repeat a doc_id are
    all written, side by side. Texts may be of any length; an empty table gives files without documents. There are as
    many files as shuffle or input partitions, whichever are more, so a file doesn't grow with the corpus. Files go to a
    name of their own and are then moved, so a task may run twice.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        final, temp, writer, n = f"{base}/part-{shard:06d}.tokens", f"{base}/.{uuid.uuid4().hex}", None, 0
        encoder = tokens.encoder(path)
        with store.open_output_stream(temp) as out:
            writer = Writer(out)
            for batch in common.slices(batches):
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                    writer.add(doc_id, ids + end)
                    n += len(ids) // 4 + 1
            writer.close()
        store.move(temp, final)
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([final]), pa.array([len(writer.docs) // 3]), pa.array([n])], ["shard", "path", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    sorted_rows = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return [x.asDict() for x in sorted(sorted_rows.mapInArrow(run, SHARD_ROWS).collect())]


def read(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; start counts the ids of all before it."""
    base, rows = 0, []
    for x in files:
        if x["n_docs"]:
            rows.append((x["path"], base))
        base += x["n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(name) as source:
                    reader = Reader(source, source.size())
                    at = start + np.cumsum(reader.n_tokens) - reader.n_tokens
                    for first in range(0, len(at), READ_DOCS):
                        own = slice(first, first + READ_DOCS)
                        crc = [zlib.crc32(reader.raw(i)) for i in range(first, min(first + READ_DOCS, len(at)))]
                        ids = pa.array(reader.doc_ids[own], pa.int64(), mask=reader.doc_ids[own] == -(1 << 63))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(at[own], pa.int64()), pa.array(reader.n_tokens[own], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, READ_ROWS)


def read_document(folder: str, name: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document of one file, reading only its frames."""
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_file(name) as source:
        reader = Reader(source, source.size())
        found = np.flatnonzero(reader.doc_ids == doc_id)
        return np.frombuffer(reader.raw(int(found[0])), "<u4") if len(found) else None
