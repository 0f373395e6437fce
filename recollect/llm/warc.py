"""WARC archives that are read by their index.

Every record is a gzip member of its own, so a reader decompresses only what it wants. While archives are written, each
record's path, offset, length, URL and digest go to an index; a read begins with the wanted rows of the index, sorts
their byte ranges and joins neighbours into one request. A record whose payload an earlier page has is a revisit of it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Fixed values of the public format.
VERSION, REVISIT_PROFILE, EMPTY_LINE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"\r\n\r\n"
#: A payload of fewer bytes is written again; bytes of an archive after which a task starts the next; date of records.
LEAST_REVISIT, FILE_BYTES, DATE, LEVEL = 100, 1 << 30, "2000-01-01T00:00:00Z", 1
#: Unwanted bytes that a request may take along, bytes of a request at most (or one record), and bytes of an archive that a task reads.
GAP, REQUEST_BYTES, TASK_BYTES = 64 << 10, 8 << 20, 128 << 20
INDEX = "page_id long, url string, record_type string, record_id string, digest string, path string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, digest string, payload binary"


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    """A name that follows from the record, so that a task that runs twice writes the same bytes."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), digest, F.coalesce(url, F.lit(""))), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with their digest, type, and the id of the record that they revisit."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    firsts = rows.where(long & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("key")).agg(F.min(F.struct("page_id", "url")).alias("first"))
    #: Short payloads meet nothing, so they are dealt by their page.
    keyed = rows.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url"))))
    joined = keyed.join(firsts, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return joined.select(
        "page_id", "url", F.when(again, "revisit").otherwise("response").alias("record_type"), record_id(F.col("page_id"), F.col("url"), F.col("digest")).alias("record_id"),
        F.when(again, record_id(F.col("first.page_id"), F.col("first.url"), F.col("digest"))).alias("refers_to_id"), "digest", F.when(~again, F.col("payload")).alias("payload"),
    )


def header_value(value: str) -> str:
    """A URL as a header can hold it: blanks and control characters, which no valid URL has, are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, kind: str, own_id: str, refers_to: str | None, digest: str, payload: bytes | None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit has the head of its response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"Content-Length: %d\r\n" % len(payload) if payload is not None else b"") + b"\r\n"
    block = http + (payload or b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{own_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Target-URI: {header_value(url)}"] if url is not None else []
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + EMPTY_LINE + block + EMPTY_LINE


def packed(raw: bytes, level: int = LEVEL) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block; a record cut short or overlong raises ValueError."""
    head, mark, rest = raw.partition(EMPTY_LINE)
    first, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    size = int(headers.get("content-length", -1))
    if not first.startswith("WARC/") or rest[size:] != EMPTY_LINE:
        raise ValueError("a damaged record")
    return headers, rest[:size]


class Archive:
    """Writes records one after another, and tells where each lies."""

    def __init__(self, store, base: str, limit: int = FILE_BYTES):
        self.store, self.base, self.limit, self.out, self.at = store, base, limit, None, 0

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= self.limit:
            self.close()
            self.path = f"{self.base}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.at = self.store.open_output_stream(self.path, compression=None), 0
            body = b"format: WARC File Format 1.1\r\n"
            self._put(f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}".encode() + EMPTY_LINE + body + EMPTY_LINE)
        return self.path, *self._put(raw)

    def _put(self, raw: bytes) -> tuple[int, int]:
        member, at = packed(raw), self.at
        self.out.write(member)
        self.at += len(member)
        return at, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record for each row of pages to archives in folder, and returns their INDEX.

    folder is a URI that executors share. Of rows with equal payloads of at least least bytes, those of the smallest
    page_id are responses and the others revisit them; rows that repeat that page_id are each a response (with one
    record id, if their urls are the same too). A null page_id is never the smallest; where a group has no other, all
    are responses. Null html is an empty payload, and html of any length is one record. A null url is left out. An empty
    table gives no archives; other columns are ignored, whatever their names. Archives have names of their own, and only
    those that the index names count: what a lost or repeated task left behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        archive = Archive(store, base, file_bytes)
        try:
            for batch in common.slices(batches, "payload"):
                places = [archive.add(record(*row)) for row in zip(*(c.to_pylist() for c in batch.columns))]
                kept = {k: batch.column(k) for k in ("page_id", "url", "record_type", "record_id", "digest")}
                yield pa.RecordBatch.from_pydict(kept | {k: pa.array(v, t) for (k, t), v in zip((("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())), zip(*places))})
        finally:
            archive.close()

    return common.staged(planned(pages, least).mapInArrow(run, INDEX), "warcindex")


def requests(ranges: Iterable[tuple[int, int]], gap: int = GAP, most: int = REQUEST_BYTES) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges) of each request: sorted ranges (offset, length) joined while the hole between them is at most gap and the whole at most most."""
    start, end, own = 0, 0, []
    for at, length in ranges:
        if own and (at - end > gap or max(end, at + length) - start > most):
            yield start, end, own
            own = []
        if not own:
            start, end = at, at
        end = max(end, at + length)
        own.append((at, length))
    if own:
        yield start, end, own


def read(selected: DataFrame, folder: str, gap: int = GAP, most: int = REQUEST_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """RECORDS of the selected rows of an index, in any order; a payload that doesn't match its digest raises ValueError.

    An index's row that is selected twice is read twice. payload is null for a revisit. A long archive is read by
    several tasks, each of task_bytes of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        now, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            at = 0
            while at < len(rows):
                path, n = rows[at][0], at
                while n < len(rows) and rows[n][0] == path:
                    n += 1
                if path != now:
                    source = source and source.close()
                    now, source = path, store.open_input_file(path)
                for start, end, own in requests([x[1:] for x in rows[at:n]], gap, most):
                    data = source.read_at(end - start, start)
                    yield _records([parse(zlib.decompress(data[o - start : o - start + length], 31)) for o, length in own])
                at = n
        if source:
            source.close()

    ranges = selected.select("path", "offset", "length")
    return ranges.repartition("path", F.floor(F.col("offset") / task_bytes)).sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)


def _records(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    rows = []
    for headers, block in found:
        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
        payload = block.partition(EMPTY_LINE)[2] if kind == "response" else None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't match its digest")
        page_id, refers_to = headers.get("warc-page-id"), headers.get("warc-refers-to")
        rows.append((None if page_id is None else int(page_id), headers.get("warc-target-uri"), kind, headers["warc-record-id"].strip("<>"), refers_to and refers_to.strip("<>"), digest, payload))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in RECORDS.split(", ")])


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of each record read.

    A revisit takes its bytes from the response that it names, which must be among the records; where it isn't, both are null.
    """
    rows = common.staged(records.select("page_id", "record_type", "record_id", "refers_to_id", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("sha256")), "warcrecords")
    own = rows.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("own_bytes"), F.max("sha256").alias("own_sha256"))
    again = rows.where("record_type = 'revisit'").join(own, "refers_to_id", "left").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_sha256").alias("payload_digest"), "record_type", "refers_to")
    first = rows.where("record_type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again)
