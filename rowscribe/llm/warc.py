"""WARC archives as a table of chunks.

Records are written from rows of (record, chunk number, chunk) and read back as
such rows, so neither side holds a payload larger than a chunk in Python. Each
chunk row carries the SHA-1 of its record up to and with this chunk; the row of
the last chunk carries that of the whole payload, no grouping needed.

Archives are gzip files with one member per record, written by the executors
through ``pyarrow.fs`` into a folder all of them reach. Pages carry no time of capture, so
a record's date is that of its writing. A record is named by its page_id; rows that
repeat a page_id repeat the name. A write returns a
manifest of byte ranges; files of failed attempts are in no manifest.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.session import cut, scratch_path

CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 8 << 20
FILE_BYTES = 1 << 30
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, payload_bytes long, digest_so_far string, payload_digest string, last boolean"


def records_of(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every page.

    The payload is the html in UTF-8, empty for null. Of equal payloads of
    ``least`` bytes or more the largest page_id is the response, the others
    revisit it; repeated rows of that page_id are all responses. A null page_id
    is a response only if no other page has its payload.
    """
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # One row per payload after map-side combine; the join splits a hot payload where it must.
    first = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy(F.col("payload_digest").alias("same_digest"), F.col("payload_bytes").alias("same_bytes"))
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .filter("copies > 1 AND response IS NOT NULL")
    )
    joined = rows.join(first, (F.col("payload_digest") == F.col("same_digest")) & (F.col("payload_bytes") == F.col("same_bytes")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("response")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of ``size`` bytes, in order within a task; a record without a body has one empty chunk."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(size))).cast("int")
    rows = records.withColumn("_body", body).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    chunk = F.substring(F.col("_body"), F.col("chunk_no") * size + 1, F.lit(size))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", F.col("chunk_no").cast("long"), chunk.alias("chunk"), (F.col("chunk_no") == count - 1).alias("last"))


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write chunk rows as archives below ``folder``; the manifest has path, first (byte), bytes and records.

    Rows of a record must be consecutive and in order, as ``chunk_rows`` gives
    them. The manifest is itself written, so the rows are produced once.
    """
    written = chunks.mapInArrow(lambda batches: _write(batches, folder), "path string, first long, bytes long, records long")
    return cut(written, "manifest")


def read_archives(manifest: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of the archives in ``manifest``: see the module's head.

    ``payload_bytes`` and ``digest_so_far`` count from the record's start; a
    revisit has one empty chunk, with the length and digest its headers state.
    A payload that differs from its stated digest ends the task with an error.
    """
    parts = manifest.sparkSession.sparkContext.defaultParallelism
    return manifest.repartition(max(parts, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "first").mapInArrow(lambda batches: _read(batches, size), READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read all chunk rows back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(chunk_rows(records_of(pages)), folder))


def _headers(row: dict, length: int) -> bytes:
    name = "none" if row["page_id"] is None else str(row["page_id"])
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:x-page:{name}>", time.strftime("WARC-Date: %Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(batches, folder: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    out, path, at, records, rows, pack = None, "", 0, 0, [], None
    fields = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "last"]
    try:
        for batch in batches:
            bodies = batch.column("chunk")
            for i, row in enumerate(batch.select(fields).to_pylist()):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, at, records = fs.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0, 0
                if row["chunk_no"] == 0:
                    head = HEAD % row["payload_bytes"]
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(pack.compress(_headers(row, len(head) + (row["payload_bytes"] if row["record_type"] == "response" else 0)) + head))
                out.write(pack.compress(bodies[i].as_buffer()))
                if row["last"]:
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    records += 1
                    if out.tell() - at >= SEGMENT_BYTES:
                        rows.append((path, at, out.tell() - at, records))
                        at, records = out.tell(), 0
                        if at >= FILE_BYTES:
                            out.close()
                            out = None
        if out is not None and records:
            rows.append((path, at, out.tell() - at, records))
    finally:
        if out is not None:
            out.close()
    names = ["path", "first", "bytes", "records"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class _Member:
    """Reads one gzip member after another of a byte range, a bounded piece at a time."""

    def __init__(self, source, length: int, step: int = 1 << 18):
        self.source, self.left, self.step, self.raw, self.have = source, length, step, b"", b""
        self.unpack = zlib.decompressobj(31)

    def more(self) -> bool:
        """Get more bytes of this member; false at its end."""
        while not self.unpack.eof:
            if not self.raw:
                self.raw = self.source.read(min(self.step, self.left))
                self.left -= len(self.raw)
                if not self.raw:
                    raise OSError("an archive ends within a record")
            got = self.unpack.decompress(self.raw, self.step)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.have += got
                return True
        return False

    def next(self) -> bool:
        self.have, self.unpack = b"", zlib.decompressobj(31)
        return bool(self.raw or self.left)

    def until(self, mark: bytes) -> bytes:
        while (at := self.have.find(mark)) < 0:
            if not self.more():
                raise OSError("a record has no end of headers")
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise OSError("a record is shorter than it states")
        out, self.have = self.have[:n], self.have[n:]
        return out


def _read(batches, size: int):
    rows, held = [], 0
    for batch in batches:
        for part in batch.to_pylist():
            fs, path = pafs.FileSystem.from_uri(part["path"])
            with fs.open_input_file(path) as source:
                source.seek(part["first"])
                member = _Member(source, part["bytes"])
                while member.next():
                    for row in _record(member, size):
                        rows.append(row)
                        held += len(row[5]) + 200
                        if held >= 4 * size:
                            yield _rows(rows)
                            rows, held = [], 0
    yield _rows(rows)


def _record(member: _Member, size: int):
    head = dict(line.split(": ", 1) for line in member.until(b"\r\n\r\n").decode().split("\r\n")[1:])
    http = member.until(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    page, url = _number(head["WARC-Record-ID"]), head.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, refers = head["WARC-Type"], _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    if kind == "revisit":
        yield page, url, kind, refers, 0, b"", length, stated, stated, True
    else:
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            chunk = member.take(min(size, length - done))
            digest.update(chunk)
            done += len(chunk)
            last = done == length
            if last and digest.hexdigest() != stated:
                raise OSError(f"the payload of page {page} is not the one that was written")
            yield page, url, kind, refers, number, chunk, done, digest.hexdigest(), stated, last
            if last:
                break
            number += 1
    member.take(4)
    while member.more():
        pass


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "none" else int(text)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in READ.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
