"""WARC archives: written as whole gzip streams, normalised to one gzip member per record, and read back.

1. ``write_streams``: every task writes its pages as records of monolithic gzip streams of at most ``ARCHIVE_BYTES``.
2. ``revisits``: of records with equal payloads one is the response, the others revisit it. Only digests are shuffled.
3. ``normalise``: one task per archive inflates the stream once, front to back, writes every record as a gzip member of
   its own (copies as revisit records without payload) and a sidecar with the offset and length of every member.
4. ``read_back``: finds the members through the sidecar and inflates each on its own.

Files lie in a folder that every executor reaches and carry a name that no other attempt of the task has; the rows a
task returns name the files that count, so that files of lost or repeated attempts are never read.

Defined results: a null html is an empty payload; a null url has no target; a null page id is the smallest and is read
back as null; among rows that repeat the largest id of a payload one is the response; an empty table gives no archive
and no rows; extra columns are ignored. Records are held one at a time, so memory follows the largest page.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayframe.llm.common import lookup, settled, shared_folder

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Levels of compression of the streams, which are read once, and of the members.
STREAM_LEVEL, MEMBER_LEVEL = 1, 4
_END = b"\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(folder: str):
    """The file system of a folder and the path in it; any that pyarrow knows (local, HDFS, object stores)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


# -- records ----------------------------------------------------------------------


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def page_of(record: bytes) -> int | None:
    found = record.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(found) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    fields = [b"WARC/1.1", b"WARC-Type: response", b"WARC-Record-ID: " + record_id(page_id)]
    if url is not None:
        fields.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    fields += [
        b"WARC-Date: 2000-01-01T00:00:00Z", b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(http) + len(payload))]
    return b"\r\n".join(fields) + _END + http + payload + _END


def parsed(head: bytes) -> dict[bytes, bytes]:
    """The named fields of a record's or an HTTP header."""
    return {name.lower(): value.strip() for name, _, value in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def as_revisit(head: bytes, body: bytes, refers_to: int | None) -> bytes:
    """The record of a copy: its HTTP header without the payload, and whom it repeats."""
    http = body[: body.index(_END) + len(_END)]
    fields = [line for line in head.split(b"\r\n") if not re.match(rb"(?i)(WARC-Type|Content-Length):", line)]
    fields[1:1] = [b"WARC-Type: revisit", b"WARC-Refers-To: " + record_id(refers_to), b"WARC-Profile: " + _PROFILE]
    return b"\r\n".join([*fields, b"Content-Length: %d" % len(http)]) + _END + http + _END


def records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """``(header, block)`` of every record of an inflated stream, held one at a time."""
    waiting = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> None:
        while len(waiting) < n:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the stream ends within a record")
            waiting.extend(more)

    while True:
        while (at := waiting.find(_END)) < 0:
            more = next(chunks, None)
            if more is None:
                if waiting:
                    raise ValueError("the stream ends within a header")
                return
            waiting.extend(more)
        head = bytes(waiting[:at])
        size = int(parsed(head)[b"content-length"])
        fill(at + 4 + size + 4)
        yield head, bytes(waiting[at + 4 : at + 4 + size])
        del waiting[: at + 4 + size + 4]


def inflated(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file inflated once from front to back; members that follow one another are one stream."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            if out := unzip.decompress(data):
                yield out
            data = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)


def member(data: bytes) -> bytes:
    zipped = zlib.compressobj(MEMBER_LEVEL, wbits=31)
    return zipped.compress(data) + zipped.flush()


# -- steps ------------------------------------------------------------------------


def write_streams(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; ``(archive, ordinal, page_id, payload_bytes, payload_digest)`` of every record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        out = name = None
        written = 0
        for batch in batches:
            rows = []
            for page_id, url, payload in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    files.create_dir(root, recursive=True)
                    name, written, ordinal, zipped = f"{uuid.uuid4().hex}.stream.gz", 0, 0, zlib.compressobj(STREAM_LEVEL, wbits=31)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                body = payload.as_py() or b""
                digest = payload_digest(body)
                data = record(page_id.as_py(), url.as_py(), body, digest)
                out.write(zipped.compress(data))
                rows.append((name, ordinal, page_id.as_py(), len(body), digest))
                ordinal, written = ordinal + 1, written + len(data)
                if written >= ARCHIVE_BYTES:
                    out.write(zipped.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["archive", "ordinal", "page_id", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(zipped.flush())
            out.close()

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("payload"))
    written = narrow.mapInArrow(run, "archive string, ordinal long, page_id long, payload_bytes long, payload_digest string")
    return settled(written, "warc-records")


def revisits(found: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(archive, ordinal, page_id, repeats)``; ``repeats`` is the record id that a copy repeats, null for responses."""
    keyed = found.withColumn("key", F.concat_ws(":", "payload_digest", "payload_bytes"))
    largest = keyed.where(F.col("payload_bytes") >= least_bytes).groupBy("key").agg(
        F.max(F.struct("page_id", "archive", "ordinal")).alias("response"), F.count("*").alias("n")).where("n > 1")
    joined = lookup(keyed.select("key", "archive", "ordinal", "page_id"), settled(largest, "warc-copies"), "key")
    is_it = (F.col("response.archive") == F.col("archive")) & (F.col("response.ordinal") == F.col("ordinal"))
    repeated = F.coalesce(F.col("response.page_id").cast("string"), F.lit(""))
    return joined.select("archive", "ordinal", "page_id", F.when(~is_it, repeated).alias("repeats"))


def normalise(decided: DataFrame, folder: str) -> DataFrame:
    """Rewrites every stream member by member with its sidecar; ``(file, members)`` of every archive."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        files, root = filesystem(folder)
        copies = {int(o): int(r) if r else None for o, r in zip(rows["ordinal"], rows["repeats"]) if r is not None}
        name = f"{uuid.uuid4().hex}.warc.gz"
        offset, count, sidecar = 0, 0, []
        with files.open_input_stream(f"{root}/{rows['archive'].iloc[0]}", compression=None) as stream, files.open_output_stream(f"{root}/{name}", compression=None) as out:
            for ordinal, (head, body) in enumerate(records(inflated(stream))):
                zipped = member(as_revisit(head, body, copies[ordinal]) if ordinal in copies else head + _END + body + _END)
                out.write(zipped)
                sidecar.append(f"{offset}\t{len(zipped)}\n")
                offset, count = offset + len(zipped), count + 1
        if count != len(rows):
            raise ValueError(f"{name}: {count} records for {len(rows)} rows")
        with files.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
            out.write("".join(sidecar).encode())
        return pd.DataFrame({"file": [name], "members": [count]})

    # the rows are few bytes for a whole archive each, so the number of tasks is set by the archives, not by their size
    parts = max(1, decided.select("archive").distinct().count())
    return settled(decided.repartition(parts, "archive").groupBy("archive").applyInPandas(run, "file string, members long"), "warc-files")


def read_back(archives: DataFrame, folder: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every member, found by the sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}.idx", compression=None) as sidecar:
                    places = [tuple(map(int, line.split())) for line in sidecar.read().splitlines()]
                with files.open_input_file(f"{root}/{name}") as archive:
                    yield pa.RecordBatch.from_pylist([_read(archive, *place) for place in places], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    parts = max(1, archives.count())
    return archives.select("file").repartition(parts).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(archive, offset: int, length: int) -> dict:
    archive.seek(offset)
    [(head, body)] = records(iter([zlib.decompress(archive.read(length), 31)]))
    fields = parsed(head)
    at = body.index(_END)
    size, digest = int(parsed(body[:at])[b"content-length"]), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    found = {"page_id": page_of(fields[b"warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields[b"warc-type"].decode(), "refers_to": None}
    if found["record_type"] == "revisit":
        return found | {"refers_to": page_of(fields[b"warc-refers-to"])}
    payload = body[at + 4 :]
    if (len(payload), payload_digest(payload)) != (size, digest):
        raise ValueError(f"record of page {found['page_id']} does not hold the payload its header names")
    return found


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """All four steps over ``pages`` (``page_id``, ``url``, ``html``) in a new shared folder."""
    folder = shared_folder(pages.sparkSession, "warc")
    found = write_streams(pages, folder)
    return read_back(normalise(settled(revisits(found, least_bytes), "warc-decided"), folder), folder)
