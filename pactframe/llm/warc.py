"""Monolithic gzip normaliser for WARC archives, with a writer and a reader around it.

An archive compressed as one gzip stream can't be entered in the middle. The normaliser inflates such a file
once, from front to end, rewrites every record as a gzip member of its own, and writes a sidecar index with each
member's place; after that any record is one ranged read. It takes a file per task and holds one block of a
record at a time.

Files lie below the shared folder and are opened by URI through pyarrow's file systems. Every attempt of a task
writes under a name of its own; only names in the manifest, which Spark commits, count, so that a lost executor or a
repeated task leaves no wrong record.

Defined results: a null payload is the empty one; a null id is written as such; control characters in an URL
are percent-encoded, a null URL is left out. Of records with equal payloads the one with the smallest id is
the response and the others revisit it (rows that repeat both id and payload are responses all; null ids come last).
Payloads below ``min_bytes`` are responses always. Other columns are ignored; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactframe.llm.common import cut, fresh_dir, map_rows

BLOCK = 1 << 20
#: Duplicate payloads are broadcast only up to this many; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: Levels of the single stream, which is read once, and of the members, which stay.
STREAM_LEVEL, MEMBER_LEVEL = 1, 5
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, record_type string, archive string, offset long, length long"


def open_uri(uri: str, mode: str):
    """A stream on a file of the shared folder: local or of a store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        system, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        if isinstance(system, fs.LocalFileSystem):
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None, buffer_size=BLOCK)
    return system.open_input_file(path) if mode == "seek" else system.open_input_stream(path, compression=None)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit's HTTP head still tells the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """What a gzip file of one or more members holds, in order, with a bounded buffer."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.z, self.rest, self.buffer = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bytes:
        """The next inflated bytes; none at the end."""
        while True:
            data = self.rest or self.raw.read(BLOCK)
            self.rest = b""
            if not data:
                return b""
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(data, BLOCK)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                return out

    def head(self) -> bytes:
        """Up to and with the next empty line; none at the end of the file."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not (got := self.more()):
                if self.buffer.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a record's head")
                return b""
            self.buffer += got
        out, self.buffer = self.buffer[: at + 4], self.buffer[at + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.buffer and not (got := self.more()):
                raise ValueError("the archive ends inside a record")
            self.buffer = self.buffer or got
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(piece)
            yield piece


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def normalise(raw: BinaryIO, out: BinaryIO, sidecar: BinaryIO, archive: str, level: int = MEMBER_LEVEL) -> Iterator[tuple[str, str, str, int, int]]:
    """Rewrite a stream of records as members and yield the index, row by row, as it is written."""
    source, offset = Inflated(raw), 0
    while head := source.head():
        head = head.lstrip(b"\r\n")
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = out.write(z.compress(head))
        for piece in source.take(int(header(head, "Content-Length")) + 4):
            length += out.write(z.compress(piece))
        length += out.write(z.flush())
        row = (header(head, "WARC-Record-ID") or "", header(head, "WARC-Type") or "", archive, offset, length)
        sidecar.write((json.dumps({"id": row[0], "type": row[1], "offset": offset, "length": length}) + "\n").encode())
        offset += length
        yield row


def read_member(data: bytes) -> tuple[bytes, bytes, bytes]:
    """(WARC head, HTTP head, payload) of one member."""
    whole = zlib.decompress(data, 31)
    at = whole.index(b"\r\n\r\n") + 4
    block = whole[at : at + int(header(whole[:at], "Content-Length"))]
    http = block.index(b"\r\n\r\n") + 4
    return whole[:at], block[:http], block[http:]


def with_revisits(pages: DataFrame, *, id_col: str, payload_col: str, url_col: str, min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, revisits, refers_to): which record keeps a payload and which ones point to it."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    key = F.sha2(F.col("payload").cast("binary"), 256)
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy(key.alias("key")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1").drop("n"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    joined = rows.withColumn("key", key).join(groups, "key", "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= min_bytes)
    return joined.select("id", "url", "payload", again.alias("revisits"), F.when(again, F.col("first_id")).alias("refers_to"))


def write_streams(records: DataFrame, folder: str, level: int = STREAM_LEVEL) -> DataFrame:
    """One monolithic archive per partition; returns the committed manifest (archive, n_records)."""

    def run(parts):
        name, n, z = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(level, zlib.DEFLATED, 31)
        with open_uri(name, "w") as out:
            for part in parts:
                for i, url, text, again, to in zip(part["id"], part["url"], part["payload"], part["revisits"], part["refers_to"]):
                    out.write(z.compress(record(i, url, text.encode(), "revisit" if again else "response", to)))
                    n += 1
            out.write(z.flush())
        yield {"archive": [name], "n_records": [n]}

    return cut(map_rows(records, run, "archive string, n_records long"))


def normalise_archives(archives: DataFrame, folder: str, level: int = MEMBER_LEVEL) -> DataFrame:
    """The committed index (record_id, record_type, archive, offset, length) of the rewritten archives."""

    def run(parts):
        for part in parts:
            for source in part["archive"]:
                name, rows = f"{folder}/{uuid.uuid4().hex}.warc.gz", []
                with open_uri(source, "r") as raw, open_uri(name, "w") as out, open_uri(f"{name}.idx", "w") as sidecar:
                    for row in normalise(raw, out, sidecar, name, level):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield dict(zip(("record_id", "record_type", "archive", "offset", "length"), map(list, zip(*rows))))
                            rows = []
                if rows:
                    yield dict(zip(("record_id", "record_type", "archive", "offset", "length"), map(list, zip(*rows))))

    tasks = max(1, archives.count())  # a file, however large, is one task: its stream has no other entry
    return cut(map_rows(archives.select("archive").repartition(tasks), run, INDEX))


def _id(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def read_records(index: DataFrame) -> DataFrame:
    """Each record by a ranged read: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""

    def run(parts):
        name, f = None, None
        for part in parts:
            out = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
            for archive, offset, length in zip(part["archive"], part["offset"], part["length"]):
                if archive != name:
                    name, f = archive, open_uri(archive, "seek")
                f.seek(offset)
                warc, http, payload = read_member(f.read(length))
                kind = header(warc, "WARC-Type")
                digest = (header(warc, "WARC-Payload-Digest") or "").removeprefix("sha1:")
                if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
                    raise ValueError(f"digest differs: {archive} at {offset}")
                out["page_id"].append(_id(header(warc, "WARC-Record-ID")))
                out["payload_bytes"].append(len(payload) if kind == "response" else int(header(http, "Content-Length")))
                out["payload_digest"].append(digest)
                out["record_type"].append(kind)
                out["refers_to"].append(_id(header(warc, "WARC-Refers-To")))
                out["url"].append(header(warc, "WARC-Target-URI"))
            yield out

    return map_rows(index.select("archive", "offset", "length"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 0) -> DataFrame:
    """Write pages as monolithic archives, normalise these, and read every record back through the index."""
    spark = pages.sparkSession
    folder = fresh_dir(spark, "warc")
    streams = write_streams(with_revisits(pages, id_col=id_col, payload_col=payload_col, url_col=url_col, min_bytes=min_bytes), f"{folder}/streams")
    return read_records(normalise_archives(streams, f"{folder}/members"))
