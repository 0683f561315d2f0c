"""Operator 7 — WARC archives and the normaliser of monolithic gzip files.

Archives arrive as whole-file gzip streams, in which no record can be reached
without inflating all before it.  The normaliser inflates such a stream once,
rewrites every record as a gzip member of its own and writes a sidecar index
(one line per record: offset, length, type, id).  Records whose payload another
record holds become ``revisit`` records while they are rewritten.

``write_archives`` makes the monolithic files (bounded in records and bytes),
``normalise`` the addressable ones, ``read_records`` reads records through the
index.  All files lie in the shared folder; names are unique per attempt and
only those named in the returned tables count, so a lost executor leaves at most
unused files.

Defined results: a null html is an empty payload, a null url gives no target
line, line ends in a url are percent-encoded; equal payloads have one response,
the row with the largest page_id (nulls are smallest; among equal rows one);
payloads under ``least_bytes`` are always responses; an empty table writes none.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import scratch_path, stored
from vigil.session import ship_package

ARCHIVE_RECORDS = 2000
ARCHIVE_BYTES = 32 << 20
INFLATE_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("archive string, number int, offset bigint, length bigint, type string, record_id string, "
         "page_id bigint, payload_bytes bigint, digest string")


def open_store(path: str):
    """(file system, path) of a shared folder's URI."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_id(value) -> str:
    return "" if value is None else str(value)


def record_bytes(kind: str, record_id: str, page_id, url: str | None, digest: str, size: int,
                 payload: bytes, refers: tuple[str, str] | None = None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {_page_id(page_id)}"]
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers[0]}>",
                 f"X-Refers-To-Page-Id: {refers[1]}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                  for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    pairs = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return fields, pairs, payload


def _write(batches: Iterator[pa.RecordBatch], folder: str, records: int, size: int) -> Iterator[pa.RecordBatch]:
    """Monolithic archives of the partition's pages; emits what each holds."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    out, deflate, rows, written, name = None, None, [], 0, ""

    def close() -> pa.RecordBatch:
        out.write(deflate.flush())
        out.close()
        cols = list(zip(*rows))
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          ["archive", "number", "record_id", "page_id", "payload_bytes", "digest"])

    for b in batches:
        for page_id, url, html in zip(*(b.column(i).to_pylist() for i in range(3))):
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                deflate, rows, written = zlib.compressobj(1, wbits=31), [], 0
            payload = (html or "").encode("utf-8", "surrogatepass")
            record_id, digest = str(uuid.uuid4()), sha1_base32(payload)
            raw = record_bytes("response", record_id, page_id, url, digest, len(payload), payload)
            out.write(deflate.compress(raw))
            rows.append((name, len(rows), record_id, page_id, len(payload), digest))
            written += len(raw)
            if len(rows) >= records or written >= size:
                yield close()
                out = None
    if out is not None:
        yield close()


def write_archives(pages: DataFrame, folder: str, records: int = ARCHIVE_RECORDS,
                   size: int = ARCHIVE_BYTES) -> DataFrame:
    """The manifest (archive, number, record_id, page_id, payload_bytes, digest) of the files written."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return stored(rows.mapInArrow(
        partial(_write, folder=folder, records=records, size=size),
        "archive string, number int, record_id string, page_id bigint, payload_bytes bigint, digest string"),
        "manifest")


def revisits(manifest: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive, number and the response referred to, of every record that repeats a payload."""
    same = manifest.where(F.col("payload_bytes") >= least_bytes)
    lead = same.groupBy("digest", "payload_bytes").agg(
        F.max(F.struct("page_id", "record_id")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    return same.join(lead.drop("n"), ["digest", "payload_bytes"]) \
        .where(F.col("record_id") != F.col("lead.record_id")) \
        .select("archive", "number", F.col("lead.record_id").alias("to_record"), F.col("lead.page_id").alias("to_page"))


def _inflated(stream) -> Iterator[bytes]:
    """Chunks of a gzip stream, whatever its members."""
    inflate = zlib.decompressobj(wbits=31)
    while chunk := stream.read(INFLATE_BYTES):
        while chunk:
            yield inflate.decompress(chunk)
            chunk = b""
            if inflate.eof:
                chunk, inflate = inflate.unused_data, zlib.decompressobj(wbits=31)
    yield inflate.flush()


def stream_records(stream) -> Iterator[bytes]:
    """The records of a monolithic stream; no more than one record is held."""
    held = bytearray()
    need = None
    for chunk in _inflated(stream):
        held += chunk
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                fields = held[:at].split(b"\r\n")
                size = next(int(f.split(b":")[1]) for f in fields if f.lower().startswith(b"content-length:"))
                need = at + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None


def _normalise(batches: Iterator[pa.RecordBatch], source: str, target: str) -> Iterator[pa.RecordBatch]:
    """Rewrite each archive of the batch; emits and writes its index."""
    store, root = open_store(source)
    there, top = open_store(target)
    there.create_dir(top, recursive=True)
    for b in batches:
        for archive, again in zip(b.column("archive").to_pylist(), b.column("again").to_pylist()):
            refers = {r["number"]: (r["to_record"], _page_id(r["to_page"])) for r in again or ()}
            name = f"{archive.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz"
            rows, offset = [], 0
            with store.open_input_stream(f"{root}/{archive}", compression=None) as stream, \
                    there.open_output_stream(f"{top}/{name}", compression=None) as out:
                for number, raw in enumerate(stream_records(stream)):
                    fields, http, payload = parse_record(raw)
                    page, kind = fields["X-Page-Id"], "response"
                    record_id = fields["WARC-Record-ID"][len("<urn:uuid:"):-1]
                    digest = fields["WARC-Payload-Digest"].partition(":")[2]
                    if number in refers:
                        kind = "revisit"
                        raw = record_bytes(kind, record_id, page, fields.get("WARC-Target-URI"), digest,
                                           len(payload), b"", refers[number])
                    member = zlib.compressobj(6, wbits=31)
                    raw = member.compress(raw) + member.flush()
                    out.write(raw)
                    rows.append((name, number, offset, len(raw), kind, record_id, int(page) if page else None,
                                 int(http["Content-Length"]), digest))
                    offset += len(raw)
            with there.open_output_stream(f"{top}/{name}.idx", compression=None) as idx:
                idx.write("".join("\t".join(map(str, r[2:6])) + "\n" for r in rows).encode())
            cols = list(zip(*rows)) or [()] * 9
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                     pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [x.split()[0] for x in INDEX.split(", ")])


def normalise(manifest: DataFrame, source: str, target: str, least_bytes: int = 0) -> DataFrame:
    """The index of the rewritten archives.  A row of work is one archive, whose records are bounded."""
    again = revisits(manifest, least_bytes).groupBy("archive").agg(
        F.collect_list(F.struct("number", "to_record", "to_page")).alias("again"))
    work = stored(manifest.select("archive").distinct().join(again, "archive", "left"), "normaliser-work")
    n = work.count()
    return stored(work.repartition(max(1, min(n, 10_000)), "archive")
                  .mapInArrow(partial(_normalise, source=source, target=target), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = open_store(folder)
    name, stream = None, None
    for b in batches:
        out = []
        for archive, offset, length in zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))):
            if archive != name:
                if stream is not None:
                    stream.close()
                name, stream = archive, store.open_input_file(f"{root}/{archive}")
            raw = zlib.decompress(stream.read_at(length, offset), wbits=31)
            fields, http, payload = parse_record(raw)
            digest = fields["WARC-Payload-Digest"].partition(":")[2]
            kind = fields["WARC-Type"]
            if kind == "response" and (sha1_base32(payload) != digest or len(payload) != int(http["Content-Length"])):
                raise ValueError(f"record at {offset} of {archive} does not hold its payload")
            to, page = fields.get("X-Refers-To-Page-Id", ""), fields["X-Page-Id"]
            out.append((int(page) if page else None, int(http["Content-Length"]), digest, kind,
                        int(to) if to else None, fields.get("WARC-Target-URI"),
                        payload if kind == "response" else None))
        cols = list(zip(*out)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
    if stream is not None:
        stream.close()


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the index, read by its offset: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, payload (null for revisits)."""
    return index.select("archive", "offset", "length").mapInArrow(
        partial(_read, folder=folder),
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
        "url string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(records read back, index) of the pages, through monolithic and normalised archives."""
    spark = pages.sparkSession
    raw, done = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    index = normalise(write_archives(pages, raw), raw, done, least_bytes)
    return read_records(index, done), index
