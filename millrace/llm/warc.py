"""WARC: write archives, normalise monolithic gzip files to one member per record, and read records by offset.

A monolithic file is one gzip stream over all its records, so no record can be reached without inflating all before
it. The normaliser inflates such a file once, as a stream, writes every record as a gzip member of its own and a
sidecar index of the members' offsets; afterwards any record is read alone. Memory is bounded by one block of the
stream, whatever the size of files and records.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import NULL_ID, id_back, id_key, materialise, scratch, width

BLOCK = 1 << 18
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100

INDEX = "archive string, offset long, size long, record_type string, record_id string, target_uri string"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_matches boolean, payload binary"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record; a revisit holds the headers of the response alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {_clean(uri)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header lines by lower-case name."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(key, digest, refers_to) of the pages whose payload of at least `least` bytes a smaller page_id has too.

    The payloads stay out of it: digests are aggregated first, then joined with digests alone.
    """
    few = pages.select(id_key("page_id").alias("key"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length("html").alias("n")).where(F.col("n") >= least)
    first = few.groupBy("digest").agg(F.min("key").alias("refers_to"), F.max("key").alias("last")).where("last > refers_to")
    return few.join(first.drop("last"), "digest").where("key > refers_to").select("key", "digest", "refers_to").distinct()


def write_monolithic(pages: DataFrame, directory: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Write (page_id, url, html) as records, a gzip stream per task; returns a table of the files written.

    Files bear names of their own and count only where the returned table, which Spark commits once, has them.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(directory)
        fs.create_dir(f"{path}/mono", recursive=True)
        name, out, squeeze, n = f"mono/{uuid.uuid4().hex}.warc.gz", None, zlib.compressobj(3, zlib.DEFLATED, 31), 0
        for batch in batches:
            for key, url, html, digest, ref in zip(*batch.columns, strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                key, ref = key.as_py(), ref.as_py()
                raw = record("response" if ref is None else "revisit", page_urn(key), url.as_py() or "", date, (html.as_py() or "").encode(), digest.as_py(), None if ref is None else page_urn(None if ref == NULL_ID else ref))
                out.write(squeeze.compress(raw))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    rows = pages.select(id_key("page_id").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    told = rows.join(revisits(pages, least), ["key", "digest"], "left")
    told = told.select(id_back(F.col("key")).alias("key"), "url", "html", "digest", "refers_to")
    return materialise(told.mapInArrow(write, "file string, records long"), "warc-files")


def inflate(source: pa.NativeFile) -> Iterator[bytes]:
    """The bytes of a gzip file, of one or more members, block by block."""
    z, data = zlib.decompressobj(31), source.read(BLOCK)
    while data:
        out = z.decompress(data, BLOCK)
        if out:
            yield out
        if z.eof:
            data = z.unused_data or source.read(BLOCK)
            z = zlib.decompressobj(31)
        else:
            data = z.unconsumed_tail or source.read(BLOCK)
    if tail := z.flush():
        yield tail


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """(header bytes, blocks of the rest of the record) in turn; each record's blocks must be read before the next."""
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        held.extend(block or b"")
        return block is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if bytes(held).strip():
                raise ValueError("the file ends within a record's headers")
            return
        head = bytes(held[: end + 4])
        del held[: end + 4]
        left = int(headers(head)["content-length"]) + 4

        def body(left: int = left) -> Iterator[bytes]:
            while left:
                if not held and not more():
                    raise ValueError("the file ends within a record")
                some = bytes(held[:left])
                del held[: len(some)]
                left -= len(some)
                yield some

        yield head, body()


def normalise(files: DataFrame, directory: str) -> DataFrame:
    """Rewrite each gzip file of `files` (a path `file` relative to the directory) with a member per record.

    Returns the index (archive, offset, size, record_type, record_id, target_uri), also written beside each archive as
    JSON lines. A file is one task: their number is given to Spark, which else merges such small rows into one.
    """
    files = materialise(files.select("file"), "warc-files")
    count = max(files.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(directory)
        fs.create_dir(f"{path}/warc", recursive=True)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name, at, rows = f"warc/{uuid.uuid4().hex}.warc.gz", 0, []
                with fs.open_input_stream(f"{path}/{file}", compression=None) as source, fs.open_output_stream(f"{path}/{name}", compression=None) as out, fs.open_output_stream(f"{path}/{name}.index.jsonl", compression=None) as side:
                    for head, body in split_records(inflate(source)):
                        squeeze, begin = zlib.compressobj(6, zlib.DEFLATED, 31), at
                        for block in chain([head], body):
                            at += out.write(squeeze.compress(block))
                        at += out.write(squeeze.flush())
                        h = headers(head)
                        row = (name, begin, at - begin, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"))
                        side.write((json.dumps(row[1:]) + "\n").encode())
                        rows.append(row)
                        if len(rows) >= 5000:
                            yield index(rows)
                            rows = []
                if rows:
                    yield index(rows)

    def index(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return materialise(files.repartitionByRange(count, "file").mapInArrow(run, INDEX), "warc-index", files)


def parse(raw: bytes) -> tuple:
    """A row of RECORD from a record's bytes."""
    end = raw.index(b"\r\n\r\n") + 4
    h = headers(raw[:end])
    block = raw[end : end + int(h["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    told = h.get("warc-payload-digest", "").rpartition(":")[2]
    if h["warc-type"] == "revisit":
        return h["warc-record-id"], "revisit", h.get("warc-target-uri"), h.get("warc-refers-to"), int(h.get("x-payload-length", 0)), told, None, None
    digest = hashlib.sha256(payload).hexdigest()
    return h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), None, len(payload), digest, digest == told, payload


def read_records(index: DataFrame, directory: str, payloads: bool = True) -> DataFrame:
    """Each indexed record, read by its offset alone. Of a revisit the size and digest are those it was written with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(directory)
        name, file = None, None
        types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            rows, held = [], 0
            for archive, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    name, file = archive, fs.open_input_file(f"{path}/{archive}")
                row = parse(zlib.decompress(file.read_at(size, offset), 31))
                rows.append(row if payloads else (*row[:-1], None))
                held += row[4] if payloads else 0
                if held > 4 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # dealt anew in the order of the archives: the index is too small to be split by its own size
    rows = index.select("archive", "offset", "size").repartitionByRange(width(index.sparkSession), "archive", "offset")
    return rows.sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, normalise the archives and read them back; one row per record.

    Of records with equal payloads of at least 100 bytes that with the smallest page_id is the response and the others
    are revisits; null payloads are empty; null page_ids sort first and stay null; rows that repeat a page_id with the
    smallest are responses each; an empty table gives no records; other columns are not read.
    """
    directory = scratch(pages.sparkSession, "warc")
    index = normalise(write_monolithic(pages, directory), directory)
    return read_records(index, directory, payloads=False)


def page_digests(records: DataFrame) -> DataFrame:
    """Records by page: the digest columns with page ids in place of record ids."""
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)>?$", 1).try_cast("long")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
