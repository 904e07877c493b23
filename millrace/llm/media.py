"""Media columns: payloads stored as archive members, read back through a Spark data source by byte ranges.

An archive is a file of members one after another; its sidecar index (Parquet) holds each member's offset and size.
The data source plans partitions of consecutive members by bytes, never more than asked for, streams their payloads to
Spark as Arrow batches and opens each member by its own offset: a member that cannot be read is tried again alone, and
if it still fails its row carries the error and no payload while the others go on.

A member is an 8-bit grey PNG of 64 samples a row, so a payload must be a positive multiple of 64 bytes.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.llm.shared import scratch

ROW = 64
#: Fixed value: the first bytes of a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, 64 a row."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    body = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    body[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of a PNG that encode_png wrote; ValueError if it is damaged."""
    if stored[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, rows = 8, [], -1
    while at + 12 <= len(stored):
        size = struct.unpack_from(">I", stored, at)[0]
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + size]
        if len(stored) < at + 12 + size or struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise ValueError("damaged samples") from e
    if len(raw) != rows * (ROW + 1):
        raise ValueError("wrong number of samples")
    return np.frombuffer(raw, dtype=np.uint8).reshape(rows, ROW + 1)[:, 1:].tobytes()


def padded(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


def feature(samples: bytes) -> str:
    """Sample statistics as text: rows, mean, standard deviation, zero share and a 16-bin histogram in 1/10000."""
    x = np.frombuffer(samples, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 10_000 // len(x)
    return json.dumps({"rows": len(x) // ROW, "mean": round(float(x.mean()), 4), "sd": round(float(x.std()), 4), "zero": round(float((x == 0).mean()), 6), "bins": bins.tolist()})


def write_archive(df: DataFrame, directory: str | None = None, most_bytes: int = 256 << 20) -> str:
    """Write (doc_id, text) as archives with a sidecar index; returns the directory.

    Each task writes files under names of its own and reports them in the index rows, which Spark commits once: files
    of tasks that were lost or repeated are in no index. An archive is closed at most_bytes.
    """
    spark = df.sparkSession
    directory = directory or scratch(spark, "media")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(directory)
        fs.create_dir(f"{path}/data", recursive=True)
        out, name, at, before = None, "", 0, 0
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None or at >= most_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"data/{uuid.uuid4().hex}.pngs", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = (text.as_py() or "").encode()
                stored = encode_png(raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW)))
                out.write(stored)
                rows.append((name, at, len(stored), doc, len(raw), before))
                at, before = at + len(stored), before + len(stored)
            if rows:
                yield index(rows)
                rows = []
        if out is not None:
            out.close()

    def index(rows: list[tuple]) -> pa.RecordBatch:
        name, *numbers = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(name, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=["archive", "offset", "size", "doc_id", "n_bytes", "before"])

    few = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few.mapInArrow(write, "archive string, offset long, size long, doc_id long, n_bytes long, before long").write.parquet(f"{directory}/index")
    return directory


class Members(InputPartition):
    """Part `part` of the `parts` byte ranges of a row group of one index file."""

    def __init__(self, file: str, group: int, part: int, parts: int) -> None:
        self.file, self.group, self.part, self.parts = file, group, part, parts


class ArchiveReader(DataSourceReader):
    """Plans byte ranges by the index's statistics; reads members by offset."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 16 << 20))
        self.tries = int(options.get("tries", 3))
        self.batch = int(options.get("batchbytes", 4 << 20))

    def partitions(self) -> list[Members]:
        """Only the index footers are read on the driver: the column `before` (bytes before a member, over the archives of
        its task) tells by its least and greatest value how many bytes a row group spans."""
        fs, path = pafs.FileSystem.from_uri(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(f"{path}/index")), key=lambda x: x.path):
            if not info.path.endswith(".parquet"):
                continue
            with fs.open_input_file(info.path) as f:
                meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                offsets = next(group.column(c).statistics for c in range(group.num_columns) if group.column(c).path_in_schema == "before")
                spread = max(offsets.max - offsets.min, 0) if offsets is not None and offsets.has_min_max else self.split
                pieces = max(1, min(group.num_rows, -(-spread // self.split)))
                out += [Members(info.path, g, i, pieces) for i in range(pieces if group.num_rows else 0)]
        return out

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark reads a source without partitions so
            return
        fs, path = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.file) as f:
            rows = pq.ParquetFile(f).read_row_group(partition.group)
        # a member belongs to the range that holds its first byte
        before = rows.column("before").to_numpy() - rows.column("before")[0].as_py()
        whole = int(before[-1]) + rows.column("size")[-1].as_py()
        first, last = np.searchsorted(before, [-(-whole * k // partition.parts) for k in (partition.part, partition.part + 1)])
        rows = rows.slice(int(first), int(last - first))
        files: dict[str, pa.NativeFile] = {}
        out: list[tuple] = []
        held = 0
        for archive, offset, size, doc, n in zip(*(rows.column(c).to_pylist() for c in ("archive", "offset", "size", "doc_id", "n_bytes")), strict=True):
            payload, stored, error = None, None, None
            for _ in range(self.tries):
                try:
                    if archive not in files:
                        files[archive] = fs.open_input_file(f"{path}/{archive}")
                    stored = files[archive].read_at(size, offset)
                    payload, error = decode_png(stored), None
                    break
                except (OSError, ValueError) as e:
                    error, stored = f"{type(e).__name__}: {e}"[:200], None
                    files.pop(archive, None)  # opened anew for the next try
            out.append((doc, archive, offset, n, payload, stored, error))
            held += len(payload or b"") + len(stored or b"")
            if held >= self.batch:
                yield _batch(out)
                out, held = [], 0
        if out:
            yield _batch(out)


MEMBER = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("stored", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), MEMBER, strict=True)], schema=MEMBER)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(directory); options splitBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, n_bytes long, payload binary, stored binary, error string"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archive(spark: SparkSession, directory: str, **options: str | int) -> DataFrame:
    """The members of an archive directory, one row each."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(directory)


def media_columns(members: DataFrame) -> DataFrame:
    """Digests and features of members as read back; a member that could not be read has nulls and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, payload, stored, error in zip(*(batch.column(c) for c in range(5)), strict=True):
                p, s = payload.as_py(), stored.as_py()
                made = (None,) * 6 if p is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ROW:]), len(s), hashlib.sha256(s).hexdigest(), feature(p))
                rows.append((doc.as_py(), n.as_py(), *made, error.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return members.select("doc_id", "n_bytes", "payload", "stored", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def store_and_read(df: DataFrame) -> DataFrame:
    """Store every whole text of (doc_id, text) as an archive member and derive its columns from the bytes read back.

    A null or empty text is 64 bytes of 0; a null doc_id stays null; repeated rows are members each; an empty table
    gives none; equal texts give equal values; other columns are not read.
    """
    return media_columns(read_archive(df.sparkSession, write_archive(df)))
