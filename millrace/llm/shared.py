"""Helpers shared by the training-data operators: scratch tables, null-safe ids and vectorised text hashing.

Text hashing works on Arrow buffers with numpy: one pass of table lookups and running sums gives the
position-independent hash of every word of a whole batch, so no per-word Python code runs.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators; null ids sort before all others.
NULL_ID = -(2**63)
#: Bytes of text that the numpy passes handle at once, so that their arrays stay small.
SLICE_BYTES = 1 << 20


def id_key(name: str = "doc_id") -> Column:
    """The id column as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    """The reverse of id_key."""
    return F.when(col != NULL_ID, col)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, which all executors share.

    Where a local session (tests) has no such setting, a temporary folder is set once; on a cluster it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again: cuts lineage and survives lost executors.

    The frames that led here are then free, and a driver collection lets Spark's cleaner delete their shuffle files;
    the tables behind `done` are deleted, since nothing is computed from them again.
    """
    spark = df.sparkSession
    path, schema = scratch(spark, name), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    drop(*done)
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["_scratch"] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables that materialise has written for frames; all that was computed from them must be written."""
    for df in frames:
        path = df.__dict__.pop("_scratch", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def handed(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, which is computed from table alone, as its new owner: dropping df deletes the table."""
    df.__dict__["_scratch"] = table.__dict__.pop("_scratch", None)
    return df


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner see which shuffles and broadcasts are no longer used."""
    gc.collect()
    for _ in range(2):  # what the first collection frees may hold more
        spark.sparkContext._jvm.System.gc()


def tagged(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """df's columns under names of ours beside `key` and `text`, so that no name of its own clashes; and how to get them
    back under their own names."""
    own = [F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(df.columns)]
    out = df.select(*own, id_key().alias("key"), F.col("text").cast("string").alias("text"))
    return out, [F.col(f"own{i}").alias(c) for i, c in enumerate(df.columns)]


def own_keys(docs: DataFrame) -> DataFrame:
    """docs (key, text, ...) with a key of its own for each text, in the order of keys.

    Texts that share a key, as those without id do, come in the order of their hash. Equal texts under one key stay one.
    Where no key has several texts, docs is given back as it is.
    """
    from millrace.operators.rows import with_row_index

    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    if docs.groupBy("key").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a != b").isEmpty():
        return docs
    pairs = docs.select("key", mark.alias("mark")).distinct()
    placed = with_row_index(pairs, "place", ["key", "mark"])
    others = [c for c in docs.columns if c != "key"]
    return docs.withColumn("mark", mark).join(placed, ["key", "mark"]).select(F.col("place").cast("long").alias("key"), *others)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs within, for wide rows; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- numpy text passes ---------------------------------------------------------------------------------------------

_GOLD = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1
_BASE = 0xD1342543DE82EF95  # odd, so that its powers have inverses modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD)) + mix(np.array([seed], dtype=np.uint64)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have += take
        step = step * step & _MASK
    return out


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> Powers:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
        return self


POWERS = Powers()

#: The bytes that part words, \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The value of each byte in a hash; A-Z count as a-z.
FOLDED = salts(256, 1)
FOLDED[ord("A") : ord("Z") + 1] = FOLDED[ord("a") : ord("z") + 1]
#: The value of each byte where case counts.
EXACT = salts(256, 2)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums s such that the bytes i..j hash to (s[j] - s[i]) * down[i], wherever they stand."""
    powers = POWERS.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers.up[: len(data)], out=out[1:])
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and their number) for rows data[offsets[i]:offsets[i+1]]; offsets[0] is 0."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(parting[data], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]  # edge[i]: between byte i-1 and i
    marks = np.flatnonzero(edge)
    starts, ends = marks[0::2], marks[1::2]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a row's end within a run of word bytes
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; the length counts."""
    down = POWERS.upto(len(sums)).down
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_GOLD))


_SHINGLE = salts(64, 3) | np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row and their number): every run of `size` words, A-Z lower-cased; a row of fewer
    words has one run, all its words; a row without words has none."""
    starts, ends, first = word_spans(data, offsets, SPACE)
    words = span_hashes(prefix_sums(data, FOLDED), starts, ends)
    count = np.diff(first)
    many = np.where(count >= size, count - size + 1, 0)
    n = max(len(words) - size + 1, 0)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        runs += words[k : k + n] * _SHINGLE[k]
    runs = mix(runs)
    out_first = np.concatenate([[0], np.cumsum(np.where(count >= size, many, np.minimum(count, 1)))])
    rows = np.repeat(np.arange(len(count)), np.diff(out_first))
    at = first[rows] + np.arange(out_first[-1]) - out_first[rows]
    out = np.zeros(out_first[-1], dtype=np.uint64)
    full = count[rows] >= size
    out[full] = runs[at[full]]
    for i in np.flatnonzero(~full):
        a, n_words = first[rows[i]], count[rows[i]]
        out[i] = mix(np.array([int(np.sum(words[a : a + n_words] * _SHINGLE[:n_words])) + int(n_words) * _GOLD & _MASK], dtype=np.uint64))[0]
    return out, out_first


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        hashes, first = shingle_hashes(data[offsets[i] : offsets[j]], part, size)
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(hashes[a:b])
