"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint is the k smallest distinct 64-bit hashes of a text's shingles, ascending, as base64 of little-endian
integers. Fingerprints of parts merge into that of their union (the k smallest of both), so corpus fingerprints are an
associative aggregation. They estimate resemblance, containment and the number of distinct shingles; with fewer than k
shingles all estimates are exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import id_back, id_key, shingle_sets, width

#: Hashes that a fingerprint keeps.
K = 128


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint or ""), dtype="<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of the union."""
    return np.union1d(a, b)[:k]


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A | B|. Two empty sets resemble each other fully, an empty and a filled one not at all."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A & B| / |A|; an empty A is contained."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def fingerprints(df: DataFrame, k: int = K, size: int = 5, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, n_distinct) of whole texts; null texts are empty, null ids stay null, repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [s[:k] for s in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(s) for s in sketches], pa.string()), pa.array([distinct_count(s, k) for s in sketches], pa.float64())], names=["doc_id", "fingerprint", "n_distinct"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def merge_fingerprints(df: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """One fingerprint per group of the column `fingerprint`: hashes are deduplicated per group before the merge and
    only the k smallest go on, in two steps so that a hot group is first merged within each input part."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for key, x in zip(zip(*(rows[c] for c in by), strict=True) if by else [()] * batch.num_rows, rows["fingerprint"], strict=True):
                held[key] = merge(held.get(key, np.zeros(0, "<u8")), decode(x), k)
            if len(held) > 20_000:
                yield out(held)
                held = {}
        yield out(held)

    def out(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], schema.field(i).type) for i in range(len(by))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([encode(x) for x in held.values()], pa.string())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    few = df.select(*by, "fingerprint")
    schema = to_arrow_schema(few.schema)
    schema = pa.schema([pa.field(f.name, f.type) for f in schema])
    few = few.mapInArrow(part, few.schema)
    return (few.repartition(*by) if by else few.repartition(1)).mapInArrow(part, few.schema)


def neighbours(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of (key, text) dealt into runs of descending key, each run followed by the row that comes next.

    Returns (part, tail, key, text): a part holds consecutive rows; its tail row is a copy of the first row of the next
    part, the last part's of the very first row. Bounds come from a quantile sketch of the keys, so that a recomputed
    task sees the same rows.
    """
    spark = df.sparkSession
    parts = parts or width(spark)
    bounds = df.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)[: max(parts - 1, 0)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rising = np.array(bounds[::-1], dtype=np.int64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            part = len(rising) - np.searchsorted(rising, keys, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], names=["part", *batch.schema.names])

    keyed = df.select("key").mapInArrow(deal, "part int, key long")
    heads = {r.part: r.head for r in keyed.groupBy("part").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads)
    #: For each part the part that its first row follows.
    before = {p: order[i - 1] for i, p in enumerate(order)}

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "tail", "key", "text"]
        for batch in deal(batches):
            part, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(len(part), bool)), *batch.columns[1:]], names=names)
            first = np.flatnonzero(keys == np.array([heads[p] for p in part.tolist()], dtype=np.int64))
            if len(first):
                some = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([before[p] for p in some.column(0).to_pylist()], pa.int32()), pa.array(np.ones(len(first), bool)), *some.columns[1:]], names=names)

    dealt = df.select("key", "text").mapInArrow(copies, "part int, tail boolean, key long, text string")
    return dealt.repartitionById(max(len(bounds) + 1, 1), F.col("part")).sortWithinPartitions("tail", F.desc("key"), F.desc("text"))


def edited(text: str, following: str) -> str:
    """The last third replaced by the first as many code points of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def fingerprint_with_edits(df: DataFrame, k: int = K, size: int = 5) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and their likeness to those and to the next document.

    The next document is the next by descending doc_id (rows of one doc_id by descending text; null ids come last);
    after the last comes the first, so a table of one row is its own next. A null text is empty. Repeated rows give a
    row each; an empty table gives none; other columns are not read. Each text is shuffled once, to the run of its
    neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, str, np.ndarray] | None = None
        ended = False
        for batch in batches:
            n = batch.num_rows
            step = 512
            for i in range(0, n, step):
                some = batch.slice(i, step)
                keys, tails, texts = some.column("key").to_pylist(), some.column("tail").to_pylist(), some.column("text").to_pylist()
                sketches = [s[:k] for s in shingle_sets(some.column("text"), size)]
                todo: list[tuple[int, str, np.ndarray, str, np.ndarray]] = []
                for key, tail, text, sketch in zip(keys, tails, texts, sketches, strict=True):
                    if held is not None and not ended:
                        todo.append((*held, text, sketch))
                    ended = ended or tail
                    held = (key, text, sketch)
                if todo:
                    changed = [edited(t[1], t[3]) for t in todo]
                    after = [s[:k] for s in shingle_sets(pa.array(changed, pa.large_string()), size)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([t[0] for t in todo], pa.int64()),
                            pa.array([len(t[1]) for t in todo], pa.int64()),
                            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                            pa.array([encode(t[2]) for t in todo], pa.string()),
                            pa.array([encode(s) for s in after], pa.string()),
                            pa.array([resemblance(t[2], s, k) for t, s in zip(todo, after, strict=True)], pa.float64()),
                            pa.array([resemblance(t[2], t[4], k) for t in todo], pa.float64()),
                            pa.array([distinct_count(t[2], k) for t in todo], pa.float64()),
                        ],
                        names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct"],
                    )

    rows = df.select(id_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = neighbours(rows).select("key", "tail", "text").mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double")
    return out.select(id_back(F.col("key")).alias("doc_id"), *out.columns[1:])
