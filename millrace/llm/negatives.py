"""Hard negatives by exact inner products, with bounds from summaries of vector segments.

Each vector is cut into 1, then 4, then 16 segments of equal length; a segment's summary is its mean m and its deviation d, the
length of what is left once the mean is taken away. Over a segment of n components x.y = n m(x) m(y) + (x - m(x)).(y - m(y)), and
the last product lies within -d(x) d(y) and d(x) d(y). The sums over segments bound a score from both sides; the pairs
that a level leaves undecided go on to its finer segments, the rest are scored exactly.

Anchors are taken in blocks of a fixed size, broadcast one after the other; every block reads the stored rows in their
partitions, without a shuffle of vectors. A task keeps, for each anchor, no more rows than are asked for, so the shuffle
carries a few rows per anchor and task, whatever one label or one much repeated vector holds. A first pass finds the
positives, a second the negatives between the bounds that these set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import drop, id_back, id_key, materialise

#: Segments of each level.
LEVELS = (1, 4, 16)
#: Anchors of a block, and scores of a part of a batch that are held at once.
ANCHORS, PAIRS = 16_384, 1 << 21
#: Part of all pairs up to which those left are picked out one by one.
SPARSE = 0.2
#: Largest sum that doubles add up exactly.
EXACT = 2.0**53
#: The range of scores.
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
STORED = "id long, key long, label long, vector binary, summary binary, anchor boolean"


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """For each level the rows' means, times the root of the segment's length, beside their deviations."""
    out = []
    for level in LEVELS:
        cuts = np.linspace(0, x.shape[1], min(level, max(x.shape[1], 1)) + 1).astype(int)
        n = np.diff(cuts)
        root = np.sqrt(n, where=n > 0, out=np.ones(len(n)))
        part = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        means = np.stack([p.mean(axis=1) if p.shape[1] else np.zeros(len(x)) for p in part], axis=1)
        spread = np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(part, means.T, strict=True)], axis=1)
        out.append(np.concatenate([means * root, spread], axis=1))
    return out


def padded(vectors: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def stored(df: DataFrame, anchor: Column, size: int) -> DataFrame:
    """The rows that take part with a number of their own and their summaries, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = padded([np.array(v.values, dtype=np.float64) for v in batch.column("vector")], size)
            made = np.concatenate(summaries(vectors), axis=1)
            both = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (vectors, made)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "key", "label")), *both, batch.column("anchor")], names=[c.split()[0] for c in STORED.split(", ")])

    given = df.select(F.monotonically_increasing_id().alias("id"), "key", F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    return materialise(given.mapInArrow(run, STORED), "vectors")


class Rows:
    """Rows as arrays: number, key, label, vectors, and summaries by level."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, size: int) -> None:
        self.id, self.key, self.label = (batch.column(c).to_numpy() for c in ("id", "key", "label"))
        whole = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float64).reshape(len(self.id), -1)
        self.vectors = whole("vector") if size else np.zeros((len(self.id), 0))
        parts = [2 * min(level, max(size, 1)) for level in LEVELS]
        self.levels = np.split(whole("summary"), np.cumsum(parts)[:-1], axis=1)

    def pick(self, at: np.ndarray) -> Rows:
        out = object.__new__(Rows)
        out.id, out.key, out.label, out.vectors = self.id[at], self.key[at], self.label[at], self.vectors[at]
        out.levels = [x[at] for x in self.levels]
        return out


def scored(anchors: Rows, rows: Rows, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs with low <= score <= high, bounds by anchor.

    allowed: a boolean for each pair. Bounds count with a margin that is wider than their rounding.
    """
    live = allowed
    for a, r in zip(anchors.levels, rows.levels, strict=True):
        half = a.shape[1] // 2
        margin = 1 + 1e-9 * (np.abs(a).sum(axis=1).max(initial=0) * np.abs(r).max(initial=0))
        if np.count_nonzero(live) <= SPARSE * live.size:
            i, j = np.nonzero(live)
            mid = np.einsum("ij,ij->i", a[i, :half], r[j, :half])
            wide = np.einsum("ij,ij->i", a[i, half:], r[j, half:]) + margin
            keep = (mid + wide >= low[i]) & (mid - wide <= high[i])
            live = np.zeros_like(live)
            live[i[keep], j[keep]] = True
        else:
            mid, wide = a[:, :half] @ r[:, :half].T, a[:, half:] @ r[:, half:].T + margin
            live = live & (mid + wide >= low[:, None]) & (mid - wide <= high[:, None])
    i, j = np.nonzero(live)
    score = products(anchors.vectors, rows.vectors, i, j)
    keep = (score >= low[i]) & (score <= high[i])
    return i[keep], j[keep], score[keep]


def products(a: np.ndarray, r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs; sums that doubles may round are taken over Python's integers."""
    if np.abs(a).max(initial=0) * np.abs(r).max(initial=0) * a.shape[1] < EXACT:
        if len(i) > SPARSE * len(a) * len(r):
            return (a @ r.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a[i], r[j]).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(a[p], r[q], strict=True)) for p, q in zip(i, j, strict=True)], dtype=np.int64)


class Best:
    """Up to k rows for each slot, by score descending, key, number; as flat arrays in this order."""

    def __init__(self, slots: int, k: int) -> None:
        self.k, self.slot = k, np.zeros(0, dtype=np.int64)
        self.score = self.key = self.id = self.slot
        self.least = np.full(slots, LOWEST)  # the k-th score of slots that are full

    def add(self, slot: np.ndarray, score: np.ndarray, key: np.ndarray, number: np.ndarray) -> None:
        new = score >= self.least[slot]
        s, v, key, number = (np.concatenate([a, b[new]]) for a, b in ((self.slot, slot), (self.score, score), (self.key, key), (self.id, number)))
        order = np.lexsort((number, key, -v, s))
        s = s[order]
        begin = np.searchsorted(s, s, side="left")
        keep = np.arange(len(s)) - begin < self.k
        order = order[keep]
        self.slot, self.score, self.key, self.id = s[keep], v[order], key[order], number[order]
        last = np.flatnonzero((np.arange(len(s)) - begin)[keep] == self.k - 1)
        self.least[self.slot[last]] = self.score[last]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.slot, self.score, self.key, self.id)], names=["slot", "score", "key", "id"])


BEST = "slot long, score long, key long, id long"


def best_of(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the first k of each slot."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "key", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scan_positives(rows: DataFrame, anchors: Rows, size: int, k: int) -> DataFrame:
    """The first k other rows of the label of each anchor (slot: its place in the block)."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = held.value
        best = Best(len(anchors.id), k)
        by_label = np.argsort(anchors.label, kind="stable")
        labels = anchors.label[by_label]
        for batch in batches:
            rows = Rows(batch, size)
            for label in np.unique(rows.label):
                own = by_label[np.searchsorted(labels, label, side="left") : np.searchsorted(labels, label, side="right")]
                at = np.flatnonzero(rows.label == label)
                step = max(1, PAIRS // max(len(own), 1))
                for p in range(0, len(at) if len(own) else 0, step):
                    few, mine = rows.pick(at[p : p + step]), anchors.pick(own)
                    i, j, score = scored(mine, few, best.least[own], np.full(len(own), HIGHEST), mine.id[:, None] != few.id)
                    best.add(own[i], score, few.key[j], few.id[j])
        yield best.batch()

    return best_of(rows.select("id", "key", "label", "vector", "summary").mapInArrow(run, BEST), k)


def scan_negatives(rows: DataFrame, anchors: Rows, size: int, low: np.ndarray, high: np.ndarray, k: int) -> DataFrame:
    """For each anchor and positive (slot: anchor times positives + the positive's rank - 1) the first k rows of another
    label whose score lies within low and high, arrays by anchor and positive; low over high stands for no positive."""
    held = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = held.value
        n, positives = low.shape
        best = Best(n * positives, k)
        step = max(1, PAIRS // max(n, 1))
        for batch in batches:
            rows = Rows(batch, size)
            for p in range(0, len(rows.id) if n else 0, step):
                few = rows.pick(np.arange(p, min(p + step, len(rows.id))))
                floor = np.maximum(low, best.least.reshape(n, positives))
                i, j, score = scored(anchors, few, np.where(low <= high, floor, HIGHEST).min(axis=1), np.where(low <= high, high, LOWEST).max(axis=1), anchors.label[:, None] != few.label)
                for c in range(positives):
                    fits = (score >= floor[i, c]) & (score <= high[i, c])
                    best.add(i[fits] * positives + c, score[fits], few.key[j[fits]], few.id[j[fits]])
        yield best.batch()

    return best_of(rows.select("id", "key", "label", "vector", "summary").mapInArrow(run, BEST), k)


def anchor_blocks(rows: DataFrame, size: int, most: int) -> Iterator[Rows]:
    """The anchors in blocks of up to most rows, through a local iterator."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("label", pa.int64()), ("vector", pa.binary()), ("summary", pa.binary())])
    held: list[dict] = []
    for row in rows.where("anchor").select(*schema.names).toLocalIterator():
        held.append(row.asDict())
        if len(held) == most:
            yield Rows(pa.Table.from_pylist(held, schema), size)
            held = []
    if held:
        yield Rows(pa.Table.from_pylist(held, schema), size)


def hard_negatives(
    df: DataFrame, anchor: Column, vector: str = "vector", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, most: int = ANCHORS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of df's rows (vec_id, label, vector).

    vector is an array of whole numbers of up to 2**53. anchor tells the anchors. An anchor's positives are its first other rows of the
    same label; a positive's negatives are the first rows of another label with low * positive <= 100 * negative <=
    high * positive, scores being inner products, higher ones first, then by vec_id.

    Rows with a null label or vector, or a null component, take no part; shorter vectors count as filled up with 0. A null vec_id
    comes before all others and stays null. Repeated rows are rows of their own: each is an anchor, a positive or a
    negative. Other columns are not read. An empty table, or one without anchors, gives no rows. Scores must fit 64 bits.
    """
    spark = df.sparkSession
    x = F.col(f"`{vector}`")
    plain = df.select(id_key("vec_id").alias("key"), F.col("label"), x.cast("array<double>").alias("vector"), anchor.alias("anchor"))
    plain = plain.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull()))
    size = plain.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = stored(plain, F.col("anchor"), size)
    done: list[DataFrame] = []
    for anchors in anchor_blocks(rows, size, most):
        found = scan_positives(rows, anchors, size, positives).orderBy("slot", "rank").collect()  # positives of one block: a bounded number
        least, largest = np.ones((len(anchors.id), positives), dtype=np.int64), np.zeros((len(anchors.id), positives), dtype=np.int64)
        for r in found:
            bounds = -((-low * r.score) // 100), high * r.score // 100
            if bounds[0] <= bounds[1]:
                least[r.slot, r.rank - 1], largest[r.slot, r.rank - 1] = max(bounds[0], LOWEST), min(bounds[1], HIGHEST)
        mined = scan_negatives(rows, anchors, size, least, largest, negatives)
        schema = "slot long, anchor long, positive long, positive_score long"
        told = spark.createDataFrame([(r.slot * positives + r.rank - 1, int(anchors.key[r.slot]), r.key, r.score) for r in found], schema)
        named = mined.join(told, "slot").select("anchor", "positive", F.col("rank"), F.col("key").alias("negative"), "positive_score", F.col("score").alias("negative_score"))
        done.append(materialise(named, "negatives"))
    drop(rows)
    if not done:
        done = [spark.createDataFrame([], "anchor long, positive long, rank int, negative long, positive_score long, negative_score long")]
    back = [id_back(F.col(c)).alias(f"{c}_id") for c in ("anchor", "positive", "negative")]
    return reduce(DataFrame.union, done).select(back[0], back[1], F.col("rank").cast("int").alias("rank"), back[2], "positive_score", "negative_score")
