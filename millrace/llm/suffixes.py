"""Suffix-array dedup over bytes: remove what a long enough repeat covers.

A byte goes if a string of `length` bytes that covers it also starts earlier (in a smaller document, or earlier in the
same one). A full suffix array keeps some ten bytes per byte of text; this one is sparse and exact:

1. Of the suffixes, those are kept that start at the smallest hash among all `GRAM`-byte grams of some `length`-byte
   string (ties: the leftmost). Equal strings keep the same suffix, so each repeat shows up among kept suffixes. A kept
   suffix stands for the run of strings that chose it.
2. Splitters sampled from the texts range-partition suffixes by their leading bytes and gram; a run of equal leading
   tokens that fills more than a bucket is split on by the content around it. Buckets sort by leading tokens, then by
   that content, and neighbours are compared: equal content means a repeat of all strings of the run, equal tokens in
   different surroundings are compared string by string (3). A run at a bucket's end counts as one that goes on in the
   next bucket, which compares across boundaries.
3. Those runs are cut in two, at half their reach before the suffix. All strings of a half share more bytes, by which
   the halves are sorted and compared alike; what shares them with nothing is done. The strings of the rest are hashed
   one by one (128 bits) and compared in the same way.
4. The strings found give byte spans, which are united per document.

Repeats within an input batch are settled there, so a passage that a third of all documents share reaches a bucket
once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import EXACT, POWERS, id_back, id_key, materialise, mix, own_keys, prefix_sums, salts, slices, span_hashes, utf8, width

LENGTH, GRAM = 100, 32
#: Documents from which splitters are drawn; they affect balance alone.
SPLITTER_DOCS = 2000
_SEED = salts(4, 21)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w neighbouring values."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[: len(x) - k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def kept_suffixes(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, key, content, place) of the kept suffixes of texts data[offsets[i]:offsets[i+1]], offsets[0] being 0.

    key: two leading bytes, then 48 bits of the gram's hash. content: hash of the bytes under the run's strings.
    place: position in the text << 16 | bytes from the run's first string to it << 8 | strings in the run - 1.
    """
    n, w = len(data), length - gram + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none
    sums = prefix_sums(data, EXACT)
    grams = mix((sums[gram:] - sums[:-gram]) * POWERS.down[: n - gram + 1])
    low = sliding_min((grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), w)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    ends = np.repeat(offsets[1:], sizes)[: len(anchor)]
    at = np.flatnonzero(ends - np.arange(len(anchor)) >= length)
    if not len(at):
        return none, none, none, none
    chosen = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    first, last, where = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], chosen[new]
    row = np.searchsorted(offsets, where, side="right") - 1
    lead = (data[where].astype(np.uint64) << np.uint64(8)) | data[where + 1]
    key = (lead << np.uint64(48)) | (grams[where] >> np.uint64(16))
    shape = ((where - first) << 8 | (last - first)).astype(np.uint64)
    content = span_hashes(sums, first, last + length) ^ mix(shape + _SEED[0])
    place = (where - offsets[row]) << 16 | shape.astype(np.int64)
    return row, (key ^ np.uint64(1 << 63)).view(np.int64), content.view(np.int64), place


def run_strings(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): positions of the first and last string of each run."""
    first = (place >> 16) - (place >> 8 & 0xFF)
    return first, first + (place & 0xFF)


def first_of(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row is not later than all others of equal (a, b), by (doc, place)."""
    order = np.lexsort((place, doc, b, a))
    new = np.ones(len(order), dtype=bool)
    x, y = a[order], b[order]
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    d, p = doc[order], place[order]
    out = np.empty(len(order), dtype=bool)
    out[order] = (d == d[lead]) & (p == p[lead])
    return out


def bucket_of(key: np.ndarray, content: np.ndarray, splits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The range of (key, content) among splitters in ascending order."""
    low, high = np.searchsorted(splits[0], key, side="left"), np.searchsorted(splits[0], key, side="right")
    out = low.copy()
    for i in np.flatnonzero(low < high):
        out[i] += np.searchsorted(splits[1][low[i] : high[i]], content[i], side="right")
    return out


COLUMNS = "bucket int, a long, b long, doc long, place long"
NAMES = ["bucket", "a", "b", "doc", "place"]


def settled(a: np.ndarray, b: np.ndarray, doc: np.ndarray, place: np.ndarray, bucket: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> pa.RecordBatch:
    """Rows for the buckets. Those known to repeat an earlier one of the batch carry -1 - place and go anywhere."""
    first = first_of(a, b, doc, place)
    to = np.where(first, 0, (mix(doc.view(np.uint64) ^ place.view(np.uint64)) % np.uint64(n)).astype(np.int64))
    to[first] = bucket(a[first], b[first])
    return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(pa.array(x) for x in (a, b, doc, np.where(first, place, -1 - place)))], names=NAMES)


def compare(rows: DataFrame, buckets: int) -> DataFrame:
    """Sort each bucket by (a, b, doc, place) and compare neighbours: (repeat, doc, place).

    repeat: an earlier row has equal (a, b). The others are told if their a occurs with another b.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the row before: a, b, the first doc and place of that (a, b); the first row of a, if it waits to be told
        last: tuple[int, int, int, int] | None = None
        waiting: tuple[int, int] | None = None
        begun = False  # an a that begins the bucket may go on from the bucket before

        def out(repeat: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(repeat, pa.bool_()), pa.array(doc, pa.int64()), pa.array(place, pa.int64())], names=["repeat", "doc", "place"])

        for batch in batches:
            a, b, doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in NAMES[1:])
            known = place < 0
            if known.any():
                yield out(np.ones(known.sum(), bool), doc[known], -1 - place[known])
                a, b, doc, place = (x[~known] for x in (a, b, doc, place))
            n = len(a)
            if not n:
                continue
            new_a, new_b = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
            new_a[1:] = a[1:] != a[:-1]
            new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
            if last is not None:
                new_a[0] = a[0] != last[0]
                new_b[0] = new_a[0] or b[0] != last[1]
            lead = np.maximum.accumulate(np.where(new_b, np.arange(n), -1))
            lead_doc = np.where(lead >= 0, doc[lead], last[2] if last else 0)
            lead_place = np.where(lead >= 0, place[lead], last[3] if last else 0)
            repeat = ~new_b & ((doc != lead_doc) | (place != lead_place))
            group = np.cumsum(new_a) - 1  # -1: goes on from the batch before
            many = np.zeros(group[-1] + 2, dtype=np.int64)
            np.add.at(many, group + 1, new_b)
            told = new_b & (many[group + 1] > 1)
            told |= new_b & ~new_a  # its a began before
            if new_b[~new_a].any() and waiting is not None and (group[new_b & ~new_a] == -1).any():
                yield out(np.zeros(1, bool), np.array([waiting[0]]), np.array([waiting[1]]))
                waiting = None
            if group[-1] >= 0:
                start = int(np.flatnonzero(new_a)[-1])
                waiting = None if told[start] else (int(doc[start]), int(place[start]))
            if not begun:
                told[0] = True
                waiting, begun = (None if group[-1] == 0 else waiting), True
            pick = repeat | told
            if pick.any():
                yield out(repeat[pick], doc[pick], place[pick])
            last = (int(a[-1]), int(b[-1]), int(lead_doc[-1]), int(lead_place[-1]))
        if waiting is not None:  # its a may go on in the next bucket
            yield out(np.zeros(1, bool), np.array([waiting[0]]), np.array([waiting[1]]))

    dealt = rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("a", "b", "doc", "place")
    return dealt.mapInArrow(scan, "repeat boolean, doc long, place long")


def suffix_rows(docs: DataFrame, splits: tuple[np.ndarray, np.ndarray], buckets: int, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            parts = []
            for i, j in slices(offsets):
                row, *rest = kept_suffixes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                parts.append((keys[i + row], *rest))
            if parts:
                doc, key, content, place = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield settled(key, content, doc, place, lambda a, b: bucket_of(a, b, splits), buckets)

    return docs.mapInArrow(run, COLUMNS)


def splitters(docs: DataFrame, buckets: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, content) at even steps through the suffixes of some documents, chosen by the hash of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, j in slices(offsets):
                _, key, content, _ = kept_suffixes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                pick = np.flatnonzero((content.view(np.uint64) % np.uint64(8)) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[pick]), pa.array(content[pick])], names=["key", "content"])

    every = max(docs.count() // SPLITTER_DOCS, 1)
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).mapInArrow(run, "key long, content long")
    cuts = some.select(F.percentile_approx(F.struct("key", "content").getField("key"), [i / buckets for i in range(1, buckets)] or [0.5], 10_000)).first()[0] or []
    # a key that several cuts name is split on by content, evenly over the hash's range
    keys = np.array(sorted(cuts), dtype=np.int64)[: buckets - 1]
    content = np.zeros(len(keys), dtype=np.int64)
    for k in np.unique(keys):
        at = np.flatnonzero(keys == k)
        content[at] = (np.linspace(-(2.0**63), 2.0**63, len(at) + 1, endpoint=False)[1:] if len(at) > 1 else np.array([-(2.0**63)])).astype(np.int64)
    return keys, content


def told_rows(docs: DataFrame, told: DataFrame, buckets: int, make: Callable[..., tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows for the buckets from the told suffixes of each text, joined to it.

    make(sums, others, row, place, offsets) gives (row, a, b, place); sums and others are running sums of the text bytes.
    """
    per_doc = told.groupBy("doc").agg(F.collect_list("place").alias("places"))
    have = docs.join(per_doc, docs["key"] == per_doc["doc"]).select("key", "text", "places")

    def spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            lists = batch.column("places")
            values, cuts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            held: list[tuple[np.ndarray, ...]] = []
            count = 0
            for i, j in slices(offsets):
                some = data[offsets[i] : offsets[j]]
                row = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1]))
                row, a, b, place = make(prefix_sums(some, EXACT), prefix_sums(some, OTHER), row, values[cuts[i] : cuts[j]], offsets[i : j + 1] - offsets[i])
                held.append((a.view(np.int64), b.view(np.int64), keys[i + row], place))
                count += len(a)
                if count > 1 << 20:
                    yield settled(*(np.concatenate(x) for x in zip(*held, strict=True)), spread, buckets)
                    held, count = [], 0
            if held:
                yield settled(*(np.concatenate(x) for x in zip(*held, strict=True)), spread, buckets)

    return have.mapInArrow(run, COLUMNS)


def halves(length: int, gram: int) -> Callable[..., tuple[np.ndarray, ...]]:
    """The near and far half of each run: the strings that start up to `half` bytes before the suffix, and the others.

    a hashes the bytes that all strings of a whole half share, b the bytes under the half's strings in this run.
    """
    half = (length - gram) // 2

    def make(sums: np.ndarray, others: np.ndarray, row: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        first, last = run_strings(place)
        anchor = place >> 16
        parts = []
        for near in (True, False):
            lo = np.maximum(first, anchor - half) if near else first
            hi = last if near else np.minimum(last, anchor - half - 1)
            some = np.flatnonzero(lo <= hi)
            base, at = offsets[row[some]], anchor[some]
            begin, end = (at, at + length - half) if near else (at - half - 1, at + gram)
            shape = (at - lo[some]) << 8 | (hi - lo)[some]
            a = span_hashes(sums, base + begin, base + end) ^ _SEED[1 + near]
            b = span_hashes(sums, base + lo[some], base + hi[some] + length) ^ mix(shape.astype(np.uint64) + _SEED[0])
            parts.append((row[some], a, b, at << 16 | shape))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    return make


def strings(length: int) -> Callable[..., tuple[np.ndarray, ...]]:
    """Each string of each run by two hashes; its place is its start."""

    def make(sums: np.ndarray, others: np.ndarray, row: np.ndarray, place: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        first, last = run_strings(place)
        n = last - first + 1
        ends = np.cumsum(n)
        start = np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        row = np.repeat(row, n)
        at = start + offsets[row]
        return row, span_hashes(sums, at, at + length), span_hashes(others, at, at + length), start

    return make


#: A second, independent value of each byte.
OTHER = salts(256, 22)


def repeated_spans(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents with key, id and text, removed spans (doc, lo, hi) in bytes, overlapping ones not yet united); a key is the
    id, or a number in the order of ids where an id has several texts."""
    buckets = width(df.sparkSession)
    docs = own_keys(df.select(id_key().alias("key"), id_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    told = lambda rows: rows.where("NOT repeat").select("doc", "place").distinct()
    found = materialise(compare(suffix_rows(docs, splitters(docs, buckets, length, gram), buckets, length, gram), buckets), "suffix-runs")
    cut = materialise(compare(told_rows(docs, told(found), buckets, halves(length, gram)), buckets), "suffix-halves")
    single = materialise(compare(told_rows(docs, told(cut), buckets, strings(length)), buckets).where("repeat"), "suffix-strings")
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)
    runs = found.where("repeat").union(cut.where("repeat")).select("doc", first.alias("lo"), (first + F.col("place").bitwiseAND(255) + length).alias("hi"))
    return docs, runs.union(single.select("doc", F.col("place").alias("lo"), (F.col("place") + length).alias("hi")))


def unite(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans as maximal ones."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.concatenate([at[1:], [len(lo)]]) - 1]


def remove_repeats(df: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of (doc_id, text).

    kept is the remaining bytes (a cut may fall within a character). A null text is empty; a null doc_id is before all
    others and stays null; equal rows count as one place, so a repeated row is not an earlier copy of itself; different texts
    of one doc_id, or without one, are documents of their own, in the order of a hash; other columns are not read; an empty
    table gives no rows.
    """
    docs, spans = repeated_spans(df, length, gram)
    per_doc = spans.groupBy("doc").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    have = docs.join(per_doc, docs["key"] == per_doc["doc"], "left").select("id", "text", "lo", "hi")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            low, high = batch.column("lo"), batch.column("hi")
            rows, held = [], 0
            keys = batch.column("id").to_pylist()
            for i, key in enumerate(keys):
                text = data[offsets[i] : offsets[i + 1]]
                n_removed = n_spans = 0
                if low[i].is_valid and len(low[i]):
                    lo, hi = unite(np.array(low[i].values), np.array(high[i].values))
                    n_removed, n_spans = int((hi - lo).sum()), len(lo)
                    edge = np.zeros(len(text) + 1, dtype=np.int8)
                    edge[lo] += 1
                    edge[hi] -= 1
                    kept = text[np.cumsum(edge[:-1]) == 0].tobytes()
                else:
                    kept = text.tobytes()
                rows.append((key, len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
                held += len(kept)
                if held > 4 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    made = have.mapInArrow(run, schema)
    return made.select(id_back(F.col("id")).alias("doc_id"), *made.columns[1:])
