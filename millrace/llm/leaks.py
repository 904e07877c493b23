"""Benchmark decontamination: words of documents that lie within windows of benchmark items.

Texts are normalised to words of letters and digits (A-Z lower-cased; all beyond ASCII counts). Every run of WINDOW words
of an item, or the whole of a shorter item, is a pattern. All patterns go into one Aho-Corasick automaton over word
numbers, which reads each document once, word by word, and so finds windows of every length in the same pass. The words
found are told as maximal runs, by word number and by code point of the original text.

The items are read in blocks of up to BLOCK windows, whose automaton a worker can hold. A test set of up to that size is
one block and one pass over the documents; a larger one is filled block by block from a local iterator, so the driver
holds two at most, and each further block reads the documents again, with what has been found so far.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialise, small_batches, tagged, word_spans
from millrace.llm.suffixes import unite

WINDOW = 10
#: Windows of one automaton, of some 800 bytes each.
BLOCK = 250_000
#: Windows of an item that one row holds.
PART = 20_000
#: Bytes of a text that are split into words at once.
CHUNK = 4 << 20

#: Whether a byte parts words: all of ASCII but letters and digits.
PARTING = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: A-Z as a-z, bytes between words as spaces.
FOLD = bytes(0x20 if PARTING[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Names of df that the result does not keep.
TAKEN = ("text", "n_words", "n_hit", "items", "spans")

Span = tuple[int, int, int, int]
SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def chunks(text: bytes, size: int = CHUNK) -> Iterator[bytes]:
    """The normalised text in parts of about size bytes that end between words."""
    text = text.translate(FOLD)
    at = 0
    while at < len(text):
        end = len(text) if at + size >= len(text) else text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


class Windows:
    """The automaton of a block of items: (item id, normalised words)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        self.sizes: list[int] = []
        self.longest = window
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        known: dict[tuple[int, ...], int] = {}
        for item, text in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split())
            size = min(len(words), window)
            for i in range(len(words) - size + 1):
                pattern = words[i : i + size]
                at = known.setdefault(pattern, len(known))
                if at == len(self.items):
                    self.items.append(set())
                    self.sizes.append(size)
                    self.automaton.add_word(pattern, at)
                self.items[at].add(item)
        self.automaton.make_automaton()

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, spans of words within windows, the items they are of)."""
        done, before, spans, found = 0, (), [], set()
        for chunk in chunks(text):
            own = tuple(map(self.numbers.get, chunk.split(), repeat(0)))
            words, base = before + own, done - len(before)
            for last, pattern in self.automaton.iter(words) if self.items else ():
                spans.append((base + last + 1 - self.sizes[pattern], base + last + 1))
                found.add(pattern)
            done += len(own)
            before = words[-self.longest + 1 :] if self.longest > 1 else ()
        return done, spans, set().union(*(self.items[p] for p in found))


#: The automaton of a worker's current block, by its token.
_CURRENT: dict[str, Windows] = {}


def automaton(block: Broadcast[tuple[str, list[tuple[str, bytes]], int]]) -> Windows:
    token, items, window = block.value
    if token not in _CURRENT:
        _CURRENT.clear()
        _CURRENT[token] = Windows(items, window)
    return _CURRENT[token]


def located(text: bytes, spans: list[tuple[int, int]]) -> list[Span]:
    """Maximal runs of words with their code points in the original text."""
    first, last = unite(*(np.array(x, dtype=np.int64) for x in zip(*spans, strict=True)))
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), PARTING)
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return list(zip(*(x.tolist() for x in (first, last, place[starts[first]], place[ends[last - 1]])), strict=True))


def merged(spans: list[Span], more: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans + more):
        if out and s[0] <= out[-1][1]:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2], max(a[3], s[3]))
        else:
            out.append(s)
    return out


def item_parts(items: DataFrame, item_id: str, window: int) -> DataFrame:
    """(item, words, n): normalised words of items, long ones in overlapping parts of up to PART windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, bytes, int]] = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").encode().translate(FOLD).split()
                n = max(len(words) - window + 1, min(len(words), 1))
                rows += [(item or "", b" ".join(words[i : i + PART + window - 1]), min(PART, n - i)) for i in range(0, n, PART)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.binary(), pa.int64()))], names=["item", "words", "n"])

    return items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item string, words binary, n long")


def blocks(parts: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The parts in lists of up to `most` windows; one empty list where there are none."""
    held: list[tuple[str, bytes]] = []
    size, given = 0, False
    for row in parts.toLocalIterator():
        if held and size + row.n > most:
            yield held
            held, size, given = [], 0, True
        held.append((row.item, bytes(row.words)))
        size += row.n
    if held or not given:
        yield held


def scan(docs: DataFrame, block: Broadcast[Any], own: list[str], last: bool) -> DataFrame:
    """One pass of a block's automaton over (own columns, key, text, spans, items); the text goes where no block follows."""
    keep = [*own, "key", *([] if last else ["text"])]
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = automaton(block)
        for batch in batches:
            counts, spans, items = [], [], []
            for text, before, had in zip(batch.column("text"), batch.column("spans"), batch.column("items"), strict=True):
                body = text.as_buffer().to_pybytes() if text.is_valid else b""
                n, new, found = windows.find(body)
                own_spans = located(body, new) if new else []
                old = [tuple(s.values()) for s in before.as_py()]
                counts.append(n)
                spans.append([dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in (merged(old, own_spans) if old else own_spans)])
                items.append(sorted(found | set(had.as_py())) if found else had.as_py())
            made = [pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "n_words", "spans", "items"])

    given = docs.select(*own, "key", "text", "spans", "items")
    return given.mapInArrow(run, ", ".join([*(kinds[c] for c in keep), "n_words long", kinds["spans"], kinds["items"]]))


def find_leaks(df: DataFrame, items: DataFrame, item_id: str = "item_id", window: int = WINDOW, most: int = BLOCK) -> DataFrame:
    """df's columns but text, then n_words, n_hit, items (ids as strings, in order) and spans of each document.

    spans are maximal runs of hit words: first and last (words, last excluded), start and end (code points of the original
    text, end excluded). A null or empty text has no words; items without words have no windows; a null item_id is ""; items of one
    item_id count as one. Rows are judged one by one, so repeated rows and ids fare alike. An empty table gives no rows, an
    empty benchmark no hits. Columns of df named like one of the result's give way to it.
    """
    spark = df.sparkSession
    docs, back = tagged(df)
    own = [c for c in docs.columns if c not in ("key", "text")]
    spans = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    out = docs.withColumns({"spans": F.array().cast(spans), "items": F.array().cast("array<string>")})
    parts = iter(blocks(item_parts(items, item_id, window), most))
    held = next(parts)
    while held is not None:
        following = next(parts, None)
        block = spark.sparkContext.broadcast((uuid.uuid4().hex, held, window))
        made = scan(out, block, own, following is None)
        if following is not None:
            with small_batches(spark, 1000):
                made = materialise(made, "leaks", out)
        out, held = made, following
    kept = [c for c, name in zip(back, df.columns, strict=True) if name.lower() not in TAKEN]
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return out.select(*kept, "n_words", n_hit.alias("n_hit"), "items", "spans")


def leak_digest(leaks: DataFrame) -> DataFrame:
    """Counts and a digest of the items of each document."""
    digest: Column = F.sha2(F.array_join("items", ","), 256)
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
