"""Packing: order-preserving dynamic programming over document and sentence ends.

Documents keep the order in which the table stores them. Each input partition is one token stream; a window (a
training sequence) holds at most `length` tokens. The program picks the cuts that minimise padding plus truncation
penalties: a window of n tokens is padded to `length` unless n is a power of two, a cut within a document costs more
than one between documents, and a cut within a sentence more still. With P the tokens before a cut,

    best(j) = penalty(j) + length - P(j) + min over cuts i with P(j) - P(i) <= length of best(i) + P(i)

so the minimum slides over a window and a monotone queue finds it in constant time per cut; windows that are an exact
power of two are tried besides. Nothing is shuffled: a stream is a scan partition, and the only state is the tail of
the stream that no window holds yet.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import slices

#: Cost in padding tokens of a cut between documents, between sentences, within a sentence, and of a short window.
PENALTIES = (0, 2, 64, 16)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Distinct words that a Python worker keeps with their ids; beyond, it starts anew.
CACHED_WORDS = 1_500_000
#: Fixed value: a character that is one token of its own and parts words in a joined call.
MARK = "\x01"
#: Tokens that are gathered before the windows are chosen.
STREAM_TOKENS = 1 << 20


class WordTokens:
    """Token ids of whole texts by way of their distinct words.

    The tokenizer's pieces never span white space, so a text's ids are those of its words in turn, and each distinct
    word is encoded once per worker.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.words = pa.array([], pa.large_string())
        self.ids = np.zeros(0, dtype=np.uint32)
        self.first = np.zeros(1, dtype=np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each word has."""
        if len(self.mark) != 1:
            single = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            return np.array([y for x in single for y in x], dtype=np.uint32), np.array([len(x) for x in single], dtype=np.int64)
        ids, sizes = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)]
        odd = [i for i, w in enumerate(words) if MARK in w]
        for a, b in pairwise([0, *(x for i in odd for x in (i, i + 1)), len(words)]):
            for k in range(a, b, 256):
                some = words[k : min(k + 256, b)]
                got = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                if MARK in some[0]:  # a word by itself
                    ids.append(got)
                    sizes.append(np.array([len(got)]))
                    continue
                at = np.flatnonzero(got == self.mark[0])
                if len(at) != len(some) - 1:
                    raise ValueError("the tokenizer does not part words at the mark")
                ids.append(got[got != self.mark[0]])
                sizes.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def lookup(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words in the cache, which takes them up."""
        if len(self.words) + len(words) > CACHED_WORDS:
            self.clear()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = at < 0
        if missing.any():
            new = words.filter(pa.array(missing))
            ids, sizes = self.encode_words(new.to_pylist())
            at[missing] = len(self.words) + np.arange(len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            self.words = pa.concat_arrays([self.words, new])
        return at

    def __call__(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids with the end id, and the places (ids before) after which a sentence ends."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        lists = pa.LargeListArray.from_arrays(lists.offsets, lists.values) if not isinstance(lists, pa.LargeListArray) else lists
        flat = lists.flatten()
        coded = pc.dictionary_encode(flat)
        place = self.lookup(coded.dictionary.cast(pa.large_string()))[coded.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.int64)
        stops = pc.match_substring_regex(coded.dictionary, r"[.!?。！？]['\")\]]*$").to_numpy(zero_copy_only=False).astype(bool)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=bool)
        sizes = self.first[place + 1] - self.first[place]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n, begin = sizes[a:b], self.first[place[a:b]]
            after = np.cumsum(n)
            total = int(after[-1]) if len(after) else 0
            ids = np.empty(total + 1, dtype=np.uint32)
            ids[:total] = self.ids[np.repeat(begin - (after - n), n) + np.arange(total)]
            ids[total] = end_id
            yield ids, after[stops[a:b]]


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per worker and file, so that its words are kept between tasks."""
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def choose_cuts(places: np.ndarray, costs: np.ndarray, length: int, last: bool, penalties: tuple[int, ...] = PENALTIES) -> list[int]:
    """Indexes of the chosen cuts among candidate `places` (ascending token counts, the first 0), gaps at most `length`.

    Not the last call of a stream: the final window may have to grow, so only cuts of full windows are returned.
    """
    n = len(places)
    total = np.zeros(n, dtype=np.int64).tolist()
    back = [0] * n
    pairs: list[list[int]] = [[] for _ in range(n)]
    size = 1
    while size < length:
        j = np.searchsorted(places, places + size)
        i = np.flatnonzero((j < n) & (places[np.minimum(j, n - 1)] == places + size))
        for a, b in zip(i.tolist(), j[i].tolist(), strict=True):
            pairs[b].append(a)
        size *= 2
    at, cost, short = places.tolist(), costs.tolist(), penalties[3]
    queue = deque([0])  # cuts in order, their total + place ascending
    low = 0
    for j in range(1, n):
        while at[j] - at[queue[low]] > length if low < len(queue) else False:
            queue.popleft()
        i = queue[0]
        best, frm = total[i] + at[i] + length - at[j], i
        for i in pairs[j]:
            if total[i] + short < best:
                best, frm = total[i] + short, i
        total[j], back[j] = best + cost[j], frm
        value = total[j] + at[j]
        while queue and total[queue[-1]] + at[queue[-1]] >= value:
            queue.pop()
        queue.append(j)
    end = n - 1
    if not last:  # the best of the cuts within the last window's reach; the rest waits for more tokens
        reach = np.flatnonzero(places >= places[-1] - length)
        reach = reach[reach > 0]
        if not len(reach):
            return []
        end = int(min(reach, key=lambda k: total[k] + (at[-1] - at[k]) / length))
    cuts = []
    while end:
        cuts.append(end)
        end = back[end]
    return cuts[::-1]


def pack(df: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, penalties: tuple[int, ...] = PENALTIES) -> DataFrame:
    """Pack the whole texts of (doc_id, text) into sequences of at most `length` tokens; one row per piece.

    tokenizer: path of a tokenizers file. Each document's ids are followed by end_id; each id lies in exactly one
    piece. sequence_id is unique over the table and offsets within a sequence run gapless from 0. A null or empty text
    is its end id alone; a null doc_id stays null; repeated rows are packed each; an empty table gives no rows; other
    columns are not read. A sentence longer than a window is cut every length / 8 tokens, at the highest penalty.
    """
    grid = max(length // 8, 1)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []  # doc, its ids before, its size, ids, sentence ends
        count, windows = 0, 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, count, windows
            if not held:
                return None
            places, costs, begin = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 0
            for _, _, _, ids, ends in held:
                inner = ends[(ends > 0) & (ends < len(ids))]
                marks = np.unique(np.concatenate([inner, [len(ids)]]))
                gaps = np.diff(np.concatenate([[0], marks]))
                cost = np.where(marks == len(ids), penalties[0], penalties[1])
                if gaps.max() > grid:
                    more = np.setdiff1d(np.arange(grid, len(ids), grid), marks)
                    marks, cost = np.concatenate([marks, more]), np.concatenate([cost, np.full(len(more), penalties[2])])
                    order = np.argsort(marks)
                    marks, cost = marks[order], cost[order]
                places.append(marks + begin)
                costs.append(cost)
                begin += len(ids)
            at = np.concatenate(places)
            cuts = choose_cuts(at, np.concatenate(costs), length, last, penalties)
            rows: list[tuple] = []
            ends_at = [int(at[c]) for c in cuts]
            where, k, low = 0, 0, 0  # tokens before the held document, window, its start
            rest: list = []
            for doc, before, size, ids, ends in held:
                done = 0
                while done < len(ids) and k < len(ends_at):
                    take = min(ends_at[k] - (where + done), len(ids) - done)
                    rows.append((doc, before + done, take, zlib.crc32(ids[done : done + take].astype("<u4").tobytes()), size, base + windows + k, where + done - low))
                    done += take
                    if where + done == ends_at[k]:
                        low, k = ends_at[k], k + 1
                if done < len(ids):
                    rest.append((doc, before + done, size, ids[done:], ends - done))
                where += len(ids)
            windows += len(cuts)
            held, count = rest, sum(len(x[3]) for x in rest)
            if not rows:
                return None
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string()).fill_null("")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for i, j in slices(np.concatenate([[0], np.cumsum(sizes)]), 8 << 20):
                docs = batch.column("doc_id").slice(i, j - i).to_pylist()
                for doc, (ids, ends) in zip(docs, tokens(texts.slice(i, j - i), end_id), strict=True):
                    held.append((doc, 0, len(ids), ids, ends))
                    count += len(ids)
                    if count >= STREAM_TOKENS and (out := flush(False)):
                        yield out
        while held:
            if out := flush(True):
                yield out

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(stream, SCHEMA)
