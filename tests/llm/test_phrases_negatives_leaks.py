"""Collocations, hard negatives and benchmark leaks against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, leaks, negatives

# ---- collocations


def pieces(text: str | None) -> list[list[str]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute_collocations(rows, least, within, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        held = [p for p in f if len(p) > 1 and f[p] >= least]
        longer = Counter()
        for p in held:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    q = p[i : i + m]
                    longer[q] = max(longer[q], f[p])
        found = []
        for p in held:
            if longer[p] and 100 * longer[p] >= within * f[p]:
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -score) for r, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows(seed=5, n=120):
    rng = random.Random(seed)
    words = ["a", "b\x01", "Émil", "émil", "tea", "time", "of", "Day", "x" * 40, "z", "\x00q"]
    make = lambda k: "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", " ;; "]) for _ in range(k))
    rows = [(rng.choice(["en", "en", "de", None, ""]), make(rng.randint(0, 60))) for _ in range(n)]
    return [*rows, ("en", None), ("en", ""), ("de", " .;\n"), ("fr", make(900)), ("en", "tea time of day " * 50), ("en", "tea time of day " * 50), ("xx", ". , ;"), ("und", "only tea")]


@pytest.fixture
def small_shards(monkeypatch):
    """Shards, chunks and ranges so small that a text of some kilobytes fills many."""
    for name, value in (("SHARD", 300), ("CHUNK", 512), ("RANGE", 20), ("EVERY", 64)):
        monkeypatch.setattr(collocations, name, value)


def test_collocations(spark, small_shards):
    rows = phrase_rows()
    df = spark.createDataFrame([(lang, text, 1, "s") for lang, text in rows], "lang string, text string, n int, phrase string").repartition(3)
    for least, within, top in ((3, 80, 2000), (8, 50, 5)):
        got = collocations.collocations(df, least, within, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, least, within, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_a_stream_is_the_same_however_it_is_fed():
    text = b"One two, three\tfour five. six " * 40
    whole, parts = collocations.Stream(), collocations.Stream()
    whole.feed(text)
    for i, j in pairwise([0, 8, 15, 30, 62, 700, 701, len(text)]):
        i, j = (text.rfind(b" ", 0, x) + 1 if 0 < x < len(text) else x for x in (i, j))
        parts.feed(text[i:j])
    (a, n, words), (b, m, same) = whole.take(True), parts.take(True)
    assert words == same
    assert (a == b).all()
    assert (n == m).all()


def test_transducers_round_trip_and_compose():
    rng = np.random.default_rng(1)
    paths, weights = collocations.grouped(rng.integers(0, 6, (4, 900)), rng.integers(1, 4, 900))
    made = collocations.Transducer.build(paths, weights)
    words = [bytes([97 + i]) for i in range(6)]
    packed = made.pack(words)
    back, n = collocations.Transducer.unpack(packed["arcs"]).paths()
    assert (back == paths).all()
    assert (n == weights).all()
    assert sum(map(len, made.label)) < sum(map(len, collocations.Transducer.build(paths, weights, share=False).label))
    pick = np.sort(rng.choice(len(paths), 50, replace=False))
    asked = collocations.grouped(np.concatenate([paths[pick], rng.integers(7, 9, (5, 4))]).T, np.ones(55, dtype=np.int64))[0]
    got, number = made.compose(collocations.Transducer.build(asked, np.arange(len(asked)), share=False))
    known = {tuple(p): w for p, w in zip(paths.tolist(), weights.tolist(), strict=True)}
    assert {tuple(asked[i]): w for i, w in zip(number.tolist(), got.tolist(), strict=True)} == {tuple(p): known[tuple(p)] for p in asked.tolist() if tuple(p) in known}


def test_paths_of_wide_vocabularies_sort_alike():
    wide = np.random.default_rng(2).integers(0, 1 << 20, (4, 3000))
    wide[:, ::3] = wide[:, :1]
    paths, n = collocations.grouped(wide, np.ones(3000, dtype=np.int64))
    want = Counter(map(tuple, wide.T.tolist()))
    assert [tuple(p) for p in paths.tolist()] == sorted(want)
    assert n.tolist() == [want[p] for p in sorted(want)]


def test_a_shard_takes_few_bytes_a_word():
    import tracemalloc

    rng = np.random.default_rng(3)
    stream = collocations.Stream()
    stream.feed(b" ".join(b"w%d" % i for i in rng.zipf(1.3, 200_000) % 50_000))
    tracemalloc.start()
    paths, counts, _ = stream.take(True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.sum() == 200_000 and len(paths) > 100_000
    assert peak / 200_000 < 80


# ---- hard negatives


def brute_negatives(rows, every, k=5, low=80, high=100):
    fit = [(i, v, label, x) for i, (v, label, x) in enumerate(rows) if label is not None and x is not None and None not in x]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    order = lambda r: (-r[0], r[1] is not None, r[1] or 0)
    out = []
    for i, v, label, x in fit:
        if v is None or v % every:
            continue
        others = [(dot(x, y), w, same == label) for j, w, same, y in fit if j != i]
        for score, positive, _ in sorted((o for o in others if o[2]), key=order)[:k]:
            band = sorted((o for o in others if not o[2] and low * score <= 100 * o[0] <= high * score), key=order)[:k]
            out += [(v, positive, r, w, score, s) for r, (s, w, _) in enumerate(band, 1)]
    return sorted(out, key=str)


def vector_rows(n=400, size=24, seed=4):
    rng = random.Random(seed)
    base = [rng.randint(-9, 9) for _ in range(size)]
    rows = [(i, rng.randint(0, 3), [b + rng.randint(-6, 6) for b in base]) for i in range(n)]
    rows += [(1000 + i, rng.randint(0, 1), base) for i in range(60)]  # one much repeated vector
    rows += [(40, 1, base), (40, 2, base), (40, 1, base), (None, 1, base), (2000, None, base), (2001, 1, None), (2002, 1, [1, None, *base[2:]])]
    return [*rows, (2020, 1, []), (2040, 2, base[:7]), (2060, 1, [0] * size), (2080, 3, [-x for x in base])]


def test_hard_negatives(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(v, label, x, 0, "k") for v, label, x in rows], "vec_id long, label int, vector array<long>, id int, key string").repartition(3)
    want = brute_negatives(rows, 20)
    for most in (1000, 7):  # one block of anchors, and several
        got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, most=most)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_hard_negatives_of_sums_beyond_doubles(spark):
    rows = [(0, 0, [2**30 + 1, 3]), (1, 0, [2**30 + 1, 4]), (2, 1, [2**30 + 1, 2]), (3, 1, [2**30 + 1, 1]), (4, 1, [2**30, 1])]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, vector array<long>"), F.col("vec_id") == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows, 7)


def test_segments_bound_scores_and_prune():
    rng = np.random.default_rng(3)
    x, y = np.cumsum(rng.normal(size=(40, 64)), axis=1), np.cumsum(rng.normal(size=(50, 64)), axis=1)  # neighbours are alike
    exact = x @ y.T
    gaps = []
    for a, b in zip(negatives.summaries(x), negatives.summaries(y), strict=True):
        h = a.shape[1] // 2
        mid, wide = a[:, :h] @ b[:, :h].T, a[:, h:] @ b[:, h:].T
        assert (exact <= mid + wide + 1e-6).all()
        assert (exact >= mid - wide - 1e-6).all()
        gaps.append(wide.mean())
    assert gaps[0] > gaps[1] > gaps[2]


# ---- leaks


def brute_leaks(text, items, window):
    find = lambda t: [(m.start(), m.end(), "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    words = find(text)
    plain = [w for *_, w in words]
    hit, named = set(), set()
    for item, body in items:
        own = [w for *_, w in find(body)]
        n = min(len(own), window)
        for pattern in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else ():
            for i in range(len(plain) - n + 1):
                if tuple(plain[i : i + n]) == pattern:
                    hit |= set(range(i, i + n))
                    named.add("" if item is None else str(item))
    runs = []
    for i in sorted(hit):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return len(words), len(hit), sorted(named), [(a, b, words[a][0], words[b - 1][1]) for a, b in runs]


def leak_rows(seed=8):
    rng = random.Random(seed)
    words = ["Tea", "été", "of", "1900", "x", "DAY", "ß", "日本"]
    make = lambda k: "".join(rng.choice(words) + rng.choice([" ", "-", "\n\n", ", ", "\x7f", "’ "]) for _ in range(k))
    items = [(i, make(rng.randint(4, 25))) for i in range(30)]
    items += [(3, make(12)), (50, None), (51, "?!"), (52, "Zebra"), (None, "tea of zebra"), (53, items[0][1]), (54, make(120))]
    docs = [(i, make(rng.randint(0, 30)) + (rng.choice(items)[1] or "") + make(rng.randint(0, 30))) for i in range(50)]
    docs += [(60, None), (61, ""), (62, " .. "), (1, "a ZEBRA!"), (None, "no zebras"), (63, make(4000) + items[-1][1].upper()), (64, "q" * 5000 + " zebra"), (65, items[0][1] * 3), (65, items[0][1] * 3)]
    return docs, items


@pytest.mark.parametrize("most", [10_000, 60])
def test_leaks(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "PART", 40)
    docs, items = leak_rows()
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, items string, key int").repartition(3)
    table = spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, words string")
    got = leaks.find_leaks(df, table, window=6, most=most)
    assert got.columns == ["doc_id", "key", "n_words", "n_hit", "items", "spans"]
    want = sorted(((d, *brute_leaks(t, items, 6)) for d, t in docs), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in got.collect()), key=str) == want


def test_leaks_across_chunks_and_empty_tables(spark, monkeypatch):
    text = ("lead words " * 30 + "one two three four five six " * 3 + "end " * 5).encode()
    windows = leaks.Windows([("a", b"one two three four five six one"), ("b", b"end")], 7)
    want = windows.find(text)
    for size in (1, 7, 40, 333):
        monkeypatch.setattr(leaks.chunks, "__defaults__", (size,))
        n, spans, items = windows.find(text)
        assert (n, sorted(set(spans)), items) == (want[0], sorted(want[1]), want[2])
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = leaks.leak_digest(leaks.find_leaks(docs, none)).first()
    assert tuple(row) == (1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert leaks.find_leaks(docs.limit(0), none).count() == 0


def test_spans_of_blocks_are_united():
    assert leaks.merged([(0, 3, 0, 9), (10, 12, 40, 50)], [(2, 6, 7, 20), (6, 7, 21, 25)]) == [(0, 7, 0, 25), (10, 12, 40, 50)]
