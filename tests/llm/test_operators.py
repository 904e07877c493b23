"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, fingerprints, lines, media, mixing, neardup, packing, shared, suffixes, toxicity, warc

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to") for b in ("x", "va", "re", "ni", "do")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def texts(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Texts with copies, near copies, shared passages, repeats within, nulls, empty and long ones."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(3, 120)) for _ in range(n)]
    passage = prose(rng, 60)
    out: list[tuple[int | None, str | None]] = list(enumerate(base))
    out += [(n + i, base[i]) for i in range(5)]
    out += [(n + 10 + i, re.sub(r"\b(\w+)\b", lambda m: m[0] if rng.random() > 0.02 else "zzz", base[i])) for i in range(20)]
    out += [(n + 40 + i, prose(rng, 10) + " " + passage + "\n" + prose(rng, 15)) for i in range(6)]
    out += [(n + 50, None), (n + 51, ""), (n + 52, " \t\n"), (n + 53, "one two"), (n + 54, "One  two"), (n + 55, "é" * 300), (n + 56, prose(rng, 5000)), (n + 57, "ab " * 400), (None, base[7] + " more words here")]
    return out


def frame(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    df = spark.createDataFrame(full, DOCS)
    return df.withColumns({"key": F.lit("k"), "id": F.lit(1), "own0": F.lit(2), "p": F.lit(3.0), "gone": F.lit("g"), "at": F.lit(0)}).repartition(3)


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


@pytest.fixture(scope="module")
def sample():
    return texts()


def test_shingle_sets_count_like_sets(sample):
    got = list(shared.shingle_sets(pa.array([t for _, t in sample], pa.string())))
    assert [len(g) for g in got] == [len(shingles(t)) for _, t in sample]


def test_slices_cover_all_rows():
    assert list(shared.slices(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(shared.slices(np.array([0]), 10)) == []


# ---- fingerprints


def test_fingerprints(spark, sample):
    rows = sorted(((shared.NULL_ID if d is None else d), t or "") for d, t in sample)[::-1]
    got = {r.doc_id: r for r in fingerprints.fingerprint_with_edits(frame(spark, sample)).collect()}
    assert len(got) == len(rows)
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        r = got[None if d == shared.NULL_ID else d]
        n = len(t) // 3
        edited = t[: len(t) - n] + following[:n] if n else t
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            a, b = shingles(t), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - true) < (0.25 if len(a | b) > fingerprints.K else 1e-9)
    by_text: dict[str, set[str]] = {}
    for d, t in rows:
        by_text.setdefault(t, set()).add(got[None if d == shared.NULL_ID else d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_merge_and_estimates(spark, sample):
    df = frame(spark, sample)
    prints = fingerprints.fingerprints(df)
    whole = fingerprints.merge_fingerprints(prints.withColumn("half", F.col("doc_id") % 2), ["half"]).collect()
    every = set().union(*(shingles(t) for d, t in sample if d is not None and d % 2 == 0))
    sketch = fingerprints.decode(next(r.fingerprint for r in whole if r.half == 0))
    assert abs(fingerprints.distinct_count(sketch) / len(every) - 1) < 0.3
    a, b = (np.arange(x, y, dtype=np.uint64) * np.uint64(2**50) for x, y in ((1, 40), (10, 80)))
    assert fingerprints.containment(a, b) == pytest.approx(30 / 39)
    assert fingerprints.resemblance(a, a) == 1.0
    assert fingerprints.resemblance(a[:0], b) == 0.0


def test_one_row_is_its_own_next(spark):
    r = fingerprints.fingerprint_with_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(r) == 1
    assert r[0].near_next == 1.0


# ---- warc


def test_warc_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 300_000 + "</p>"
    pages = spark.createDataFrame([(1, "http://a", "a" * 150), (2, "http://b\r\nX: y", "a" * 150), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", long), (None, "u", "b" * 100), (7, "u", "b" * 100)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.page_digests(warc.round_trip(pages)).collect()}
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in rows.items()} == {
        1: ("response", None, 150), 2: ("revisit", 1, 150), 3: ("response", None, 0), 4: ("response", None, 5), 5: ("response", None, 5), 6: ("response", None, len(long)), None: ("response", None, 100), 7: ("revisit", None, 100),
    }
    assert rows[6].payload_digest == hashlib.sha256(long.encode()).hexdigest()


def test_warc_members_are_read_alone_and_payloads_match(spark):
    directory = shared.scratch(spark, "warc-test")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>é {i}</p>" * (i + 1)) for i in range(50)], "page_id long, url string, html string")
    index = warc.normalise(warc.write_monolithic(pages, directory), directory)
    one = warc.read_records(index.where("record_id = '<urn:page:17>'"), directory).collect()
    assert len(one) == 1
    assert bytes(one[0].payload).decode() == "<p>é 17</p>" * 18
    assert one[0].digest_matches
    ends = index.groupBy("archive").agg(F.sum("size").alias("s"), F.max(F.col("offset") + F.col("size")).alias("e")).collect()
    assert all(r.s == r.e for r in ends)


def test_inflate_takes_many_members_and_rejects_cuts(tmp_path):
    import gzip

    raw = warc.record("response", "urn:page:1", "u", "d", b"body", "x")
    path = tmp_path / "w.gz"
    path.write_bytes(gzip.compress(raw) + gzip.compress(raw))
    with pa.OSFile(str(path)) as f:
        assert [b"".join(body)[-8:-4] for _, body in warc.split_records(warc.inflate(f))] == [b"body"] * 2
    path.write_bytes(gzip.compress(raw[:-20]))
    with pa.OSFile(str(path)) as f, pytest.raises(ValueError, match="ends within"):
        for _, body in warc.split_records(warc.inflate(f)):
            list(body)


# ---- suffixes


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(((shared.NULL_ID if d is None else d), t or "") for d, t in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for q in range(len(b) - length + 1):
            s = b[q : q + length]
            if s in seen:
                gone[q : q + length] = b"\1" * length
            else:
                seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def test_suffix_dedup(spark, sample):
    rng = random.Random(9)
    rows = sample + [(1000 + i, "".join(rng.choice("ab") for _ in range(30)) * 12) for i in range(4)] + [(1010, "q" * 1000), (1011, "q" * 99), (1012, "q" * 100)]
    want = brute_repeats(rows)
    got = suffixes.remove_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, gone, spans, kept = want[shared.NULL_ID if r.doc_id is None else r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, gone, spans, kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_repeated_row_is_no_earlier_copy(spark):
    text = prose(random.Random(1), 80)
    got = suffixes.remove_repeats(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(text))]


# ---- packing


def test_packing_covers_every_token(spark, sample):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*sample, (2000, "<|endoftext|> a \x01 b\x01c"), (2001, "x" * 30_000)]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    got = packing.pack(frame(spark, rows), path, 256).toPandas()
    for d, want in ids.items():
        mine = (got[got.doc_id.isna()] if d is None else got[got.doc_id == d]).sort_values("start")
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]]
        assert mine.length.sum() == len(want) == mine.doc_tokens.iloc[0]
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() <= 256


def test_word_ids_come_as_arrays():
    """Ids of many words in one array, without a list for each word; words that hold the mark are encoded by themselves."""
    import public_tokenizers

    rng = random.Random(6)
    words = [f"w{i}" + "xé漢"[i % 3] * rng.randint(1, 9) for i in range(700)]
    words[3], words[256], words[257], words[699] = "a\x01b", "\x01", "\x01\x01c", "<|endoftext|>"
    tokens = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    want = [tokens.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    ids, sizes = tokens.encode_words(words)
    assert ids.tolist() == [y for x in want for y in x] and sizes.tolist() == [len(x) for x in want]
    at = tokens.lookup(pa.array(words[:500], pa.large_string()))
    again = tokens.lookup(pa.array(words[400:], pa.large_string()))
    assert at.tolist() == list(range(500)) and again.tolist() == list(range(400, 700))


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    places = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 40))])
    costs = rng.choice([0, 2], 41)
    length, pen = 32, packing.PENALTIES

    def cost(cuts):
        n = np.diff(places[[0, *cuts]])
        return sum(min(length - x, pen[3] if x & (x - 1) == 0 and x < length else 10**9) for x in n) + sum(costs[c] for c in cuts)

    best = [0] + [10**9] * 40
    for j in range(1, 41):
        for i in range(j):
            n = places[j] - places[i]
            if n <= length:
                pad = min(length - n, pen[3] if n & (n - 1) == 0 and n < length else 10**9)
                best[j] = min(best[j], best[i] + pad + costs[j])
    cuts = packing.choose_cuts(places, costs, length, True)
    assert cuts[-1] == 40
    assert cost(cuts) == best[40]


# ---- toxicity and mixing


def labelled_texts(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic, low = i % 5 == 0, i % 7 == 3
        words = prose(rng, 40).split()
        if toxic:
            for w in rng.sample(["vile", "nasty", "rotten"], rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        if low:
            words = [w.upper() + "!!" for w in words[:8]] * 5
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(not low), int(toxic)))
    return rows, spark.createDataFrame([*labels, (None, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_texts(spark):
    rows, labels = labelled_texts(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame(spark, [*rows, (9000, None)]), labels).collect()}
    held = [i for i in range(len(rows)) if i % 2 and i % 7 != 3]
    right = sum(got[i].rejected == (i % 5 == 0) for i in held)
    assert right >= 0.97 * len(held)
    assert not got[9000].rejected
    assert all(abs(r.severity - r.p_toxic - r.p_severe) < 1e-9 and r.p_severe <= r.p_toxic for r in got.values())
    kept = toxicity.drop_toxic(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(rows)) if not got[i].rejected}


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.rejected for r in toxicity.score_toxicity(frame(spark, [(1, "a b")]), none).collect()] == [False]
    assert toxicity.score_toxicity(frame(spark, [(1, "a b")]).limit(0), none).count() == 0


def test_rates_reach_targets(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    n = rng.integers(1, 300, 500)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "tokens long, p0 double, p1 double, p2 double")
    history, reached, target = mixing.fit_rates(rows, shares=np.array([0.8, 0.15, 0.05]))
    assert np.allclose(reached, target, rtol=1e-3)
    r = last = np.ones(500)
    for m, h in history:
        r, last = np.maximum(0, r + m * (r - last) - p @ np.array(h)), r
    got = np.array([x[0] for x in rows.select(mixing.rate(history)).collect()])
    assert np.allclose(np.sort(got), np.sort(r))
    assert (got >= 0).all()
    assert np.allclose(((n * r)[:, None] * p).sum(axis=0), target, rtol=1e-3)


def test_mixing_keeps_clean_texts(spark):
    rows, labels = labelled_texts(spark)
    df = frame(spark, [*rows, (9000, None), (9001, "")])
    rates = {r.doc_id: r for r in mixing.mixture_rates(df, labels).collect()}
    assert len(rates) == len(rows) + 2
    kept = {r.doc_id for r in mixing.mix_down(df, labels, low_share=0.02).collect()}
    clean = [i for i in range(len(rows)) if i % 5 and i % 7 != 3]
    low = [i for i in range(len(rows)) if i % 5 and i % 7 == 3]
    assert set(clean) <= kept
    assert len(kept & set(low)) < 0.7 * len(low)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixture_rates(df, none).count() == len(rows) + 2
    assert mixing.mix_down(df.limit(0), none).count() == 0


# ---- chat


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(2)
    convs: dict[int | None, list[tuple]] = {}
    for i in range(30):
        convs[i] = [(("user", "assistant")[k % 2], prose(rng, 4)) for k in range(rng.randint(1, 6))]
    for i in range(30, 60):
        src = convs[rng.randrange(30)]
        convs[i] = src[: rng.randint(1, len(src))]
    convs[None] = [*convs[0], ("user", None)]
    convs[70] = [*convs[0], ("user", "")]
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("at", F.lit(9)).repartition(3)
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    order = sorted(convs, key=lambda c: -1 if c is None else c)
    want = {}
    for c in order:
        mine = convs[c]
        longer = any(len(o) > len(mine) and o[: len(mine)] == mine for o in convs.values())
        if not longer and not any(convs[w] == mine for w in want):
            want[c] = sum(o == mine for o in convs.values())
    assert {c: r.copies for c, r in got.items()} == want
    r = got[70]
    assert r.text == "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in convs[70])
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- lines


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(8, 60)) for _ in range(40)]
    rows = []
    for d in range(30):
        own = [rng.choice(base) if rng.random() < 0.5 else prose(rng, 12) for _ in range(4)]
        own = [re.sub(r"\w", "y", x, count=1) if rng.random() < 0.3 else x.upper() if rng.random() < 0.2 else x for x in own]
        rows.append((d, "\n".join([*own, "", "Page %d" % d])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base[0]), (103, " ".join(f"w{i}" for i in range(3000)))]
    df = frame(spark, rows)
    norm = df.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("doc_id", "i", lines.normalised(F.col("line")).alias("n")).where("n != ''")
    listed = sorted(norm.select("doc_id", "i", "n").collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.i))
    group = {r.n: r.n for r in listed}
    root = lambda x: x if group[x] == x else root(group[x])
    names = list(group)
    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= 0.9 * max(len(a), len(b)) and edit_distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9:
                group[root(a)] = root(b)
    first, gone = {}, {}
    for r in listed:
        k = root(r.n)
        if k in first:
            gone.setdefault(r.doc_id, set()).add(r.i)
        first.setdefault(k, r)
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        assert (got[d].text, got[d].n_removed, got[d].n_lines) == (kept, len(gone.get(d, ())), len((t or "").split("\n")))
    assert any(root(a) != a for a in names)
    out = lines.without_repeated_lines(df)
    assert out.columns == df.columns
    kept_ids = {r.doc_id for r in out.collect()}
    assert {100, 101, 102} <= kept_ids


def test_line_dedup_finds_edited_lines(spark):
    """Edit similarity alone: each base line, an edited copy, and nothing else near."""
    rng = random.Random(21)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(letter() for _ in range(rng.randint(3, 9)))
    pairs = [("mississippian", "mississippjan"), ("abcdefghij", "abcdefghi"), ("x" + "ab" * 2000, "y" + "ab" * 2000)]
    for n in [1, 2, 3, 5, 8, 12, 15, 16, 20, 21, 25, 40, 80, 300] * 8:
        words = [word() for _ in range(n)]
        line = " ".join(words)
        while len(line) < 10:
            line += letter()
        at = rng.randrange(len(line))
        pairs.append((line, line[:at] + "#" + line[at + 1 :]))
        if n >= 15:
            i = rng.randrange(n)
            pairs.append((line + " q", " ".join([*words[:i], "zzz", *words[i + 1 :]]) + " q"))
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, b) in enumerate(pairs)]
    group = {}
    for i, (a, b) in enumerate(pairs[:2] + pairs[3:]):
        group[i] = edit_distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9
    assert all(group.values())
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert [i for i in range(len(pairs)) if not got[1000 + i]] == []
    assert not got[0] and not got[1] and not got[2]


def edited(rng: random.Random, line: str, share: float) -> str:
    """The line with a share of its letters replaced, at most a tenth of its characters."""
    at = [i for i, c in enumerate(line) if c.isalpha()]
    out = list(line)
    for i in rng.sample(at, min(round(len(at) * share), len(line) // 10)):
        out[i] = rng.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


def test_line_dedup_recall_of_scattered_edits(spark):
    """By edit similarity alone: at least nine in ten pairs of each length and share of edited letters are found."""
    rng = random.Random(33)
    words = [prose(rng, 1) for _ in range(3000)]
    rows, cells = [], []
    for n in (12, 20, 40, 80):
        for share in (0.03, 0.06, 0.09):
            for _ in range(60):
                line = " ".join(rng.choice(words) for _ in range(n))
                rows += [(len(cells), line), (10_000 + len(cells), edited(rng, line, share))]
                cells.append((n, share))
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame(spark, rows)).collect()}
    for cell in set(cells):
        mine = [i for i, c in enumerate(cells) if c == cell]
        assert sum(got[10_000 + i] for i in mine) >= 0.9 * len(mine), cell
    assert not any(got[i] for i in range(len(cells)))


def test_lines_around_a_passage_are_not_paired_with_all(spark, monkeypatch):
    """Unlike lines of twenty common and twenty own words: pairs grow with the lines, not with their square; an edited copy
    among them is found."""
    rng = random.Random(34)
    words = [prose(rng, 1) for _ in range(3000)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    pairs: list[int] = []
    known = lines.link_buckets

    def counted(buckets, verify, *more, **named):
        def look(rows):
            pairs.append(rows.count())
            return verify(rows)

        return known(buckets, look, *more, **named)

    monkeypatch.setattr(lines, "link_buckets", counted)
    tried = {}
    for n in (200, 800):
        passage = some(20)
        rows = []
        for i in range(n):
            own, at = some(20), rng.choice((0, 10, 20))
            rows.append((i, " ".join(own[:at] + passage + own[at:])))
        rows.append((n, edited(rng, rows[7][1], 0.04)))
        pairs.clear()
        got = {r.doc_id for r in lines.dedup_lines(frame(spark, rows)).collect() if r.n_removed}
        assert got == {n}
        tried[n] = sum(pairs)
    assert tried[800] <= 6 * tried[200]
    assert tried[800] <= 0.05 * 800 * 799 / 2


def test_line_dedup_does_not_depend_on_bucket_sizes(spark, monkeypatch):
    """Copies edited all over their first quarter, among many unlike lines around one passage: found in a large bucket, as
    they are in one of up to SMALL lines; its blocks are so small here that copies fall into others."""
    from millrace.llm import graph

    monkeypatch.setattr(graph, "BLOCK", 16, raising=False)
    rng = random.Random(35)
    text = lambda n: "".join(rng.choice("bcdfgjkmpquvwxyz") for _ in range(n))
    passage = text(100)
    rows = [(i, text(50) + passage + text(50 + i % 3)) for i in range(60)]
    rows += [(100 + i, "".join("0" if k < 50 and k % 5 == 2 else c for k, c in enumerate(rows[i][1]))) for i in range(0, 60, 6)]
    got = {r.doc_id for r in lines.dedup_lines(frame(spark, rows)).collect() if r.n_removed}
    assert got == {100 + i for i in range(0, 60, 6)}


def test_line_dedup_fetches_only_lines_that_can_be_similar(spark, monkeypatch):
    """Lines around one passage whose lengths are unlike have buckets in common, but their texts are not copied."""
    rng = random.Random(36)
    text = lambda n: "".join(rng.choice("bcdfgjkmpquvwxyz") for _ in range(n))
    passage = text(150)
    rows = [(i, passage + text(round(20 * 1.2**i))) for i in range(0, 16, 2)]
    rows += [(100, text(200)), (101, "a lone line of its own")]
    rows.append((102, rows[-2][1][:150] + "0" + rows[-2][1][151:]))
    fetched, known = [], lines.materialise

    def look(df, name, *done):
        out = known(df, name, *done)
        if name == "line-texts":
            fetched.append({r.norm for r in out.select("norm").collect()})
        return out

    monkeypatch.setattr(lines, "materialise", look)
    got = {r.doc_id for r in lines.dedup_lines(frame(spark, rows)).collect() if r.n_removed}
    assert got == {102}
    like = lambda a, b: min(len(a), len(b)) >= 0.9 * max(len(a), len(b))
    can = {t for _, t in rows if any(like(t, u) for _, u in rows if t != u)}
    assert len(can) < len(rows) - 3
    assert fetched and set().union(*fetched) <= can


def test_line_dedup_keeps_lines_of_other_digits(spark):
    rows = [(1, "2019: 1,204\n7: 5\n+49 30 5550100"), (2, "7: 6\n2020: 3,881\n+49 30 7770199"), (3, "7: 5"), (4, "the meter of house 4 reads 20177 units"), (5, "the meter of house 5 reads 20177 units")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "", 4: rows[3][1], 5: ""}


# ---- near duplicates


def components(rows, share=75, of=100):
    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets, key=lambda d: -1 if d is None else d)
    up = {d: d for d in ids}
    root = lambda d: d if up[d] == d else root(up[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and of * both >= share * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=lambda d: -1 if d is None else d)
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def test_near_duplicates(spark, sample):
    want = components(sample)
    got = neardup.near_duplicates(frame(spark, sample)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    out = neardup.without_near_duplicates(frame(spark, sample))
    assert out.columns == frame(spark, sample).columns
    assert {r.doc_id for r in out.collect()} == {d for d, (_, c) in want.items() if d == c}


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """Short texts around one common passage: they share bands but do not link, beside true near copies."""
    from millrace.llm import graph

    monkeypatch.setattr(graph, "SMALL", 8)
    rng = random.Random(12)
    common = prose(rng, 24)
    rows = [(i, common + " " + prose(rng, 11)) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(10)]
    want = components(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_repeats_and_empty(spark):
    text = prose(random.Random(1), 30)
    got = neardup.near_duplicates(spark.createDataFrame([(5, text), (5, text), (3, text), (9, None), (8, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (8, 8, True), (9, 9, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- media


def test_media_round_trip(spark, sample):
    got = {r.doc_id: r for r in media.store_and_read(frame(spark, sample)).collect()}
    assert len(got) == len(sample)
    for d, t in sample:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), None)
        stored = media.encode_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_member_fails_alone(spark):
    directory = media.write_archive(spark.createDataFrame([(i, f"text {i} " * 20) for i in range(20)], "doc_id long, text string").coalesce(1))
    index = spark.read.parquet(f"{directory}/index").orderBy("offset").collect()
    path = f"{directory}/{index[7].archive}".removeprefix("file://")
    with open(path, "r+b") as f:
        f.seek(index[7].offset + 50)
        f.write(b"\xff\xff\xff")
    rows = media.read_archive(spark, directory, splitBytes=400, batchBytes=500)
    assert rows.rdd.getNumPartitions() > 1
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == 20
    assert [d for d, r in got.items() if r.error] == [index[7].doc_id]
    assert got[index[7].doc_id].payload is None


def test_media_ranges_hold_each_member_once(spark):
    """One giant member among small ones, over several archives and byte ranges."""
    rows = [(i, "x" * (200_000 if i == 11 else 50 + i)) for i in range(40)]
    directory = media.write_archive(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = media.read_archive(spark, directory, splitBytes=300)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(40))


EMPTY = {
    "fingerprints": lambda d: fingerprints.fingerprint_with_edits(d),
    "suffixes": lambda d: suffixes.remove_repeats(d),
    "packing": lambda d: packing.pack(d, public_path()),
    "lines": lambda d: lines.dedup_lines(d),
    "media": lambda d: media.store_and_read(d),
    "warc": lambda d: warc.page_digests(warc.round_trip(d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html")))),
}


def public_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](frame(spark, []).drop("n")).count() == 0


@pytest.mark.parametrize("name", ["fingerprints", "packing", "lines", "media", "warc"])
def test_repeated_rows_and_clashing_columns(spark, name):
    rows = [(1, "one line of several words here\nand another"), (1, "one line of several words here\nand another"), (2, None), (3, ""), (None, "null id")]
    out = EMPTY[name](frame(spark, rows))
    ids = [r[0] for r in out.select(out.columns[0]).collect()]
    assert {i for i in ids} == {1, 2, 3, None}
    assert ids.count(1) == 2


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows, labels = labelled_texts(spark, 120)
    near = [(500 + i, rows[i][1] + " tail") for i in range(1, 9)]
    frame(spark, [*rows, *near, (900, None)]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        docs = shared.materialise(out, "t")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() >= docs.count()
