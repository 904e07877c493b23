"""Different texts under one id, or under none: each is a document of its own."""

from __future__ import annotations

import hashlib
import random

from millrace.llm import lines, shared, suffixes

SCHEMA = "doc_id long, text string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def without_repeats(texts: list[bytes], length: int = 100) -> list[bytes]:
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            piece = t[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def test_suffixes_of_texts_that_share_an_id(spark):
    passage = words(1, 40)
    for shared_id in (None, 5):
        first, second, third = passage + words(2, 400), "short " + words(3, 4), words(4, 30)
        rows = [(shared_id, first), (shared_id, second), (shared_id, third), (9, third + passage + words(5, 10)), (9, third + passage + words(5, 10)), (10, words(6, 30))]
        got = sorted((r.doc_id or 0, r.n_bytes, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
        plain = [first, second, third, rows[3][1], rows[5][1]]
        kept = without_repeats([t.encode() for t in plain])
        ids = [shared_id or 0] * 3 + [9, 10]
        want = [(i, len(t.encode()), hashlib.sha256(k).hexdigest()) for i, t, k in zip(ids, plain, kept, strict=True)]
        assert got == sorted([*want, want[3]])  # the repeated row fares like its twin


def test_lines_of_texts_that_share_an_id(spark):
    same = "a line that two texts have in common word for word"
    rows = [(None, "first own line here one two\n" + same), (None, "second own line other three four\nonly here delta epsilon zeta eta\nlast of these five six"), (None, same + "\nthird text seven eight nine ten"), (4, "stands alone eleven twelve"), (4, "quite another line thirteen fourteen")]
    got = sorted(((r.doc_id or 0), r.text, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    texts = [t for _, t, _ in got]
    assert sum(t.count(same) for t in texts) == 1
    assert sum(n for *_, n in got) == 1
    for line in {x for _, t in rows for x in t.split("\n")}:
        assert sum(line in t.split("\n") for t in texts) == 1
    kept = lines.without_repeated_lines(spark.createDataFrame([(*r, "e") for r in rows], SCHEMA + ", id string"))
    assert kept.columns == ["doc_id", "text", "id"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted((i, t) for i, t, _ in got)


def test_keys_stay_where_ids_are_unique(spark):
    df = spark.createDataFrame([(3, "a"), (7, "b"), (7, "b")], "key long, text string")
    assert shared.own_keys(df) is df
    mixed = shared.own_keys(spark.createDataFrame([(3, "a", 1), (7, "b", 2), (7, "c", 3), (9, None, 4)], "key long, text string, n int"))
    assert mixed.columns == ["key", "text", "n"]
    keys = {r.n: r.key for r in mixed.collect()}
    assert keys[1] == 0
    assert {keys[2], keys[3]} == {1, 2}
    assert keys[4] == 3
