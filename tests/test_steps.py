"""Single steps on small frames: the behaviour that recipes rely on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions.conditions import holds
from millrace.functions.derive import derive
from millrace.operators import columns, fuzzy, impute, moves, numeric, rows, text, types
from millrace.plans.recipe import Context, compile_recipe, validate


def values(df, column, order="id"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("case", "given", "want"),
    [("lower", "  ALICE ", "alice"), ("upper", " bob ", "BOB"), ("capitalize", " MARY ANN", "Mary ann"), ("title", "o'connor", "O'Connor"), ("title", "jean-luc PICARD", "Jean-Luc Picard"), ("preserve", " aB ", "aB")],
)
def test_normalize(spark, case, given, want):
    df = frame(spark, [(1, given), (2, None)], "id int, v string")
    assert values(text.normalize(df, "v", {"case": case}), "v") == [want, None]


def test_normalize_rejects_unknown_case(spark):
    with pytest.raises(ValueError, match="case"):
        text.normalize(frame(spark, [(1, "a")], "id int, v string"), "v", {"case": "odd"})


def test_unicode_normalize_removes_accents(spark):
    df = frame(spark, [(1, "José"), (2, "Müller"), (3, "Zürich"), (4, "plain"), (5, None)], "id int, v string")
    assert values(text.unicode_normalize(df, "v", {"form": "NFC", "remove_diacritics": True}), "v") == ["Jose", "Muller", "Zurich", "plain", None]
    assert values(text.unicode_normalize(df, "v", {"form": "NFC"}), "v")[0] == "José"


@pytest.mark.parametrize("form", text.FORMS)
def test_accents_of_all_letters(spark, form):
    """Letters one by one, and beside marks and Hangul, which do depend on their neighbours."""
    import unicodedata

    each = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x2100), 0xAC01, 0x1100, 0x1161]]
    given = [*each, *(f"a{c}\u0301\u0591e" for c in each), *(f"é{c}ß" for c in each), "\u1100\u1161", "", None]
    apart = "NFKD" if form.startswith("NFK") else "NFD"
    bare = lambda v: "".join(c for c in unicodedata.normalize(apart, v) if not "\u0300" <= c <= "\u036f")
    df = frame(spark, list(enumerate(given)), "id int, v string")
    assert values(text.unicode_normalize(df, "v", {"form": form, "remove_diacritics": True}), "v") == [None if v is None else unicodedata.normalize(form, bare(v)) for v in given]
    assert values(text.unicode_normalize(df, "v", {"form": form}), "v") == [None if v is None else unicodedata.normalize(form, v) for v in given]


def test_accents_are_removed_from_a_few_texts_at_a_time(spark):
    """The memory beside a batch and its result is that of a few texts; the texts in all their forms take some times theirs."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["é" * 5_000 for _ in range(640)], pa.string())
    tracemalloc.start()
    try:
        made = text.normal_form("NFC", True).func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made) == 640
    assert made[639].as_py() == "e" * 5_000
    assert peak < 5_000 * 2 * 640 / 2


def test_replace_map_regex(spark):
    df = frame(spark, [(1, "a.b.a"), (2, None)], "id int, v string")
    assert values(text.replace(df, "v", {"old": "a", "new": "$"}), "v") == ["$.b.$", None]
    assert values(text.replace(df, "v", {"old": "a", "new": "$", "first": True}), "v") == ["$.b.a", None]
    assert values(text.map_values(df, "v", {"mapping": {"a.b.a": "x"}}), "v") == ["x", None]
    assert values(text.map_values(df, "v", {"mapping": {"a.b": "x"}}), "v") == ["a.b.a", None]
    assert values(text.regex_replace(df, "v", {"pattern": r"(\w)\.(?P<n>\w)", "replace": r"\g<n>-\1"}), "v") == ["b-a.a", None]
    with pytest.raises(ValueError, match="flag"):
        text.regex_replace(df, "v", {"pattern": "a", "flags": "q"})


def test_large_map_is_joined(spark):
    df = frame(spark, [(1, "k5"), (2, "other")], "id int, v string")
    assert values(text.map_values(df, "v", {"mapping": {f"k{i}": f"v{i}" for i in range(1500)}}), "v") == ["v5", "other"]


def test_cast(spark):
    df = frame(spark, [(1, "$1,000"), (2, "ten"), (3, "(2)"), (4, None), (5, "3.9")], "id int, v string")
    assert values(types.cast(df, "v", {"type": "int"}), "v") == [1000, None, 2, None, 3]
    assert values(types.cast(df, "v", {"type": "float", "parens": "negative"}), "v") == [1000.0, None, -2.0, None, 3.9]
    with pytest.raises(ValueError, match="type"):
        types.cast(df, "v", {"type": "odd"})


def test_cast_dates(spark):
    df = frame(spark, [(1, "2024-03-05"), (2, "03/05/2024"), (3, "05-Mar-24"), (4, "2024-02-30"), (5, "not a date")], "id int, v string")
    assert values(types.cast(df, "v", {"to_type": "datetime", "format": "%Y-%m-%d"}), "v") == ["2024-03-05", "2024-03-05", "2024-03-05", None, None]
    out = types.cast(df, "v", {"type": "datetime", "on_invalid": {"action": "set_error", "column": "e"}})
    assert values(out, "e") == [None, None, None, "invalid", "invalid"]


def test_cast_bool(spark):
    df = frame(spark, [(1, "Yes"), (2, "f"), (3, "7"), (4, "maybe"), (5, None)], "id int, v string")
    assert values(types.cast(df, "v", {"type": "bool"}), "v") == [True, False, True, None, None]


def test_abs_only_on_its_column(spark):
    df = frame(spark, [(1, -1.5, -2), (2, 3.0, -4)], "id int, a double, b int")
    out = numeric.numeric_transform(df, "a", {"op": "abs"})
    assert values(out, "a") == [1.5, 3.0]
    assert values(out, "b") == [-2, -4]


def test_numeric_text_and_moves(spark):
    df = frame(spark, [(1, "1", "p"), (2, "x", "q"), (3, "(2)", "r"), (4, "$3", "s"), (5, None, "t")], "id int, a string, b string")
    assert values(moves.remove_by_type(df, "a", {"target_type": "numeric"}), "a") == ["", "x", "", "", None]
    assert moves.rows_removed(df, "a", {"target_type": "numeric"}).first()[0] == 3
    moved = moves.move_by_type(df, {"source": "a", "target": "b", "type": "numeric"})
    assert values(moved, "b") == ["1", "q", "(2)", "$3", "t"]
    assert values(moved, "a") == ["", "x", "", "", None]


def test_swap(spark):
    df = frame(spark, [(1, "12", "abc"), (2, "abc", "12"), (3, "7", "8")], "id int, a string, b string")
    out = moves.swap_by_types(df, {"moves": [{"source": "a", "target": "b", "type": "numeric"}, {"source": "b", "target": "a", "type": "string"}]})
    assert [tuple(r) for r in out.orderBy("id").select("a", "b").collect()] == [("abc", "12"), ("abc", "12"), ("", "7")]


def test_bucketize_first_bucket_wins(spark):
    df = frame(spark, [(1, "5 units"), (2, "10"), (3, "11"), (4, "none"), (5, None)], "id int, v string")
    out = numeric.bucketize(df, "v", {"buckets": [{"min": 0, "max": 10, "label": "low"}, {"min": 5, "label": "high"}]})
    assert values(out, "v") == ["low", "low", "high", "none", None]


def test_quantile_buckets(spark):
    df = spark.range(1, 101).select(F.col("id").alias("v"))
    rows = numeric.suggest_buckets(df, "v", "quantile", 4).orderBy("label").collect()
    assert [(r.label, r.min, r.max) for r in rows] == [("b1", 1.0, 25.0), ("b2", 25.0, 50.0), ("b3", 50.0, 75.0), ("b4", 75.0, 100.0)]
    assert numeric.suggest_buckets(df.limit(0), "v", "quantile", 4).count() == 0


def test_conditions(spark):
    df = frame(spark, [(1, 1, "x"), (2, 6, "x"), (3, 7, "y"), (4, None, "x")], "id int, a int, b string")
    both = {"op": "and", "conds": [{"column": "a", "op": ">", "value": 5}, {"column": "b", "op": "==", "value": "x"}]}
    either = {"op": "or", "conds": [{"column": "a", "op": ">", "value": 6}, {"column": "b", "op": "=", "value": "x"}]}
    assert values(df.where(holds(df, both)), "id") == [2]
    assert values(df.where(holds(df, either)), "id") == [1, 2, 3, 4]
    assert values(columns.conditional(df, "b", {"value": "z", "condition": both}), "b") == ["x", "z", "y", "x"]
    for bad in ({"op": "and", "conds": []}, {"column": "a", "op": "~", "value": 1}, {"column": "none", "op": "==", "value": 1}):
        with pytest.raises(ValueError):
            holds(df, bad)


def test_derive_follows_python(spark):
    df = frame(spark, [(1, "Ann", "Lee", 30, None), (2, "Bob", "Ray", 15, 0.0), (3, None, "Kim", None, 2.0)], "id int, first string, last string, age int, x double")
    out = derive(df, [{"if": "age >= 18", "then": {"col": "full", "value": "first + ' ' + last"}}, {"if": "not x", "then": {"col": "flag", "value": "1"}}, {"then": {"col": "m", "value": "-7 % 3"}}, {"then": {"col": "q", "value": "age / x"}}, {"if": "18 <= age < 40", "then": {"col": "band", "value": "'mid'"}}, {"if": "'a' in last", "then": {"col": "has", "value": "True"}}, {"if": "first != 'Ann'", "then": {"col": "other", "value": "1"}}])
    assert values(out, "full") == ["Ann Lee", None, None]
    assert values(out, "flag") == [1, 1, None]
    assert values(out, "m") == [2, 2, 2]
    assert values(out, "q") == [None, None, None]
    assert values(out, "band") == ["mid", None, None]
    assert values(out, "has") == [None, True, None]
    assert values(out, "other") == [None, 1, 1]


def test_impute(spark):
    df = frame(spark, [(1, 20.0, 21.0, "P"), (2, None, 30.0, "P"), (3, 25.0, 26.0, "Q"), (4, None, 28.0, "Q"), (5, 29.0, 31.0, "Q")], "id int, age double, guess double, city string")
    run = lambda p, order=None: values(impute.impute(df, "age", p, order), "age")
    assert run({"strategy": "from_column", "source": "guess"})[1] == 30.0
    assert run({"strategy": "mean", "group_by": "city"})[3] == 27.0
    assert run({"strategy": "ffill"}, "id") == [20.0, 20.0, 25.0, 25.0, 29.0]
    assert run({"strategy": "bfill"}, "id") == [20.0, 25.0, 25.0, 29.0, 29.0]
    assert run({"strategy": "median"})[1] == 25.0
    assert run({"strategy": "constant", "value": 0})[1] == 0.0
    assert run({"strategy": "row_mean", "sources": ["guess"]})[1] == 30.0
    with pytest.raises(ValueError, match="strategy"):
        run({"strategy": "odd"})
    with pytest.raises(ValueError, match="order"):
        run({"strategy": "ffill"})


def test_impute_leaves_metadata(spark):
    df = frame(spark, [(1, None)], "id int, _meta string")
    assert values(impute.impute(df, "_meta", {"strategy": "constant", "value": "x"}), "_meta") == [None]


def test_regression(spark):
    rows = [(i, 150.0 + i, 50.0 + (i * 7) % 13, None if i % 10 == 0 else 0.5 * (150 + i) + 0.3 * (50 + (i * 7) % 13) + 2) for i in range(50)]
    df = frame(spark, rows, "id int, h double, w double, age double")
    out = values(impute.impute(df, "age", {"strategy": "regression", "sources": ["h", "w"]}), "age")
    assert all(abs(v - (0.5 * r[1] + 0.3 * r[2] + 2)) < 1e-6 for v, r in zip(out, rows, strict=True))
    with pytest.raises(ValueError, match="depend"):
        impute.impute(df.withColumn("h2", F.col("h") * 2), "age", {"strategy": "regression", "sources": ["h", "h2"]})


def test_safe_rename(spark):
    df = frame(spark, [(1, 2, 3)], "name int, name_1 int, other int")
    out, applied = columns.safe_rename(df, {"other": "name"})
    assert applied == {"other": "name_2"}
    assert out.columns == ["name", "name_1", "name_2"]
    assert columns.rename(df, ["name", "other"], ["other", "name"]).columns == ["other", "name_1", "name"]


def test_fuzzy_dedupe_is_greedy(spark):
    names = ["Alice", "Alic3", "Bob", "Robert", "Rob", "", None]
    df = frame(spark, list(enumerate(names)), "id int, name string")
    kept = set(values(fuzzy.fuzzy_dedupe(df, ["name"], "id", 0.6), "id"))
    import difflib

    leaders, want = [], set()
    for i, n in enumerate(names):
        key = (n or "").lower()
        if not any(difflib.SequenceMatcher(None, a, key).ratio() >= 0.6 or a == key for a in leaders):
            leaders.append(key)
            want.add(i)
    assert kept == want


@pytest.mark.parametrize("cutoff", [0.7, 0.8, 0.9])
def test_candidates_lose_no_match(spark, cutoff):
    import difflib
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    words = sorted({w for b in base for w in (b, b[:3] + "x" + b[3:], b[1:], b.replace("a", "e", 1))})
    df = frame(spark, [(w,) for w in words], "k string")
    got = {(r.a, r.b) for r in fuzzy.matching_pairs(df, df, cutoff).collect()}
    want = {(a, b) for a in words for b in words if difflib.SequenceMatcher(None, a, b).ratio() >= cutoff}
    assert got == want


def jaccard_leaders(rows, threshold):
    """The ids that a greedy pass by id keeps."""
    leaders, kept = [], set()
    for i, t in rows:
        key = " ".join((t or "").lower().split())
        words = set(key.split())
        if not any(key == k or (words and w and len(words & w) >= threshold * len(words | w) - 1e-9) for k, w in leaders):
            leaders.append((key, words))
            kept.add(i)
    return kept


def test_minhash_dedupe_reads_whole_texts(spark, tmp_path):
    import random

    import __spark_entry__ as entry

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.sample(words, 60) for _ in range(12)]
    rows = [(i, "same head line\n" + " ".join(w)) for i, w in enumerate(base)]
    rows += [(100 + i, "other head %d\n" % i + " ".join(w[:57])) for i, w in enumerate(base)]
    rows += [(200 + i, "same head line\n" + " ".join(w[:40] + rng.sample(words, 20))) for i, w in enumerate(base)]
    rows += [(300, None), (301, ""), (302, " \n ")]
    frame(spark, rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = set(values(entry.queries()["d03_minhash_dedupe"](spark, f"{tmp_path}"), "doc_id", "doc_id"))
    assert got == jaccard_leaders(rows, 0.8)
    assert set(range(12)) <= got and not got & set(range(100, 112))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_minhash_pairs_lose_no_match(spark, threshold):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    side = lambda n: sorted({" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(n)} | {"common", ""})
    left, right = side(150), side(150)
    got = {(r.a, r.b): r.distance for r in fuzzy.minhash_pairs(frame(spark, [(k,) for k in left], "k string"), frame(spark, [(k,) for k in right], "k string"), threshold).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    want = {(a, b): 1 - s for a in right for b in left if (s := like(set(a.split()), set(b.split()))) >= threshold - 1e-9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9, 1.0])
def test_sets_meet_in_parts_without_loss(spark, threshold):
    """Every similar pair is found, also of small sets with empty parts; sets that share common words alone do not meet."""
    import random

    rng = random.Random(12)
    sets = [rng.sample(range(1000), n) for n in [*range(1, 40), 60, 90, 200, 200, 400] for _ in range(2)]
    near = []
    for s in sets:
        for _ in range(3):
            gone = rng.randint(0, max(1, len(s) // 5))
            near.append(s[gone:] + rng.sample(range(1000, 9000), rng.randint(0, max(0, len(s) // 5 - gone) + 1)))
    sets = [set(s) for s in [*sets, *near] if s]
    common = [{*range(20_000, 20_030), *rng.sample(range(30_000, 90_000), 60)} for _ in range(60)]
    rows = [(i, sorted(s)) for i, s in enumerate(sets + common)]
    df = frame(spark, rows, "k long, w array<long>")
    hashed = df.select("k", F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    got = {(r.a, r.b) for r in fuzzy.set_pairs(hashed, threshold).collect()}
    both = sets + common
    want = {(i, j) for j in range(len(both)) for i in range(j) if len(both[i] & both[j]) >= threshold * len(both[i] | both[j]) - 1e-9}
    assert len(want) > 20 and want <= got
    # parts are so many at a low threshold that they hold single words
    assert threshold < 0.8 or sum(i >= len(sets) for i, _ in got) <= 5


def test_random_keys_seldom_share_runs(spark):
    """The runs are as long as the cutoff allows: at 0.85 keys of 22 characters share five in a row, of which random keys
    have far fewer in common than of four."""
    import random

    rng = random.Random(14)
    keys = frame(spark, [("".join(rng.choices("0123456789abcdef", k=22)),) for _ in range(1500)], "k string")
    met = fuzzy.slots(keys, keys, 0.85).groupBy("slot").count().agg(F.sum(F.expr("count * (count - 1) / 2")).alias("n")).first().n
    assert met < 2500


def test_recipe_validation_and_missing_column(spark):
    with pytest.raises(ValueError, match="step 0"):
        validate({"cleaning_steps": [{"action": "odd", "column": "a"}]})
    with pytest.raises(ValueError, match="step 1"):
        validate({"cleaning_steps": [{"action": "drop_column", "column": "a"}, {"action": "map", "column": "a", "params": {}}]})
    df = frame(spark, [(1, "A")], "id int, v string")
    context = Context()
    out = compile_recipe(df, {"cleaning_steps": [{"action": "normalize", "column": ["v", "gone"], "params": {}}]}, context)
    assert values(out, "v") == ["a"]
    assert context.warnings == [{"step": 0, "action": "normalize", "column": "gone", "warning": "column_missing"}]


def test_conditional_step(spark):
    df = frame(spark, [(1, "A", 1), (2, "B", 9)], "id int, v string, n int")
    recipe = {"cleaning_steps": [{"action": "normalize", "column": "v", "params": {"case": "lower", "condition": {"column": "n", "op": ">", "value": 5}}}]}
    assert values(compile_recipe(df, recipe), "v") == ["A", "b"]


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_backward_fill_has_no_frame_to_the_end(spark, keys):
    """Spark works a frame from the current row to the end anew for each row."""
    n = 20_000
    df = spark.range(n).select("id", F.lit(1).alias("k"), F.when((F.col("id") % 1000 == 999) & (F.col("id") < 15_000), F.col("id")).alias("v"))
    made = rows.fill(df, ["v"], "id", keys, backward=True)
    assert "currentrow$(), unboundedfollowing$()" not in made._jdf.queryExecution().analyzed().toString().lower()
    assert made.columns == ["id", "k", "v"]
    assert made.where("v <=> CASE WHEN id < 15000 THEN id div 1000 * 1000 + 999 END").count() == n


@pytest.mark.parametrize("cutoff", [0.75, 0.8, 0.85, 0.95])
def test_slots_of_characters_lose_no_match(spark, cutoff):
    """Differences spread over a key as thinly as the ratio allows, and keys with repeated runs."""
    import difflib
    import random

    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (9, 10, 14, 22, 22, 31, 45, 60)] + ["ab" * 8, "a" * 20, "abcd" * 5]

    def spread(text: str, every: int) -> str:
        """Every so many characters one is lost or added, in turn."""
        out = []
        for i, c in enumerate(text):
            out.append("" if i % (2 * every) == every - 1 else c + "#" if i % (2 * every) == 2 * every - 1 else c)
        return "".join(out)

    words = sorted({w for b in base for w in (b, *(spread(b, n) for n in (2, 3, 4, 5)), spread(b[::-1], 3)[::-1], "##" + b, b + "##", b[:4] + "##" + b[4:-4] + "##" + b[-4:], b[3:] + b[:3])})
    df = frame(spark, [(w,) for w in words], "k string")
    got = {(r.a, r.b) for r in fuzzy.matching_pairs(df, df, cutoff).collect()}
    assert got == {(a, b) for a in words for b in words if difflib.SequenceMatcher(None, a, b).ratio() >= cutoff}


def test_unlike_keys_seldom_meet(spark):
    """Random keys meet in their slots about as often as there are keys, not as there are pairs."""
    keys = spark.range(4000).select(F.substring(F.base64(F.unhex(F.md5(F.col("id").cast("string")))), 1, 22).alias("k"))
    filed = fuzzy.slots(keys, keys, 0.8).select("k", "slot").distinct().groupBy("slot").agg(F.count("*").alias("n"))
    met = filed.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("met")).first().met
    assert met < 40 * 4000 and fuzzy.bigram_pairs(keys, keys, 0.8).isEmpty()


def test_fuzzy_search_reads_its_tables_once(spark, tmp_path):
    frame(spark, [("large ring",), ("larga ring",), ("old gear",)], "k string").write.parquet(f"{tmp_path}/keys")
    keys = spark.read.parquet(f"{tmp_path}/keys").distinct()
    pairs = fuzzy.matching_pairs(keys, spark.read.parquet(f"{tmp_path}/keys").distinct(), 0.8)
    assert pairs.where("a < b").select("a", "b").collect() == [("larga ring", "large ring")]
    # the tables are behind the written keys, so the search itself has none of their scans
    assert "parquet" not in pairs._jdf.queryExecution().toString()
