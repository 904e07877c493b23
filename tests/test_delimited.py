"""Delimited text in splits, against Python's reader of whole files."""

from __future__ import annotations

import csv
import io
import random

import pytest

from millrace.sources import delimited, readers

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split_bytes(spark):
    """Sets the size of splits; the session's own setting is put back."""
    before = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}

    def put(n: int) -> None:
        spark.conf.set(SPLIT, str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def table(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    parts = ["a", "bé", '"', '""', "\n", "\r\n", ",", ";", " ", "x" * 30, "\n\n", '",', ',"', '"\n']
    value = lambda: "v" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) + "w"
    return [[str(i), value(), "plain", value()] for i in range(n)]


def written(rows: list[list[str]], end: str = "\n", header: tuple[str, ...] = ("id", "a", "b", "c")) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([header, *rows])
    return out.getvalue().encode()


@pytest.mark.parametrize(("end", "sizes"), [("\n", (41, 64, 333, 5000)), ("\r\n", (97,))])
def test_quoted_newlines_at_every_split_size(spark, tmp_path, split_bytes, end, sizes):
    want = []
    for k in range(3):
        rows = [[f"{k}-{r[0]}", *r[1:]] for r in table(k, 60)]
        (tmp_path / f"f{k}.csv").write_bytes(written(rows, end))
        want += rows
    for size in sizes:
        split_bytes(size)
        got = delimited.read_quoted(spark, f"file://{tmp_path}", ",")
        assert got.columns == ["id", "a", "b", "c"]
        assert sorted(list(r) for r in got.collect()) == sorted(want)


def test_one_value_over_many_splits(spark, tmp_path, split_bytes):
    long = "first\n" + "line without quote\n" * 40 + 'a ""quoted"" word\n' + "more\n" * 40 + "last"
    rows = [["1", long, "x", "y"], ["2", "short", "x", "y"], ["3", long, long, "z"]]
    (tmp_path / "t.csv").write_bytes(written(rows))
    for size in (50, 200, 1 << 20):
        split_bytes(size)
        assert sorted(list(r) for r in delimited.read_quoted(spark, f"file://{tmp_path}/t.csv", ",").collect()) == rows
    split_bytes(200)
    assert delimited.records(spark, f"file://{tmp_path}/t.csv", ",").rdd.getNumPartitions() > 4


def test_a_header_with_newlines_and_a_value_that_never_closes(spark, tmp_path, split_bytes):
    (tmp_path / "h.csv").write_bytes(written([["1", "b\nc", "d", "e"]], header=("id", "a\nlong header over a split", "b", "c")))
    (tmp_path / "open.csv").write_text('id,a\n1,"b"\n2,"never\nclosed, 3\n4')
    for size in (12, 1000):
        split_bytes(size)
        got = delimited.read_quoted(spark, f"file://{tmp_path}/h.csv", ",")
        assert got.columns == ["id", "a\nlong header over a split", "b", "c"]
        assert [list(r) for r in got.collect()] == [["1", "b\nc", "d", "e"]]
        rows = delimited.read_quoted(spark, f"file://{tmp_path}/open.csv", ",").orderBy("id").collect()
        assert [r.id for r in rows] == ["1", "2"]
        assert "closed, 3\n4" in rows[1].a


def test_stray_quotes_ragged_and_blank_lines(spark, tmp_path, split_bytes):
    (tmp_path / "t.csv").write_text('id,size,note\n1,5" pipe,"a\nb"\n\n2,6"x" bolt\n3,"7"" rod",x,cut\n4,NA,"say ""hi"""\n')
    for size in (9, 25, 1000):
        split_bytes(size)
        got = readers.read_delimited(spark, f"file://{tmp_path}/t.csv", infer=False).orderBy("id").collect()
        assert [tuple(r) for r in got] == [("1", '5" pipe', "a\nb"), ("2", '6"x" bolt', None), ("3", '7" rod', "x"), ("4", None, 'say "hi"')]


def test_plain_files_stay_with_sparks_reader(spark, tmp_path, split_bytes):
    (tmp_path / "t.csv").write_text('id;a\n1;"x;""y"""\n2;z\n')
    split_bytes(8)
    got = delimited.read_quoted(spark, f"file://{tmp_path}/t.csv", ";")
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("1", 'x;"y"'), ("2", "z")]
    (tmp_path / "none.csv").write_text("id;a\n")
    assert delimited.read_quoted(spark, f"file://{tmp_path}/none.csv", ";").count() == 0


def test_states_of_lines():
    cases = [('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('5" x', False, False), ('a, "b', False, False), ('"', False, True), ('""', False, False), ('"","', False, True), ('x",""', True, False), ('"a"b",c', False, False)]
    for line, inside, after in cases:
        assert delimited.open_after(line, inside, ",") is after
