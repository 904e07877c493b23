"""Sources, sinks, whole recipes and streams over files."""

from __future__ import annotations

import io
import zipfile
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest

from millrace.plans.recipe import apply_recipe
from millrace.sources import readers, writers
from millrace.streaming import incremental


def test_read_delimited(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,name,day,note\n1,"a, b",2024-01-02,NA\n2,c,2024-01-03\n3,d,2024-01-04,x,extra\n')
    df = readers.read_delimited(spark, f"file://{p}")
    rows = df.orderBy("id").collect()
    assert [(r.id, r.name, r.note) for r in rows] == [(1, "a, b", None), (2, "c", None), (3, "d", "x")]
    assert dict(df.dtypes)["id"] == "bigint"
    assert dict(df.dtypes)["day"] == "timestamp_ntz"


def test_no_separator(spark, tmp_path):
    p = tmp_path / "in.txt"
    p.write_text("alpha\nbeta\n")
    assert [r.value for r in readers.read_delimited(spark, f"file://{p}").collect()] == ["alpha", "beta"]


def test_apply_is_all_or_nothing(spark, tmp_path):
    source, out = tmp_path / "in.csv", tmp_path / "out.csv"
    source.write_text("a,b\n1,x\n2,y\n")
    recipe = {"sources": [{"path": f"file://{source}"}], "cleaning_steps": [], "outputs": [{"path": f"file://{out}"}]}
    told = apply_recipe(spark, recipe, snapshots=f"file://{tmp_path}/snap", runs=f"file://{tmp_path}/runs")
    assert sorted(map(tuple, spark.read.csv(f"file://{out}", header=True).collect())) == [("1", "x"), ("2", "y")]
    assert spark.read.parquet(told["snapshot"]).count() == 2
    assert spark.read.parquet(f"file://{tmp_path}/runs").first().status == "completed"
    assert not [p for p in tmp_path.iterdir() if ".tmp" in p.name or ".old" in p.name]


def test_failed_write_leaves_no_trace(spark, tmp_path):
    df = spark.sql("SELECT raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        writers.write_table(df, f"file://{tmp_path}/t")
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="brotli"):
        writers.write_table(spark.range(1), f"file://{tmp_path}/t", compression="brotli")


def test_a_table_may_replace_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writers.write_table(spark.range(5), path)
    writers.write_table(spark.read.parquet(path).where("id > 2"), path)
    assert spark.read.parquet(path).count() == 2


def test_drift_stops_a_run(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a\n1\n")
    with pytest.raises(ValueError, match="lacks"):
        apply_recipe(spark, {"sources": [{"path": f"file://{tmp_path}/in.csv"}], "expected_columns": ["a", "b"], "outputs": [{"path": f"file://{tmp_path}/o"}]})


def test_snapshot_retention(spark, tmp_path):
    now = datetime(2024, 5, 1, tzinfo=UTC)
    for days in (40, 10, 0):
        writers.snapshot(spark.range(3), f"file://{tmp_path}", "t", now - timedelta(days=days))
    assert writers.expire_snapshots(spark, f"file://{tmp_path}", "t", 30, now) == (1, 2)
    assert writers.snapshots(spark, f"file://{tmp_path}", "t").count() == 2


def test_text_to_long_form_and_back(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;age\nAnn;3\nBob;4\n".encode())
    rows = readers.ingest(spark, f"file://{tmp_path}")
    assert rows.columns == readers.LONG_FORM.names
    back = readers.reconstruct(rows)
    assert [(r.name, r.age) for r in back.orderBy("row_index").collect()] == [("Ann", "3"), ("Bob", "4")]


def test_encodings_and_placeholder(spark, tmp_path):
    (tmp_path / "latin.txt").write_bytes("caf\xe9 \x80".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    rows = {r.source_name: r for r in readers.ingest(spark, f"file://{tmp_path}").collect()}
    assert rows["latin.txt"].text == "café €"
    assert rows["empty.txt"].unit_kind == "placeholder"


def office(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2"><f>A2*2</f><v>14</v></c></row></sheetData></worksheet>'
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'
    (tmp_path / "b.xlsx").write_bytes(office({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": "<sst><si><t>twice</t></si></sst>"}))
    (tmp_path / "d.docx").write_bytes(office({"word/document.xml": "<document><body><p><r><t>Hello</t></r></p><tbl><tr><tc><p><r><t>x</t></r></p></tc></tr></tbl></body></document>"}))
    (tmp_path / "p.pptx").write_bytes(office({"ppt/slides/slide1.xml": "<sld><sp><txBody><p><r><t>Title</t></r></p></txBody></sp></sld>"}))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = readers.ingest(spark, f"file://{tmp_path}").collect()
    kinds = sorted((r.source_kind, r.unit_kind, r.text) for r in rows)
    assert kinds == [("docx", "paragraph", "Hello"), ("docx", "table_cell", "x"), ("pptx", "paragraph", "Title"), ("xlsx", "cell", "14"), ("xlsx", "cell", "7"), ("xlsx", "cell", "id"), ("xlsx", "cell", "twice"), ("xlsx", "file_error", "")]
    wide = readers.reconstruct(readers.ingest(spark, f"file://{tmp_path}/b.xlsx"))
    assert [tuple(r) for r in wide.select("id", "twice").collect()] == [("7", "14")]


def test_duplicate_files(spark, tmp_path):
    for name, body in (("a", "xx"), ("b", "xx"), ("c", "xy"), ("d", "longer")):
        (tmp_path / name).write_text(body)
    rows = readers.duplicate_files(spark, f"file://{tmp_path}").collect()
    assert [[Path(p).name for p in r.paths] for r in rows] == [["a", "b"]]


def test_audit_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "audit.log").write_text('{"data": {"event": "login", "ts": "t"}, "hmac": "h"}\nnot json\n')
    rows = readers.audit_lines(spark, f"file://{tmp_path}/audit.log").collect()
    assert {(r.data.event if r.data else None, r.raw) for r in rows} == {("login", None), (None, "not json")}


def test_shortcuts(spark, tmp_path):
    (tmp_path / "x.gdoc").write_text('{"title": "Plan", "url": "https://docs.example/d/abcdefghijkl/edit"}')
    rows = readers.ingest(spark, f"file://{tmp_path}").orderBy("unit_kind").collect()
    assert [(r.unit_kind, r.text) for r in rows] == [("shortcut_metadata", "Plan"), ("shortcut_reference", "https://docs.example/d/abcdefghijkl/edit")]
    assert "abcdefghijkl" in rows[0].style_json


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, " A "), (2, "B")], "id int, v string").write.parquet(f"file://{tmp_path}/in")
    stream = incremental.read_stream(spark, f"file://{tmp_path}/in", "id int, v string")
    steps = {"cleaning_steps": [{"action": "normalize", "column": "v", "params": {"case": "lower"}}]}
    incremental.run_stream(stream, steps, f"file://{tmp_path}/out", f"file://{tmp_path}/c1").awaitTermination()
    assert sorted(r.v for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]
    whole = {"cleaning_steps": [{"action": "groupby", "column": None, "params": {"columns": [], "aggregations": [{"op": "count", "as": "n"}]}}]}
    with pytest.raises(ValueError, match="whole table"):
        incremental.clean_stream(stream, whole)
    incremental.run_stream(stream, whole, f"file://{tmp_path}/agg", f"file://{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/agg").first().n == 2


def test_fields_of_long_lines_are_found_in_one_pass(spark):
    long = "x" * 200_000
    rows = [(1, "id,name,note"), (2, f'1,"a, ""b""",{long}'), (3, "2,,plain"), (4, '3,5" pipe,"q, r"')]
    df = spark.createDataFrame([("line", i, t) for i, t in rows], "unit_kind string, row_index int, text string")
    got = [(r.id, r["name"], r.note) for r in readers.wide_from_lines(df).orderBy("row_index").collect()]
    assert got[:2] == [("1", 'a, "b"', long), ("2", "", "plain")]
    assert got[2][0] == "3"
    many = spark.createDataFrame([("line", 1, ",".join(f'"{i}, {i}"' for i in range(3000)))], df.schema)
    assert len(readers.wide_from_lines(many).columns) == 3001
