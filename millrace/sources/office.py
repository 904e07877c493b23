"""Office files to the long form: XLSX cells, DOCX and PPTX paragraphs and table cells.

Spark reads the files and deals them out; a task unzips one file at a time and walks its XML with the standard library.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.readers import LONG_FORM

FIELDS = LONG_FORM.names


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def inner(node: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in node.iter() if local(x.tag) == name]


def joined(node: ET.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in inner(node, name))


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n


def xlsx_units(z: zipfile.ZipFile) -> Iterator[dict]:
    """A row per filled cell: sheet, row, column, coordinate, text, and formula and format in style_json."""
    names = z.namelist()
    shared = [joined(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")) if local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    book = ET.fromstring(z.read("xl/workbook.xml"))
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
    for i, sheet in enumerate(inner(book, "sheet"), 1):
        rid = next((v for k, v in sheet.attrib.items() if local(k) == "id"), None)
        target = (rels.get(rid) or f"worksheets/sheet{i}.xml").lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        for c in inner(ET.fromstring(z.read(target)), "c"):
            ref, kind = c.get("r") or "", c.get("t")
            unit = {"unit_kind": "cell", "container_name": sheet.get("name"), "sheet_name": sheet.get("name"), "cell_label": ref, "row_index": int(re.sub(r"\D", "", ref) or 0), "column_index": column_number(ref)}
            try:
                value = next((x.text or "" for x in c if local(x.tag) == "v"), "")
                text = shared[int(value)] if kind == "s" and value else joined(c) if kind == "inlineStr" else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
                formula = next((x.text for x in c if local(x.tag) == "f"), None)
                if text or formula:
                    yield unit | {"text": text, "style_json": json.dumps({"style": c.get("s"), "formula": formula})}
            except (ValueError, IndexError) as e:
                yield unit | {"unit_kind": "cell_error", "text": "", "notes": str(e)}


def table_units(rows: list[list[ET.Element]], index: int, extra: dict) -> Iterator[dict]:
    for r, cells in enumerate(rows, 1):
        for c, cell in enumerate(cells, 1):
            yield extra | {"unit_kind": "table_cell", "table_index": index, "row_index": r, "column_index": c, "text": joined(cell)}


def docx_units(z: zipfile.ZipFile) -> Iterator[dict]:
    """Paragraphs of the body with their style and counts of bold and italic runs, then the cells of each table."""
    body = next(x for x in ET.fromstring(z.read("word/document.xml")) if local(x.tag) == "body")
    for i, p in enumerate([x for x in body if local(x.tag) == "p"], 1):
        style = next((next(iter(x.attrib.values()), None) for x in inner(p, "pStyle")), None)
        if joined(p).strip():
            yield {"unit_kind": "paragraph", "paragraph_index": i, "text": joined(p), "style_json": json.dumps({"style": style, "runs": len(inner(p, "r")), "bold": len(inner(p, "b")), "italic": len(inner(p, "i"))})}
    for i, t in enumerate([x for x in body if local(x.tag) == "tbl"], 1):
        yield from table_units([[c for c in r if local(c.tag) == "tc"] for r in t if local(r.tag) == "tr"], i, {})


def pptx_units(z: zipfile.ZipFile) -> Iterator[dict]:
    """Paragraphs and table cells of each slide's shapes, slide by slide."""
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for number, name in slides:
        count = tables = 0
        for shape in ET.fromstring(z.read(name)).iter():
            where = {"slide_number": number, "container_name": f"slide {number}"}
            if local(shape.tag) == "sp":
                for p in inner(shape, "p"):
                    count += 1
                    if joined(p).strip():
                        yield where | {"unit_kind": "paragraph", "paragraph_index": count, "text": joined(p)}
            elif local(shape.tag) == "tbl":
                tables += 1
                yield from table_units([[c for c in r if local(c.tag) == "tc"] for r in shape if local(r.tag) == "tr"], tables, where)


READERS = {"xlsx": xlsx_units, "docx": docx_units, "pptx": pptx_units}


def units(path: str, content: bytes) -> list[dict]:
    """All units of a file; one that cannot be read gives an error row."""
    kind = path.lower().rpartition(".")[2]
    base = {"source_kind": kind, "source_name": path.rpartition("/")[2], "source_path": path}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [base | u for u in READERS[kind](z)]
    except (zipfile.BadZipFile, KeyError, ET.ParseError, StopIteration) as e:
        return [base | {"unit_kind": "file_error", "text": "", "notes": f"{type(e).__name__}: {e}"}]


def file_rows(files: DataFrame) -> DataFrame:
    """The long form of office files (path, content), each walked by the task that has it; other suffixes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for file, content in zip(some["path"], some["content"], strict=True):
                rows = units(file, content)
                if rows:
                    yield pd.DataFrame(rows, columns=FIELDS).astype({f.name: "Int32" if f.dataType.typeName() == "integer" else object for f in LONG_FORM.fields})

    return files.where(F.lower("path").rlike(r"\.(xlsx|docx|pptx)$")).select("path", "content").mapInPandas(run, LONG_FORM)


def office_rows(spark: SparkSession, path: str) -> DataFrame:
    """The long form of all office files under path."""
    return file_rows(spark.read.format("binaryFile").load(path))
