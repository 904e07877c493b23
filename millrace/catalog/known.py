"""Queries whose right answer is known from how their input is made: misspelt keys, office files, drifting records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Sequence
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.operators import fuzzy, quality
from millrace.sources.office import file_rows

# ---- misspelt keys: a key is 22 letters and digits; misspelt, one of them is a #. Two keys have less than 0.8 in common.


def spelt(s: SparkSession, d: str) -> DataFrame:
    """(c_custkey, name, typo): a customer's key and its misspelling."""
    name = F.substring(F.base64(F.unhex(F.md5(F.col("c_custkey").cast("string")))), 1, 22)
    at = F.col("c_custkey") % 15 + 4
    return table(s, d, "customer").select("c_custkey", name.alias("name"), F.overlay(name, F.lit("#"), at.cast("int")).alias("typo"))


SPELT = """
    SELECT c_custkey, name, substr(name, 1, c_custkey % 15 + 3) || '#' || substr(name, c_custkey % 15 + 5) AS typo
    FROM (SELECT c_custkey, substr(to_base64(unhex(md5(CAST(c_custkey AS VARCHAR)))), 1, 22) AS name FROM customer)
"""


def asked() -> Column:
    """The key, its misspelling, or one that is like no other."""
    kind = F.col("c_custkey") % 3
    return F.when(kind == 0, F.col("name")).when(kind == 1, F.col("typo")).otherwise(F.concat(F.repeat(F.lit("~"), 16), F.substring("name", 1, 6)))


ASKED = "CASE c_custkey % 3 WHEN 0 THEN name WHEN 1 THEN typo ELSE repeat('~', 16) || substr(name, 1, 6) END"


@register("j02b_fuzzy_join_known", f"SELECT c_custkey, {ASKED} AS asked, CASE WHEN c_custkey % 3 < 2 THEN c_custkey END AS right__id FROM ({SPELT})")
def j02b_join(s: SparkSession, d: str) -> DataFrame:
    """Keys, misspelt keys and others joined to the keys."""
    keys = spelt(s, d)
    left = keys.select("c_custkey", asked().alias("asked"))
    return fuzzy.fuzzy_join(left, keys.select(F.col("c_custkey").alias("id"), "name"), "asked", "name").select("c_custkey", "asked", "right__id")


@register("w09b_best_match_known", f"SELECT name AS a, typo AS b, CAST(42 AS DOUBLE) / 44 AS score FROM ({SPELT})")
def w09b_best(s: SparkSession, d: str) -> DataFrame:
    """The best match of each misspelt key: 21 of 22 letters are common."""
    keys = spelt(s, d)
    pairs = fuzzy.matching_pairs(keys.select(F.col("typo").alias("k")), keys.select(F.col("name").alias("k")), 0.8)
    return fuzzy.best_per_query(pairs).select("a", "b", "score")


def doubled(s: SparkSession, d: str) -> DataFrame:
    """Each key in upper case, then its misspelling."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("i"), F.upper("name").alias("key")), F.struct(F.lit(1).alias("i"), F.col("typo").alias("key"))))
    return spelt(s, d).select("c_custkey", both.alias("r")).select((F.col("c_custkey") * 2 + F.col("r.i")).alias("place"), "r.key")


DOUBLED = f"SELECT c_custkey * 2 AS place, upper(name) AS key FROM ({SPELT})"
register("d02b_fuzzy_dedupe_known", DOUBLED)(lambda s, d: fuzzy.fuzzy_dedupe(doubled(s, d), ["key"], "place", 0.85))
register("d04b_entity_resolution_known", DOUBLED)(lambda s, d: fuzzy.entity_resolution(doubled(s, d), ["key"], "place", 0.85))


@register("x11b_spell_correct_known", f"SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN name ELSE {ASKED} END AS out FROM ({SPELT})")
def x11b_spell(s: SparkSession, d: str) -> DataFrame:
    """Misspelt words by a vocabulary; words that are like none stay."""
    keys = spelt(s, d)
    return fuzzy.spell_correct(keys.select("c_custkey", asked().alias("out")), "out", keys.select(F.col("name").alias("word")), None, 0.8)


X17B = f"""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 2 THEN CAST(42 AS DOUBLE) / 44 ELSE CAST(0.95 AS DOUBLE) END AS score FROM ({SPELT})
"""


@register("x17b_similarity_known", X17B)
def x17b_similarity(s: SparkSession, d: str) -> DataFrame:
    """Equal in other case, held within the other on either side, and misspelt."""
    kind = F.col("c_custkey") % 4
    other = F.when(kind == 0, F.concat(F.lit(" "), F.upper("name"))).when(kind == 1, F.concat(F.lit("the "), F.col("name"))).when(kind == 2, F.col("typo")).otherwise(F.substring("name", 3, 10))
    return spelt(s, d).select("c_custkey", fuzzy.similarity(F.col("name"), other).alias("score"))


# ---- office files: one for every 50 suppliers, built in tasks and read from there


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def xlsx(keys: Sequence[int], names: Sequence[str]) -> bytes:
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{escape(text)}</t></is></c>'
    rows = "".join(f'<row r="{i}">{cell(f"A{i}", str(k))}{cell(f"B{i}", n)}</row>' for i, (k, n) in enumerate(zip(keys, names, strict=True), 1))
    return zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="suppliers"/></sheets></workbook>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def docx(keys: Sequence[int], names: Sequence[str]) -> bytes:
    body = "".join(f"<p><r><t>{k}: </t></r><r><t>{escape(n)}</t></r></p>" for k, n in zip(keys, names, strict=True))
    return zipped({"word/document.xml": f"<document><body>{body}</body></document>"})


def pptx(keys: Sequence[int], names: Sequence[str]) -> bytes:
    """A slide for each supplier."""
    slide = lambda k, n: f"<sld><sp><txBody><p><r><t>{k}</t></r></p><p><r><t>{escape(n)}</t></r></p></txBody></sp></sld>"
    return zipped({f"ppt/slides/slide{i}.xml": slide(k, n) for i, (k, n) in enumerate(zip(keys, names, strict=True), 1)})


def office_files(s: SparkSession, d: str, kind: str, make: Callable[[Sequence[int], Sequence[str]], bytes]) -> DataFrame:
    """(path, content): a file of that kind for every 50 suppliers."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("s_suppkey")
        return pd.DataFrame({"path": [f"suppliers-{rows['g'].iloc[0]}.{kind}"], "content": [make(rows["s_suppkey"].tolist(), rows["s_name"].tolist())]})

    some = table(s, d, "supplier").select("s_suppkey", "s_name", F.expr("CAST(s_suppkey AS BIGINT) div 50").alias("g"))
    return some.groupBy("g").applyInPandas(build, "path string, content binary")


PLACED = "SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) AS i, 'suppliers-' || (s_suppkey // 50) AS file FROM supplier"
S07 = f"""
    SELECT file || '.xlsx' AS source_name, 'cell' AS unit_kind, CAST(i AS INTEGER) AS row_index, 1 AS column_index, 'A' || i AS cell_label, CAST(s_suppkey AS VARCHAR) AS text FROM ({PLACED})
    UNION ALL
    SELECT file || '.xlsx', 'cell', CAST(i AS INTEGER), 2, 'B' || i, s_name FROM ({PLACED})
"""


@register("s07_xlsx", S07)
def s07_xlsx(s: SparkSession, d: str) -> DataFrame:
    """Cells of workbooks."""
    return file_rows(office_files(s, d, "xlsx", xlsx)).select("source_name", "unit_kind", "row_index", "column_index", "cell_label", "text")


@register("s08_docx", f"SELECT file || '.docx' AS source_name, 'paragraph' AS unit_kind, CAST(i AS INTEGER) AS paragraph_index, s_suppkey || ': ' || s_name AS text FROM ({PLACED})")
def s08_docx(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents, each of two runs."""
    return file_rows(office_files(s, d, "docx", docx)).select("source_name", "unit_kind", "paragraph_index", "text")


S09 = f"""
    SELECT file || '.pptx' AS source_name, CAST(i AS INTEGER) AS slide_number, 1 AS paragraph_index, CAST(s_suppkey AS VARCHAR) AS text FROM ({PLACED})
    UNION ALL
    SELECT file || '.pptx', CAST(i AS INTEGER), 2, s_name FROM ({PLACED})
"""


@register("s09_pptx", S09)
def s09_pptx(s: SparkSession, d: str) -> DataFrame:
    """Paragraphs of slides."""
    return file_rows(office_files(s, d, "pptx", pptx)).select("source_name", "slide_number", "paragraph_index", "text")


# ---- drift of records

Q01B = """
    SELECT lang AS source, CASE WHEN lang = 'fr' THEN 'n_chars' ELSE '' END AS missing, CASE WHEN lang = 'de' THEN 'extra' ELSE '' END AS extra, lang <> 'fr' AS ok
    FROM documents GROUP BY lang
"""


@register("q01b_record_drift", Q01B)
def q01b_drift(s: SparkSession, d: str) -> DataFrame:
    """The fields that the records of each language hold, against those of the table; French ones lack one, German ones
    have one more."""
    docs = table(s, d, "documents")
    n_chars, extra = F.when(F.col("lang") != "fr", F.col("n_chars")), F.when(F.col("lang") == "de", F.lit(1))
    records = docs.select("lang", F.to_json(F.struct("doc_id", "text", "lang", "source", n_chars.alias("n_chars"), extra.alias("extra"))).alias("body"))
    expected = docs.select("lang").distinct().select(F.col("lang").alias("source"), F.explode(F.array(*map(F.lit, docs.columns))).alias("column"))
    told = quality.schema_difference(expected, quality.record_columns(records, "lang", "body"))
    return told.select("source", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "ok")
