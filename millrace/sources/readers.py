"""Sources: delimited text, Parquet, URIs, text and cell extraction to the long form, and its way back to a wide table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import NULL_TOKENS, col, is_numeric_text, parse_date
from millrace.sources.database import read_database
from millrace.sources.delimited import read_quoted

DATABASES = ("sqlite", "duckdb", "derby")
SEPARATORS = (",", "\t", ";")
#: The fields of the long form.
LONG_FORM = T.StructType(
    [
        T.StructField(n, T.IntegerType() if n in ("slide_number", "paragraph_index", "table_index", "row_index", "column_index") else T.StringType())
        for n in ("source_kind", "source_name", "source_path", "unit_kind", "container_name", "sheet_name", "slide_number", "paragraph_index", "table_index", "row_index", "column_index", "cell_label", "text", "style_json", "notes")
    ]
)


def nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text tokens that stand for null."""
    return df.select(*[F.when(~col(f.name).isin(*tokens), col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns all of whose filled values are whole numbers, numbers or dates, typed so; one pass to decide."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    fits = lambda n: {"bigint": col(n).try_cast("bigint").isNotNull() & col(n).rlike(r"^[-+]?\d+$"), "double": col(n).try_cast("double").isNotNull(), "timestamp_ntz": parse_date(col(n)).isNotNull()}
    row = df.agg(*(F.struct(F.count(col(n)).alias("n"), *(F.count_if(c).alias(k) for k, c in fits(n).items())).alias(f"c{i}") for i, n in enumerate(text))).first()
    out = {}
    for i, n in enumerate(text):
        kind = next((k for k in ("bigint", "double", "timestamp_ntz") if row[i].n and row[i][k] == row[i].n), None)
        if kind:
            out[n] = parse_date(col(n)) if kind == "timestamp_ntz" else col(n).try_cast(kind)
    return df.withColumns(out) if out else df


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, infer: bool = True) -> DataFrame:
    """A text table with header. sep None: the first of comma, tab and semicolon that the header holds, else one column
    `value` without header. Ragged rows are cut or filled with null; NA, N/A, null, None and "" are null. Files are read in
    splits, those with quoted newlines too (see delimited.py)."""
    sep = sep or choose_separator(spark, path)
    if sep is None:
        return nulls(spark.read.text(path))
    df = nulls(read_quoted(spark, path, sep))
    return infer_types(df) if infer else df


def choose_separator(spark: SparkSession, path: str) -> str | None:
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return next((s for s in SEPARATORS if s in line), None)


def sniff_delimiter(lines: DataFrame, candidates: str = ",\t;|:", k: int = 20) -> str:
    """The most frequent candidate in the first filled lines (column value); tab wins a tie with comma."""
    some = lines.where(F.trim("value") != "").limit(k)
    row = some.agg(*(F.coalesce(F.sum(F.size(F.split("value", "\\Q" + c + "\\E")) - 1), F.lit(0)).alias(f"c{i}") for i, c in enumerate(candidates))).first()
    order = {c: i for i, c in enumerate("\t,;|:")}
    best = max(candidates, key=lambda c: (row[candidates.index(c)], -order.get(c, 9)))
    return best if row[candidates.index(best)] else ","


@F.pandas_udf(T.StringType())
def decode_bytes(content: pd.Series) -> pd.Series:
    """Text by the first encoding that fits: UTF-8 with or without mark, cp1252, latin-1."""

    def one(b: bytes) -> str:
        for name in ("utf-8-sig", "cp1252"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("latin-1")

    return content.map(one)


def decoded(content: Column) -> Column:
    """Text of file bytes; valid UTF-8 stays on the JVM side."""
    text = F.decode(content, "UTF-8")
    plain = F.when(F.startswith(content, F.lit(b"\xef\xbb\xbf")), F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).otherwise(text)
    valid = F.is_valid_utf8(content.cast("string"))
    return F.when(valid, plain).otherwise(decode_bytes(F.when(~valid, content).otherwise(F.lit(b""))))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def long_form(df: DataFrame) -> DataFrame:
    """The 15 fields in order; fields that df lacks are null."""
    return df.select(*[(col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in LONG_FORM.fields])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as a `line` row per line, its fields by the file's delimiter in style_json."""
    files = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("body"))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n")).alias("i", "text"))
    filled = lines.where(F.trim("text") != "")
    w = Window.partitionBy("path").orderBy("i")
    head = filled.withColumn("rank", F.row_number().over(w)).where("rank <= 8")
    count = lambda c: F.sum(F.size(F.split("text", "\\Q" + c + "\\E")) - 1)
    ranked = head.groupBy("path").agg(F.array(*[F.struct(count(c).alias("n"), F.lit(-i).alias("p"), F.lit(c).alias("c")) for i, c in enumerate("\t,;|:")]).alias("all"))
    sep = ranked.select("path", F.array_max("all").alias("m")).select("path", F.when(F.col("m.n") > 0, F.col("m.c")).otherwise(",").alias("sep"))
    rows = filled.join(sep, "path")
    fields = F.transform(F.split("text", F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))), F.trim)
    made = rows.select(
        F.lit("text").alias("source_kind"), name_of(F.col("path")).alias("source_name"), F.col("path").alias("source_path"), F.lit("line").alias("unit_kind"),
        (F.col("i") + 1).alias("row_index"), "text", F.to_json(F.struct(F.col("sep").alias("delimiter"), fields.alias("fields"))).alias("style_json"),
    )
    return long_form(made)


def shortcut_rows(spark: SparkSession, path: str) -> DataFrame:
    """Cloud shortcut files (JSON with title, url, id) as a metadata row and a reference row each."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.from_json("value", "title string, name string, url string, doc_id string, resource_id string").alias("j"))
    url = F.coalesce("j.url", F.lit(""))
    file_id = F.coalesce(F.col("j.doc_id"), F.nullif(F.regexp_extract(url, r"/d/([A-Za-z0-9_-]{10,})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})", 1), F.lit("")))
    units = F.array(
        F.struct(F.lit("shortcut_metadata").alias("unit_kind"), F.coalesce("j.title", "j.name", F.lit("")).alias("text")),
        F.struct(F.lit("shortcut_reference").alias("unit_kind"), url.alias("text")),
    )
    rows = files.select("p", F.to_json(F.struct(file_id.alias("file_id"))).alias("style_json"), F.explode(units).alias("u"))
    return long_form(rows.select(F.lit("shortcut").alias("source_kind"), name_of(F.col("p")).alias("source_name"), F.col("p").alias("source_path"), F.col("u.unit_kind").alias("unit_kind"), F.col("u.text").alias("text"), "style_json"))


OFFICE = (".xlsx", ".docx", ".pptx")
SHORTCUTS = (".gdoc", ".gsheet", ".gslides")


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """All files under path in the long form by suffix: office files, shortcuts, others as text with a note for suffixes
    that are no text. A file that gives no row has one placeholder row."""
    from millrace.sources.office import office_rows

    # the listing, since scans leave out files without bytes; Spark's file index holds these names on the driver as well
    listed = sorted(unquote(p) for p in spark.read.format("binaryFile").load(path).inputFiles())
    names = spark.createDataFrame([(p,) for p in listed], "source_path string").withColumn("source_path", F.regexp_replace("source_path", "^file:/+", "file:/"))
    lower = F.lower(names["source_path"])
    kinds = {r.k for r in names.select(F.when(lower.rlike(r"\.(xlsx|docx|pptx)$"), "office").when(lower.rlike(r"\.(gdoc|gsheet|gslides)$"), "shortcut").otherwise("text").alias("k")).distinct().collect()}
    parts = []
    if "office" in kinds:
        parts.append(office_rows(spark, path))
    if "shortcut" in kinds:
        low = lambda df: df.where(F.lower("source_path").rlike(r"\.(gdoc|gsheet|gslides)$"))
        parts.append(low(shortcut_rows(spark, path)))
    if "text" in kinds:
        rows = text_lines(spark, path).where(~F.lower("source_path").rlike(r"\.(xlsx|docx|pptx|gdoc|gsheet|gslides)$"))
        parts.append(rows.withColumn("notes", F.when(~F.lower("source_path").rlike(r"\.(txt|csv|tsv|md|json|log)$"), "unknown suffix, read as text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    empty = names.join(out.select("source_path").distinct(), "source_path", "left_anti")
    place = empty.select(F.lit("placeholder").alias("unit_kind"), F.lit("unknown").alias("source_kind"), name_of(F.col("source_path")).alias("source_name"), "source_path", F.lit("").alias("text"))
    return out.unionByName(long_form(place))


def is_long_form(df: DataFrame) -> bool:
    return {"unit_kind", "text"} <= set(df.columns)


def _headed(table: DataFrame, width: int, order: str) -> DataFrame:
    """c0 ... by their header: the first row is one if it has a filled value that is no number; gaps are col_N."""
    first = table.orderBy(order).limit(1).collect()
    values = [first[0][f"c{i}"] for i in range(width)] if first else []
    probe = table.sparkSession.createDataFrame([(v,) for v in values] or [("",)], "v string").select((~is_numeric_text(F.col("v")) & (F.trim("v") != "")).alias("t")).collect()
    header = any(r.t for r in probe)
    names: list[str] = []
    for i in range(width):
        name = (values[i] or "").strip() if header and i < len(values) else ""
        name = name or f"col_{i + 1}"
        while name in names:
            name += "_"
        names.append(name)
    rows = table.where(col(order) != first[0][order]) if header else table
    return rows.select(col(order), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def wide_from_lines(df: DataFrame, source: str | None = None) -> DataFrame:
    """A wide table from `line` rows: delimiter by count in the first eight lines, quoted fields kept whole."""
    lines = df.where("unit_kind = 'line'")
    if source:
        lines = lines.where(F.col("source_path") == source)
    sep = sniff_delimiter(lines.orderBy("row_index").limit(8).select(F.col("text").alias("value")))
    quoted = "\\Q" + sep + "\\E"
    # each field follows a separator: quoted stretches, which may hold more, and runs without quotes; linear in the line
    each = F.regexp_extract_all(F.concat(F.lit(sep), "text"), F.lit(quoted + '((?:"[^"]*+"|[^' + quoted + '"]++|")*+)'), F.lit(1))
    fields = F.transform(each, lambda x: F.replace(F.regexp_replace(F.trim(x), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    rows = lines.select("row_index", fields.alias("f"))
    width = rows.agg(F.max(F.size("f"))).first()[0] or 0
    return _headed(rows.select("row_index", *[F.get("f", F.lit(i)).alias(f"c{i}") for i in range(width)]), width, "row_index")


def wide_from_cells(df: DataFrame) -> DataFrame:
    """A wide grid from `cell` rows of the first sheet, columns by their index."""
    cells = df.where("unit_kind = 'cell'")
    sheet = cells.agg(F.min("sheet_name")).first()[0]
    own = cells.where(F.col("sheet_name").eqNullSafe(F.lit(sheet)))
    width = own.agg(F.max("column_index")).first()[0] or 0
    grid = own.groupBy("row_index").pivot("column_index", list(range(1, width + 1))).agg(F.first("text"))
    return _headed(grid.select("row_index", *[col(str(i + 1)).alias(f"c{i}") for i in range(width)]), width, "row_index")


def reconstruct(df: DataFrame) -> DataFrame:
    """A long-form table as the wide one it came from; other tables as they are."""
    if not is_long_form(df):
        return df
    kinds = {r.unit_kind for r in df.select("unit_kind").distinct().collect()}
    return wide_from_cells(df) if "cell" in kinds else wide_from_lines(df) if "line" in kinds else df


def read_source(spark: SparkSession, uri: str) -> DataFrame:
    """A table by URI: paths, file:, s3: and http(s): files by suffix; sqlite:, duckdb: and derby: by table= or query= over
    JDBC, with the user's driver, in ranges of key= of about rows= rows (see database.py); versioned: a table of versions,
    with @ and a number one of them (see versioned.py)."""
    if uri.startswith("versioned:"):
        from millrace.sources.versioned import versioned_table

        versioned, version = versioned_table(spark, uri)
        return versioned.read(version)
    u = urlparse(uri)
    if u.scheme in DATABASES:
        q = {k: v[0] for k, v in parse_qs(u.query).items()}
        if ("query" in q) == ("table" in q):
            raise ValueError("a database URI needs table= or query=")
        file = u.path[1:] if u.path.startswith("//") else u.path
        more = {"rows": int(q["rows"])} if "rows" in q else {}
        return read_database(spark, f"jdbc:{u.scheme}:{file}", q.get("table"), q.get("query"), q.get("key"), **more)
    path = uri.replace("s3://", "s3a://", 1) if u.scheme == "s3" else uri
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_delimited(spark, path)


def audit_lines(spark: SparkSession, path: str, schema: str = "data struct<event string, payload map<string,string>, ts string>, hmac string") -> DataFrame:
    """JSON-lines logs with the file each line came from; lines that do not parse are kept in raw."""
    kind = T.StructType.fromDDL(schema)
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value", F.from_json("value", kind).alias("j"))
    bad = F.col("j").isNull() | ~F.col("value").rlike(r"^\s*\{.*\}\s*$")
    return rows.select("source", *[F.when(~bad, F.col(f"j.{f.name}")).alias(f.name) for f in kind.fields], F.when(bad, F.col("value")).alias("raw"))


def json_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A folder of JSON records: a record (or an array of them) a file over any lines, or with lines one on each line,
    which is read in splits. Records of whole files are typed from a scan of their bytes: Spark's own way looks each file up
    on the driver first."""
    if lines:
        return spark.read.json(path)
    bodies = spark.read.format("binaryFile").load(path).select("content").rdd.map(lambda r: bytes(r[0]).decode(json.detect_encoding(bytes(r[0])), "replace"))
    return spark.read.schema(spark.read.json(bodies).schema).json(path, multiLine=True)


def duplicate_files(spark: SparkSession, path: str) -> DataFrame:
    """(length, hash, paths) of equal files: grouped by length from the listing, hashed only where lengths repeat."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    often = listed.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content").join(often, "length", "left_semi")
    return files.groupBy("length", F.sha2("content", 256).alias("hash")).agg(F.sort_array(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
