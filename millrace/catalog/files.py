"""Queries of file sources and sinks, over files that Spark writes from the tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.catalog.tables import line_files, scratch
from millrace.operators import privacy, rows
from millrace.sources import readers, writers
from millrace.sources.versioned import VersionedTable, delete_subject_files

# ---- sources

S04 = """
    SELECT '|' AS delimiter, CAST(o_orderkey AS VARCHAR) AS first, CAST(4 AS INTEGER) AS n_fields FROM orders
"""


@register("s04_sniff_delimiter", S04)
def s04_sniff(s: SparkSession, d: str) -> DataFrame:
    """The lines of files parted by the delimiter that was found in them."""
    lines = s.read.text(line_files(s, d))
    sep = readers.sniff_delimiter(lines)
    fields = F.split("value", f"\\Q{sep}\\E")
    kept = lines.where("NOT startswith(value, 'o_')")
    return kept.select(F.lit(sep).alias("delimiter"), fields[0].alias("first"), F.size(fields).alias("n_fields"))


@register("s01b_quoted_newlines", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang FROM documents")
def s01b_quoted(s: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their newlines and quotes, as values of delimited files that are read in splits."""
    path = scratch(s, "quoted")
    kept = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(s, d, "documents").select("doc_id", "text", "lang").write.options(**kept).csv(path)
    return readers.read_delimited(s, path, ",", infer=False)


@register("s06_encodings", "SELECT c_name || ' café' AS text FROM customer")
def s06_encodings(s: SparkSession, d: str) -> DataFrame:
    """Lines of files in a one-byte encoding, which the reader has to find out."""
    path = scratch(s, "latin")
    named = table(s, d, "customer").select(F.concat("c_name", F.lit(" café")))
    named.write.option("encoding", "ISO-8859-1").option("quote", "").csv(path)
    return readers.text_lines(s, path).select("text")


def file_each(rows: DataFrame, path: str) -> None:
    """A text file for each row, all in one folder, written by as many tasks as a shuffle has. Folders of their own would
    each be listed, and a table of one split would be written by one task."""
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt.write.option("maxRecordsPerFile", 1).text(path)


S10 = """
    WITH s AS (SELECT s_name AS title, 'https://docs.example.org/d/document-' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') || '/edit' AS url,
                      'document-' || lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS file_id FROM supplier)
    SELECT 'shortcut_metadata' AS unit_kind, title AS text, file_id FROM s
    UNION ALL
    SELECT 'shortcut_reference', url, file_id FROM s
"""


@register("s10_shortcuts", S10)
def s10_shortcuts(s: SparkSession, d: str) -> DataFrame:
    """A shortcut file for each supplier."""
    path = scratch(s, "shortcuts")
    url = F.concat(F.lit("https://docs.example.org/d/document-"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0"), F.lit("/edit"))
    body = F.to_json(F.struct(F.col("s_name").alias("title"), url.alias("url"))).alias("value")
    file_each(table(s, d, "supplier").select(body), path)
    units = readers.shortcut_rows(s, path)
    return units.select("unit_kind", "text", F.get_json_object("style_json", "$.file_id").alias("file_id"))


S11 = """
    SELECT 'text' AS source_kind, 'line' AS unit_kind, c_name AS text FROM customer
    UNION ALL
    SELECT 'unknown', 'placeholder', ''
"""


@register("s11_ingest", S11)
def s11_ingest(s: SparkSession, d: str) -> DataFrame:
    """A folder of text files, one of them without bytes."""
    path = scratch(s, "ingest")
    names = table(s, d, "customer").select("c_name", F.lit("names").alias("folder"))
    # by folder, since a plain write makes a file without bytes of its own where its first task has no rows
    names.write.partitionBy("folder").text(path)
    names.where("false").select("c_name").coalesce(1).write.text(f"{path}/folder=empty")
    return readers.ingest(s, path).select("source_kind", "unit_kind", "text")


@register("s14_reconstruct", "SELECT CAST(s_suppkey AS VARCHAR) AS col_1, s_name AS col_2 FROM supplier")
def s14_reconstruct(s: SparkSession, d: str) -> DataFrame:
    """A long-form table is told by its columns; the first line, all numbers or empty, is no header."""
    lines = table(s, d, "supplier").select(F.lit("line").alias("unit_kind"), F.col("s_suppkey").cast("int").alias("row_index"), F.concat_ws(",", "s_suppkey", "s_name").alias("text"))
    numbers = lines.groupBy("unit_kind").agg((F.min("row_index") - 1).alias("row_index"), F.lit("0,0").alias("text"))
    return readers.reconstruct(lines.union(numbers)).where("col_2 != '0'").select("col_1", "col_2")


def database(s: SparkSession, name: str) -> str:
    """A URI's path of a new embedded database file, which one process opens at a time: for local sessions."""
    return scratch(s, name).removeprefix("file:").replace("///", "/", 1)


@register("s15_database", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 500")
def s15_database(s: SparkSession, d: str) -> DataFrame:
    """Orders of a database file, read by ranges of the order key, with a filter and columns that the database gets."""
    path = database(s, "database")
    table(s, d, "orders").write.jdbc(f"jdbc:derby:{path};create=true", "orders")
    return readers.read_source(s, f"derby:{path}?table=orders&key=o_orderkey&rows=4000").where("o_custkey < 500").select("o_orderkey", "o_custkey", "o_totalprice")


@register("k07b_join_database", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def k07b_join_database(s: SparkSession, d: str) -> DataFrame:
    """A join exported to a database table and read back."""
    path = database(s, "exported")
    joined = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    writers.write_jdbc(joined, f"jdbc:derby:{path};create=true")
    return readers.read_source(s, f"derby:{path}?query=SELECT%20*%20FROM%20joined")


S18 = """
    SELECT CAST(sum(strlen(c_name) + 1) AS BIGINT) AS length, sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS hash, CAST(2 AS INTEGER) AS n
    FROM customer GROUP BY c_nationkey
"""


@register("s18_duplicate_files", S18)
def s18_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Two copies of a file for each nation."""
    path = scratch(s, "copies")
    both = table(s, d, "customer").select("c_nationkey", "c_custkey", "c_name", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    dealt = both.repartition(8, "copy", "c_nationkey").sortWithinPartitions("copy", "c_nationkey", "c_custkey")
    dealt.select("copy", "c_nationkey", "c_name").write.partitionBy("copy", "c_nationkey").text(path)
    return readers.duplicate_files(s, path).select("length", "hash", F.size("paths").alias("n"))


# ---- sinks


@register("k01_write_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def k01_write_csv(s: SparkSession, d: str) -> DataFrame:
    path = writers.write_table(table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), scratch(s, "csv"), "csv")
    return s.read.csv(path, header=True)


@register("k02_replace_source", "SELECT c_custkey, upper(c_mktsegment) AS c_mktsegment, false AS left_over FROM customer")
def k02_replace(s: SparkSession, d: str) -> DataFrame:
    """A table written in the place of the one it is computed from; left_over: whether anything else is left there."""
    folder = scratch(s, "replace")
    path = writers.write_table(table(s, d, "customer").select("c_custkey", "c_mktsegment"), f"{folder}/table")
    writers.write_table(s.read.parquet(path).withColumn("c_mktsegment", F.upper("c_mktsegment")), path)
    fs, base = writers.hadoop(s, folder)
    there = [x.getPath().getName() for x in fs.listStatus(base)]
    return s.read.parquet(path).withColumn("left_over", F.lit(there != ["table"]))


@register("k06_expire_snapshots", "SELECT p_partkey, p_name, 1 AS deleted, 1 AS remaining FROM part")
def k06_expire(s: SparkSession, d: str) -> DataFrame:
    """Of two snapshots the one older than 30 days goes; the other is read back."""
    folder, now = scratch(s, "expire"), datetime(2024, 6, 30, tzinfo=UTC)
    part = table(s, d, "part").select("p_partkey", "p_name")
    writers.snapshot(part.where("p_partkey IS NULL"), folder, "part", datetime(2024, 1, 1, tzinfo=UTC))
    kept = writers.snapshot(part, folder, "part", now)
    deleted, remaining = writers.expire_snapshots(s, folder, "part", 30, now)
    return s.read.parquet(kept).withColumns({"deleted": F.lit(deleted), "remaining": F.lit(remaining)})


@register("k07_join_export", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def k07_join_export(s: SparkSession, d: str) -> DataFrame:
    """A join exported as delimited text and read back."""
    joined = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return s.read.csv(writers.write_table(joined.select("c_custkey", "n_name"), scratch(s, "joined"), "csv"), header=True)


def versioned(s: SparkSession, name: str) -> VersionedTable:
    return VersionedTable(s, scratch(s, name))


@register("k04b_version_rollback", "SELECT c_custkey, c_name, c_acctbal, CAST(0 AS BIGINT) AS files_written, CAST(6 AS BIGINT) AS version FROM customer")
def k04b_versions(s: SparkSession, d: str) -> DataFrame:
    """A table of versions: a snapshot without a file of its own, an append, a change, and the way back."""
    t, customer = versioned(s, "versions"), table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    t.overwrite(customer.where("c_acctbal < 0"))
    t.append(customer.where("c_acctbal >= 0 OR c_acctbal IS NULL"))
    kept = t.snapshot()
    new = t.manifest(kept).where("file IS NOT NULL").join(t.manifest(kept - 1), "file", "left_anti").count()
    t.append(customer)
    t.overwrite(t.read().where("c_custkey IS NULL"))
    version = t.rollback(kept)
    return t.read().withColumns({"files_written": F.lit(new).cast("long"), "version": F.lit(version).cast("long")})


@register("k06b_expire_versions", "SELECT p_partkey, p_name, CAST(2 AS BIGINT) AS versions, true AS earlier_kept FROM part WHERE p_partkey > 50")
def k06b_expire(s: SparkSession, d: str) -> DataFrame:
    """Old versions go, but not the files that a later one still names."""
    t, part = versioned(s, "expire-versions"), table(s, d, "part").select("p_partkey", "p_name")
    old, now = datetime(2024, 1, 1, tzinfo=UTC), datetime(2024, 6, 30, tzinfo=UTC)
    t.overwrite(part, old)
    kept = t.snapshot(now)
    t.delete_where(F.col("p_partkey") <= 50, now)
    t.expire(30, now)
    same = t.read(kept).exceptAll(part).isEmpty()
    return t.read().withColumns({"versions": F.lit(len(t.versions())).cast("long"), "earlier_kept": F.lit(same)})


@register("p16b_subject_deletion_files", "SELECT event_id, user_id, true AS others_untouched FROM events WHERE user_id <> 7 OR user_id IS NULL")
def p16b_deletion(s: SparkSession, d: str) -> DataFrame:
    """A user's events deleted from a table of files; others_untouched: the files without that user keep their names."""
    t, events = versioned(s, "events"), table(s, d, "events").select("event_id", "user_id")
    before = t.overwrite(events.repartitionByRange(8, "user_id"))
    parts = F.split("_metadata.file_path", "/")
    held = t.read(before).where("user_id = 7").select(F.concat(F.lit("data/"), F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)).alias("file")).distinct()
    version, _ = delete_subject_files(t, "user_id", 7, "event_id")
    gone = t.manifest(before).where("file IS NOT NULL").join(t.manifest(version), "file", "left_anti").select("file")
    return t.read().withColumn("others_untouched", F.lit(gone.exceptAll(held).isEmpty()))


K08 = """
    SELECT 'customers' AS recipe_id, 'completed' AS status, 'parquet' AS export_format, CAST(count(*) AS VARCHAR) || ' rows' AS diagnostics FROM customer
"""


@register("k08_record_run", K08)
def k08_record_run(s: SparkSession, d: str) -> DataFrame:
    """A run's record, read back as the latest of its recipe."""
    folder, began = scratch(s, "runs"), datetime(2024, 6, 30)
    path = writers.write_table(table(s, d, "customer"), f"{folder}/out")
    common = {"recipe_id": "customers", "started_at": began, "export_format": "parquet", "output_path": path}
    writers.record_run(s, f"{folder}/runs", status="failed", finished_at=began.replace(hour=1), **common)
    told = f"{s.read.parquet(path).count()} rows"
    writers.record_run(s, f"{folder}/runs", status="completed", finished_at=began.replace(hour=2), diagnostics=told, **common)
    latest = rows.latest_run(s.read.parquet(f"{folder}/runs"))
    return latest.select("recipe_id", "status", "export_format", "diagnostics")


@register("k09_write_long_form", "SELECT 'text' AS source_kind, 'line' AS unit_kind, c_name AS text, CAST(15 AS INTEGER) AS n_fields FROM customer")
def k09_long_form(s: SparkSession, d: str) -> DataFrame:
    """The long form written with its 15 fields and read back."""
    units = table(s, d, "customer").select(F.lit("text").alias("source_kind"), F.lit("line").alias("unit_kind"), F.col("c_name").alias("text"))
    back = s.read.csv(writers.write_long_form(units, scratch(s, "long")), header=True)
    return back.select("source_kind", "unit_kind", "text", F.lit(len(back.columns)).alias("n_fields"))


# ---- order and nested redaction


@register("t05_latest_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 50")
def t05_latest(s: SparkSession, d: str) -> DataFrame:
    """The latest 50 events: the limit is the feature."""
    return rows.page(table(s, d, "events").select("event_id", "ts"), [F.col("ts").desc(), F.col("event_id")])


P19 = """
    SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, 'redacted@example.com' AS user_name, 'write to redacted@example.com' AS note, 'redacted@example.com' AS nested FROM customer
"""


@register("p19_redact_json", P19)
def p19_json(s: SparkSession, d: str) -> DataFrame:
    """Personal keys and addresses within JSON, an array of structs included."""
    note = F.concat(F.lit("write to c"), F.col("c_custkey").cast("string"), F.lit("@example.org"))
    item = F.array(F.struct(F.col("c_name").alias("email")))
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("user_name"), note.alias("note"), item.alias("items")))
    made = privacy.redact_json(table(s, d, "customer").select("c_custkey", body.alias("body")), "body", "id long, user_name string, note string, items array<struct<email: string>>")
    part = lambda path, name: F.get_json_object("body", path).alias(name)
    return made.select("c_custkey", part("$.id", "id"), part("$.user_name", "user_name"), part("$.note", "note"), part("$.items[0].email", "nested"))


@register("s17b_json_record_files", "SELECT s_suppkey, s_name FROM supplier")
def s17b_json_record_files(s: SparkSession, d: str) -> DataFrame:
    """A file with one JSON record over several lines for each supplier."""
    path = scratch(s, "records")
    body = F.to_json(F.struct("s_suppkey", "s_name"), {"pretty": "true"}).alias("value")
    file_each(table(s, d, "supplier").select(body), path)
    return readers.json_records(s, path).select("s_suppkey", "s_name")
