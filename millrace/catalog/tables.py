"""Queries of joins, deduplication, fuzzy matching, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.operators import fuzzy, joins
from millrace.operators.joins import JoinSpec
from millrace.operators.rows import shared_folder
from millrace.plans.recipe import Context, compile_recipe
from millrace.sources import readers, writers
from millrace.streaming import incremental


def scratch(s: SparkSession, name: str) -> str:
    """A new path in the shared folder of the session."""
    return f"{shared_folder(s)}/catalog/{name}-{uuid.uuid4().hex}"


def sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents and labels, whole; some documents have no label."""
    docs = table(s, d, "documents").select("doc_id", "lang", F.col("source").alias("tag"))
    return docs, table(s, d, "labels").select("doc_id", "quality", F.concat(F.lit("q"), "quality").alias("tag"))


LEFT = "(SELECT doc_id, lang, source AS tag FROM documents) l"
RIGHT = "(SELECT doc_id, quality, 'q' || quality AS tag FROM labels) r"


def joining(name: str, how: str, key: str, kind: str) -> None:
    @register(name, f"SELECT {key} AS doc_id, l.lang, l.tag, r.quality, r.tag AS tag_right FROM {LEFT} {kind} JOIN {RIGHT} ON l.doc_id = r.doc_id")
    def run(s: SparkSession, d: str) -> DataFrame:
        left, right = sides(s, d)
        return joins.equi_join(left, right, JoinSpec(["doc_id"], ["doc_id"], how))


joining("j04_inner", "inner", "l.doc_id", "")
joining("j05_left", "left", "l.doc_id", "LEFT")
joining("j06_right", "right", "r.doc_id", "RIGHT")
joining("j07_full", "outer", "coalesce(l.doc_id, r.doc_id)", "FULL")
register("j08_anti", f"SELECT l.* FROM {LEFT} WHERE l.doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: joins.equi_join(*sides(s, d), JoinSpec(["doc_id"], ["doc_id"], "anti")))
register("j01_join_step", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: compile_recipe(table(s, d, "orders").select("o_orderkey", "o_custkey"), {"cleaning_steps": [{"action": "join", "column": None, "params": {"right": "customers", "keys": ["o_custkey"]}}]}, Context(tables={"customers": table(s, d, "customer").selectExpr("c_custkey AS o_custkey", "c_name")}))
)
register("j09_composite_keys", "SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.l_tax AS tax FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber")(lambda s, d: joins.equi_join(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), table(s, d, "lineitem").selectExpr("l_orderkey AS ok", "l_linenumber AS ln", "l_tax AS tax"), JoinSpec(["l_orderkey", "l_linenumber"], ["ok", "ln"])))
register("j10_key_inference", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")(lambda s, d: joins.equi_join(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels").select("doc_id", "quality"), JoinSpec()))
register("j11_rename_map", "SELECT o_orderkey, c_name AS buyer, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")(
    lambda s, d: joins.equi_join(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), JoinSpec(["o_custkey"], ["o_custkey"], right_rename={"c_custkey": "o_custkey", "c_name": "buyer"})).drop("o_custkey")
)
register("j12_conflict_suffix", f"SELECT l.doc_id, l.lang, l.tag, r.quality, r.tag AS tag_lab FROM {LEFT} JOIN {RIGHT} ON l.doc_id = r.doc_id")(lambda s, d: joins.equi_join(*sides(s, d), JoinSpec(["doc_id"], ["doc_id"], suffix="_lab")))
register("j13_prefer_right", f"SELECT l.doc_id, l.lang, coalesce(r.tag, l.tag) AS tag, r.quality FROM {LEFT} LEFT JOIN {RIGHT} ON l.doc_id = r.doc_id")(lambda s, d: joins.equi_join(*sides(s, d), JoinSpec(["doc_id"], ["doc_id"], "left", prefer="right")))
register("j14_statistics", f"SELECT (SELECT count(*) FROM {LEFT}) AS left_rows, (SELECT count(*) FROM {RIGHT}) AS right_rows, (SELECT count(*) FROM {LEFT} JOIN {RIGHT} ON l.doc_id = r.doc_id) AS joined_rows, (SELECT count(*) FROM {LEFT} WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS left_unmatched, (SELECT count(*) FROM {RIGHT} WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS right_unmatched")(lambda s, d: joins.join_statistics(*sides(s, d), JoinSpec(["doc_id"], ["doc_id"])))

# ---- the same joins over whole tables: documents with labels, and labels with documents, of which some have no label


def whole_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents and all labels; some documents have no label."""
    return table(s, d, "documents").select("doc_id", "lang", F.col("source").alias("tag")), sides(s, d)[1]


def turned_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All labels and all documents: rows of the right side have no partner."""
    return whole_sides(s, d)[::-1]


WHOLE_LEFT = "(SELECT doc_id, lang, source AS tag FROM documents) l"
TURNED_LEFT, TURNED_RIGHT = RIGHT.removesuffix("r") + "l", WHOLE_LEFT.removesuffix("l") + "r"


def joining_whole(name: str, how: str, key: str, kind: str) -> None:
    @register(name, f"SELECT {key} AS doc_id, l.lang, l.tag, r.quality, r.tag AS tag_right FROM {WHOLE_LEFT} {kind} JOIN {RIGHT} ON l.doc_id = r.doc_id")
    def run(s: SparkSession, d: str) -> DataFrame:
        return joins.equi_join(*whole_sides(s, d), JoinSpec(["doc_id"], ["doc_id"], how))


def joining_turned(name: str, how: str, key: str, kind: str) -> None:
    @register(name, f"SELECT {key} AS doc_id, l.quality, l.tag, r.lang, r.tag AS tag_right FROM {TURNED_LEFT} {kind} JOIN {TURNED_RIGHT} ON l.doc_id = r.doc_id")
    def run(s: SparkSession, d: str) -> DataFrame:
        return joins.equi_join(*turned_sides(s, d), JoinSpec(["doc_id"], ["doc_id"], how))


joining_whole("j04w_inner_whole", "inner", "l.doc_id", "")
joining_whole("j05w_left_whole", "left", "l.doc_id", "LEFT")
joining_turned("j06w_right_whole", "right", "r.doc_id", "RIGHT")
joining_turned("j07w_full_whole", "outer", "coalesce(l.doc_id, r.doc_id)", "FULL")
register("j08w_anti_whole", f"SELECT l.* FROM {WHOLE_LEFT} WHERE l.doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: joins.equi_join(*whole_sides(s, d), JoinSpec(["doc_id"], ["doc_id"], "anti")))
register("j12w_conflict_suffix_whole", f"SELECT l.doc_id, l.lang, l.tag, r.quality, r.tag AS tag_lab FROM {WHOLE_LEFT} JOIN {RIGHT} ON l.doc_id = r.doc_id")(lambda s, d: joins.equi_join(*whole_sides(s, d), JoinSpec(["doc_id"], ["doc_id"], suffix="_lab")))
register("j13w_prefer_right_whole", f"SELECT l.doc_id, l.lang, coalesce(r.tag, l.tag) AS tag, r.quality FROM {WHOLE_LEFT} LEFT JOIN {RIGHT} ON l.doc_id = r.doc_id")(lambda s, d: joins.equi_join(*whole_sides(s, d), JoinSpec(["doc_id"], ["doc_id"], "left", prefer="right")))
register("j14w_statistics_whole", f"SELECT (SELECT count(*) FROM {TURNED_LEFT}) AS left_rows, (SELECT count(*) FROM {TURNED_RIGHT}) AS right_rows, (SELECT count(*) FROM {TURNED_LEFT} JOIN {TURNED_RIGHT} ON l.doc_id = r.doc_id) AS joined_rows, (SELECT count(*) FROM {TURNED_LEFT} WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS left_unmatched, (SELECT count(*) FROM {TURNED_RIGHT} WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS right_unmatched")(lambda s, d: joins.join_statistics(*turned_sides(s, d), JoinSpec(["doc_id"], ["doc_id"])))

register("j15_suggest_keys", "SELECT 'doc_id' AS left_key, 'doc_id' AS right_key, 1.0 AS similarity, (SELECT count(*) FROM labels) / (SELECT count(*) FROM documents) AS containment, 1.0 AS left_unique, 1.0 AS right_unique")(lambda s, d: joins.suggest_keys(table(s, d, "documents"), table(s, d, "labels")))
J15B = """
    SELECT 'o_custkey' AS left_key, 'c_custkey' AS right_key, CAST(1 AS DOUBLE) AS containment,
        (SELECT count(DISTINCT o_custkey) / count(o_custkey) FROM orders) AS left_unique, CAST(1 AS DOUBLE) AS right_unique
"""
register("j15b_discover_keys", J15B)(lambda s, d: joins.discover_keys(table(s, d, "orders"), table(s, d, "customer"), most=1).drop("similarity"))
register("j16_entity_link", "SELECT c_custkey, n_nationkey AS right__n_nationkey, upper(n_name) AS right__n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(
    lambda s, d: fuzzy.entity_link(table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), F.lower("n_name")).alias("n_name")), table(s, d, "nation").select("n_nationkey", F.upper("n_name").alias("n_name")), ["n_name"]).drop("n_name")
)
register("j17_consistency", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN n_name ELSE n_name END AS nation, s_suppkey % 4 = 0 AS bad, CASE WHEN s_suppkey % 4 = 0 THEN n_name END AS hint FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda s, d: joins.consistency_check(table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 4 == 0, "Nowhere").otherwise(F.col("n_name")).alias("nation")), table(s, d, "nation").select("n_nationkey", "n_name"), "s_nationkey", "nation", True, "bad", "hint").drop("s_nationkey")
)
register("j18_lookup", "SELECT c_custkey, n_name AS nation, n_regionkey AS region FROM customer LEFT JOIN nation ON c_nationkey + 3 = n_nationkey")(lambda s, d: joins.lookup(table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("c_nationkey")), table(s, d, "nation"), {"c_nationkey": "n_nationkey"}, {"n_name": "nation", "n_regionkey": "region"}).drop("c_nationkey"))
register("j19_geocode", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN CAST(n_nationkey AS DOUBLE) END AS place__lat, CASE WHEN s_suppkey % 4 > 0 THEN n_regionkey * 1.5 END AS place__lon FROM supplier JOIN nation ON s_nationkey = n_nationkey")(
    lambda s, d: joins.geocode(table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit(" "), F.lower("n_name"))).otherwise("nowhere").alias("place")), "place", table(s, d, "nation").select(F.col("n_name").alias("address"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_regionkey") * F.lit(1.5)).alias("lon"))).drop("place")
)
register("j20_exchange", "SELECT o_orderkey, round(o_totalprice * (2 + o_custkey % 3) / (1 + o_custkey % 5), 6) AS made FROM orders")(
    lambda s, d: joins.exchange(table(s, d, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("f"), F.col("o_custkey") % 5).alias("f"), F.concat(F.lit("t"), F.col("o_custkey") % 3).alias("t")), table(s, d, "customer").select(F.concat(F.lit("F"), F.col("c_custkey") % 5).alias("currency"), (1 + F.col("c_custkey") % 5).cast("double").alias("rate")).union(table(s, d, "customer").select(F.concat(F.lit("T"), F.col("c_custkey") % 3), (2 + F.col("c_custkey") % 3).cast("double"))), "o_totalprice", "f", "t", "made").select("o_orderkey", F.round("made", 6).alias("made"))
)
register("j21_recipe_joins", "SELECT doc_id, upper(lang) AS lang, quality FROM documents LEFT JOIN labels USING (doc_id)")(lambda s, d: compile_recipe(table(s, d, "documents").select("doc_id", "lang"), {"joins": [{"left": "documents", "right": "labels", "keys": ["doc_id"]}], "cleaning_steps": [{"action": "normalize", "column": "lang", "params": {"case": "upper"}}]}, Context(tables={"labels": table(s, d, "labels").select("doc_id", "quality")})))
register("j22_duplicate_keys", "SELECT p_name, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1")(lambda s, d: joins.duplicate_keys(table(s, d, "part"), ["p_name"]))

# ---- deduplication and fuzzy matching

register("d01a_deduplicate", "SELECT DISTINCT text, lang FROM documents")(lambda s, d: compile_recipe(table(s, d, "documents").select("text", "lang"), {"cleaning_steps": [{"action": "deduplicate", "column": None, "params": {}}]}))
register("d01b_deduplicate_subset", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")(lambda s, d: compile_recipe(table(s, d, "documents").select("text", "doc_id"), {"order": "doc_id", "cleaning_steps": [{"action": "deduplicate", "column": "text", "params": {}}]}))


def misspelt(s: SparkSession, d: str) -> DataFrame:
    """Part names, every other with a letter doubled or lost."""
    return table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 1, F.concat(F.substring("p_name", 1, 3), F.lit("x"), F.expr("substr(p_name, 4)"))).when(F.col("p_partkey") % 4 == 3, F.expr("substr(p_name, 2)")).otherwise(F.col("p_name")).alias("name"))


register("d02_fuzzy_dedupe")(lambda s, d: fuzzy.fuzzy_dedupe(misspelt(s, d), ["name"], "p_partkey", 0.85))
register("d03_minhash_dedupe")(lambda s, d: fuzzy.fuzzy_dedupe(table(s, d, "documents").select("doc_id", "text"), ["text"], "doc_id", 0.8, "minhash"))
register("d04_entity_resolution")(lambda s, d: fuzzy.entity_resolution(misspelt(s, d), ["name"], "p_partkey", 0.9))
register("j02_fuzzy_join")(lambda s, d: fuzzy.fuzzy_join(misspelt(s, d), table(s, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("p_brand")), "name", "p_name", 0.8))
register("j03_minhash_join")(lambda s, d: fuzzy.minhash_join(misspelt(s, d), table(s, d, "part").select("p_name").distinct(), "name", "p_name", 0.3))
register("w09_best_match")(lambda s, d: fuzzy.best_per_query(fuzzy.matching_pairs(misspelt(s, d).select(F.col("name").alias("k")).distinct(), table(s, d, "part").select(F.col("p_name").alias("k")).distinct(), 0.8)))

# ---- sources and sinks, over files written from the tables


@register("s01_read_delimited", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s01_read_delimited(s: SparkSession, d: str) -> DataFrame:
    return readers.read_delimited(s, writers.write_table(table(s, d, "customer"), scratch(s, "csv"), "csv"))


register("s02_read_parquet", "SELECT * FROM orders")(lambda s, d: readers.read_source(s, f"{d}/orders.parquet"))


@register("s03_separator", "SELECT c_custkey, c_name FROM customer")
def s03_separator(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "semi")
    table(s, d, "customer").select("c_custkey", "c_name").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_delimited(s, path)


def line_files(s: SparkSession, d: str) -> str:
    """Orders as text files of five fields parted by "|", with header."""
    path = scratch(s, "lines")
    table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).write.option("header", True).option("sep", "|").csv(path)
    return path


register("s05_text_lines", "SELECT CAST(o_orderkey AS VARCHAR) || '|' || CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d') AS text, '|' AS delimiter FROM orders")(lambda s, d: readers.text_lines(s, line_files(s, d)).where("NOT startswith(text, 'o_')").select("text", F.get_json_object("style_json", "$.delimiter").alias("delimiter")))
register("s12_wide_from_lines", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders")(lambda s, d: readers.reconstruct(table(s, d, "orders").select(F.lit("line").alias("unit_kind"), (F.col("o_orderkey") + 1).alias("row_index"), F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("text")).union(table(s, d, "region").where("r_regionkey = 0").select(F.lit("line"), F.lit(-1), F.lit("o_orderkey,o_custkey,o_orderstatus")))).drop("row_index"))


@register("s13_wide_from_cells", "SELECT c_custkey + 2 AS row_index, CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def s13_cells(s: SparkSession, d: str) -> DataFrame:
    customer = table(s, d, "customer")
    cells = customer.select((F.col("c_custkey") + 2).alias("row_index"), F.explode(F.array(F.struct(F.lit(1).alias("c"), F.col("c_custkey").cast("string").alias("t")), F.struct(F.lit(2).alias("c"), F.col("c_name").alias("t")))).alias("x")).select("row_index", F.col("x.c").alias("column_index"), F.col("x.t").alias("text"))
    head = customer.agg(F.count("*")).select(F.lit(1).alias("row_index"), F.explode(F.array(F.struct(F.lit(1).alias("c"), F.lit("c_custkey").alias("t")), F.struct(F.lit(2).alias("c"), F.lit("c_name").alias("t")))).alias("x")).select("row_index", F.col("x.c"), F.col("x.t"))
    return readers.reconstruct(cells.union(head).withColumns({"unit_kind": F.lit("cell"), "sheet_name": F.lit("S")}))


@register("s16_audit_lines", "SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS event, event_id % 10 = 0 AS bad, count(*) AS n FROM events GROUP BY ALL")
def s16_audit(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "audit")
    body = F.to_json(F.struct(F.struct(F.col("event_type").alias("event"), F.col("ts").cast("string").alias("ts")).alias("data"), F.lit("x").alias("hmac")))
    table(s, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), "event_type")).otherwise(body)).write.text(path)
    return readers.audit_lines(s, path).groupBy(F.col("data.event").alias("event"), F.col("raw").isNotNull().alias("bad")).agg(F.count("*").alias("n"))


@register("s17_json_records", "SELECT p_partkey, p_name FROM part")
def s17_json(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "json")
    table(s, d, "part").select("p_partkey", "p_name").write.json(path)
    return readers.json_records(s, path, lines=True)


@register("k03_write_parquet", "SELECT * FROM supplier")
def k03_write(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "parquet")
    writers.write_table(table(s, d, "nation"), path, compression="zstd")
    return s.read.parquet(writers.write_table(table(s, d, "supplier"), path, compression="gzip"))


@register("k04_snapshot_rollback", "SELECT count(*) AS rows, true AS same FROM part")
def k04_snapshot(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "snapshots")
    part = table(s, d, "part")
    kept = writers.snapshot(part, folder, "part")
    back = s.read.parquet(writers.rollback(s, kept, f"{folder}/restored"))
    told = writers.snapshots(s, folder, "part").select("rows", "fingerprint")
    return told.join(back.agg(writers.content_hash(back).alias("now"))).select("rows", (F.col("fingerprint") == F.col("now")).alias("same"))


register("k10_export_columns", "SELECT row_number() OVER (ORDER BY c_custkey) AS \"#\", c_custkey, c_name FROM customer")(lambda s, d: writers.export_columns(table(s, d, "customer"), ["c_custkey", "c_name"], "c_custkey"))


@register("r01_incremental", "SELECT event_id, upper(event_type) AS event_type FROM events")
def r01_incremental(s: SparkSession, d: str) -> DataFrame:
    folder = scratch(s, "stream")
    table(s, d, "events").select("event_id", "event_type").write.parquet(f"{folder}/in")
    stream = incremental.read_stream(s, f"{folder}/in", "event_id long, event_type string")
    query = incremental.run_stream(stream, {"cleaning_steps": [{"action": "normalize", "column": "event_type", "params": {"case": "upper"}}]}, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return s.read.parquet(f"{folder}/out")
