"""Queries of the cleaning steps: projections, conditions, text, types, numbers, typed moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.functions.conditions import condition
from millrace.operators import columns, fuzzy, moves, numeric, text, types
from millrace.plans.recipe import Context, compile_recipe


def step(name: str, action: str, source: str, column: str, params: dict, keys: list[str], sql: str | None, out: str = "out") -> None:
    """A query that runs one recipe step on a copy `out` of a column."""

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source).select(*keys, F.expr(column).alias(out))
        return compile_recipe(df, {"cleaning_steps": [{"action": action, "column": out, "params": params}]})


# ---- projections, predicates, edits

register("p01_select", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s, d: columns.select(table(s, d, "orders"), ["o_orderkey", "o_totalprice"]))
register("p02_drop_column", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")(lambda s, d: columns.drop_column(table(s, d, "orders"), ["o_orderstatus", "o_orderdate", "o_orderpriority"]))
register("p03_drop_constant", "SELECT p_partkey, p_name FROM part")(lambda s, d: columns.drop_constant(table(s, d, "part").select("p_partkey", "p_name", F.lit("x").alias("c1"), F.lit(None).cast("int").alias("c2"))))
register("p04_rename", "SELECT c_custkey AS id, c_name AS customer FROM customer")(lambda s, d: columns.rename(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"], ["id", "customer"]))
register("p05_safe_rename", "SELECT c_custkey AS c_nationkey_1, c_name, c_nationkey FROM customer")(
    lambda s, d: columns.safe_rename(table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey"), {"c_custkey": "c_nationkey"})[0]
)
register("p06_exclude_metadata", "SELECT o_orderkey FROM orders")(
    lambda s, d: columns.without_meta(table(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("sheet_name"), F.col("o_orderpriority").alias("_hidden")))
)


def conditioned(name: str, tree: dict, sql: str, source: str = "lineitem", keys: str = "l_orderkey, l_linenumber") -> None:
    @register(name, f"SELECT {keys} FROM {source} WHERE {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.where(condition(df, tree)).select(*keys.split(", "))


conditioned("p07a_order_predicates", {"op": "and", "conds": [{"column": "l_quantity", "op": ">", "value": 10}, {"column": "l_quantity", "op": "<=", "value": 30}, {"column": "l_discount", "op": "<", "value": 0.07}, {"column": "l_tax", "op": ">=", "value": 0.02}]}, "l_quantity > 10 AND l_quantity <= 30 AND l_discount < 0.07 AND l_tax >= 0.02")
conditioned("p07b_equality", {"op": "and", "conds": [{"column": "l_returnflag", "op": "==", "value": "A"}, {"column": "l_linestatus", "op": "!=", "value": "O"}]}, "l_returnflag = 'A' AND l_linestatus <> 'O'")
conditioned("p07c_in", {"column": "l_returnflag", "op": "in", "value": ["A", "N"]}, "l_returnflag IN ('A', 'N')")
conditioned("p07d_contains", {"column": "p_name", "op": "contains", "value": "^[a-c].*e"}, "regexp_matches(p_name, '^[a-c].*e')", "part", "p_partkey, p_name")
conditioned("p07e_or", {"op": "or", "conds": [{"column": "l_quantity", "op": ">", "value": 45}, {"op": "and", "conds": [{"column": "l_returnflag", "op": "=", "value": "R"}, {"column": "l_discount", "op": ">", "value": 0.08}]}]}, "l_quantity > 45 OR (l_returnflag = 'R' AND l_discount > 0.08)")
conditioned("p07f_not", {"op": "not", "cond": {"column": "l_quantity", "op": ">=", "value": 5}}, "NOT l_quantity >= 5")

step("p08_conditional", "conditional", "customer", "c_mktsegment", {"value": "RICH", "condition": {"column": "c_acctbal", "op": ">", "value": 5000}}, ["c_custkey", "c_acctbal"], "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS out FROM customer")
step("p09_conditional_step", "normalize", "customer", "c_mktsegment", {"case": "lower", "condition": {"column": "c_acctbal", "op": "<", "value": 0}}, ["c_custkey", "c_acctbal"], "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS out FROM customer")


@register("p10_derive", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 10 AND l_discount < 0.05 THEN l_extendedprice * (1 - l_discount) END AS net,
        CASE WHEN l_returnflag = 'A' OR l_quantity >= 40 THEN l_returnflag || '-' || l_linestatus END AS tag, l_linenumber % 3 AS left_over, CAST(l_quantity AS DOUBLE) / 7 AS part
    FROM lineitem""")
def p10_derive(s: SparkSession, d: str) -> DataFrame:
    df = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus")
    rules = [{"if": "l_quantity > 10 and l_discount < 0.05", "then": {"col": "net", "value": "l_extendedprice * (1 - l_discount)"}}, {"if": "l_returnflag == 'A' or l_quantity >= 40", "then": {"col": "tag", "value": "l_returnflag + '-' + l_linestatus"}}, {"then": {"col": "left_over", "value": "l_linenumber % 3"}}, {"then": {"col": "part", "value": "l_quantity / 7"}}]
    return columns.derive_column(df, {"rules": rules}).select("l_orderkey", "l_linenumber", "net", "tag", "left_over", "part")


P11 = """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'row ' || c_custkey ELSE c_name END AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
        CASE WHEN c_custkey % 7 = 3 THEN 'seen' ELSE '' END AS note
    FROM customer
"""


@register("p11_apply_patch", P11)
def p11_patch(s: SparkSession, d: str) -> DataFrame:
    """Patches of a column and of a new one, older ones of the same cells, and patches of rows that are not there."""
    customer = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    patch = lambda rows, column, value, seq: rows.select(F.col("c_custkey").cast("long").alias("row"), F.lit(column).alias("column"), value.alias("value"), F.lit(seq).alias("seq"))
    fifth, seen = customer.where("c_custkey % 5 = 0"), customer.where("c_custkey % 7 = 3")
    gone = customer.select((F.col("c_custkey") + 10**12).alias("c_custkey"))
    patches = [
        patch(fifth, "c_name", F.concat(F.lit("row "), F.col("c_custkey").cast("string")), 1), patch(fifth, "c_name", F.lit("older"), 0),
        patch(seen, "note", F.lit("seen"), 0), patch(gone, "note", F.lit("far"), 0), patch(gone, "c_nationkey", F.lit("x"), 0),
    ]
    return columns.apply_patches(customer, reduce(DataFrame.union, patches), "c_custkey")


register("p12_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue') OR contains(lower(p_type), 'blue')")(lambda s, d: columns.search(table(s, d, "part"), ["p_name", "p_brand", "p_type"], "BLUE").select("p_partkey", "p_name"))
register("p13_category", "SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events)")(lambda s, d: columns.category(table(s, d, "events"), "event_type", table(s, d, "events").agg(F.min("event_type")).first()[0]).select("event_id", "event_type"))

# ---- text

step("x01a_normalize_lower", "normalize", "documents", "concat('  ', text, ' ')", {"case": "lower"}, ["doc_id"], "SELECT doc_id, lower(trim('  ' || text || ' ', ' ')) AS out FROM documents")
step("x01w_normalize_lower_whole", "normalize", "documents", "concat('  ', text, ' ')", {"case": "lower"}, ["doc_id"], "SELECT doc_id, lower(trim('  ' || text || ' ', ' ')) AS out FROM documents")
step("x01b_normalize_upper", "normalize", "part", "p_name", {"case": "upper"}, ["p_partkey"], "SELECT p_partkey, upper(trim(p_name)) AS out FROM part")
step("x02_normalize_capitalize", "normalize", "part", "concat(' ', upper(p_name))", {"case": "capitalize"}, ["p_partkey"], "SELECT p_partkey, upper(substr(trim(p_name), 1, 1)) || lower(substr(trim(p_name), 2)) AS out FROM part")
step("x03_normalize_title", "normalize", "part", "replace(p_name, ' ', '-')", {"case": "title"}, ["p_partkey"], "SELECT p_partkey, array_to_string(list_transform(string_split(trim(replace(p_name, ' ', '-')), '-'), lambda w: upper(w[1]) || lower(w[2:])), '-') AS out FROM part")
step("x04_normalize_preserve", "normalize", "customer", "concat(' ', c_name, ' ')", {"case": "preserve"}, ["c_custkey"], "SELECT c_custkey, trim(c_name) AS out FROM customer")
step("x05a_unicode_nfc", "unicode_normalize", "documents", "text", {"form": "NFC"}, ["doc_id"], "SELECT doc_id, nfc_normalize(text) AS out FROM documents")
step("x05b_strip_accents", "unicode_normalize", "documents", "text", {"form": "NFC", "remove_diacritics": True}, ["doc_id"], "SELECT doc_id, strip_accents(text) AS out FROM documents")
step("x06a_replace", "replace", "documents", "text", {"old": "the", "new": "$1"}, ["doc_id"], "SELECT doc_id, replace(text, 'the', '$1') AS out FROM documents")
step("x06b_replace_first", "replace", "documents", "text", {"old": "the", "new": "THE", "first": True}, ["doc_id"], "SELECT doc_id, regexp_replace(text, 'the', 'THE') AS out FROM documents")
step("x07_map", "map", "orders", "o_orderstatus", {"mapping": {"O": "open", "F": "filled"}}, ["o_orderkey"], "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS out FROM orders")
step("x08_regex_replace", "regex_replace", "part", "p_brand", {"pattern": r"([A-Za-z]+)#?(\d)", "replace": r"\2:\1"}, ["p_partkey"], r"SELECT p_partkey, regexp_replace(p_brand, '([A-Za-z]+)#?(\d)', '\2:\1', 'g') AS out FROM part")
step("x09_regex_flags", "regex_replace", "documents", "text", {"pattern": "^THE", "replace": "<the>", "flags": "i,m"}, ["doc_id"], "SELECT doc_id, regexp_replace(text, '(?im)^THE', '<the>', 'g') AS out FROM documents")
step("x10a_remove_dash", "remove_dash", "events", "CAST(to_date(ts) AS string)", {}, ["event_id"], "SELECT event_id, replace(strftime(ts, '%Y-%m-%d'), '-', '') AS out FROM events")
step("x10b_remove_letters", "remove_letters", "customer", "c_name", {}, ["c_custkey"], "SELECT c_custkey, regexp_replace(c_name, '[A-Za-z]+', '', 'g') AS out FROM customer")


@register("x11_spell_correct")
def x11_spell(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", F.translate("p_name", "ae", "ea").alias("out"))
    return fuzzy.spell_correct(part, "out", table(s, d, "part").select(F.col("p_name").alias("word")).distinct(), {"blue": "azure"}, 0.8)


step("x12_ocr_cleanup", "ocr_cleanup", "documents", "text", {"replacements": {"0": "O", "|": "I"}}, ["doc_id"], r"SELECT doc_id, trim(regexp_replace(replace(replace(regexp_replace(text, '[^\x20-\x7E]', '', 'g'), '0', 'O'), '|', 'I'), '\s+', ' ', 'g')) AS out FROM documents")
MIXED = "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS string) WHEN o_orderkey % 5 = 1 THEN CAST(to_date(o_orderdate) AS string) WHEN o_orderkey % 5 = 2 THEN o_orderpriority WHEN o_orderkey % 5 = 3 THEN concat('u', o_custkey, '@mail.example') ELSE concat('12 High St, ', o_orderstatus) END"
MIXED_SQL = "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 2 THEN o_orderpriority WHEN o_orderkey % 5 = 3 THEN 'u' || o_custkey || '@mail.example' ELSE '12 High St, ' || o_orderstatus END"
KIND = "CASE WHEN v LIKE '%@%.%' THEN 'email' WHEN regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') THEN 'date' WHEN regexp_full_match(v, '[-+]?[0-9]+(\\.[0-9]+)?') THEN 'numeric' WHEN regexp_matches(v, '\\d{5}(-\\d{4})?') THEN 'postal' WHEN v LIKE '%,%' THEN 'address' ELSE 'text' END"


@register("x13_split_mixed", f"SELECT o_orderkey, {', '.join(f'CASE WHEN k = {k!r} THEN v END AS m_{k}' for k in text.KINDS)} FROM (SELECT *, {KIND} AS k FROM (SELECT o_orderkey, {MIXED_SQL} AS v FROM orders))")
def x13_split(s: SparkSession, d: str) -> DataFrame:
    return text.split_mixed(table(s, d, "orders").select("o_orderkey", F.expr(MIXED).alias("v")), "v", {"prefix": "m_"}).drop("v")


NUMERIC = "regexp_full_match(v, '[-+]?\\d+(\\.\\d+)?')"
step("x14a_remove_numeric", "remove_by_type", "orders", MIXED, {"target_type": "numeric", "replacement": "-"}, ["o_orderkey"], f"SELECT o_orderkey, CASE WHEN {NUMERIC} THEN '-' ELSE v END AS out FROM (SELECT o_orderkey, {MIXED_SQL} AS v FROM orders)")
step("x14b_remove_text_but_dates", "remove_by_type", "orders", MIXED, {"target_type": "string", "exceptions": ["date"]}, ["o_orderkey"], f"SELECT o_orderkey, CASE WHEN {NUMERIC} OR regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN v ELSE '' END AS out FROM (SELECT o_orderkey, {MIXED_SQL} AS v FROM orders)")
PAIR_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '77' END AS b FROM orders"


def pair(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS string) ELSE o_orderstatus END AS a", "CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '77' END AS b")


register("x15_move_by_type", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE a END AS a, CASE WHEN o_orderkey % 3 = 0 THEN a ELSE b END AS b FROM ({PAIR_SQL})")(lambda s, d: moves.move_by_type(pair(s, d), {"source": "a", "target": "b", "type": "numeric"}))
register("x16_swap_by_types", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN b WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN b ELSE a END AS a, CASE WHEN o_orderkey % 3 = 0 THEN a WHEN o_orderkey % 2 = 0 THEN '' ELSE b END AS b FROM ({PAIR_SQL})")(lambda s, d: moves.swap_by_types(pair(s, d), {"moves": [{"source": "a", "target": "b", "type": "numeric"}, {"source": "b", "target": "a", "type": "string"}]}))
register("x17_similarity")(lambda s, d: table(s, d, "part").select("p_name", "p_type").distinct().select("p_name", "p_type", fuzzy.similarity(F.col("p_name"), F.col("p_type")).alias("score")))
register("x18_looks", f"SELECT o_orderkey, {NUMERIC} AS is_number, regexp_full_match(v, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS is_date FROM (SELECT o_orderkey, {MIXED_SQL} AS v FROM orders)")(lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr(MIXED).alias("v")).select("o_orderkey", moves.looks(F.col("v"), "numeric").alias("is_number"), moves.looks(F.col("v"), "date").alias("is_date")))

# ---- types and numbers

DIRTY = "CASE WHEN l_linenumber % 4 = 0 THEN concat('$', CAST(CAST(l_extendedprice AS bigint) AS string), '.5') WHEN l_linenumber % 4 = 1 THEN concat('(', CAST(CAST(l_quantity AS int) AS string), ')') WHEN l_linenumber % 4 = 2 THEN 'ten' ELSE concat('1,', CAST(100 + l_linenumber AS string)) END"
DIRTY_SQL = "CASE WHEN l_linenumber % 4 = 0 THEN '$' || CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) || '.5' WHEN l_linenumber % 4 = 1 THEN '(' || CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) || ')' WHEN l_linenumber % 4 = 2 THEN 'ten' ELSE '1,' || CAST(100 + l_linenumber AS VARCHAR) END"
CLEAN = "TRY_CAST(regexp_replace(v, '[$,\\s()]', '', 'g') AS DOUBLE)"
LINE = ["l_orderkey", "l_linenumber"]
dirty = lambda made: f"SELECT l_orderkey, l_linenumber, {made} AS out FROM (SELECT l_orderkey, l_linenumber, {DIRTY_SQL} AS v FROM lineitem)"
step("n01_cast_int", "cast", "lineitem", DIRTY, {"type": "int"}, LINE, dirty(f"CAST(trunc({CLEAN}) AS BIGINT)"))
step("n02_cast_float", "cast", "lineitem", DIRTY, {"type": "float"}, LINE, dirty(CLEAN))
step("n03_cast_string", "cast", "orders", "o_custkey", {"type": "string"}, ["o_orderkey"], "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS out FROM orders")
DATES = "CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'not a date' ELSE date_format(o_orderdate, 'd MMM yyyy') END END"
step("n04_cast_datetime", "cast", "orders", DATES, {"type": "datetime"}, ["o_orderkey"], "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE date_trunc('day', o_orderdate) END AS out FROM orders")
step("n05_cast_datetime_format", "cast", "orders", DATES, {"type": "datetime", "format": "%d.%m.%Y"}, ["o_orderkey"], "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 2 = 0 THEN NULL ELSE strftime(o_orderdate, '%d.%m.%Y') END AS out FROM orders")
step("n06_cast_on_invalid", "cast", "lineitem", DIRTY, {"type": "float", "on_invalid": {"action": "set_error", "column": "problem", "value": "bad"}}, LINE, f"SELECT l_orderkey, l_linenumber, {CLEAN} AS out, CASE WHEN {CLEAN} IS NULL THEN 'bad' END AS problem FROM (SELECT l_orderkey, l_linenumber, {DIRTY_SQL} AS v FROM lineitem)")
step("n07_cast_bool", "cast", "lineitem", "CASE WHEN l_linenumber = 1 THEN 'Yes' WHEN l_linenumber = 2 THEN 'f' WHEN l_linenumber = 3 THEN '7' WHEN l_linenumber = 4 THEN '0' ELSE 'maybe' END", {"type": "bool"}, LINE, "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS out FROM lineitem")
step("n08_cast_category", "cast", "part", "p_size", {"type": "category"}, ["p_partkey"], "SELECT p_partkey, CAST(p_size AS VARCHAR) AS out FROM part")
step("n09_abs", "numeric_transform", "customer", "c_acctbal", {"op": "abs"}, ["c_custkey"], "SELECT c_custkey, abs(c_acctbal) AS out FROM customer")
step("n10_round", "numeric_transform", "orders", "CAST(o_totalprice AS bigint)", {"op": "round", "ndigits": -3}, ["o_orderkey"], "SELECT o_orderkey, CAST((CAST(trunc(o_totalprice) AS BIGINT) + 500) // 1000 * 1000 AS BIGINT) AS out FROM orders")
step("n11_convert_currency", "convert_currency", "lineitem", DIRTY, {"from": "USD", "to": "EUR", "rate": 0.5}, LINE, dirty("CASE WHEN v LIKE '(%' THEN -0.5 ELSE 0.5 END * " + CLEAN))
step("n12_bucketize", "bucketize", "part", "p_size", {"buckets": [{"max": 10, "label": "small"}, {"min": 10, "max": 30, "label": "medium"}, {"min": 30, "label": "large"}]}, ["p_partkey"], "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS out FROM part")
step("n13_percentile_bucketize", "percentile_bucketize", "customer", "c_acctbal", {"buckets": [{"pmin": 0, "pmax": 25, "label": "low"}, {"pmin": 25, "pmax": 75, "label": "middle"}, {"pmin": 75, "pmax": 100, "label": "high"}]}, ["c_custkey"], "SELECT c_custkey, CASE WHEN c_acctbal <= (SELECT quantile_disc(c_acctbal, 0.25) FROM customer) THEN 'low' WHEN c_acctbal <= (SELECT quantile_disc(c_acctbal, 0.75) FROM customer) THEN 'middle' ELSE 'high' END AS out FROM customer")
register("n14_suggest_quantile", """
    WITH v AS (SELECT CAST(p_size AS DOUBLE) AS v, row_number() OVER (ORDER BY p_size) - 1 AS i, count(*) OVER () AS n FROM part), e AS (SELECT k, min(v) AS edge FROM v, range(0, 5) t(k) WHERE i = CAST(floor(k / 4.0 * (n - 1)) AS BIGINT) GROUP BY k)
    SELECT 'b' || CAST(a.k + 1 AS VARCHAR) AS label, a.edge AS min, b.edge AS max, CAST(a.k / 4.0 AS DOUBLE) AS pmin, CAST(b.k / 4.0 AS DOUBLE) AS pmax FROM e a JOIN e b ON b.k = a.k + 1""")(lambda s, d: numeric.suggest_buckets(table(s, d, "part"), "p_size", "quantile", 4))
register("n15_suggest_equal", "SELECT 'b' || CAST(k + 1 AS VARCHAR) AS label, CASE WHEN k > 0 THEN lo + (hi - lo) * (k / 4.0) END AS min, CASE WHEN k < 3 THEN lo + (hi - lo) * ((k + 1) / 4.0) END AS max, CAST(NULL AS DOUBLE) AS pmin, CAST(NULL AS DOUBLE) AS pmax FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), range(0, 4) t(k)")(lambda s, d: numeric.suggest_buckets(table(s, d, "customer"), "c_acctbal", "equal", 4))
N16 = """
    WITH b AS (SELECT avg(CAST(p_retailprice AS DOUBLE)) AS m FROM part),
    v AS (SELECT CAST(p_retailprice AS DOUBLE) - m AS v, count(*) AS n FROM part, b GROUP BY 1),
    p AS (SELECT row_number() OVER w AS i, sum(n) OVER w AS c, sum(n * v) OVER w AS s FROM v WINDOW w AS (ORDER BY v)),
    t AS (SELECT i, c, s FROM p ORDER BY i DESC LIMIT 1),
    best AS (
        SELECT x.s / x.c AS a, (y.s - x.s) / (y.c - x.c) AS b, (t.s - y.s) / (t.c - y.c) AS c
        FROM p AS x JOIN p AS y ON x.i < y.i JOIN t ON y.i < t.i
        ORDER BY round(x.s * x.s / x.c + (y.s - x.s) * (y.s - x.s) / (y.c - x.c) + (t.s - y.s) * (t.s - y.s) / (t.c - y.c), 4) DESC, y.i, x.i LIMIT 1
    ), cuts AS (SELECT round((best.a + best.b) / 2 + m, 4) AS x, round((best.b + best.c) / 2 + m, 4) AS y FROM best, b)
    SELECT 'b1' AS label, CAST(NULL AS DOUBLE) AS min, x AS max FROM cuts UNION ALL SELECT 'b2', x, y FROM cuts UNION ALL SELECT 'b3', y, NULL FROM cuts
"""


@register("n16_suggest_kmeans", N16)
def n16_kmeans(s: SparkSession, d: str) -> DataFrame:
    """The best three clusters of prices."""
    found = numeric.suggest_buckets(table(s, d, "part"), "p_retailprice", "kmeans", 3)
    return found.select("label", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


step("n17a_outliers_iqr", "detect_outliers", "orders", "o_totalprice", {"multiplier": 0.5, "flag_col": "odd"}, ["o_orderkey"], "SELECT o_orderkey, o_totalprice AS out, o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1) AS odd FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)")
step("n17b_outliers_deviation", "detect_outliers", "orders", "o_totalprice", {"method": "zscore", "multiplier": 1.5, "flag_col": "odd"}, ["o_orderkey"], "SELECT o_orderkey, o_totalprice AS out, o_totalprice < m - 1.5 * s OR o_totalprice > m + 1.5 * s AS odd FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")


@register("q09_multi_column", "SELECT c_custkey, lower(c_name) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer")
def q09_multi(s: SparkSession, d: str) -> DataFrame:
    return compile_recipe(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"cleaning_steps": [{"action": "normalize", "column": ["c_name", "c_mktsegment"], "params": {"case": "lower"}}]})


@register("q10_hoisting", "SELECT s_suppkey, upper(n_name) AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def q10_hoisting(s: SparkSession, d: str) -> DataFrame:
    recipe = {"cleaning_steps": [{"action": "normalize", "column": "nation", "params": {"case": "upper"}}, {"action": "lookup_join", "column": None, "params": {"table": "nation", "keys": {"s_nationkey": "n_nationkey"}, "fields": {"n_name": "nation"}}}]}
    return compile_recipe(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), recipe, Context(tables={"nation": table(s, d, "nation")})).select("s_suppkey", "nation")


@register("flagship_recipe", """
    SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean_balance, count(*) AS customers
    FROM (SELECT CASE WHEN c_acctbal > 9000 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer) GROUP BY 1""")
def flagship(s: SparkSession, d: str) -> DataFrame:
    recipe = {
        "cleaning_steps": [
            {"action": "normalize", "column": "c_name", "params": {"case": "lower"}},
            {"action": "conditional", "column": "c_mktsegment", "params": {"value": "VIP", "condition": {"column": "c_acctbal", "op": ">", "value": 9000}}},
            {"action": "groupby", "column": None, "params": {"columns": ["c_mktsegment"], "aggregations": [{"column": "c_acctbal", "op": "mean", "as": "mean_balance"}, {"op": "count", "as": "customers"}]}},
        ]
    }
    return compile_recipe(table(s, d, "customer"), recipe).withColumn("mean_balance", F.round("mean_balance", 6))


register("n06b_types_preserved", "SELECT o_orderkey, o_orderdate AS out FROM orders")(lambda s, d: types.cast(table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("out")), "out", {"type": "datetime"}))
