"""Queries of aggregations, windows, order, imputation, quality and privacy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import register, table
from millrace.operators import aggregate, columns, impute, numeric, privacy, quality, ranks, rows
from millrace.plans import preview

# ---- aggregations

register("a01_groupby", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS lines FROM lineitem GROUP BY ALL")(
    lambda s, d: aggregate.groupby(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [{"column": "l_quantity", "op": "sum", "as": "sum_qty"}, {"column": "l_extendedprice", "op": "mean", "as": "mean_price"}, {"op": "count", "as": "lines"}]).withColumns({"sum_qty": F.round("sum_qty", 2), "mean_price": F.round("mean_price", 4)})
)
GAP_COLUMNS = (
    "o_orderkey AS id", "o_custkey AS l_orderkey", "o_orderkey % 7 + 1 AS l_linenumber", "o_orderpriority AS l_returnflag",
    "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice / 1000) END AS q",
    "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN 'NA' ELSE o_orderstatus END AS t",
)
GAPS = f"SELECT {', '.join(GAP_COLUMNS)} FROM orders"


def gaps(s: SparkSession, d: str) -> DataFrame:
    """Orders with gaps: q is null for a third of them, t is empty or NA for half."""
    return table(s, d, "orders").selectExpr(*GAP_COLUMNS)


def scalars(s: SparkSession, d: str) -> DataFrame:
    """Mean, median and mode, the latter two without a task that holds all values."""
    lines, quantity = table(s, d, "lineitem"), F.col("l_quantity")
    median = F.lit(ranks.percentiles(lines, quantity, [0.5])[0]).alias("median")
    return lines.agg(F.round(F.avg(quantity), 6).alias("mean")).join(F.broadcast(ranks.mode(lines, quantity))).select("mean", median, F.col("v").alias("mode"))


def quartiles(s: SparkSession, d: str, kind: str) -> DataFrame:
    found = ranks.percentiles(table(s, d, "orders"), F.col("o_totalprice"), [0.25, 0.75], kind)
    return s.createDataFrame([tuple(found)], "q1 double, q3 double")


PROFILED = ("q", "t", "l_returnflag")
register("a02_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS \"unique\" FROM g" for c in PROFILED).join([f"WITH g AS ({GAPS}) ", ""]))(lambda s, d: aggregate.profile(gaps(s, d).select(*PROFILED)).select("column", "nulls", "unique"))
register("a03_inspect", f"WITH g AS ({GAPS}) SELECT 't' AS \"column\", count_if(t = '') AS missing_count, round(count_if(t = '') * 100.0 / count(*), 2) AS missing_pct, count(DISTINCT CASE WHEN t <> '' THEN t END) AS unique_count, false AS mixed_type, count(DISTINCT CASE WHEN t <> '' THEN t END) <= 1 AS constant, (SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM g WHERE t = '' ORDER BY id LIMIT 20)) AS positions FROM g")(
    lambda s, d: aggregate.inspect(gaps(s, d).select("id", "t"), "id").withColumn("positions", F.array_join("missing_positions", ",")).drop("missing_positions")
)
register("a04_scalars", "SELECT round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, (SELECT l_quantity FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM lineitem")(lambda s, d: scalars(s, d))
register("a05_group_median", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem GROUP BY 1")(lambda s, d: aggregate.groupby(table(s, d, "lineitem"), "l_returnflag", [{"column": "l_quantity", "op": "mean", "as": "mean"}, {"column": "l_quantity", "op": "median", "as": "median"}]).withColumn("mean", F.round("mean", 6)))
register("a06_quantiles_linear", "SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders")(lambda s, d: quartiles(s, d, "linear"))
register("a07_quantiles_discrete", "SELECT quantile_disc(o_totalprice, 0.25) AS q1, quantile_disc(o_totalprice, 0.75) AS q3 FROM orders")(lambda s, d: quartiles(s, d, "disc"))
register("a08_mean_deviation", "SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS deviation FROM orders")(lambda s, d: table(s, d, "orders").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("deviation")))

A06B = """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
    SELECT round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM q
"""
A08B = """
    SELECT round(avg(o_totalprice) - 2 * stddev_pop(o_totalprice), 4) AS low, round(avg(o_totalprice) + 2 * stddev_pop(o_totalprice), 4) AS high
    FROM orders
"""
A07B = """
    WITH q AS (SELECT quantile_disc(o_totalprice, 0.25) AS q1, quantile_disc(o_totalprice, 0.75) AS q3 FROM orders)
    SELECT count(*) FILTER (o_totalprice <= q1) AS lower, any_value(q1) AS q1, any_value(q3) AS q3 FROM orders, q
"""


def rounded_bounds(s: SparkSession, d: str, method: str, multiplier: float) -> DataFrame:
    found = numeric.outlier_bounds(table(s, d, "orders"), "o_totalprice", method, multiplier)
    return found.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


register("a06b_quartile_bounds", A06B)(lambda s, d: rounded_bounds(s, d, "iqr", 1.5))
register("a08b_deviation_bounds", A08B)(lambda s, d: rounded_bounds(s, d, "zscore", 2.0))


@register("a07b_percentile_buckets", A07B)
def a07b_buckets(s: SparkSession, d: str) -> DataFrame:
    """The bounds of the buckets of percentiles, as the labelled rows show them."""
    orders = table(s, d, "orders").select("o_totalprice", F.col("o_totalprice").alias("label"))
    buckets = [{"pmin": 0, "pmax": 25, "label": "low"}, {"pmin": 25, "pmax": 75, "label": "mid"}]
    made = numeric.percentile_bucketize(orders, "label", {"buckets": buckets})
    top = lambda label: F.max(F.when(F.col("label") == label, F.col("o_totalprice")))
    return made.agg(F.count_if(F.col("label") == "low").alias("lower"), top("low").alias("q1"), top("mid").alias("q3"))


@register("a09_ols", "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def a09_ols(s: SparkSession, d: str) -> DataFrame:
    fitted = impute.ols(table(s, d, "lineitem"), F.col("l_extendedprice"), [F.col("l_quantity")])
    return s.createDataFrame([(round(float(fitted[0]), 4), round(float(fitted[1]), 6))], "intercept double, slope double")


register("a11_rows_changed", f"WITH g AS ({GAPS}) SELECT count_if(t IN ('', 'NA')) AS rows_changed, (SELECT array_to_string(list(id ORDER BY id), ',') FROM (SELECT id FROM g WHERE t IN ('', 'NA') ORDER BY id LIMIT 20)) AS positions FROM g")(
    lambda s, d: impute.imputed_rows(g := gaps(s, d).select("id", "t"), impute.impute(g, "t", {"strategy": "constant", "value": "x", "treat_as_missing": ["NA"]}), "t", "id", ["NA"]).select("rows_changed", F.array_join("sample_positions", ",").alias("positions"))
)
register("a12_top_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda s, d: aggregate.top_counts(table(s, d, "events"), "event_type", 10))
register("a13_preview_counts", "SELECT count(*) AS row_count, 6 AS column_count, count(*) > 50 AS has_next FROM events")(lambda s, d: aggregate.preview_counts(table(s, d, "events"), 50))
register("a14_duplicate_content", "SELECT octet_length(encode(text)) AS size, sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY text HAVING count(*) > 1")(lambda s, d: aggregate.duplicate_rows(table(s, d, "documents"), ["text"], "doc_id"))

# ---- windows and order

register("w01_ffill", f"WITH g AS ({GAPS}) SELECT id, last_value(q IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS q FROM g")(lambda s, d: rows.fill(gaps(s, d).select("id", "q"), ["q"], "id"))
register("w01b_ffill_keyed", f"WITH g AS ({GAPS}) SELECT id, last_value(q IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY id ROWS UNBOUNDED PRECEDING) AS q FROM g")(lambda s, d: rows.fill(gaps(s, d), ["q"], "id", ["l_orderkey"]).select("id", "q"))
register("w02_bfill", f"WITH g AS ({GAPS}) SELECT id, first_value(q IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM g")(lambda s, d: rows.fill(gaps(s, d).select("id", "q"), ["q"], "id", backward=True))
register("w04_row_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events")(lambda s, d: rows.with_row_index(table(s, d, "events").select("event_id", "ts"), "i", ["ts", "event_id"]).select("event_id", "i"))
register("w05_keep_first", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")(lambda s, d: rows.keep_first(table(s, d, "part").select("p_partkey", "p_name"), ["p_name"], "p_partkey"))
register("w06_latest_per_key", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")(lambda s, d: rows.latest_per_key(table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts", ["event_id"])[0].select("user_id", "event_id"))


@register("w07_latest_run", "SELECT l_suppkey AS recipe_id, max(l_shipdate) AS finished_at FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def w07_latest_run(s: SparkSession, d: str) -> DataFrame:
    runs = table(s, d, "lineitem").select(F.col("l_suppkey").alias("recipe_id"), F.col("l_shipdate").alias("finished_at"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("failed").alias("status"), F.col("l_orderkey").alias("run"))
    return rows.latest_run(runs).select("recipe_id", "finished_at")


@register("w08_hash_chain", "SELECT conv_id, turn, conv_id % 7 <> 3 OR turn <> 1 AS ok FROM conversations")
def w08_chain(s: SparkSession, d: str) -> DataFrame:
    turns = table(s, d, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", "text").alias("body"))
    logged = privacy.chain_log(turns, "conv_id", "turn", "body", "key")
    forged = logged.withColumn("body", F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), "forged").otherwise(F.col("body")))
    return privacy.verify_chain(forged, "conv_id", "turn", "body", "key").select("conv_id", "turn", "ok")


register("t02_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 30 OFFSET 60")(lambda s, d: rows.page(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 60, 30))
register("t03_numbered_page", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")(lambda s, d: rows.numbered_page(table(s, d, "customer").select("c_custkey"), "c_custkey", 3, 25)[0])
register("t04_head", "SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 10")(lambda s, d: rows.head(table(s, d, "supplier").select("s_suppkey"), 10, "s_suppkey"))
register("t06_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")(lambda s, d: rows.top(table(s, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 10, ["o_orderkey"]))
register("t07_first_matching", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') ORDER BY 1 LIMIT 7")(lambda s, d: rows.head(columns.search(table(s, d, "part"), ["p_name"], "e").select("p_partkey"), 7, "p_partkey"))

# ---- imputation


def imputing(name: str, params: dict, made: str, column: str = "q", order: bool = False) -> None:
    @register(name, f"WITH g AS ({GAPS}) SELECT id, {made} AS {column} FROM g")
    def run(s: SparkSession, d: str) -> DataFrame:
        return impute.impute(gaps(s, d), column, params, "id" if order else None).select("id", column)


imputing("m01_from_column", {"strategy": "from_column", "source": "l_linenumber"}, "coalesce(q, l_linenumber)")
imputing("m02_ffill", {"strategy": "forward_fill"}, "last_value(q IGNORE NULLS) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING)", order=True)
imputing("m03_bfill", {"strategy": "backfill"}, "first_value(q IGNORE NULLS) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", order=True)
imputing("m04_constant", {"strategy": "constant", "value": "none", "treat_as_missing": ["NA"]}, "CASE WHEN t IN ('', 'NA') THEN 'none' ELSE t END", "t")
imputing("m05_empty_string", {"strategy": "empty_string", "treat_as_missing": ["NA"]}, "CASE WHEN t = 'NA' THEN '' ELSE t END", "t")
imputing("m06_mode", {"strategy": "most_common"}, "coalesce(q, (SELECT q FROM g WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1))")
imputing("m08_median", {"strategy": "median"}, "coalesce(q, (SELECT median(q) FROM g))")
imputing("m09_grouped_median", {"strategy": "median", "group_by": "l_returnflag"}, "coalesce(q, median(q) OVER (PARTITION BY l_returnflag))")
imputing("m12_group_median", {"strategy": "robust_impute", "group_by": "l_orderkey"}, "coalesce(q, median(q) OVER (PARTITION BY l_orderkey))")
register("m07_mean", f"WITH g AS ({GAPS}) SELECT id, round(coalesce(q, (SELECT avg(q) FROM g)), 6) AS q FROM g")(lambda s, d: impute.impute(gaps(s, d), "q", {"strategy": "mean"}).select("id", F.round("q", 6).alias("q")))
register("m10_row_mean", f"WITH g AS ({GAPS}) SELECT id, coalesce(q, (l_linenumber + l_orderkey) / 2.0) AS q FROM g")(lambda s, d: impute.impute(gaps(s, d), "q", {"strategy": "row_mean", "sources": ["l_linenumber", "l_orderkey"]}).select("id", "q"))
register("m11_regression", f"WITH g AS ({GAPS}), f AS (SELECT regr_slope(q, l_linenumber) AS b, regr_intercept(q, l_linenumber) AS a FROM g) SELECT id, round(coalesce(q, a + b * l_linenumber), 6) AS q FROM g, f")(lambda s, d: impute.impute(gaps(s, d), "q", {"strategy": "regression", "sources": ["l_linenumber"]}).select("id", F.round("q", 6).alias("q")))
register("m13_default_strategy", f"WITH g AS ({GAPS}) SELECT id, coalesce(q, (SELECT median(q) FROM g)) AS q, t FROM g")(lambda s, d: impute.impute(impute.impute(gaps(s, d), "q", {}), "t", {}).select("id", "q", "t"))

# ---- quality

register("q01_drift", "SELECT 'orders' AS source, 'o_extra' AS missing, 'o_custkey,o_orderdate' AS extra, false AS ok")(
    lambda s, d: quality.schema_difference(s.createDataFrame([("orders", c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_extra")], "source string, column string"), quality.schema_table(table(s, d, "orders"), "orders")).select("source", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "ok")
)
register("q02_migrate", "SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS BIGINT) AS price, 'new' AS state FROM orders")(lambda s, d: quality.migrate(table(s, d, "orders"), {"id": {"rename_from": "o_orderkey"}, "price": {"rename_from": "o_totalprice", "type": "int"}, "state": {"default": "new"}}, strict=True))
register("q02b_cast_failures", "SELECT 'o_orderpriority' AS \"column\", count(*) AS failures FROM orders UNION ALL SELECT 'o_custkey', 0")(lambda s, d: quality.cast_failures(table(s, d, "orders"), {"o_orderpriority": {"type": "float"}, "o_custkey": {"type": "int"}}))
register("q03_suggest_fixes", "SELECT 'q' AS \"column\", 'impute' AS action, 'median' AS strategy")(lambda s, d: quality.suggest_fixes(aggregate.profile(gaps(s, d))))
register("q04_suggest_cleaning", f"WITH g AS ({GAPS}) SELECT 'q' AS \"column\", round(least(0.7, 0.1 + (count(*) - count(q)) / 1000), 6) AS score FROM g UNION ALL SELECT 'id', 0.35")(lambda s, d: quality.suggest_cleaning(aggregate.profile(gaps(s, d))))


@register("q05_preview", "SELECT c_custkey, lower(c_name) AS c_name FROM customer ORDER BY 1 LIMIT 5")
def q05_preview(s: SparkSession, d: str) -> DataFrame:
    return preview.preview(table(s, d, "customer").select("c_custkey", "c_name"), {"cleaning_steps": [{"action": "normalize", "column": "c_name", "params": {"case": "lower"}}]}, 5, "c_custkey")[1]


register("q06_step_preview", "SELECT 'p_name' AS \"column\", string_agg(p_name, ',' ORDER BY p_partkey) AS before, string_agg(upper(p_name), ',' ORDER BY p_partkey) AS after FROM (FROM part ORDER BY p_partkey LIMIT 20)")(
    lambda s, d: preview.step_preview(table(s, d, "part").select("p_partkey", "p_name"), {"action": "normalize", "column": "p_name", "params": {"case": "upper"}}, 20, "p_partkey").select("column", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))
)
EXPLAINED = f"""
    WITH g AS ({GAPS})
    SELECT 0 AS step, 'impute' AS action, 'q' AS "column", CAST(0.8 AS DOUBLE) AS confidence,
        'impute: q is double with ' || CAST(count(*) - count(q) AS VARCHAR) || ' missing; strategy=median' AS reason
    FROM g
    UNION ALL
    SELECT 1, 'rename', 't', CAST(0.9 AS DOUBLE), 'rename: t is string with ' || CAST(count(*) - count(t) AS VARCHAR) || ' missing; new_name=u' FROM g
"""
register("q07_explain", EXPLAINED)(
    lambda s, d: preview.explain({"cleaning_steps": [{"action": "impute", "column": "q", "params": {}}, {"action": "rename", "column": "t", "params": {"new_name": "u"}}]}, aggregate.profile(gaps(s, d)))
)


def changed(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    return quality.cell_difference(parts, parts.withColumns({"p_brand": F.lower("p_brand"), "p_size": F.when(F.col("p_size") > 25, 25).otherwise(F.col("p_size"))}), "p_partkey")


register("q08_cell_difference", "SELECT p_partkey, 'p_brand' AS \"column\", p_brand AS old, lower(p_brand) AS new FROM part WHERE lower(p_brand) <> p_brand UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR), '25' FROM part WHERE p_size > 25")(changed)
register("q11_accept_cells", "SELECT p_partkey AS row, 'p_size' AS \"column\", '25' AS value FROM part WHERE p_size > 25 AND p_partkey % 2 = 0")(lambda s, d: quality.accepted_patches(changed(s, d), table(s, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.lit("p_size").alias("column")), "p_partkey"))
register("u02_union", "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")(lambda s, d: quality.union_all([table(s, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name"), table(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")]))
register("u03_tagged_union", "SELECT s_suppkey AS id, 'supplier' AS _type FROM supplier UNION ALL SELECT c_custkey, 'customer' FROM customer")(lambda s, d: quality.tagged_union({"supplier": table(s, d, "supplier").selectExpr("s_suppkey AS id"), "customer": table(s, d, "customer").selectExpr("c_custkey AS id")}))

# ---- privacy

register("p14_opt_out", "SELECT event_id FROM events WHERE user_id % 5 <> 0 AND lower('u' || user_id || '@x.example') NOT IN (SELECT DISTINCT 'u' || user_id || '@x.example' FROM events WHERE user_id % 7 = 0)")(
    lambda s, d: privacy.without_opted_out(table(s, d, "events").select("event_id", "user_id", F.concat(F.lit("U"), "user_id", F.lit("@X.example")).alias("email")), table(s, d, "events").select(F.when(F.col("user_id") % 5 == 0, F.col("user_id")).alias("user_id"), F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("u"), "user_id", F.lit("@x.example"))).alias("email"))).select("event_id")
)
register("p15_subject_access", "SELECT source, count(*) AS records FROM (SELECT 'orders' AS source FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'events' FROM events WHERE user_id = 7) GROUP BY 1")(lambda s, d: privacy.subject_rows({"orders": (table(s, d, "orders"), "o_custkey"), "events": (table(s, d, "events"), "user_id")}, 7).groupBy("source").agg(F.count("*").alias("records")))
register("p16_subject_deletion", "SELECT event_id FROM events WHERE user_id <> 7")(lambda s, d: privacy.delete_subject(table(s, d, "events"), "user_id", 7, "event_id")[0].select("event_id"))
register("p17_strip_secrets", "SELECT c_custkey, '<redacted>' AS token FROM customer")(lambda s, d: privacy.strip_secrets(table(s, d, "customer").select("c_custkey", F.col("c_name").alias("pw_hash"), F.col("c_name").alias("token"))))
register("p18_redact_columns", "SELECT c_custkey, 'redacted@example.com' AS c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'redacted@example.com' ELSE 'redacted@example.com' END AS contact FROM customer")(lambda s, d: privacy.redact_columns(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "a@b.example").otherwise("none").alias("contact"))))
register("p19_redact_text", r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 'redacted@example.com', 'g') AS text FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", privacy.redact_text(F.col("text")).alias("text")))
