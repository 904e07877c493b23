"""Schema drift, declared schemas, suggestions and differences between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import col, is_meta
from millrace.operators.types import cast_column

TEXT_NAMES = ("name", "email", "id", "text", "address", "city")


def schema_table(df: DataFrame, source: str) -> DataFrame:
    """(source, column) of a table's columns."""
    return df.sparkSession.createDataFrame([(source, c) for c in df.columns], "source string, column string")


def record_columns(df: DataFrame, source: str, body: str) -> DataFrame:
    """(source, column) of the fields that the JSON records (column body) of each source hold; text that is no JSON object
    has none."""
    keys = F.explode(F.json_object_keys(col(body))).alias("column")
    return df.select(col(source).cast("string").alias("source"), keys).distinct()


def schema_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(source, missing, extra, ok) for (source, column) tables, many sources at once; ok: nothing is missing."""
    e, a = (x.groupBy("source").agg(F.collect_set("column").alias(n)) for x, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, "source", "full").select("source", F.coalesce("e", F.array().cast("array<string>")).alias("e"), F.coalesce("a", F.array().cast("array<string>")).alias("a"))
    less = lambda x, y: F.array_sort(F.array_except(x, y))
    return both.select("source", less("e", "a").alias("missing"), less("a", "e").alias("extra"), (F.size(F.array_except("e", "a")) == 0).alias("ok"))


def check_drift(df: DataFrame, expected: Sequence[str], extra_ok: bool = True) -> dict[str, Any]:
    """The difference of one table's columns, before any job runs."""
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(c for c in set(df.columns) - set(expected) if not is_meta(c))
    return {"missing": missing, "extra": extra, "ok": not missing and (extra_ok or not extra)}


def migrate(df: DataFrame, schema: Mapping[str, Mapping[str, Any]], strict: bool = False) -> DataFrame:
    """Bring a table to a declared schema {column: {type, required, default, rename_from}}: renames, then added columns
    with their default, then casts (null where a value does not fit), with strict only the declared columns.

    A required column that is neither there nor has a default raises.
    """
    for name, want in schema.items():
        old = want.get("rename_from")
        if name not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, name)
        if name not in df.columns:
            if want.get("required") and "default" not in want:
                raise ValueError(f"required column {name!r} is missing")
            df = df.withColumn(name, F.lit(want.get("default")).cast("string") if want.get("default") is None else F.lit(want["default"]))
    df = df.withColumns({n: cast_column(col(n), df.schema[n].dataType, str(w["type"]), {}) for n, w in schema.items() if w.get("type")})
    return df.select(*[col(c) for c in schema]) if strict else df


def cast_failures(df: DataFrame, schema: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """(column, failures): filled values that the declared type cannot hold."""
    typed = [(n, str(w["type"])) for n, w in schema.items() if w.get("type") and n in df.columns]
    row = df.agg(*(F.struct(F.lit(n).alias("column"), F.count_if(col(n).isNotNull() & cast_column(col(n), df.schema[n].dataType, t, {}).isNull()).alias("failures")).alias(f"c{i}") for i, (n, t) in enumerate(typed)))
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(typed))])).alias("c")).select("c.*")


def suggest_fixes(profile: DataFrame) -> DataFrame:
    """(column, action, strategy) by rules over a profile: gaps of numbers by median, of text by empty_string, one value
    only drop_constant."""
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    rules = F.array(
        F.when((F.col("nulls") > 0) & numeric, F.struct(F.lit("impute").alias("action"), F.lit("median").alias("strategy"))),
        F.when((F.col("nulls") > 0) & (F.col("dtype") == "string"), F.struct(F.lit("impute").alias("action"), F.lit("empty_string").alias("strategy"))),
        F.when(F.col("unique") <= 1, F.struct(F.lit("drop_constant").alias("action"), F.lit(None).cast("string").alias("strategy"))),
    )
    return profile.select("column", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("column", "r.*")


def suggest_cleaning(profile: DataFrame, action: str | None = None, k: int = 5) -> DataFrame:
    """(column, score): the k columns that most need cleaning: gaps min(0.7, 0.1 + nulls / 1000), one value 0.4, a name
    of identity or text 0.35, and 0.2 where the action fits the type."""
    named = F.col("column").rlike("(?i)" + "|".join(TEXT_NAMES))
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    score = F.when(F.col("nulls") > 0, F.least(F.lit(0.7), F.lit(0.1) + F.col("nulls") / 1000)).otherwise(0.0) + F.when(F.col("unique") <= 1, 0.4).otherwise(0.0) + F.when(named, 0.35).otherwise(0.0)
    bonus = {"impute": F.col("nulls") > 0, "normalize": F.col("dtype") == "string", "cast": F.col("dtype") == "string", "bucketize": numeric, "numeric_transform": numeric}.get(action or "")
    score = score + (F.when(bonus, 0.2).otherwise(0.0) if bonus is not None else F.lit(0.0))
    return profile.select("column", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "column").limit(k)


def cell_difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, column, old, new) of each cell that differs, as text; rows matched by the unique key, columns by name."""
    names = [c for c in before.columns if c in after.columns and c != key]
    x = before.select(col(key).alias("__k"), *[col(c).cast("string").alias(f"x{i}") for i, c in enumerate(names)])
    y = after.select(col(key).alias("__k"), *[col(c).cast("string").alias(f"y{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("old"), F.col(f"y{i}").alias("new")) for i, c in enumerate(names)])
    changed = F.filter(cells, lambda c: ~c["old"].eqNullSafe(c["new"]))
    return x.join(y, "__k").select(F.col("__k").alias(key), F.explode(changed).alias("c")).select(key, "c.*")


def accepted_patches(difference: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """The cells of a difference that (key, column) rows accept, as patches (row, column, value)."""
    return difference.join(accepted.select(key, "column").distinct(), [key, "column"], "left_semi").select(F.col(key).alias("row"), "column", F.col("new").alias("value"))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def tagged_union(tables: Mapping[str, DataFrame], tag: str = "_type") -> DataFrame:
    """Rows of all tables with the table's name in a column."""
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in tables.items()])


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row (rows_changed, cells_changed)."""
    return cell_difference(before, after, key).agg(F.count_distinct(col(key)).alias("rows_changed"), F.count("*").alias("cells_changed"))
