"""Aggregations: grouped steps, profiles, diagnostics, counts by label and duplicates by content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col, data_columns, is_blank, is_numeric_text
from millrace.operators.ranks import group_medians

#: Bytes of a value from which its digest stands for it in a profile.
LONG = 64

OPS = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": F.median, "std": F.stddev_samp, "var": F.var_samp, "first": F.min, "n_unique": F.count_distinct, "nunique": F.count_distinct, "mode": lambda c: F.mode(c, True)}


def groupby(df: DataFrame, columns: str | Sequence[str], aggregations: Sequence[Mapping[str, Any]]) -> DataFrame:
    """aggregations [{column, op, as}] per group; count without a column counts rows."""
    keys = [columns] if isinstance(columns, str) else list(columns)
    made: list[Column] = []
    medians: list[tuple[str, str]] = []
    names: list[str] = []
    for a in aggregations:
        op, name = str(a["op"]).lower(), a.get("column")
        if op not in OPS:
            raise ValueError(f"unknown aggregation {op!r}")
        names.append(a.get("as") or (f"{name}_{op}" if name else op))
        if op == "median":
            medians.append((name, names[-1]))
        else:
            made.append((F.count("*") if op == "count" and not name else OPS[op](col(name))).alias(names[-1]))
    out = df.groupBy(*[col(k) for k in keys]).agg(*made) if made or not medians else None
    for name, alias in medians:
        found = group_medians(df, keys, col(name)).withColumnRenamed("v", alias)
        if out is None:
            out = found
            continue
        renamed = found.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], col(alias))
        same = [out[f"`{k}`"].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        out = out.join(renamed, same).drop(*[f"__k{i}" for i in range(len(keys))])
    return out.select(*[col(k) for k in keys], *[col(n) for n in names])


def exact_text(df: DataFrame, name: str) -> Column:
    """A column's value as text, different for different values."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.FloatType | T.DoubleType):
        return (c + F.lit(0.0)).cast("string")  # -0.0 is 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType | T.StructType | T.MapType):
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    return c.cast("string")


def value_counts(df: DataFrame, names: Sequence[str], blanks: bool) -> DataFrame:
    """(i, v, number, n): how often each column (i, its place) has each value, in one exchange for all columns. v is the
    value as text, or the digest of a long one; null for null, with blanks for blank values too."""

    def cell(i: int, name: str) -> Column:
        text = exact_text(df, name)
        v = F.when(F.octet_length(text) > LONG, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
        filled = ~is_blank(col(name)) if blanks else col(name).isNotNull()
        return F.struct(F.lit(i).alias("i"), F.when(filled, v).alias("v"), F.when(filled, is_numeric_text(col(name).cast("string")) if blanks else F.lit(False)).alias("number"))

    long = df.select(F.explode(F.array(*[cell(i, n) for i, n in enumerate(names)])).alias("c")).select("c.*")
    return long.groupBy("i", "v", "number").agg(F.count("*").alias("n"))


def named(df: DataFrame, names: Sequence[str], by: DataFrame) -> DataFrame:
    """A row for each column: its place, name and type beside its row of `by` (i, ...), if there is one."""
    kinds = dict(df.dtypes)
    head = df.sparkSession.createDataFrame([(i, n, kinds[n]) for i, n in enumerate(names)], "position int, column string, dtype string")
    return head.join(by, head["position"] == by["i"], "left").drop("i")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(position, column, dtype, nulls, unique) per data column; null counts as a value of unique.

    One exchange, whatever the number of columns: cells are counted by column and value, and those counts by column.
    approximate takes a sketch per column instead.
    """
    names = data_columns(df)
    kinds = dict(df.dtypes)
    if not approximate:
        per = value_counts(df, names, False).groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("*").alias("unique"))
        zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
        return named(df, names, per).select("position", "column", "dtype", zero("nulls"), zero("unique"))
    aggs = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), F.lit(kinds[n]).alias("dtype"), F.count_if(col(n).isNull()).alias("nulls"), (F.approx_count_distinct(col(n)) + F.max(F.when(col(n).isNull(), 1).otherwise(0))).alias("unique")).alias(f"c{i}") for i, n in enumerate(names)]
    return df.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(names))])).alias("c")).select("c.*")


def inspect(df: DataFrame, order: str, sample: int = 20) -> DataFrame:
    """Per data column: missing_count, missing_pct (2 digits), unique_count, mixed_type, constant, and the first
    `sample` positions (values of the unique column `order`) that are missing. Missing is null or blank.

    Two scans, whatever the number of columns: one for counts by column and value, one for positions, of which each task
    keeps no more than `sample` a column.
    """
    names = [n for n in data_columns(df) if n != order]
    filled = F.col("v").isNotNull()
    per = value_counts(df, names, True).groupBy("i").agg(
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("missing_count"), F.sum("n").alias("rows"), F.count("v").alias("unique_count"),
        F.coalesce(F.bool_or(F.when(filled, F.col("number"))) & F.bool_or(F.when(filled, ~F.col("number"))), F.lit(False)).alias("mixed_type"),
    )
    gaps = F.array(*[F.when(is_blank(col(n)), F.lit(i)) for i, n in enumerate(names)])
    places = df.select(col(order).alias("place"), F.explode(F.array_compact(gaps)).alias("i"))
    first = places.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("place"))).where(F.col("rank") <= sample)
    first = first.groupBy("i").agg(F.sort_array(F.collect_list("place")).alias("missing_positions"))
    made = named(df, names, per.join(first, "i", "left"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    pct = F.round(F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("rows")), F.lit(0.0)), 2).alias("missing_pct")
    empty = F.array().cast(T.ArrayType(df.schema[order].dataType))
    return made.select("column", zero("missing_count"), pct, zero("unique_count"), F.coalesce("mixed_type", F.lit(False)).alias("mixed_type"), (F.coalesce("unique_count", F.lit(0)) <= 1).alias("constant"), F.coalesce("missing_positions", empty).alias("missing_positions"))


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*[col(c) for c in columns]).agg(F.count("*").alias("count"))


def top_counts(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    return counts_by(df, [column]).orderBy(F.desc("count"), col(column)).limit(k)


def preview_counts(df: DataFrame, limit: int) -> DataFrame:
    """One row (row_count, column_count, has_next)."""
    return df.agg(F.count("*").alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"), (F.col("row_count") > limit).alias("has_next"))


def duplicate_rows(df: DataFrame, columns: Sequence[str], id_column: str) -> DataFrame:
    """Rows of equal content: (size, hash, copies, first, last). Sizes that occur once are left out before hashing."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) for c in columns])
    sized = df.withColumn("__size", size)
    often = sized.groupBy("__size").agg(F.count("*").alias("__n")).where("__n > 1").select("__size")
    some = sized.join(often, "__size", "left_semi")
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
    return some.groupBy(F.col("__size").alias("size"), digest.alias("hash")).agg(F.count("*").alias("copies"), F.min(col(id_column)).alias("first"), F.max(col(id_column)).alias("last")).where("copies > 1")
