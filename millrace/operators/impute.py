"""Imputation: one step, many strategies. Missing is null, empty text and the step's sentinels (treat_as_missing)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col, is_meta, is_missing
from millrace.operators.numeric import number_of, one_row
from millrace.operators.ranks import group_medians, mode, percentiles
from millrace.operators.rows import fill

#: Groups of tasks whose factors are merged, rows that are factored at once, and the part of a column's length that must be
#: left beside the columns before it.
FAN, STACK, DEPENDENT = 32, 4096, 1e-12
ALIASES = {"forward_fill": "ffill", "backfill": "bfill", "most_common": "mode", "average": "mean", "robust_impute": "group_median"}


def like(df: DataFrame, column: str, value: Column) -> Column:
    """A filler in the column's type; a fraction for a whole-number column makes the column double."""
    kind = df.schema[column].dataType
    return value.cast("string") if isinstance(kind, T.StringType) else value if isinstance(kind, T.NumericType) else value.try_cast(kind.simpleString())


def impute(df: DataFrame, column: str, params: Mapping[str, Any], order: Any = None) -> DataFrame:
    """strategy: from_column, ffill, bfill, constant, empty_string, mode, mean, median, row_mean, regression or
    group_median, with source, sources, value, group_by and treat_as_missing. ffill and bfill need the order of rows.
    Columns that start with "_" are never changed.
    """
    if is_meta(column):
        return df
    how = str(params.get("strategy") or params.get("method") or default_strategy(df.schema[column].dataType))
    how = ALIASES.get(how, how)
    sentinels = params.get("treat_as_missing") or ()
    gap = is_missing(col(column), sentinels)
    source = params.get("source") or column
    groups = [params["group_by"]] if isinstance(params.get("group_by"), str) else list(params.get("group_by") or [])
    put = lambda frame, value: frame.withColumn(column, F.when(gap, like(df, column, value)).otherwise(col(column))).select(*[col(c) for c in df.columns])
    if how == "from_column":
        return put(df, col(source))
    if how in ("ffill", "bfill"):
        if order is None:
            raise ValueError(f"{how} needs the order of rows")
        marked = df.withColumn(column, F.when(~gap, col(column)))
        return fill(marked, [column], order, groups, backward=how == "bfill").select(*[col(c) for c in df.columns])
    if how == "constant":
        return put(df, F.lit(params.get("value")))
    if how == "empty_string":
        return df.withColumn(column, F.when(gap, F.lit("")).otherwise(col(column).cast("string")))
    if how == "mode":
        own = F.when(~is_missing(col(source), sentinels), col(source))
        return put(one_row(df, mode(df, own).select(F.col("v").alias("__v"))), F.col("__v"))
    if how in ("mean", "median", "group_median"):
        n = F.when(~is_missing(col(source), sentinels), number_of(df, source))
        if groups:
            found = df.groupBy(*[col(g) for g in groups]).agg(F.avg(n).alias("v")) if how == "mean" else group_medians(df, groups, n)
            found = found.select(*[col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("v").alias("__v"))
            same = [col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
            return put(df.join(found, same, "left"), F.col("__v"))
        if how == "mean":
            return put(one_row(df, df.agg(F.avg(n).alias("__v"))), F.col("__v"))
        return put(df, F.lit(percentiles(df, n, [0.5])[0]).cast("double"))
    if how == "row_mean":
        values = F.filter(F.array(*(number_of(df, s) for s in params.get("sources") or [])), lambda x: x.isNotNull())
        return put(df, F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)))
    if how == "regression":
        return regression(df, column, list(params.get("sources") or []), gap, str(params.get("model", "linear")))
    raise ValueError(f"unknown imputation strategy {how!r}")


def default_strategy(kind: T.DataType) -> str:
    """The strategy by type: numbers median, booleans and dates as below, text empty_string."""
    if isinstance(kind, T.NumericType):
        return "median"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "ffill"
    return "constant" if isinstance(kind, T.BooleanType) else "empty_string"


def triangle(rows: DataFrame, names: Sequence[str]) -> np.ndarray:
    """The triangular factor R of the columns `names` of all rows: a factor for each task, merged in FAN groups and then on
    the driver, which gets FAN factors of as many rows as there are columns."""
    fields = ", ".join(f"{n} double" for n in names)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(names)))
        for batch in batches:
            block = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            for i in range(0, len(block), STACK):
                r = np.linalg.qr(np.concatenate([r, block[i : i + STACK]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[:, j])) for j in range(len(names))], names=list(names))

    def merge(group: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.stack([group.column(n).to_numpy() for n in names], axis=1), mode="r")
        return pa.table([pa.array(np.ascontiguousarray(r[:, j])) for j in range(len(names))], names=list(names))

    parts = rows.select(*names).mapInArrow(factor, fields).withColumn("fan", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    merged = parts.groupBy("fan").applyInArrow(lambda group: merge(group), fields)
    return np.linalg.qr(np.array(merged.collect(), dtype=float).reshape(-1, len(names)), mode="r")


def ols(df: DataFrame, target: Column, sources: Sequence[Column]) -> np.ndarray:
    """Intercept and slopes of least squares over rows that are complete, by QR factors of the centred columns.

    No sums of squares are formed, so nearly dependent sources keep their digits. Sources that depend on each other raise.
    """
    names = [f"x{i}" for i in range(len(sources))]
    rows = df.select(*(s.cast("double").alias(n) for s, n in zip(sources, names, strict=True)), target.cast("double").alias("y")).dropna()
    k = len(names)
    means = rows.agg(F.count("*"), *(F.avg(n) for n in [*names, "y"])).first()
    if means[0] < k + 1:
        raise ValueError("regression needs more complete rows than sources")
    centre = np.array(means[1:], dtype=float)
    shifted = rows.select(F.lit(1.0).alias("one"), *((F.col(n) - float(c)).alias(n) for n, c in zip([*names, "y"], centre, strict=True)))
    r = triangle(shifted, ["one", *names, "y"])
    left = r[: k + 1, : k + 1]
    if len(left) < k + 1 or (np.abs(np.diag(left)) <= DEPENDENT * np.linalg.norm(left, axis=0)).any():
        raise ValueError("the sources of the regression depend on each other")
    found = np.linalg.solve(left, r[: k + 1, k + 1])
    slopes = found[1:]
    return np.concatenate([[found[0] + centre[-1] - slopes @ centre[:-1]], slopes])


def regression(df: DataFrame, column: str, sources: Sequence[str], gap: Column, model: str) -> DataFrame:
    """Missing values by least squares on the sources; rows without all sources stay missing."""
    if model not in ("linear", "ols"):
        raise ValueError(f"unknown regression model {model!r}")
    if not sources:
        raise ValueError("regression needs sources")
    x = [number_of(df, s) for s in sources]
    fitted = ols(df, F.when(~gap, number_of(df, column)), x)
    guess = sum((c * float(b) for c, b in zip(x, fitted[1:], strict=True)), F.lit(float(fitted[0])))
    return df.withColumn(column, F.when(gap, like(df, column, guess)).otherwise(col(column)))


def imputed_rows(before: DataFrame, after: DataFrame, column: str, order: str, sentinels: Sequence[object] = (), sample: int = 20) -> DataFrame:
    """One row (rows_changed, sample_positions): how many gaps of before are filled in after, and the first positions
    by the key column `order` (1-based positions, if that is a row number)."""
    a = before.select(col(order).alias("k"), is_missing(col(column), sentinels).alias("was"))
    b = after.select(col(order).alias("k"), is_missing(col(column), sentinels).alias("is"))
    hit = a.join(b, "k").where("was AND NOT is").select("k")
    first = hit.orderBy("k").limit(sample).agg(F.sort_array(F.collect_list("k")).alias("sample_positions"))
    return hit.agg(F.count("*").alias("rows_changed")).join(F.broadcast(first))
