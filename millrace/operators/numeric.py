"""Number steps: abs and round, currencies, buckets, quantiles and outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col, parse_number, plain_number
from millrace.operators.ranks import at_ranks, percentiles
from millrace.operators.types import to_double

#: Distinct values that clusters are found over exactly, and passes in which centres of more values may move.
CLUSTERED, MOVES = 100_000, 50
#: The rates that stand in where a step gives none.
FALLBACK_RATES = {("USD", "EUR"): 0.92, ("EUR", "USD"): 1.09, ("USD", "GBP"): 0.79, ("GBP", "USD"): 1.27}


def number_of(df: DataFrame, column: str) -> Column:
    """The column as double; text by plain_number."""
    kind = df.schema[column].dataType
    return col(column).cast("double") if isinstance(kind, T.NumericType) else plain_number(col(column))


def numeric_transform(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """op abs, or round to ndigits (-9 to 9; half_even as Python does, else half up). Values that are no number stay."""
    op = str(params.get("op") or params.get("operation") or "").lower()
    kind, c = df.schema[column].dataType, col(column)
    n = c if isinstance(kind, T.NumericType) else to_double(c, "negative")
    if op == "abs":
        made = F.abs(n)
    elif op == "round":
        digits = int(params.get("ndigits", 0))
        if not -9 <= digits <= 9:
            raise ValueError("ndigits must lie between -9 and 9")
        made = F.bround(n, digits) if params.get("half_even") else F.round(n, digits)
    else:
        raise ValueError(f"unknown numeric operation {op!r}")
    return df.withColumn(column, made if isinstance(kind, T.NumericType) else F.coalesce(made.cast("string"), c))


def convert_currency(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """out_col = number * rate, the rate given or from a small table by from and to; null where there is no number."""
    rate = params.get("rate") or FALLBACK_RATES.get((str(params.get("from", "")).upper(), str(params.get("to", "")).upper()))
    if not rate:
        raise ValueError("convert_currency needs a rate, or a pair of currencies that is known")
    c = col(column)
    n = c.cast("double") if isinstance(df.schema[column].dataType, T.NumericType) else parse_number(c)
    return df.withColumn(params.get("out_col") or column, n * F.lit(float(rate)))


def bucket_label(n: Column, rest: Column, buckets: Sequence[Mapping[str, Any]]) -> Column:
    """The label of the first bucket that holds n: over min, under max, or between both inclusive; else rest."""
    made = None
    for b in buckets:
        low, high = b.get("min"), b.get("max")
        if low is None and high is None:
            raise ValueError("a bucket needs min or max")
        inside = n.between(float(low), float(high)) if low is not None and high is not None else n > float(low) if low is not None else n < float(high)
        label = F.lit(str(b["label"]))
        made = F.when(inside, label) if made is None else made.when(inside, label)
    return rest if made is None else made.otherwise(rest)


def bucketize(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """buckets [{min, max, label}]: the first that holds the value's first number gives its label; others stay as text."""
    c = col(column)
    n = c.cast("double") if isinstance(df.schema[column].dataType, T.NumericType) else F.regexp_extract(F.replace(c.cast("string"), F.lit(","), F.lit("")), r"[-+]?\d*\.?\d+", 0).try_cast("double")
    return df.withColumn(column, bucket_label(n, c.cast("string"), params.get("buckets") or []))


def percentile_bucketize(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """buckets [{pmin, pmax, label}], bounds as exact discrete percentiles (0 to 100, or 0 to 1), both inclusive."""
    buckets = params.get("buckets") or []
    scale = lambda p: float(p) / 100 if float(p) > 1 else float(p)
    n = number_of(df, column)
    bounds = percentiles(df, n, [scale(b.get(k, d)) for b in buckets for k, d in (("pmin", 0), ("pmax", 100))], "disc")
    made = F.when(F.lit(False), F.lit(""))
    for b, low, high in zip(buckets, bounds[::2], bounds[1::2], strict=True):
        made = made.when(n.between(low, high), F.lit(str(b["label"])))
    return df.withColumn(column, made.otherwise(col(column).cast("string")))


def one_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """df beside an aggregate's single row."""
    return df.join(F.broadcast(row))


def suggest_buckets(df: DataFrame, column: str, method: str = "quantile", n: int = 4) -> DataFrame:
    """(label, min, max, pmin, pmax) of n buckets b1 ... by quantile, equal width or kmeans.

    quantile: the edges are the values at rank floor(p * (count - 1)). equal: even steps between least and greatest, the
    ends open. kmeans: midpoints between the centres of the best clusters, by quantile if there are fewer values.
    """
    spark = df.sparkSession
    values = df.select(number_of(df, column).alias("v")).where("v IS NOT NULL")
    share = [i / n for i in range(n + 1)]
    if method == "equal":
        low, high = values.agg(F.min("v"), F.max("v")).first()
        if low is None:
            return spark.createDataFrame([], "label string, min double, max double, pmin double, pmax double")
        edges = [low + (high - low) * p for p in share]
        rows = [(f"b{i + 1}", None if i == 0 else edges[i], None if i == n - 1 else edges[i + 1], None, None) for i in range(n)]
    elif method == "kmeans":
        centres = cluster_centres(values, n)
        if len(centres) < n:
            return suggest_buckets(df, column, "quantile", n)
        cuts = [None, *((a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)), None]
        rows = [(f"b{i + 1}", cuts[i], cuts[i + 1], None, None) for i in range(len(centres))]
    elif method == "quantile":
        edges = quantile_edges(values, share)
        if not edges:
            return spark.createDataFrame([], "label string, min double, max double, pmin double, pmax double")
        rows = [(f"b{i + 1}", edges[i], edges[i + 1], share[i], share[i + 1]) for i in range(n)]
    else:
        raise ValueError(f"unknown bucket method {method!r}")
    return spark.createDataFrame([tuple(x if x is None or isinstance(x, str) else float(x) for x in r) for r in rows], "label string, min double, max double, pmin double, pmax double")


def quantile_edges(values: DataFrame, shares: Sequence[float]) -> list[float]:
    """The exact values of v at ranks floor(share * (count - 1))."""
    total = values.count()
    return at_ranks(values, F.col("v"), [int(p * (total - 1)) for p in shares]) if total else []


def cluster_centres(values: DataFrame, k: int, most: int = CLUSTERED) -> list[float]:
    """The centres of the k clusters of v with the least sum of squares, ascending; of fewer distinct values, those.

    Spark counts the distinct values, and clusters are found exactly over those. More than `most` distinct values are first
    put into about as many bins of equal counts; from the best clusters of these bins on, each value moves to its nearest
    centre and each centre to the mean of its values, until no value moves.
    """
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    if counts.count() <= most:
        return clusters_of(counts, k)
    edges = values.agg(F.percentile_approx("v", [i / most for i in range(1, most)], 10 * most)).first()[0]
    cuts = sorted(set(edges))
    place = F.pandas_udf(lambda x: pd.Series(np.searchsorted(cuts, x, side="right")), "long")
    centres = clusters_of(counts.groupBy(place("v").alias("b")).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n")), k)
    for _ in range(MOVES):
        middle = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
        own = sum(((F.col("v") >= m).cast("int") for m in middle), F.lit(0))
        moved = [r.v for r in values.groupBy(own.alias("c")).agg(F.avg("v").alias("v")).orderBy("c").collect()]
        if moved == centres:
            break
        centres = moved
    return centres


def clusters_of(counts: DataFrame, k: int) -> list[float]:
    rows = np.array([(r.v, r.n) for r in counts.orderBy("v").collect()], dtype=float).reshape(-1, 2)
    return [float(c) for c in best_clusters(rows[:, 0], rows[:, 1], k)]


def best_clusters(v: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Means of the k runs of ascending values v of weights n with the least sum of squares; of ties the run that begins
    first, from the last run on.

    cost[j] is the least for the first j values in so many runs. The best start of the last run only moves right as j grows,
    so the starts of a row are found by halves: that of the middle bounds those on either side.
    """
    m = len(v)
    if m <= k:
        return v
    base = np.average(v, weights=n)
    c, s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * (v - base), n * (v - base) ** 2))

    def spread(i: np.ndarray, j: int) -> np.ndarray:
        return np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (c[j] - c[i]), 0.0)

    slack = 1e-12 * q[m]  # sums that differ by their rounding alone are ties
    cost = np.concatenate([[0.0], [float(spread(np.array([0]), j)[0]) for j in range(1, m + 1)]])
    starts: list[np.ndarray] = []
    for run in range(2, k + 1):
        new, best = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        todo = [(run, m, run - 1, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            total = cost[i] + spread(i, j)
            at = int(np.argmax(total <= total.min() + slack))
            new[j], best[j] = total[at], i[at]
            todo += [(low, j - 1, first, int(i[at])), (j + 1, high, int(i[at]), last)]
        cost = new
        starts.append(best)
    cuts, j = [m], m
    for best in reversed(starts):
        j = int(best[j])
        cuts.append(j)
    edges = np.array([0, *reversed(cuts)])
    return base + np.diff(s[edges]) / np.diff(c[edges])


def outlier_bounds(df: DataFrame, column: str, method: str, multiplier: float) -> DataFrame:
    """One row (low, high): quartiles -/+ multiplier * their distance, or mean -/+ multiplier * population deviation."""
    values = df.select(number_of(df, column).alias("v"))
    if method == "iqr":
        a, b = percentiles(values, F.col("v"), [0.25, 0.75])
        rows = [(None, None) if a is None else (a - multiplier * (b - a), b + multiplier * (b - a))]
        return df.sparkSession.createDataFrame(rows, "low double, high double")
    return values.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).select((F.col("m") - multiplier * F.col("s")).alias("low"), (F.col("m") + multiplier * F.col("s")).alias("high"))


def detect_outliers(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """A boolean column flag_col (column + "__outlier"): outside the bounds of method iqr (default) or another name for
    mean and deviation; false for what is no number."""
    method, multiplier = str(params.get("method", "iqr")), float(params.get("multiplier", 1.5))
    flag = params.get("flag_col") or f"{column}__outlier"
    bounds = outlier_bounds(df, column, method, multiplier).select(F.col("low").alias("__low"), F.col("high").alias("__high"))
    n = number_of(df, column)
    made = one_row(df, bounds).withColumn(flag, F.coalesce((n < F.col("__low")) | (n > F.col("__high")), F.lit(False)))
    return made.drop("__low", "__high")
