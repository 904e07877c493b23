"""Typed moves: clear, move or swap values by what they look like."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import col, is_blank, is_date, is_numeric_text


def looks(c: Column, kind: str, exceptions: Iterable[str] = ()) -> Column:
    """Whether a value is numeric, date or string (filled and not numeric); values of an exception's kind are not."""
    kind = kind.lower()
    if kind not in ("numeric", "number", "string", "text", "date"):
        raise ValueError(f"unknown kind {kind!r}")
    date = is_date(c)
    mask = date if kind == "date" else is_numeric_text(c) if kind in ("numeric", "number") else ~is_blank(c) & ~is_numeric_text(c)
    for e in exceptions:
        mask = mask & ~looks(c, e)
    return F.coalesce(mask, F.lit(False))


def remove_by_type(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """Replace values of target_type numeric or string by replacement (""), except those of the exceptions' kinds."""
    c = col(column).cast("string")
    mask = looks(c, str(params.get("target_type", "numeric")), params.get("exceptions") or ())
    return df.withColumn(column, F.when(mask, F.lit(params.get("replacement", ""))).otherwise(c))


def rows_removed(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """One row (rows_changed): the values that remove_by_type replaces."""
    return df.agg(F.count_if(looks(col(column).cast("string"), str(params.get("target_type", "numeric")), params.get("exceptions") or ())).alias("rows_changed"))


def move_by_type(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Copy source to target where source is of the type, and blank source (replacement, "")."""
    source, target = params["source"], params["target"]
    s, t = col(source).cast("string"), col(target).cast("string")
    mask = looks(s, str(params.get("type", "numeric")), params.get("exceptions") or ())
    return df.withColumns({target: F.when(mask, s).otherwise(t), source: F.when(mask, F.lit(params.get("replacement", ""))).otherwise(s)})


def swap_by_types(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """moves [{source, target, type}, ...]: where both moves of a reciprocal pair apply, the values swap; then each move
    applies one way to the rows that did not swap."""
    moves: Sequence[Mapping[str, Any]] = params.get("moves") or []
    blank = params.get("replacement", "")
    done: set[int] = set()
    swapped: dict[int, str] = {}
    for i, a in enumerate(moves):
        for j, b in enumerate(moves):
            if i < j and i not in done and j not in done and (a["source"], a["target"]) == (b["target"], b["source"]):
                done |= {i, j}
                x, y = col(a["source"]).cast("string"), col(a["target"]).cast("string")
                both = looks(x, str(a.get("type", "numeric")), a.get("exceptions") or ()) & looks(y, str(b.get("type", "numeric")), b.get("exceptions") or ())
                flag = f"__swap{i}"
                df = df.withColumn(flag, both).withColumns({a["source"]: F.when(both, y).otherwise(x), a["target"]: F.when(both, x).otherwise(y)})
                swapped |= {i: flag, j: flag}
    for i, m in enumerate(moves):
        s, t = col(m["source"]), col(m["target"]).cast("string")
        mask = looks(s.cast("string"), str(m.get("type", "numeric")), m.get("exceptions") or ())
        if i in swapped:
            mask = mask & ~F.col(swapped[i])
        df = df.withColumn("__mask", mask)
        df = df.withColumns({m["target"]: F.when(F.col("__mask"), s.cast("string")).otherwise(t), m["source"]: F.when(F.col("__mask"), F.lit(blank)).otherwise(s.cast("string"))}).drop("__mask")
    return df.drop(*set(swapped.values()))
