"""Condition trees to boolean columns.

A leaf is {"column", "op", "value"}, a branch {"op": "and" | "or", "conds": [...]} or {"op": "not", "cond": ...}. Nulls
follow SQL: a comparison with null does not match. Ordering a text column against a number compares its number.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col, pattern, plain_number

ORDER = {">": "__gt__", "<": "__lt__", ">=": "__ge__", "<=": "__le__"}
EQUAL, UNEQUAL = ("==", "="), ("!=", "<>")


def _sides(df: DataFrame, name: str, value: Any) -> tuple[Column, Column]:
    if name not in df.columns:
        raise ValueError(f"condition on unknown column {name!r}")
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(value, bool):
        return (c, F.lit(value)) if isinstance(kind, T.BooleanType) else (c.cast("string"), F.lit(str(value)))
    if isinstance(value, int | float):
        return (plain_number(c) if isinstance(kind, T.StringType) else c.cast("double") if not isinstance(kind, T.NumericType) else c), F.lit(value)
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        return c, F.lit(value).try_cast("double")
    if isinstance(value, str) and isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return c, F.lit(value).try_cast(kind.simpleString())
    return c, F.lit(value)


def condition(df: DataFrame, tree: dict[str, Any]) -> Column:
    """The boolean column of a condition tree; null where a comparison meets null."""
    op = str(tree.get("op", "")).lower()
    if op in ("and", "or"):
        parts = [condition(df, x) for x in tree.get("conds") or []]
        if not parts:
            raise ValueError(f"{op!r} needs conds")
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        inner = tree.get("cond") or (tree.get("conds") or [None])[0]
        if inner is None:
            raise ValueError("'not' needs cond")
        return ~condition(df, inner)
    name, value = tree.get("column"), tree.get("value")
    if op in ORDER:
        left, right = _sides(df, name, value)
        return getattr(left, ORDER[op])(right)
    if op in EQUAL or op in UNEQUAL:
        left, right = _sides(df, name, value)
        return left == right if op in EQUAL else left != right
    if op == "in":
        values = value if isinstance(value, list | tuple | set) else [value]
        return reduce(lambda a, b: a | b, [l == r for l, r in (_sides(df, name, v) for v in values)], F.lit(False))  # noqa: E741
    if op == "contains":
        return _sides(df, name, "")[0].cast("string").rlike(pattern(str(value)))
    raise ValueError(f"unknown operator {tree.get('op')!r} in a condition")


def holds(df: DataFrame, tree: dict[str, Any]) -> Column:
    """The condition with null as false."""
    return F.coalesce(condition(df, tree), F.lit(False))
