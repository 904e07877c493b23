"""Derivation expressions to columns.

The grammar is a small part of Python: literals, column names, + - * / % **, and / or / not, unary signs, chained
comparisons, in / not in. Values follow Python: null == x is false and null != x true, ordering with null or between
unlike types is false, and / or / not take null, 0 and "" as false, % takes the divisor's sign. What cannot be computed
(division by zero, unlike types in arithmetic, unsupported syntax, unknown names) is null. Nothing runs per row in
Python: the expression is compiled once, by the column types.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import col


@dataclass(frozen=True)
class Value:
    """A column and its kind: num, str, bool, null or other (dates and nested types)."""

    column: Column
    kind: str


def null() -> Value:
    return Value(F.lit(None), "null")


def kind_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "num"
    return {T.StringType: "str", T.BooleanType: "bool", T.NullType: "null"}.get(type(kind), "other")


def truth(v: Value) -> Column:
    """bool(v), never null."""
    if v.kind == "null":
        return F.lit(False)
    test = {"num": lambda c: c != 0, "str": lambda c: c != "", "bool": lambda c: c}.get(v.kind, lambda c: c.isNotNull())
    return F.coalesce(test(v.column), F.lit(False))


def _number(v: Value) -> Column:
    return v.column.cast("int") if v.kind == "bool" else v.column


def arithmetic(op: ast.operator, a: Value, b: Value) -> Value:
    if a.kind == b.kind == "str" and isinstance(op, ast.Add):
        return Value(F.concat(a.column, b.column), "str")
    if a.kind not in ("num", "bool") or b.kind not in ("num", "bool"):
        return null()
    x, y = _number(a), _number(b)
    wide = lambda c: c.cast("double")
    made = {
        ast.Add: lambda: F.try_add(x, y), ast.Sub: lambda: F.try_subtract(x, y), ast.Mult: lambda: F.try_multiply(x, y), ast.Div: lambda: F.try_divide(wide(x), wide(y)),
        ast.Mod: lambda: F.when(y != 0, x - F.floor(wide(x) / wide(y)) * y), ast.Pow: lambda: F.pow(wide(x), wide(y)),
    }.get(type(op))
    return Value(made(), "num") if made else null()


def _alike(a: Value, b: Value) -> bool:
    return a.kind == b.kind or {a.kind, b.kind} <= {"num", "bool"}


def compare(op: ast.cmpop, a: Value, b: Value) -> Column:
    """A comparison that is never null."""
    if isinstance(op, ast.Eq | ast.NotEq):
        if a.kind == "null" or b.kind == "null":
            known = b if a.kind == "null" else a
            same = F.lit(True) if known.kind == "null" else known.column.isNull()
        elif not _alike(a, b):
            same = a.column.isNull() & b.column.isNull()
        else:
            same = _number(a).eqNullSafe(_number(b))
        # in Python None == None holds; null columns count as None
        return same if isinstance(op, ast.Eq) else ~same
    if "null" in (a.kind, b.kind) or not _alike(a, b):
        return F.lit(False)
    x, y = _number(a), _number(b)
    made = {ast.Lt: lambda: x < y, ast.LtE: lambda: x <= y, ast.Gt: lambda: x > y, ast.GtE: lambda: x >= y}.get(type(op))
    return F.coalesce(made(), F.lit(False)) if made else F.lit(False)


class Compiler:
    """Compiles expressions over the columns of a schema."""

    def __init__(self, schema: T.StructType) -> None:
        self.schema = schema

    def expression(self, text: object) -> Value:
        if text is None:
            return null()
        try:
            return self.node(ast.parse(str(text), mode="eval").body)
        except SyntaxError:
            return null()

    def node(self, n: ast.AST) -> Value:
        if isinstance(n, ast.Constant):
            kind = {bool: "bool", int: "num", float: "num", str: "str"}.get(type(n.value))
            return Value(F.lit(n.value), kind) if kind else null()
        if isinstance(n, ast.Name):
            if n.id not in self.schema.names:
                return null()
            kind = self.schema[n.id].dataType
            c = col(n.id)
            if isinstance(kind, T.FloatType | T.DoubleType):
                c = F.when(~F.isnan(c), c)
            return Value(c, kind_of(kind))
        if isinstance(n, ast.BinOp):
            return arithmetic(n.op, self.node(n.left), self.node(n.right))
        if isinstance(n, ast.BoolOp):
            parts = [truth(self.node(v)) for v in n.values]
            return Value(reduce((lambda a, b: a & b) if isinstance(n.op, ast.And) else (lambda a, b: a | b), parts), "bool")
        if isinstance(n, ast.UnaryOp):
            v = self.node(n.operand)
            if isinstance(n.op, ast.Not):
                return Value(~truth(v), "bool")
            if v.kind in ("num", "bool") and isinstance(n.op, ast.USub | ast.UAdd):
                return Value(-_number(v) if isinstance(n.op, ast.USub) else _number(v), "num")
            return null()
        if isinstance(n, ast.Compare):
            parts, left = [], n.left
            for op, right in zip(n.ops, n.comparators, strict=True):
                parts.append(self.member(op, left, right) if isinstance(op, ast.In | ast.NotIn) else compare(op, self.node(left), self.node(right)))
                left = right
            return Value(reduce(lambda a, b: a & b, parts), "bool")
        return null()

    def member(self, op: ast.cmpop, left: ast.AST, right: ast.AST) -> Column:
        """in and not in: a text within a text. Lists are no part of the grammar, so membership in one is false."""
        a, b = self.node(left), self.node(right)
        if a.kind != "str" or b.kind != "str":
            return F.lit(False)
        inside = b.column.contains(a.column)
        return F.coalesce(inside if isinstance(op, ast.In) else ~inside, F.lit(False))


def derive(df: DataFrame, rules: list[Mapping]) -> DataFrame:
    """Add a column per rule {"if": expression, "then": {"col", "value"}}; a rule without "if" always holds.

    Rows that do not match get null; a later rule on the same column replaces the whole column.
    """
    for i, rule in enumerate(rules):
        then = rule.get("then") or {}
        if not then.get("col"):
            raise ValueError(f"rule {i} names no column")
        compiler = Compiler(df.schema)
        value = compiler.expression(then.get("value"))
        made = value.column if value.kind != "null" else F.lit(None).cast("string")
        keep = F.lit(True) if rule.get("if") is None else truth(compiler.expression(rule["if"]))
        df = df.withColumn(then["col"], F.when(keep, made))
    return df
