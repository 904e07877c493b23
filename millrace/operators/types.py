"""cast: text to numbers, dates, booleans and back, with null for what does not fit."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.exprs import CURRENCY, col, is_blank, java_pattern, parse_date

TRUE, FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def to_double(c: Column, parens: str = "strip") -> Column:
    """The number after $, separators and spaces go; parens strip ("(2)" is 2) or negative (-2). No other text may stay."""
    text = F.trim(c.cast("string"))
    if parens == "negative":
        text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    number = F.regexp_replace(text, f"[{CURRENCY},\\s()]", "").try_cast("double")
    return F.when(~F.isnan(number), number)


def to_boolean(c: Column) -> Column:
    """The truth table of words, else the truth of an integer, else null."""
    text = F.lower(F.trim(c.cast("string")))
    whole = text.try_cast("bigint")
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False).when(whole.isNotNull(), whole != 0)


def cast_column(c: Column, kind: T.DataType, target: str, params: Mapping[str, Any]) -> Column:
    target = target.lower()
    numeric = isinstance(kind, T.NumericType)
    if target in ("int", "integer"):
        number = c.cast("double") if numeric else to_double(c, params.get("parens", "strip"))
        return c.cast("bigint") if isinstance(kind, T.IntegralType) else number.try_cast("bigint")
    if target in ("float", "double", "number"):
        return c.cast("double") if numeric else to_double(c, params.get("parens", "strip"))
    if target in ("str", "string", "category", "cat"):
        return c.cast("string")
    if target in ("bool", "boolean"):
        return c if isinstance(kind, T.BooleanType) else to_boolean(c)
    if target in ("datetime", "date", "ts", "timestamp"):
        stamp = c.cast("timestamp_ntz") if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType) else parse_date(c, params["formats"]) if params.get("formats") else parse_date(c)
        if params.get("format"):
            return F.date_format(stamp, java_pattern(params["format"]))
        return stamp.cast("date") if target == "date" and params.get("as_date") else stamp
    raise ValueError(f"unknown type {target!r}")


def cast(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """type int, float, string, datetime, boolean or category. format: dates become text in that strftime format.

    on_invalid {"action": "set_error", "column", "value"} adds a column with value ("invalid") where a filled value did
    not fit; the default leaves null.
    """
    target = params.get("type") or params.get("to_type") or params.get("dtype") or params.get("to")
    if not target:
        raise ValueError("cast needs a type")
    before = col(column)
    made = cast_column(before, df.schema[column].dataType, str(target), params)
    out = {column: made}
    invalid = params.get("on_invalid") or {}
    if isinstance(invalid, Mapping) and invalid.get("action") in ("set_error", "error_column"):
        out[invalid.get("column") or f"{column}__error"] = F.when(~is_blank(before) & made.isNull(), F.lit(invalid.get("value", "invalid")))
    return df.withColumns(out)
