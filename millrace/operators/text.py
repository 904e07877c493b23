"""Text steps: case, Unicode forms, replacement, mapping, cleanup and splitting by kind.

Each step takes (df, column, params) and returns df with the column changed; null stays null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import capitalise, col, is_date, literal_replacement, pattern, replacement, title_case

CASES = {"lower": F.lower, "upper": F.upper, "capitalize": capitalise, "title": title_case, "preserve": lambda c: c, "trim": lambda c: c}
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
#: Texts that a Python task holds in several forms at once.
HELD = 64


def normalize(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """case lower (default), upper, capitalize, title, preserve or trim; all trim. unicode: true also normalises the form."""
    case = str(params.get("case") or params.get("method") or "lower").lower()
    if case not in CASES:
        raise ValueError(f"unknown case {case!r}")
    df = df.withColumn(column, CASES[case](F.trim(col(column).cast("string"))))
    return unicode_normalize(df, column, params) if params.get("unicode") else df


def normal_form(form: str, strip: bool):  # noqa: ANN201
    """A function to a Unicode form; strip drops combining marks. Spark has no built-in for either."""

    apart, marks = "NFKD" if form.startswith("NFK") else "NFD", re.compile("[\u0300-\u036f]")

    def one(s: str | None) -> str | None:
        if s is None:
            return None
        return unicodedata.normalize(form, marks.sub("", unicodedata.normalize(apart, s)) if strip else s)

    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        # a few texts at a time beside the batch and its result, as whole texts may be long
        parts = [pa.array([one(x) for x in s.slice(i, HELD).to_pylist()], pa.string()) for i in range(0, len(s), HELD)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


def unicode_normalize(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """form NFC, NFD, NFKC or NFKD (others count as NFKC); remove_diacritics drops combining marks.

    Pure ASCII text is its own normal form and stays on the JVM side.
    """
    form = str(params.get("form", "NFKC")).upper()
    form = form if form in FORMS else "NFKC"
    c = col(column).cast("string")
    made = normal_form(form, bool(params.get("remove_diacritics")))(F.when(~c.rlike(r"^\p{ASCII}*$"), c))
    return df.withColumn(column, F.coalesce(made, c))


def replace(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """Literal old to new, everywhere; first: true replaces the first occurrence only."""
    old, new = str(params.get("old", "")), str(params.get("new", ""))
    if not old:
        raise ValueError("replace needs old")
    c = col(column).cast("string")
    if params.get("first"):
        quoted = "\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return df.withColumn(column, F.regexp_replace(c, f"(?s)^(.*?){quoted}", "$1" + literal_replacement(new)))
    return df.withColumn(column, F.replace(c, F.lit(old), F.lit(new)))


#: A mapping of more entries is joined instead of compiled into the expression.
LITERAL_MAP = 1000


def map_values(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """Whole values by an exact mapping, compared as text; others stay."""
    mapping = {str(k): None if v is None else str(v) for k, v in (params.get("mapping") or {}).items()}
    if not mapping:
        raise ValueError("map needs a mapping")
    text = col(column).cast("string")
    if len(mapping) > LITERAL_MAP:
        table = df.sparkSession.createDataFrame(list(mapping.items()), "__from string, __to string")
        joined = df.join(table, text == F.col("__from"), "left")
        return joined.withColumn(column, F.when(F.col("__from").isNotNull(), F.col("__to")).otherwise(text)).select(*[col(c) for c in df.columns])
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(column, F.when(F.map_contains_key(pairs, F.coalesce(text, F.lit("\0"))), pairs[text]).otherwise(text))


def regex_replace(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """All matches of pattern by replace; flags i, m, s, x, a as names or a comma list."""
    if not params.get("pattern"):
        raise ValueError("regex_replace needs a pattern")
    made = F.regexp_replace(col(column).cast("string"), pattern(params["pattern"], params.get("flags") or ()), replacement(str(params.get("replace", params.get("replacement", "")))))
    return df.withColumn(column, made)


def remove_dash(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    return df.withColumn(column, F.replace(col(column).cast("string"), F.lit("-"), F.lit("")))


def remove_letters(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(col(column).cast("string"), "[A-Za-z]+", ""))


def ocr_cleanup(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """Drop characters outside printable ASCII (or apply patterns), then replacements in order, then single spaces."""
    c = col(column).cast("string")
    for p, sub in params.get("patterns") or [(r"[^\x20-\x7E]", "")]:
        c = F.regexp_replace(c, pattern(p), replacement(sub))
    for old, new in (params.get("replacements") or {}).items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return df.withColumn(column, F.trim(F.regexp_replace(c, r"\s+", " ")))


KINDS = ("numeric", "date", "email", "postal", "address", "text")


def kind_of(c: Column) -> Column:
    """The kind of a value: email, date, numeric, postal, address or text in this order; null if blank."""
    text = F.trim(c.cast("string"))
    return (
        F.when(c.isNull() | (text == ""), None)
        .when(text.contains("@") & text.contains("."), "email")
        .when(is_date(c), "date")
        .when(text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?$"), "numeric")
        .when(text.rlike(r"\d{5}(-\d{4})?"), "postal")
        .when(text.contains(","), "address")
        .otherwise("text")
    )


def split_mixed(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """One column per kind, named prefix + kind (prefix: the column's name and "__"), with the values of that kind."""
    prefix = params.get("prefix") or f"{column}__"
    df = df.withColumn("__kind", kind_of(col(column)))
    return df.withColumns({prefix + k: F.when(F.col("__kind") == k, col(column)) for k in KINDS}).drop("__kind")
