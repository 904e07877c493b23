"""Column and row steps: choosing, renaming, conditions, derivations, patches, searching and filtering."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.conditions import holds
from millrace.functions.derive import derive
from millrace.functions.exprs import col, data_columns, is_meta


def as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def known(df: DataFrame, columns: Iterable[str]) -> list[str]:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return list(columns)


def select(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    return df.select(*[col(c) for c in known(df, as_list(columns))])


def drop_column(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    gone = set(as_list(columns))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns that hold one value or none, null being a value; one pass over the table."""
    names = data_columns(df)
    if not names:
        return []
    row = df.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(c.isNull()).alias("nulls"), F.count("*").alias("n")).alias(f"c{i}") for i, c in enumerate(col(x).cast("string") for x in names))).first()
    return [name for i, name in enumerate(names) if (row[i].nulls == row[i].n) or (row[i].nulls == 0 and row[i].low == row[i].high)]


def drop_constant(df: DataFrame) -> DataFrame:
    return drop_column(df, constant_columns(df))


def rename(df: DataFrame, columns: str | Sequence[str], new_names: str | Sequence[str]) -> DataFrame:
    """Rename one column, or a list paired with a list; names may be swapped."""
    old, new = as_list(columns), as_list(new_names)
    if len(old) != len(new):
        raise ValueError("rename needs as many new names as columns")
    to = dict(zip(known(df, old), new, strict=True))
    out = [to.get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("rename gives two columns one name")
    return df.select(*[col(c).alias(n) for c, n in zip(df.columns, out, strict=True)])


def safe_rename(df: DataFrame, mapping: Mapping[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Rename with conflicts resolved by _1, _2 ...; returns the names that were given. Swaps are no conflict."""
    moved = {k: v for k, v in mapping.items() if k in df.columns}
    taken = {c for c in df.columns if c not in moved}
    applied = {}
    for old, new in moved.items():
        name, i = new, 0
        while name in taken:
            i += 1
            name = f"{new}_{i}"
        taken.add(name)
        applied[old] = name
    return df.select(*[col(c).alias(applied.get(c, c)) for c in df.columns]), applied


def without_meta(df: DataFrame) -> DataFrame:
    """The columns that are no metadata."""
    return df.select(*[col(c) for c in df.columns if not is_meta(c)])


def conditional(df: DataFrame, column: str, params: Mapping[str, Any]) -> DataFrame:
    """Set the column to a literal where the condition holds. A text for a number column makes it text."""
    value, kind = params.get("value"), df.schema[column].dataType
    c = col(column)
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        c = c.cast("string")
    elif isinstance(kind, T.StringType) and value is not None:
        value = str(value)
    return df.withColumn(column, F.when(holds(df, params["condition"]), F.lit(value)).otherwise(c))


def derive_column(df: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Rules as in functions.derive, or the short form {condition, expression or value, output}."""
    if params.get("rules"):
        return derive(df, params["rules"])
    output = params.get("output") or params.get("column")
    if not output:
        raise ValueError("derive needs rules or an output")
    text = params.get("expression")
    text = repr(params.get("value")) if text is None else text
    given = params.get("condition")
    if isinstance(given, Mapping):
        made = derive(df, [{"then": {"col": "__derived", "value": text}}])
        return made.withColumn(output, F.when(holds(df, given), F.col("__derived"))).drop("__derived")
    return derive(df, [{"if": given, "then": {"col": output, "value": text}}])


def apply_patches(df: DataFrame, patches: DataFrame, order: str) -> DataFrame:
    """Set single cells: patches (row 0-based, column, value, and seq if several may hit a cell: the latest wins).

    order: the column whose order numbers the rows. Rows out of range change nothing; a column that df lacks is made,
    "" elsewhere; patched columns become text. Patches are pivoted to a row per patched row and joined by position.
    """
    from millrace.operators.rows import with_row_index

    seq = F.col("seq") if "seq" in patches.columns else F.lit(0)
    last = patches.select("row", "column", "value", seq.alias("seq")).groupBy("row", "column").agg(F.max_by("value", "seq").alias("value"), F.lit(True).alias("hit"))
    names = [r.column for r in patches.select("column").distinct().orderBy("column").collect()]
    wide = last.groupBy(F.col("row").cast("long").alias("__row")).pivot("column", names).agg(F.first(F.struct("value", "hit")))
    wide = wide.select("__row", *(col(n).alias(f"__patch{i}") for i, n in enumerate(names)))
    base = with_row_index(df, "__row", order)
    base = base.withColumns({n: F.lit("") for n in names if n not in df.columns})
    out = base.join(wide, "__row", "left")
    out = out.withColumns({n: F.when(F.col(f"__patch{i}.hit"), F.col(f"__patch{i}.value")).otherwise(col(n).cast("string")) for i, n in enumerate(names)})
    return out.drop("__row", *(f"__patch{i}" for i in range(len(names))))


def applied_patches(df: DataFrame, patches: DataFrame) -> DataFrame:
    """One row (applied): how many patches name a row of df."""
    return patches.crossJoin(F.broadcast(df.agg(F.count("*").alias("n")))).agg(F.count_if((F.col("row") >= 0) & (F.col("row") < F.col("n"))).alias("applied"))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows where some column contains the text, in any case."""
    low = text.lower()
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(col(c).cast("string")).contains(low), F.lit(False)) for c in known(df, columns)]))


def category(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows of one category; None keeps all."""
    return df if value is None else df.where(col(column) == value)

