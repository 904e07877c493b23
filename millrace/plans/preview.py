"""Previews: rows before and after, one step alone, and why a recipe's steps make sense."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.exprs import col
from millrace.operators.columns import without_meta
from millrace.plans.recipe import Context, apply_step, compile_recipe, names_of

#: The confidence that goes with each action; impute and normalize depend on the profile, others have 0.3.
CONFIDENCE = {
    "cast": 0.85, "move_by_type": 0.7, "swap_by_types": 0.75, "remove_by_type": 0.7, "map": 0.8, "regex_replace": 0.8, "bucketize": 0.8,
    "conditional": 0.7, "join": 0.75, "fuzzy_join": 0.7, "deduplicate": 0.8, "rename": 0.9, "drop_column": 0.95,
}


def preview(df: DataFrame, recipe: Mapping[str, Any], n: int = 20, order: str | None = None, context: Context | None = None) -> tuple[DataFrame, DataFrame, list[dict[str, Any]]]:
    """(first n rows before, first n rows after, warnings) by the same plan as a full run."""
    context = context or Context(order=order or recipe.get("order"))
    before = without_meta(df)
    after = compile_recipe(df, recipe, context)
    first = lambda x: (x.orderBy(col(order)) if order and order in x.columns else x).limit(n)
    return first(before), first(after), context.warnings


def step_preview(df: DataFrame, step: Mapping[str, Any], n: int = 20, order: str | None = None) -> DataFrame:
    """(column, before, after) of each column of one step over the first n rows, as lists of text."""
    some = (df.orderBy(col(order)) if order else df).limit(n)
    names = names_of(step) or [c for c in df.columns if c != order]
    kept = some.withColumns({f"__b{i}": col(c).cast("string") for i, c in enumerate(names)})
    made = apply_step(kept, step, Context(order=order))
    key = col(order) if order else F.monotonically_increasing_id()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__b{i}").alias("b"), (col(c).cast("string") if c in made.columns else F.lit(None).cast("string")).alias("a")) for i, c in enumerate(names)])
    long = made.select(key.alias("k"), F.explode(pairs).alias("p")).select("k", "p.*")
    listed = F.array_sort(F.collect_list(F.struct("k", "b", "a")))
    return long.groupBy("column").agg(listed.alias("l")).select("column", F.transform("l", lambda x: x["b"]).alias("before"), F.transform("l", lambda x: x["a"]).alias("after"))


def explain(recipe: Mapping[str, Any], profile: DataFrame) -> DataFrame:
    """(step, action, column, reason, confidence) of each step and column.

    A reason states what the step meets and what it was given: "impute: q is double with 5 missing; strategy=median".
    """
    spark = profile.sparkSession
    listed = []
    for i, s in enumerate(recipe.get("cleaning_steps") or []):
        params = s.get("params") or {}
        given = ", ".join(f"{k}={params[k]}" for k in sorted(params))
        listed += [(i, s["action"], c, given, "strategy" in params) for c in (names_of(s) or [None])]
    steps = spark.createDataFrame(listed, "step int, action string, column string, given string, chosen boolean")
    known = steps.join(profile.select("column", "dtype", "nulls"), "column", "left")
    kind, gaps = F.coalesce("dtype", F.lit("unknown")), F.coalesce("nulls", F.lit(0))
    numeric = kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    usual = F.when(numeric, "median").when(kind == "boolean", "constant").when(kind.rlike("^(date|timestamp)"), "ffill").otherwise("empty_string")
    impute, normal = F.col("action") == "impute", F.col("action") == "normalize"
    usual = F.when(impute & ~F.col("chosen"), F.concat(F.lit("strategy="), usual))
    given = F.concat_ws(", ", F.nullif("given", F.lit("")), usual)
    met = F.when(F.col("column").isNull(), "the whole table").otherwise(F.concat("column", F.lit(" is "), kind, F.lit(" with "), gaps, F.lit(" missing")))
    reason = F.concat_ws("; ", F.concat("action", F.lit(": "), met), F.nullif(given, F.lit("")))
    sure = F.when(impute, F.when(gaps > 0, 0.8).otherwise(0.6)).when(normal, F.when(kind == "string", 0.75).otherwise(0.6))
    for action, confidence in CONFIDENCE.items():
        sure = sure.when(F.col("action") == action, confidence)
    return known.select("step", "action", "column", reason.alias("reason"), sure.otherwise(0.3).alias("confidence")).orderBy("step", "column")
