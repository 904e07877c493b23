"""Recipes: an ordered list of cleaning steps compiled to one chain of DataFrame transformations.

A recipe is {"sources": [{"path"}], "cleaning_steps": [{"action", "column", "params"}], "joins": [{"left", "right",
"keys"}], "outputs": [{"path"}]}. Compiling validates every step first; steps on the whole table (entity resolution,
consistency, schema, lookups) are hoisted before the others, whose order stays. A step that names a missing column is
skipped with a warning, metadata columns are never changed, and nothing else is skipped in silence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.conditions import holds
from millrace.functions.exprs import col, is_meta
from millrace.operators import aggregate, columns, fuzzy, impute, joins, moves, numeric, quality, rows, text, types
from millrace.operators.joins import JoinSpec

#: The row position that file order gives; added when a step needs an order and the recipe names none.
POSITION = "_position"


@dataclass
class Context:
    """What steps need besides the table: the order of rows, and other tables by name or path."""

    order: str | None = None
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    warnings: list[dict[str, Any]] = field(default_factory=list)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        from millrace.sources.readers import read_source

        return self.tables[name] if name in self.tables else read_source(df.sparkSession, name)


ColumnStep = Callable[[DataFrame, str, Mapping[str, Any]], DataFrame]
TableStep = Callable[[DataFrame, list[str], Mapping[str, Any], Context], DataFrame]

#: Steps on one column at a time; a list of columns applies them to each.
COLUMN_STEPS: dict[str, ColumnStep] = {
    "normalize": text.normalize, "unicode_normalize": text.unicode_normalize, "replace": text.replace, "map": text.map_values, "regex_replace": text.regex_replace,
    "remove_dash": text.remove_dash, "remove_letters": text.remove_letters, "ocr_cleanup": text.ocr_cleanup, "ocr_clean": text.ocr_cleanup, "split_mixed": text.split_mixed,
    "cast": types.cast, "numeric_transform": numeric.numeric_transform, "convert_currency": numeric.convert_currency, "bucketize": numeric.bucketize,
    "percentile_bucketize": numeric.percentile_bucketize, "detect_outliers": numeric.detect_outliers, "conditional": columns.conditional, "remove_by_type": moves.remove_by_type,
}


def _ordered(df: DataFrame, context: Context) -> tuple[DataFrame, str]:
    """df and the column that orders it; file order if the recipe names none."""
    if context.order:
        return df, context.order
    return (df if POSITION in df.columns else df.withColumn(POSITION, F.monotonically_increasing_id())), POSITION


def _impute(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    how = str(params.get("strategy") or params.get("method") or "")
    for name in names:
        needs = impute.ALIASES.get(how, how) in ("ffill", "bfill") or not how and impute.default_strategy(df.schema[name].dataType) == "ffill"
        frame, order = _ordered(df, context) if needs else (df, None)
        df = impute.impute(frame, name, params, order)
    return df


def _join(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    right = context.table(df, params["right"])
    keys = [params["keys"]] if isinstance(params.get("keys"), str) else list(params.get("keys") or [])
    if params.get("fuzzy"):
        keys = keys or joins.infer_keys(df, right)
        made = fuzzy.minhash_join if params.get("method") == "minhash" else fuzzy.fuzzy_join
        return made(df, right, keys[0], keys[0], float(params.get("threshold", 0.8)))
    return joins.equi_join(df, right, JoinSpec(left_on=keys, right_on=keys, how=str(params.get("how", "left"))))


def _dedupe(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    subset = names or list(params.get("subset") or [])
    if not subset:
        return df.dropDuplicates([c for c in df.columns if c != POSITION])
    frame, order = _ordered(df, context)
    return rows.keep_first(frame, subset, order)


def _fuzzy_dedupe(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    frame, order = _ordered(df, context)
    return fuzzy.fuzzy_dedupe(rows.stable(frame), names or list(params.get("columns") or []), order, float(params.get("threshold", 0.85)), str(params.get("method", "difflib")))


def _entities(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    keys = names or list(params.get("keys") or [])
    if params.get("right_path") or params.get("right"):
        return fuzzy.entity_link(df, context.table(df, params.get("right_path") or params["right"]), keys)
    frame, order = _ordered(df, context)
    return fuzzy.entity_resolution(rows.stable(frame), keys, order, float(params.get("threshold", 0.85)))


def _consistency(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    for rule in params.get("rules") or []:
        df = joins.consistency_check(df, context.table(df, rule["map_path"]), rule["lhs"], rule["rhs"], bool(rule.get("auto_fix")), rule.get("flag_col"), rule.get("suggest_col"))
    return df


def _lookup(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    return joins.lookup(df, context.table(df, params["table"]), params["keys"], params["fields"])


def _groupby(df: DataFrame, names: list[str], params: Mapping[str, Any], context: Context) -> DataFrame:
    return aggregate.groupby(df, names or params.get("columns") or [], params.get("aggregations") or [])


#: Steps on the whole table.
TABLE_STEPS: dict[str, TableStep] = {
    "impute": _impute, "join": _join, "fuzzy_join": lambda df, n, p, c: _join(df, n, {**p, "fuzzy": True}, c), "deduplicate": _dedupe, "fuzzy_dedupe": _fuzzy_dedupe, "groupby": _groupby,
    "robust_impute": lambda df, n, p, c: _impute(df, n, {**p, "strategy": "group_median"}, c),
    "entity_resolution": _entities, "consistency_check": _consistency, "consistency_rules": _consistency, "external_lookup": _lookup, "lookup_join": _lookup,
    "validate_schema": lambda df, n, p, c: quality.migrate(df, p["schema"], bool(p.get("strict"))), "schema_migrate": lambda df, n, p, c: quality.migrate(df, p["schema"], bool(p.get("strict"))),
    "select": lambda df, n, p, c: columns.select(df, n or p.get("columns") or []), "drop_column": lambda df, n, p, c: columns.drop_column(df, n or p.get("columns") or []),
    "drop_constant": lambda df, n, p, c: columns.drop_constant(df), "rename": lambda df, n, p, c: columns.rename(df, n, p["new_name"]),
    "derive": lambda df, n, p, c: columns.derive_column(df, p), "derive_column": lambda df, n, p, c: columns.derive_column(df, p),
    "move_by_type": lambda df, n, p, c: moves.move_by_type(df, p), "swap_by_types": lambda df, n, p, c: moves.swap_by_types(df, p),
    "spell_correct": lambda df, n, p, c: fuzzy.spell_correct(df, n[0], df.sparkSession.createDataFrame([(w,) for w in p["vocabulary"]], "word string") if p.get("vocabulary") else None, p.get("abbrev_map"), float(p.get("max_dist", 0.8))),
}
#: Steps that run before all others.
HOISTED = ("entity_resolution", "consistency_check", "consistency_rules", "validate_schema", "schema_migrate", "external_lookup", "lookup_join")
#: Parameters without which a step cannot run.
NEEDED = {"rename": ("new_name",), "map": ("mapping",), "regex_replace": ("pattern",), "conditional": ("condition",), "join": ("right",), "fuzzy_join": ("right",), "move_by_type": ("source", "target"), "swap_by_types": ("moves",), "validate_schema": ("schema",), "schema_migrate": ("schema",), "external_lookup": ("table", "keys", "fields"), "lookup_join": ("table", "keys", "fields")}


def names_of(step: Mapping[str, Any]) -> list[str]:
    c = step.get("column")
    return [] if c is None else [c] if isinstance(c, str) else list(c)


def validate(recipe: Mapping[str, Any]) -> None:
    """Raise for the first step that cannot run, by its number."""
    for i, step in enumerate(recipe.get("cleaning_steps") or []):
        action = step.get("action")
        if action not in COLUMN_STEPS and action not in TABLE_STEPS:
            raise ValueError(f"step {i}: unknown action {action!r}")
        if action in COLUMN_STEPS and not names_of(step):
            raise ValueError(f"step {i}: {action} needs a column")
        for name in NEEDED.get(action, ()):
            if name not in (step.get("params") or {}):
                raise ValueError(f"step {i}: {action} needs {name}")


def hoisted(steps: Sequence[Mapping[str, Any]]) -> list[Mapping[str, Any]]:
    return [s for s in steps if s["action"] in HOISTED] + [s for s in steps if s["action"] not in HOISTED]


def conditionally(df: DataFrame, name: str, params: Mapping[str, Any], run: ColumnStep) -> DataFrame:
    """A step that changes a column only where its condition held before."""
    marked = df.withColumns({"__if": holds(df, params["condition"]), "__old": col(name)})
    made = run(marked, name, {k: v for k, v in params.items() if k != "condition"})
    same = made.schema[name].dataType == df.schema[name].dataType
    new, old = (col(name), F.col("__old")) if same else (col(name).cast("string"), F.col("__old").cast("string"))
    return made.withColumn(name, F.when(F.col("__if"), new).otherwise(old)).drop("__if", "__old")


def apply_step(df: DataFrame, step: Mapping[str, Any], context: Context, number: int = 0) -> DataFrame:
    action, params, names = step["action"], step.get("params") or {}, names_of(step)
    missing = [n for n in names if n not in df.columns]
    if missing:
        context.warnings += [{"step": number, "action": action, "column": n, "warning": "column_missing"} for n in missing]
        names = [n for n in names if n in df.columns]
        if not names:
            return df
    if action in TABLE_STEPS:
        if action == "impute" and "condition" in params:
            for n in names:
                df = conditionally(df, n, params, lambda d, c, p: _impute(d, [c], p, context))
            return df
        return TABLE_STEPS[action](df, names, params, context)
    for n in names:
        if is_meta(n):
            continue
        run = COLUMN_STEPS[action]
        df = conditionally(df, n, params, run) if "condition" in params and action != "conditional" else run(df, n, params)
    return df


def compile_recipe(df: DataFrame, recipe: Mapping[str, Any], context: Context | None = None) -> DataFrame:
    """The recipe's steps as one lazy plan over df."""
    validate(recipe)
    context = context or Context(order=recipe.get("order"))
    for spec in recipe.get("joins") or []:
        df = joins.equi_join(df, context.table(df, spec["right"]), JoinSpec(left_on=list(spec.get("keys") or []), right_on=list(spec.get("keys") or []), how=str(spec.get("how", "left"))))
    steps = list(recipe.get("cleaning_steps") or [])
    for step in hoisted(steps):
        df = apply_step(df, step, context, steps.index(step))
    return df.drop(POSITION) if POSITION in df.columns else df


def apply_recipe(spark: SparkSession, recipe: Mapping[str, Any], snapshots: str | None = None, runs: str | None = None) -> dict[str, Any]:
    """Read the first source, compile, keep a snapshot of the source if a folder is given, write the output in one go.

    Of a table of versions the snapshot is a further version, which copies no file.
    """
    from datetime import UTC, datetime

    from millrace.sources.readers import read_source, reconstruct
    from millrace.sources.versioned import versioned_table
    from millrace.sources.writers import record_run, snapshot, write_table

    started = datetime.now(UTC)
    source = reconstruct(read_source(spark, recipe["sources"][0]["path"]))
    if recipe.get("expected_columns"):
        drift = quality.check_drift(source, recipe["expected_columns"])
        if not drift["ok"]:
            raise ValueError(f"the source lacks columns {drift['missing']}")
    context = Context(order=recipe.get("order"))
    made = compile_recipe(source, recipe, context)
    kept = None
    if snapshots and recipe["sources"][0]["path"].startswith("versioned:"):
        versioned, version = versioned_table(spark, recipe["sources"][0]["path"])
        kept = f"versioned:{versioned.path}@{version or versioned.snapshot()}"
    elif snapshots:
        kept = snapshot(source, snapshots, "source")
    output = recipe["outputs"][0]["path"]
    kind = "parquet" if output.rstrip("/").endswith(".parquet") else "csv"
    write_table(made, output, kind)
    if runs:
        record_run(spark, runs, recipe_id=str(recipe.get("id", "")), started_at=started, finished_at=datetime.now(UTC), status="completed", export_format=kind, output_path=output, warnings=str(context.warnings))
    return {"written": output, "snapshot": kept, "warnings": context.warnings}
