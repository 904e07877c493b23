"""Incremental runs: new files of a folder through the row-local part of a recipe as they come."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.recipe import COLUMN_STEPS, Context, apply_step, compile_recipe, validate

#: Steps that look at one row only and so run on a stream directly.
ROW_LOCAL = frozenset(COLUMN_STEPS) - {"percentile_bucketize", "detect_outliers"} | {"select", "drop_column", "rename", "derive", "derive_column", "move_by_type", "swap_by_types"}


def is_row_local(recipe: Mapping[str, Any]) -> bool:
    return not recipe.get("joins") and all(s["action"] in ROW_LOCAL for s in recipe.get("cleaning_steps") or [])


def read_stream(spark: SparkSession, folder: str, schema: str, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream, a bounded number per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("header", True).csv(folder) if kind == "csv" else reader.format(kind).load(folder)


def clean_stream(df: DataFrame, recipe: Mapping[str, Any]) -> DataFrame:
    """Row-local steps on a stream; other steps raise."""
    validate(recipe)
    for i, step in enumerate(recipe.get("cleaning_steps") or []):
        if step["action"] not in ROW_LOCAL:
            raise ValueError(f"step {i}: {step['action']} needs the whole table; use run_stream, which cleans batch by batch")
        df = apply_step(df, step, Context(), i)
    return df


def run_stream(df: DataFrame, recipe: Mapping[str, Any], output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the cleaned stream as Parquet, each file exactly once. Recipes with steps that aggregate or join are compiled
    per micro-batch, so their statistics are those of the batch; each batch replaces its own folder if it is retried."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    if is_row_local(recipe):
        return clean_stream(df, recipe).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    def batch(rows: DataFrame, number: int) -> None:
        compile_recipe(rows, recipe).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch={number}")

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
