"""Sinks: CSV, Parquet and JDBC, all-or-nothing replacement, snapshots with rollback and retention, run records."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.exprs import col
from millrace.operators.rows import with_row_index
from millrace.sources.readers import long_form

CODECS = ("snappy", "gzip", "zstd", "none", "uncompressed")


def hadoop(spark: SparkSession, path: str):  # noqa: ANN201
    """(file system, path) of Hadoop for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def replace_path(spark: SparkSession, new: str, old: str) -> None:
    """Put a finished folder in the place of another: the old one moves aside, the new one in, then the old one goes."""
    fs, source = hadoop(spark, new)
    _, target = hadoop(spark, old)
    _, aside = hadoop(spark, f"{old.rstrip('/')}.{uuid.uuid4().hex}.old")
    there = fs.exists(target)
    if there and not fs.rename(target, aside):
        raise OSError(f"cannot move {old} aside")
    if not fs.rename(source, target):
        if there:
            fs.rename(aside, target)
        raise OSError(f"cannot put {new} in the place of {old}")
    if there:
        fs.delete(aside, True)


def write_table(df: DataFrame, path: str, kind: str = "parquet", compression: str = "snappy", atomic: bool = True) -> str:
    """Write Parquet or CSV with header. atomic writes beside the target and swaps when all tasks are through, so the
    table being read may be the one that is written and a failed job leaves no trace."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp" if atomic else path
    try:
        if kind == "parquet":
            if compression not in CODECS:
                raise ValueError(f"compression {compression!r} is not available; use one of {', '.join(CODECS)}")
            df.write.mode("overwrite").option("compression", compression).parquet(beside)
        elif kind == "csv":
            df.write.mode("overwrite").option("header", True).option("escape", '"').csv(beside)
        else:
            raise ValueError(f"unknown format {kind!r}")
    except Exception:
        if atomic:
            fs, p = hadoop(spark, beside)
            fs.delete(p, True)
        raise
    if atomic:
        replace_path(spark, beside, path)
    return path


def write_jdbc(df: DataFrame, url: str, table: str = "joined", mode: str = "overwrite", **properties: str) -> None:
    """A database table of text columns."""
    df.select(*[col(c).cast("string").alias(c) for c in df.columns]).write.jdbc(url, table, mode=mode, properties=properties)


def write_long_form(df: DataFrame, path: str) -> str:
    return write_table(long_form(df), path, "csv")


def export_columns(df: DataFrame, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Chosen columns, numbered from 1 in a column "#" if an order is given."""
    if order is None:
        return df.select(*[col(c) for c in columns])
    return with_row_index(df, "#", order, start=1).select(col("#"), *[col(c) for c in columns])


def content_hash(df: DataFrame) -> Column:
    """An order-free fingerprint of a table's rows, as an aggregate: equal rows in any order give equal text."""
    row = F.xxhash64(*[col(c) for c in df.columns]) if df.columns else F.lit(0)
    return F.concat_ws("-", F.count("*").cast("string"), F.hex(F.coalesce(F.bit_xor(row), F.lit(0))), F.coalesce(F.sum((row % 1000003).cast("decimal(38,0)")), F.lit(0)).cast("string"))


def snapshot(df: DataFrame, folder: str, name: str, now: datetime | None = None) -> str:
    """Keep a table as folder/name/snapshot_ts=...; the manifest row has its time, path, rows and fingerprint."""
    now = now or datetime.now(UTC)
    stamp = now.strftime("%Y%m%dT%H%M%S%f")
    path = f"{folder.rstrip('/')}/{name}/snapshot_ts={stamp}"
    df.write.parquet(path)
    kept = df.sparkSession.read.parquet(path)
    told = kept.agg(F.count("*").alias("rows"), content_hash(kept).alias("fingerprint")).select(F.lit(name).alias("name"), F.lit(stamp).alias("snapshot_ts"), F.lit(path).alias("path"), "rows", "fingerprint")
    told.write.mode("append").parquet(f"{folder.rstrip('/')}/{name}/manifest")
    return path


def snapshots(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The manifest of a table's snapshots that are still there."""
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}/manifest")
    fs, base = hadoop(spark, f"{folder.rstrip('/')}/{name}")
    there = [s.getPath().getName().partition("=")[2] for s in fs.listStatus(base) if s.getPath().getName().startswith("snapshot_ts=")]
    return rows.where(F.col("snapshot_ts").isin(*there))


def rollback(spark: SparkSession, snapshot_path: str, target: str, kind: str = "parquet") -> str:
    """Write a snapshot or a run's output as the table again."""
    return write_table(spark.read.parquet(snapshot_path), target, kind)


def expire_snapshots(spark: SparkSession, folder: str, name: str, days: int, now: datetime | None = None) -> tuple[int, int]:
    """Delete snapshots older than so many days: (deleted, remaining)."""
    limit = ((now or datetime.now(UTC)) - timedelta(days=days)).strftime("%Y%m%dT%H%M%S%f")
    fs, base = hadoop(spark, f"{folder.rstrip('/')}/{name}")
    deleted = remaining = 0
    for s in fs.listStatus(base):
        stamp = s.getPath().getName().partition("snapshot_ts=")[2]
        if stamp and stamp < limit:
            fs.delete(s.getPath(), True)
            deleted += 1
        elif stamp:
            remaining += 1
    return deleted, remaining


RUN = "id string, recipe_id string, started_at timestamp, finished_at timestamp, status string, export_format string, output_path string, diagnostics string, warnings string"


def record_run(spark: SparkSession, table: str, **fields: object) -> None:
    """Append a run to the runs table."""
    row = {"id": uuid.uuid4().hex} | fields
    spark.createDataFrame([tuple(row.get(x.split()[0]) for x in RUN.split(", "))], RUN).write.mode("append").parquet(table)
