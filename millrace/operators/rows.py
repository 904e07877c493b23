"""Row order: numbering, carrying values along, keep-first and latest-per-key, all without a single-partition window.

Tables have no order in Spark, so every operator here takes the columns that define it.
"""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import col


def as_columns(order: str | Column | Sequence[str | Column]) -> list[Column]:
    items = [order] if isinstance(order, str | Column) else list(order)
    return [col(x) if isinstance(x, str) else x for x in items]


def range_parts(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df range-partitioned and sorted by order, with its part's number and row number within it.

    The parts are computed twice by what follows, so they are checkpointed: a range partitioning that is computed anew
    may draw other bounds.
    """
    local = Window.partitionBy("__part").orderBy(*[F.col(f"__o{i}") for i in range(len(order))])
    keyed = df.withColumns({f"__o{i}": o for i, o in enumerate(order)})
    parts = keyed.repartitionByRange(*[F.col(f"__o{i}") for i in range(len(order))]).withColumn("__part", F.spark_partition_id())
    return stable(parts).withColumn("__local", F.row_number().over(local))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where it is unset in a local session, as in tests. On a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def freed(df: DataFrame) -> DataFrame:
    """stable, and the shuffle files of what is no longer used go: Spark's cleaner sees them when the driver collects."""
    spark, out = df.sparkSession, stable(df)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def with_row_index(df: DataFrame, name: str, order: str | Column | Sequence[str | Column], start: int = 0) -> DataFrame:
    """Number the rows by order from start: range parts, then each row's number in its part plus the rows before it."""
    columns = as_columns(order)
    parts = range_parts(df, columns)
    before = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = before.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__local") - 1 + start)
    return out.drop("__part", "__local", "__before", *(f"__o{i}" for i in range(len(columns))))


def fill(df: DataFrame, columns: Sequence[str], order: str | Column | Sequence[str | Column], keys: Sequence[str] = (), backward: bool = False, missing: Sequence[object] = ()) -> DataFrame:
    """Carry the last filled value of each column forward (or the next backward) in order, within keys if given.

    Without keys, parts are filled alone and the last filled value before each part is joined to its leading gap.
    """
    from millrace.functions.exprs import is_missing

    columns_order = as_columns(order)
    filled = lambda c: F.when(~is_missing(col(c), missing) if missing else col(c).isNotNull(), col(c))
    # backward runs over the turned order: Spark works a frame up to the end anew for each row
    last = lambda c, w: F.last(filled(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if keys:
        w = Window.partitionBy(*[col(k) for k in keys])
        if not backward:
            return df.withColumns({c: last(c, w.orderBy(*columns_order)) for c in columns})
        placed = df.withColumn("__place", F.row_number().over(w.orderBy(*columns_order)))
        return placed.withColumns({c: last(c, w.orderBy(F.desc("__place"))) for c in columns}).drop("__place")
    parts = range_parts(df, columns_order)
    w = Window.partitionBy("__part").orderBy(F.desc("__local") if backward else F.asc("__local"))
    pick = F.first if backward else F.last
    edge = F.min_by if backward else F.max_by
    ends = parts.groupBy("__part").agg(*(edge(col(c), F.when(filled(c).isNotNull(), F.col("__local"))).alias(f"__e{i}") for i, c in enumerate(columns)))
    over = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing) if backward else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("__part", *(pick(F.col(f"__e{i}"), ignorenulls=True).over(over).alias(f"__c{i}") for i in range(len(columns))))
    out = parts.join(F.broadcast(carry), "__part")
    out = out.withColumns({c: F.coalesce(last(c, w), F.col(f"__c{i}")) for i, c in enumerate(columns)})
    return out.drop("__part", "__local", *(f"__o{i}" for i in range(len(columns_order))), *(f"__c{i}" for i in range(len(columns))))


def keep_first(df: DataFrame, keys: Sequence[str], order: str | Column | Sequence[str | Column]) -> DataFrame:
    """The first row of each key by order; nulls are a key."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*as_columns(order))
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest_per_key(df: DataFrame, key: str, newest: str, tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): the newest record of each key and the others; a record without key is its own, by its hash."""
    whole = F.sha2(F.to_json(F.struct(*[col(c) for c in df.columns])), 256)
    w = Window.partitionBy(F.coalesce(col(key).cast("string"), whole)).orderBy(F.desc_nulls_last(newest), *[F.asc(t) for t in tie])
    ranked = df.withColumn("__rank", F.row_number().over(w))
    return ranked.where("__rank = 1").drop("__rank"), ranked.where("__rank > 1").drop("__rank")


def latest_run(runs: DataFrame, by: str = "recipe_id", status: str = "completed") -> DataFrame:
    """The newest run of each recipe with that status."""
    return runs.where(F.col("status") == status).groupBy(by).agg(F.max_by(F.struct(*[col(c) for c in runs.columns if c != by]), "finished_at").alias("r")).select(by, "r.*")


def page(df: DataFrame, order: str | Column | Sequence[str | Column], offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    """Rows offset ... offset + limit of the ordered table; limit is held to 1 ... most."""
    return df.orderBy(*as_columns(order)).offset(max(int(offset), 0)).limit(min(max(int(limit), 1), most))


def numbered_page(df: DataFrame, order: str | Column | Sequence[str | Column], number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows of page `number` from 1, rows in all, pages in all)."""
    total = df.count()
    size = max(int(size), 1)
    return page(df, order, (max(int(number), 1) - 1) * size, size, size), total, -(-total // size)


def head(df: DataFrame, n: int, order: str | Column | Sequence[str | Column]) -> DataFrame:
    """The first n rows by order; there is no "all", since that would collect an unbounded table."""
    if n is None or n <= 0:
        raise ValueError("head needs a positive number of rows")
    return df.orderBy(*as_columns(order)).limit(int(n))


def top(df: DataFrame, by: Column, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """The k rows of highest score."""
    return df.orderBy(by.desc(), *[F.asc(t) for t in tie]).limit(k)
