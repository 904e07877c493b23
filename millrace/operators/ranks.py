"""Exact order statistics without a task that holds all values.

Of a whole column: a quantile sketch, merged over tasks, gives bounds about each rank asked for; a pass counts what lies below
and within them. Bounds that still hold too many rows are drawn closer by a sketch of their own rows alone; each pass leaves a
few ten-thousandths. The values within the last bounds are counted by value, and the rank is read off.

Of groups: small ones are aggregated as they are. The distinct values of large ones are dealt out by range of (group,
value), with running counts per group and part, so that one group may fill any number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.exprs import col
from millrace.operators.rows import stable

#: Accuracy of the sketches: a rank is off by no more than this part of the rows.
ACCURACY = 10_000
#: Rows within bounds that are counted by value at once.
HELD = 50_000
#: Rows of a group from which its values are dealt out.
LARGE = 1_000_000


def at_ranks(df: DataFrame, value: Column, ranks: Sequence[int], held: int = HELD) -> list[float]:
    """The values at 0-based ranks of the filled values in order; each must be smaller than their number."""
    values = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    wanted = sorted(set(ranks))
    if not wanted:
        return []
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    bounds = {r: (low, high, 0, n) for r in wanted}  # the rank's bounds, rows below them, rows within
    while open_ := [r for r, (a, b, _, m) in bounds.items() if not alike(a, b) and m > held]:
        for a, b in {bounds[r][:2] for r in open_}:
            mine = [r for r in open_ if bounds[r][:2] == (a, b)]
            below, m = bounds[mine[0]][2:]
            narrower(values.where(F.col("v").between(a, b)), mine, bounds, below, m)
    ranges = sorted({b[:2] for b in bounds.values() if not alike(*b[:2])}, key=str)
    within = F.lit(False)
    for a, b in ranges:
        within = within | F.col("v").between(a, b)
    counts = values.where(within).groupBy("v").count().orderBy("v").collect() if ranges else []
    found = {}
    for r, (a, b, below, _) in bounds.items():
        if alike(a, b):
            found[r] = a
            continue
        for row in counts:
            if in_order(a, row.v) and in_order(row.v, b):
                below += row["count"]
                if below > r:
                    found[r] = row.v
                    break
    return [found[r] for r in ranks]


def alike(a: float, b: float) -> bool:
    return a == b or math.isnan(a) and math.isnan(b)


def in_order(a: float, b: float) -> bool:
    """a <= b as Spark orders numbers, NaN last."""
    return math.isnan(b) or a <= b


def narrower(rows: DataFrame, ranks: Sequence[int], bounds: dict[int, tuple[float, float, int, int]], below: int, n: int) -> None:
    """Closer bounds for ranks that lie within the n rows, `below` being the rows before them."""
    share = [max(0.0, min(1.0, (r - below) / max(n - 1, 1) + d / ACCURACY)) for r in ranks for d in (-2, 2)]
    cuts = rows.agg(F.percentile_approx("v", share, ACCURACY)).first()[0]
    pairs = {r: (cuts[2 * i], cuts[2 * i + 1]) for i, r in enumerate(ranks)}
    told = rows.agg(*(F.struct(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)) for a, b in pairs.values())).first()
    for (r, (a, b)), (before, upto) in zip(pairs.items(), told, strict=True):
        first, last, _, _ = bounds[r]
        if before <= r - below < upto:
            bounds[r] = (a, b, below + before, upto - before)
        elif r - below >= upto:  # beyond the sketch's promise; one bound still holds
            bounds[r] = (b, last, below + rows.where(F.col("v") < b).count(), n - rows.where(F.col("v") < b).count())
        else:
            bounds[r] = (first, a, below, rows.where(F.col("v") <= a).count())
        if bounds[r][3] >= n:  # nothing was gained: nearly all rows have one of the two bounds
            a, b = bounds[r][:2]
            own, last, up, down = rows.agg(F.count_if(F.col("v") == a), F.count_if(F.col("v") == b), F.min(F.when(F.col("v") > a, F.col("v"))), F.max(F.when(F.col("v") < b, F.col("v")))).first()
            first_rank, end = below + own, below + n - last
            bounds[r] = (a, a, below, own) if r < first_rank else (b, b, end, last) if r >= end else (up, down, first_rank, n - own - last)


def places(n: int, shares: Sequence[float], kind: str) -> list[tuple[int, int, float]]:
    """(rank, next rank, position) of each share of n rows: linear between two, or disc, the first at which the share is
    reached."""
    if kind == "disc":
        return [(max(math.ceil(p * n) - 1, 0),) * 2 + (0.0,) for p in shares]
    return [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1)) for p in shares]


def between(low: float, high: float, a: int, b: int, position: float) -> float:
    return low if a == b or alike(low, high) else (b - position) * low + (position - a) * high


def percentiles(df: DataFrame, value: Column, shares: Sequence[float], kind: str = "linear", held: int = HELD) -> list[float | None]:
    """Exact percentiles (shares from 0 to 1) of the filled values, linear or disc, as Spark's percentile and
    percentile_disc; None where there is no value."""
    n = df.agg(F.count(value.cast("double"))).first()[0]
    if not n:
        return [None] * len(shares)
    where = places(n, shares, kind)
    found = at_ranks(df, value, [r for a, b, _ in where for r in (a, b)], held)
    return [between(found[2 * i], found[2 * i + 1], *w) for i, w in enumerate(where)]


def mode(df: DataFrame, value: Column) -> DataFrame:
    """One row (v): the most frequent filled value, ties by the smallest; null where there is none."""
    counts = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))


def group_medians(df: DataFrame, keys: Sequence[str], value: Column, large: int = LARGE) -> DataFrame:
    """(keys, v): the median of each group's filled values, null where a group has none; a null key is a group."""
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(col(k).alias(n) for k, n in zip(keys, names, strict=True)), value.cast("double").alias("v"))
    back = [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    big = rows.groupBy(*names).agg(F.count("v").alias("n")).where(F.col("n") >= large)
    hot = stable(big.select(*(F.col(n).alias(f"h{n}") for n in names)))  # a row for `large` rows at most
    if hot.isEmpty():
        return rows.groupBy(*names).agg(F.median("v").alias("v")).select(*back, "v")
    same = [F.col(n).eqNullSafe(F.col(f"h{n}")) for n in names]
    # by broadcast: a shuffle by so few keys would bring a group into one task
    few = rows.join(F.broadcast(hot), same, "left_anti").groupBy(*names).agg(F.median("v").alias("v"))
    many = rows.join(F.broadcast(hot), same, "left_semi").where("v IS NOT NULL")
    return few.union(dealt_medians(many, names)).select(*back, "v")


def dealt_medians(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, v): medians by running counts over range parts of (keys, v)."""
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    parts = stable(counts.repartitionByRange(*keys, "v").withColumn("part", F.spark_partition_id()))
    own = parts.groupBy(*keys, "part").agg(F.sum("n").alias("own"))
    by_key = Window.partitionBy(*keys)
    bases = own.select(*keys, "part", (F.sum("own").over(by_key.orderBy("part")) - F.col("own")).alias("base"), F.sum("own").over(by_key).alias("total"))
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("v"))
    local = parts.withColumn("upto", running).alias("a")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "part"]]
    placed = local.join(bases.alias("b"), same).select(*(F.col(f"a.{k}").alias(k) for k in keys), "v", (F.col("base") + F.col("upto")).alias("upto"), "total")
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    found = placed.groupBy(*keys).agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"))
    return found.select(*keys, F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(0.5 * F.col("a") + 0.5 * F.col("b")).alias("v"))
