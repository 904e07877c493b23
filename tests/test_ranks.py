"""Exact order statistics, grouped medians and profiles, against Spark's own aggregates."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate, impute, numeric, ranks


def values(spark, kind: str):
    rng = random.Random(7)
    made = {
        "spread": [rng.gauss(0, 100) for _ in range(3000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(3000)],
        "two": [0.0] * 1500 + [1.0] * 1500,
        "ends": [0.0] * 1490 + [0.25, 0.5, 0.75] + [9.0] * 1507,
        "one": [4.0] * 500,
        "few": [3.0, 1.0, 2.0],
        "odd": [float("nan"), float("inf"), float("-inf"), -0.0, 0.0] * 40,
    }[kind]
    return spark.createDataFrame([(v,) for v in [*made, None, None]], "x double").repartition(5)


@pytest.mark.parametrize("kind", ["spread", "ties", "two", "ends", "one", "few", "odd"])
def test_percentiles_equal_sparks(spark, monkeypatch, kind):
    """The sketch is so coarse and so few values are held that bounds are drawn closer several times."""
    monkeypatch.setattr(ranks, "ACCURACY", 30)
    df = values(spark, kind)
    shares = [0.0, 0.1, 0.25, 0.4967, 0.5, 0.75, 0.999, 1.0] if kind == "spread" else [0.0, 0.25, 0.4967, 0.5, 1.0]
    linear, disc = df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0], df.selectExpr(*(f"percentile_disc({p!r}) WITHIN GROUP (ORDER BY x) AS p{i}" for i, p in enumerate(shares))).first()
    for got, want in ((ranks.percentiles(df, F.col("x"), shares, held=20), linear), (ranks.percentiles(df, F.col("x"), shares, "disc", held=20), disc)):
        assert [str(abs(g) if g == 0 else g) for g in got] == [str(abs(w) if w == 0 else w) for w in want]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert ranks.percentiles(df, F.col("x"), [0.5, 1.0]) == [None, None]
    assert ranks.mode(df, F.col("x")).collect()[0].v is None
    assert ranks.at_ranks(df, F.col("x"), []) == []
    assert numeric.detect_outliers(df, "x", {}).collect()[0]["x__outlier"] is False
    assert impute.impute(df, "x", {"strategy": "median"}).collect()[0].x is None
    assert numeric.percentile_bucketize(df, "x", {"buckets": [{"pmin": 0, "pmax": 50, "label": "a"}]}).collect()[0].x is None


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "b", "a", "a", None, None, None]], "x string")
    assert ranks.mode(df, F.col("x")).first().v == "a"


@pytest.mark.parametrize("large", [40, 10**6])
def test_group_medians_under_skew(spark, large):
    """One group has nine tenths of the rows; with a small bound it is dealt out by ranges of its values."""
    rng = random.Random(3)
    rows = [("hot", 1, rng.choice([rng.gauss(0, 9), float(rng.randint(0, 3)), None])) for _ in range(1800)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([float(rng.randint(0, 50)), None])) for _ in range(200)]
    rows += [("none", 1, None), (None, 7, 1.0), (None, 7, 2.0)]
    df = spark.createDataFrame(rows, "g string, h int, x double")
    want = df.groupBy("g", "h").agg(F.median("x").alias("v"))
    assert sorted(map(str, ranks.group_medians(df, ["g", "h"], F.col("x"), large).collect())) == sorted(map(str, want.collect()))


def test_a_large_group_fills_many_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k0"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # the parts are small
    try:
        counts = df.groupBy("k0", "v").agg(F.count("*").alias("n")).repartitionByRange("k0", "v")
        assert counts.select(F.spark_partition_id()).distinct().count() >= 3
    finally:
        spark.conf.unset(key)
    assert ranks.dealt_medians(df, ["k0"]).first().v == df.agg(F.median("v")).first()[0]


def test_grouped_steps_take_medians_beside_others(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), (None, 2.0), ("b", None)], "g string, x double")
    got = aggregate.groupby(df, "g", [{"column": "x", "op": "median", "as": "m"}, {"op": "count"}, {"column": "x", "op": "median"}])
    assert got.columns == ["g", "m", "count", "x_median"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 2.5, 2, 2.5), (None, 2.0, 1, 2.0), ("b", None, 1, None)], key=str)
    assert sorted(map(tuple, aggregate.groupby(df, "g", [{"column": "x", "op": "median"}]).collect()), key=str) == sorted([("a", 2.5), (None, 2.0), ("b", None)], key=str)


def test_profile_has_one_exchange_of_cells(spark):
    rows = [(1, -0.0, "x" * 100, bytearray(b"a"), [1, None]), (2, 0.0, "x" * 100, None, [1]), (3, float("nan"), "x" * 99 + "y", bytearray(b"a"), None), (4, float("nan"), None, bytearray(b"b"), [1, None])]
    df = spark.createDataFrame(rows, "id int, d double, t string, b binary, a array<int>")
    got = {r.column: (r.dtype, r.nulls, r.unique) for r in aggregate.profile(df).collect()}
    assert got == {"id": ("int", 0, 4), "d": ("double", 0, 2), "t": ("string", 1, 3), "b": ("binary", 1, 3), "a": ("array<int>", 1, 3)}
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    wide = df.select("*", *[F.col("t").alias(f"t{i}") for i in range(20)])
    for narrow, broad in ((aggregate.profile(df), aggregate.profile(wide)), (aggregate.inspect(df.drop("a"), "id"), aggregate.inspect(wide.drop("a"), "id"))):
        assert "Expand" not in plan(broad)
        assert plan(broad).count("Exchange") == plan(narrow).count("Exchange")
    assert [r.unique for r in aggregate.profile(df.limit(0)).collect()] == [0] * 5
    assert {r.column: r.nulls for r in aggregate.profile(df, approximate=True).collect()} == {"id": 0, "d": 0, "t": 1, "b": 1, "a": 1}


def test_inspect(spark):
    df = spark.createDataFrame([(i, " " if i % 2 else "7", "k") for i in range(60)] + [(60, "word", None)], "id int, a string, b string")
    got = {r.column: r for r in aggregate.inspect(df, "id", 5).collect()}
    a, b = got["a"], got["b"]
    assert (a.missing_count, a.missing_pct, a.unique_count, a.mixed_type, a.constant, a.missing_positions) == (30, 49.18, 2, True, False, [1, 3, 5, 7, 9])
    assert (b.missing_count, b.unique_count, b.mixed_type, b.constant, b.missing_positions) == (1, 1, False, True, [60])
    empty = aggregate.inspect(df.limit(0), "id").collect()
    assert [(r.missing_count, r.missing_pct, r.constant, r.missing_positions) for r in empty] == [(0, 0.0, True, [])] * 2


def test_number_order():
    assert ranks.in_order(1.0, math.nan)
    assert not ranks.in_order(math.nan, 1.0)
    assert ranks.places(5, [0.0, 0.5, 1.0], "disc") == [(0, 0, 0.0), (2, 2, 0.0), (4, 4, 0.0)]


def test_large_groups_are_not_shuffled_by_their_key(spark):
    """A join by sort and merge would bring each large group into one task."""
    df = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ranks.group_medians(df, ["g"], F.col("x"), large=1000)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "hk0" in line]
        assert sorted(map(tuple, made.collect())) == [(0, 1999.5), (1, 1999.0), (2, 2000.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
