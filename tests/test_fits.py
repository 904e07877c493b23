"""Least squares, clusters, chained logs over ranges and key discovery."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import impute, joins, numeric, privacy, ranks


def test_nearly_dependent_sources_keep_their_digits(spark):
    """The normal equations lose all digits here: the columns differ by a millionth of a millionth of their squares."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=900)
    x = np.stack([a, a + 1e-7 * rng.normal(size=900), rng.normal(size=900) + 1000], axis=1)
    y = 3 + x @ np.array([2.0, -1.0, 0.5])
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(7)
    got = impute.ols(df, F.col("y"), [F.col("a"), F.col("b"), F.col("c")])
    assert got == pytest.approx([3.0, 2.0, -1.0, 0.5], rel=1e-7)
    centred = x - x.mean(axis=0)
    try:
        normal = np.linalg.solve(centred.T @ centred, centred.T @ (y - y.mean()))
    except np.linalg.LinAlgError:
        normal = np.zeros(3)
    assert abs(normal[0] - 2.0) > 1e-5
    with pytest.raises(ValueError, match="depend"):
        impute.ols(df, F.col("y"), [F.col("a"), F.col("a") * 2])
    with pytest.raises(ValueError, match="more complete rows"):
        impute.ols(df.limit(2), F.col("y"), [F.col("a"), F.col("b")])


def test_least_squares_leaves_out_incomplete_rows(spark):
    rows = [(float(i), 2.0 * i + 1) for i in range(50)] + [(None, 7.0), (5.0, None)]
    got = impute.ols(spark.createDataFrame(rows, "x double, y double"), F.col("y"), [F.col("x")])
    assert got == pytest.approx([1.0, 2.0])
    exact = impute.ols(spark.createDataFrame(rows[:2], "x double, y double"), F.col("y"), [F.col("x")])
    assert exact == pytest.approx([1.0, 2.0])


def test_best_clusters_equal_all_cut_sets():
    rng = random.Random(5)
    for trial in range(30):
        v = np.array(sorted(rng.sample(range(60), 9)), dtype=float) * (1e6 if trial % 3 == 0 else 1.0)
        n = np.array([rng.randint(1, 5) for _ in v], dtype=float)
        for k in (1, 2, 3, 4, 9, 12):
            best = numeric.best_clusters(v, n, k)
            if k >= len(v):
                assert best.tolist() == v.tolist()
                continue
            cost = lambda edges: sum(float(n[a:b] @ (v[a:b] - np.average(v[a:b], weights=n[a:b])) ** 2) for a, b in itertools.pairwise(edges))
            least = min(cost([0, *c, len(v)]) for c in itertools.combinations(range(1, len(v)), k - 1))
            near = np.abs(v[:, None] - best).argmin(axis=1)
            own = sum(float(n[near == j] @ (v[near == j] - best[j]) ** 2) for j in range(k))
            assert own == pytest.approx(least, rel=1e-9, abs=1e-6)


def test_cluster_buckets(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 1.0, 2.0, 50.0, 51.0, 52.0, 100.0, None]], "x double")
    rows = [(r.label, r.min, r.max) for r in numeric.suggest_buckets(df, "x", "kmeans", 3).collect()]
    assert rows == [("b1", None, pytest.approx((4 / 3 + 51) / 2)), ("b2", pytest.approx((4 / 3 + 51) / 2), 75.5), ("b3", 75.5, None)]
    many = spark.range(5000).select((F.col("id") % 1000 + F.when(F.col("id") % 2 == 0, 10_000).otherwise(0)).cast("double").alias("v"))
    assert numeric.cluster_centres(many, 2, most=50) == pytest.approx([500, 10_499], abs=2)
    assert numeric.suggest_buckets(df.where("x = 100"), "x", "kmeans", 3).count() == 3  # too few values: by quantile


def test_one_long_log_is_verified_over_many_tasks(spark):
    rows = [("long", i, f"body {i}") for i in range(3000)] + [(None, 1, "a"), (None, 2, None), ("z", 1, "b")]
    made = privacy.chain_log(spark.createDataFrame(rows, "log string, seq int, body string"), "log", "seq", "body", "key")
    logged = spark.createDataFrame(made.collect(), made.schema)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # the ranges are small
    try:
        parts = ranks.stable(logged.repartitionByRange("log", "seq").select("seq", F.spark_partition_id().alias("p"), "log"))
        borders = sorted(r.seq for r in parts.where("log = 'long'").groupBy("p").agg(F.min("seq").alias("seq")).collect())
        assert len(borders) >= 3
        assert privacy.verify_chain(logged, "log", "seq", "body", "key").where("NOT ok").count() == 0
        forged = [*borders[:2], 77, 2999]
        changed = logged.withColumn("body", F.when((F.col("log") == "long") & F.col("seq").isin(forged), "forged").otherwise(F.col("body")))
        told = privacy.verify_chain(changed, "log", "seq", "body", "key")
        assert told.columns == ["log", "seq", "body", "hmac", "ok"]
        assert sorted(r.seq for r in told.where("NOT ok").collect()) == sorted(set(forged))
        gone = logged.where(~((F.col("log") == "long") & (F.col("seq") == borders[1] - 1)) | F.col("log").isNull())
        assert [r.seq for r in privacy.verify_chain(gone, "log", "seq", "body", "key").where("NOT ok").collect()] == [borders[1]]
    finally:
        spark.conf.unset(key)
    assert privacy.verify_chain(logged.limit(0), "log", "seq", "body", "key").count() == 0


def test_keys_are_found_whatever_their_names(spark):
    left = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") % 700).alias("buyer"), F.lit("x").alias("kind"), F.lit(None).cast("string").alias("empty"))
    right = spark.range(1000).select(F.col("id").cast("string").alias("who"), (F.col("id") % 10).alias("size"), F.lit("x").alias("note"))
    got = joins.discover_keys(left, right).collect()
    assert (got[0].left_key, got[0].right_key, got[0].containment, got[0].right_unique) == ("buyer", "who", 1.0, 1.0)
    assert [(r.left_key, r.right_key) for r in got] == [("buyer", "who")]
    plan = joins.column_sketches(right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
    assert joins.discover_keys(left.limit(0), right).count() == 0
