"""Database tables in ranges, over a file of the embedded database that comes with Spark."""

from __future__ import annotations

import pytest

from millrace.sources import database, readers, writers


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """A table whose keys have a gap, a dense stretch and nulls."""
    path = f"{tmp_path_factory.mktemp('db')}/orders"
    keys = [*range(0, 100), *range(1_000_000, 1_000_900), None, None]
    rows = [(f"n{i}", k, float(i)) for i, k in enumerate(keys)]
    spark.createDataFrame(rows, "name string, id long, price double").coalesce(1).write.jdbc(f"jdbc:derby:{path};create=true", "orders")
    return path, rows


def test_ranges_hold_each_row_once_and_evenly(spark, orders):
    path, rows = orders
    df = readers.read_source(spark, f"derby:{path}?table=orders&key=ID&rows=150")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    sizes = df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) >= 7
    assert max(sizes) <= 150  # though the dense stretch is one step of the whole width
    close = database.read_database(spark, f"jdbc:derby:{path}", query='SELECT * FROM orders WHERE "id" >= 1000000', rows=150)
    sizes = close.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 900
    assert max(sizes) <= 150


def test_filters_and_columns_are_pushed(spark, orders):
    path, rows = orders
    df = readers.read_source(spark, f"derby:{path}?table=orders&rows=300").where("price < 50").select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(price,50.0)" in plan or "LessThan(PRICE,50.0)" in plan
    assert "name" not in plan[plan.index("ReadSchema") :].lower()
    assert df.count() == 50


def test_uris_without_range(spark, orders):
    path, rows = orders
    assert readers.read_source(spark, f"derby:{path}?query=SELECT%20%22name%22%20FROM%20orders").count() == len(rows)
    assert readers.read_source(spark, f"derby:{path}?table=orders").rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="table= or query="):
        readers.read_source(spark, f"derby:{path}")
    with pytest.raises(ValueError, match="no whole-number column"):
        readers.read_source(spark, f"derby:{path}?table=orders&key=name")


def test_predicates_and_cuts():
    assert database.key_predicates("k", []) == ["1 = 1"]
    assert database.key_predicates("k", [5, 9]) == ["k < 5 OR k IS NULL", "k >= 5 AND k < 9", "k >= 9"]
    assert database.cut_points([(0, 5), (10, 5), (20, 20), (30, 1), (40, 1)], 10) == [20, 30]
    assert database.cut_points([], 10) == []
    assert database.merged([(0, 4), (4, 8), (12, 16)]) == [(0, 8), (12, 16)]


def test_join_export(spark, tmp_path):
    writers.write_jdbc(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"), f"jdbc:derby:{tmp_path}/out;create=true")
    back = readers.read_source(spark, f"derby:{tmp_path}/out?table=joined")
    assert sorted(map(tuple, back.collect())) == [("1", "a"), ("2", None)]
