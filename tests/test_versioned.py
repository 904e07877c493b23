"""Versions of a table as lists of files: snapshots, rollback, retention and deletion."""

from __future__ import annotations

import hashlib
from datetime import UTC, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from millrace.plans.recipe import apply_recipe
from millrace.sources.readers import read_source
from millrace.sources.versioned import ConflictError, VersionedTable, delete_subject_files

NOW = datetime(2024, 6, 30, tzinfo=UTC)


def files(path) -> dict[str, str]:
    """The data files and their bytes' digests."""
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).glob("data/*/*.parquet")}


def rows(spark, low: int, high: int):
    return spark.range(low, high).select("id", (F.col("id") % 5).alias("user"), F.col("id").cast("string").alias("name"))


@pytest.fixture
def table(spark, tmp_path):
    made = VersionedTable(spark, f"file://{tmp_path}/t")
    made.overwrite(rows(spark, 0, 100).repartitionByRange(4, "id"), NOW - timedelta(days=90))
    return made, tmp_path / "t"


def test_a_snapshot_writes_no_data_and_rollback_is_bit_equal(spark, table):
    t, path = table
    before = files(path)
    kept = t.snapshot(NOW - timedelta(days=60))
    assert files(path) == before
    assert t.append(rows(spark, 100, 120)) == 3
    assert t.read().count() == 120
    t.overwrite(t.read().where("id < 10").withColumn("name", F.lit("new")))  # computed from the table itself
    assert {r.name for r in t.read().collect()} == {"new"}
    assert t.rollback(kept) == 5
    now = {r.file for r in t.manifest(5).where("file IS NOT NULL").collect()}
    assert now == set(before)
    assert {k: v for k, v in files(path).items() if k in now} == before
    assert sorted(r.id for r in t.read().collect()) == list(range(100))
    told = {r.version: (r.kind, r.files > 0, r.rows) for r in t.history().collect()}
    assert told == {1: ("overwrite", True, 100), 2: ("snapshot", True, 100), 3: ("append", True, 120), 4: ("overwrite", True, 10), 5: ("rollback to 2", True, 100)}


def test_expiry_keeps_what_another_version_names(spark, table):
    t, path = table
    first = set(files(path))
    t.snapshot(NOW - timedelta(days=10))
    t.overwrite(rows(spark, 0, 5), NOW - timedelta(days=5))
    assert t.expire(30, NOW) == (1, 0)  # version 2 still names the files of version 1
    assert first <= set(files(path))
    assert t.read(2).count() == 100
    assert t.expire(7, NOW) == (1, len(first))
    assert first.isdisjoint(files(path))
    assert t.expire(0, NOW) == (0, 0)  # the current version stays, however old
    assert t.read().count() == 5


def test_deletion_rewrites_touched_files_only(spark, table):
    t, path = table
    before = set(files(path))
    version = t.delete_where(F.col("id").between(3, 7))
    names = {r.file for r in t.manifest(version).where("file IS NOT NULL").collect()}
    assert len(before & names) == len(before) - 1
    assert sorted(r.id for r in t.read().collect()) == [i for i in range(100) if not 3 <= i <= 7]
    assert t.read(1).count() == 100
    assert t.delete_where(F.col("id") > 1000) == version  # nothing to delete
    assert t.delete_where(F.col("id").isNotNull()) == version + 1
    assert t.read().count() == 0
    assert t.read().columns == ["id", "user", "name"]
    assert t.append(rows(spark, 7, 8)) == version + 2
    assert t.read().count() == 1


def test_subject_deletion(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/s")
    df = rows(spark, 0, 40).withColumn("user", F.when(F.col("id") < 30, F.floor(F.col("id") / 10)))
    t.overwrite(df.repartitionByRange(4, "id"))
    before = set(files(tmp_path / "s"))
    version, ids = delete_subject_files(t, "user", 1, "id")
    assert sorted(r.deleted_id for r in ids.collect()) == list(range(10, 20))
    assert sorted(r.id for r in t.read().collect()) == [*range(10), *range(20, 40)]
    kept = {r.file for r in t.manifest(version).where("file IS NOT NULL").collect()}
    assert len(before - kept) <= 2
    version, ids = delete_subject_files(t, "user", 2, "id", purge=True)
    assert sorted(r.deleted_id for r in ids.collect()) == list(range(20, 30))
    assert t.versions() == [version]
    left = spark.read.parquet(*(f"file://{tmp_path}/s/{f}" for f in files(tmp_path / "s")))
    assert left.where("user IN (1, 2)").count() == 0


def test_writers_do_not_overtake_each_other(spark, table):
    t, path = table
    slow = VersionedTable(spark, t.path)
    slow.current = lambda: 1  # has read version 1
    t.append(rows(spark, 100, 101))
    with pytest.raises(ConflictError):
        slow.delete_where(F.col("id") == 1)
    assert t.read().count() == 101
    (path / "manifests" / "_claim-000000000003").touch()  # a writer that broke off
    with pytest.raises(ConflictError):
        t.snapshot()
    assert t.recover() == [3]
    assert t.snapshot() == 3
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, f"{t.path}-none").read()


def test_recipes_read_versions_and_keep_one(spark, table):
    t, path = table
    t.append(rows(spark, 100, 101))
    assert read_source(spark, f"versioned:{t.path}@1").count() == 100
    recipe = {"sources": [{"path": f"versioned:{t.path}"}], "cleaning_steps": [{"action": "normalize", "column": "name", "params": {"case": "upper"}}], "outputs": [{"path": f"file://{path}-out.parquet"}]}
    before = files(path)
    told = apply_recipe(spark, recipe, snapshots=f"file://{path}-snapshots")
    assert told["snapshot"] == f"versioned:{t.path}@3"
    assert files(path) == before
    assert read_source(spark, told["snapshot"]).count() == 101
