"""The queries of file sources and sinks, and of bounds, against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.test_catalog import pytestmark, sql, test_query_equals_sql  # noqa: F401

NAMES = (
    "s01b_quoted_newlines", "s04_sniff_delimiter", "s07_xlsx", "s08_docx", "s09_pptx", "s15_database", "k04b_version_rollback", "k06b_expire_versions", "p16b_subject_deletion_files", "q01b_record_drift", "s06_encodings", "s10_shortcuts", "s11_ingest", "s14_reconstruct", "s18_duplicate_files", "k01_write_csv", "k02_replace_source", "k06_expire_snapshots", "k07_join_export", "k08_record_run",
    "k09_write_long_form", "t05_latest_events", "p19_redact_json", "s17b_json_record_files", "a06b_quartile_bounds", "a07b_percentile_buckets", "a08b_deviation_bounds",
)
check = test_query_equals_sql
del test_query_equals_sql


@pytest.mark.parametrize("name", NAMES)
def test_file_query_equals_sql(spark, sql, name):  # noqa: F811
    check(spark, sql, name)


def test_ingest_has_one_empty_file_though_the_first_task_has_no_rows(spark, tmp_path):
    """One row group over several splits: the first split gives no rows."""
    rows = pa.table({"c_custkey": list(range(2000)), "c_name": [f"Customer#{i:09d}" for i in range(2000)]})
    pq.write_table(rows, tmp_path / "customer.parquet", row_group_size=10_000, compression="none", use_dictionary=False)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        assert len(spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.glom().first()) == 0
        got = entry.queries()["s11_ingest"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(entry.oracle_sql()["s11_ingest"]).fetchall())


def test_a_file_for_each_row_in_one_folder(spark, tmp_path):
    from millrace.catalog.files import file_each

    file_each(spark.range(50).selectExpr("concat('{\n\"id\": ', id, '}') AS value"), f"{tmp_path}/each")
    assert len(list(tmp_path.glob("each/*.txt"))) == 50
    assert not [p for p in tmp_path.glob("each/*") if p.is_dir()]


def test_json_record_files_need_no_look_up_of_each_file(spark, tmp_path):
    from millrace.sources import readers

    (tmp_path / "a.json").write_text('{\n"id": 1, "name": "é"\n}')
    (tmp_path / "b.json").write_text('[{"id": 2},\n{"id": 3, "more": 1.5}]')
    (tmp_path / "c.json").write_bytes('{"id": 4,\n"name": "ü"}'.encode("utf-16"))
    df = readers.json_records(spark, str(tmp_path))
    assert df.schema == spark.read.json(str(tmp_path), multiLine=True).schema
    assert sorted(map(tuple, df.select("id", "name", "more").collect())) == [(1, "é", None), (2, None, None), (3, None, 1.5), (4, "ü", None)]
