"""A cross-section of the registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
SOME = (
    "flagship_recipe", "p03_drop_constant", "p07e_or", "p10_derive", "p11_apply_patch", "x03_normalize_title", "x07_map", "x13_split_mixed", "x16_swap_by_types", "n01_cast_int", "n05_cast_datetime_format",
    "n14_suggest_quantile", "n16_suggest_kmeans", "a04_scalars", "a07_quantiles_discrete", "j15b_discover_keys", "x17b_similarity_known", "p11_apply_patch", "a02_profile", "a03_inspect", "w01_ffill", "w04_row_index", "w08_hash_chain", "m09_grouped_median", "m11_regression", "q07_explain", "q08_cell_difference", "j07_full", "j14_statistics",
    "j17_consistency", "p14_opt_out", "s13_wide_from_cells", "k04_snapshot_rollback", "r01_incremental",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or pd.isna(v):
            return None
        return round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    assert rows(got) == rows(sql.execute(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


WHOLE_JOINS = ("j04w_inner_whole", "j05w_left_whole", "j06w_right_whole", "j07w_full_whole", "j08w_anti_whole", "j12w_conflict_suffix_whole", "j13w_prefer_right_whole", "j14w_statistics_whole")


@pytest.mark.parametrize("name", WHOLE_JOINS)
def test_whole_join_equals_sql(spark, sql, name):
    test_query_equals_sql(spark, sql, name)


def test_whole_joins_leave_no_row_out(spark, sql):
    one = lambda q: sql.execute(q).fetchone()[0]
    run = lambda name: entry.queries()[name](spark, DATA)
    assert run("j05w_left_whole").count() == one("SELECT count(*) FROM documents")
    assert run("j04w_inner_whole").where("doc_id % 3 = 0").count() == one("SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 = 0") > 0
    assert run("j06w_right_whole").where("quality IS NULL").count() == one("SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)") > 0


def test_normalize_runs_on_the_whole_text(spark, sql):
    test_query_equals_sql(spark, sql, "x01w_normalize_lower_whole")
    longest = entry.queries()["x01w_normalize_lower_whole"](spark, DATA).selectExpr("max(length(out))").first()[0]
    assert longest == sql.execute("SELECT max(length(trim(text))) FROM documents").fetchone()[0] > 80
