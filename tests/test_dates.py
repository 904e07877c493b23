"""Dates in text: a pattern is tried only on texts of its shape, with the results of trying all."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions.exprs import DATE_FORMATS, date_shape, is_date, parse_date

TEXTS = [
    "2024-03-05", "2024-3-5", "2024-03-05 07:08:09", "2024-03-05T07:08:09", "2024-03-05T07:08:09+02:00", "2024-03-05T07:08:09Z", "3/5/2024", "13/5/2024", "03/05/2024", "31/12/2024", "5-3-2024",
    "2024/03/05", "Mar 5, 2024", "5 Mar 2024", "March 5, 2024", "5 March 2024", "5-Mar-24", "mar 5, 2024", "May 5, 2024", "5 Sept 2024", "2024-02-30", "9999-99-99", "12/31/99", "", " ", "not a date", "20240305", " 2024-03-05 ", None,
]


def test_shapes_leave_out_no_date(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    every = F.coalesce(*(F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in DATE_FORMATS)).cast("timestamp_ntz")
    for r in df.select("t", parse_date(F.col("t")).alias("got"), every.alias("want")).collect():
        assert r.got == r.want, r.t


def test_each_pattern_has_its_shape(spark):
    stamp = datetime(2024, 11, 25, 17, 4, 9)
    row = spark.createDataFrame([(stamp,)], "t timestamp").select(*(F.date_format("t", f) for f in DATE_FORMATS)).first()
    for f, text in zip(DATE_FORMATS, row, strict=True):
        assert re.fullmatch(date_shape(f)[1:-1], text), (f, text)
    assert re.fullmatch(date_shape("EEEE dd.MM.yyyy")[1:-1], "Monday 25.11.2024")


def test_impossible_days_are_no_dates(spark):
    got = spark.createDataFrame([("9999-99-99",), ("2023-02-29",), ("2024-02-29",), (None,)], "t string").select(is_date(F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False, True, False]


def test_other_patterns(spark):
    df = spark.createDataFrame([("25.11.2024 5 PM",), ("x",)], "t string")
    assert [r[0] for r in df.select(parse_date(F.col("t"), ["dd.MM.yyyy h a"])).collect()] == [datetime(2024, 11, 25, 17), None]
