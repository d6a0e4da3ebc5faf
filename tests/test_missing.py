"""Missing numbers, times with zones and workbook cells that earlier versions changed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from colweave.functions.values import parse_date
from colweave.operators import profiling as P
from colweave.operators import shared_values as S
from colweave.operators.transform import all_null_columns, cast_loss_report
from colweave.sinks.xlsx import write_xlsx
from colweave.sources.xlsx import read_xlsx

NAN = float("nan")


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.5, NAN), (2, NAN, NAN), (3, None, NAN)], "id int, x double, y float")
    assert P.completeness(df).first().asDict() == {"total_rows": 3, "total_columns": 3, "null_cells": 5, "completeness": 44.4}
    assert [r.null_count for r in P.schema_profile(df, ["id"]).orderBy("ordinal").collect()] == [0, 2, 3]
    assert [(r.n_values, r.pattern) for r in P.profile_patterns_full(df).orderBy("ordinal").collect()] == [(3, "numeric"), (1, "numeric"), (0, "empty")]
    assert [r.n_values for r in S.cardinality(df).collect()] == [3, 1, 0]
    assert all_null_columns(df) == ["y"]
    report = cast_loss_report(df, {"t": ("x", 1.0)}, spark.createDataFrame([], "t double")).first()
    assert (report.n_before, report.n_after) == (1, 1)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zone_suffix_gives_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    want = {
        "2024-01-15T10:30:00Z": "2024-01-15 10:30:00", "2024-01-15T10:30:00+05:30": "2024-01-15 05:00:00",
        "2024-01-15 10:30-0800": "2024-01-15 18:30:00", "2024-03-10T02:30:00.25-05": "2024-03-10 07:30:00.25",
        "2024-01-15T10:30:00": "2024-01-15 10:30:00", "2024-01-15+05:00": None, "2024-01-15T10:30:00+25:00": None, "2024-13-01T00:00Z": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in want], "t string")
        assert {r.t: r.d for r in df.select("t", parse_date(F.col("t")).cast("string").alias("d")).collect()} == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_workbook_keeps_cells(spark, tmp_path):
    rows = [("a\x01b\r\n_x0041_ ￿", dt.datetime(2024, 1, 15, 10, 30, 0, 123456), 2**53 - 1, 1.5), ("\x1f", dt.datetime(1999, 12, 31, 23, 59, 59), -5, NAN)]
    write_xlsx(spark.createDataFrame(rows, "`a``b` string, t timestamp_ntz, n long, x double").coalesce(1), str(tmp_path / "x"))
    back = read_xlsx(spark, str(tmp_path / "x"))
    assert back.columns == ["a`b", "t", "n", "x"]
    assert sorted(map(tuple, back.collect()), key=lambda r: r[2]) == [("\x1f", rows[1][1], -5, None), rows[0]]


@pytest.mark.parametrize("sql", ["SELECT 9007199254740993 AS n", "SELECT 1234567890.12345678901BD AS n"])
def test_workbook_refuses_digits_it_cannot_hold(spark, tmp_path, sql):
    with pytest.raises(Exception, match="more digits than a cell holds"):
        write_xlsx(spark.sql(sql), str(tmp_path / "x"))


def test_workbook_cells_beyond_the_header_are_an_error(spark, tmp_path):
    from colweave.sinks.xlsx import _Workbook

    with open(tmp_path / "wide.xlsx", "wb") as f:
        book = _Workbook(f, ["a", "b"], "Data")
        book.add((1, 2))
        book.add((1, 2, 3))
        book.close()
    with pytest.raises(Exception, match="row 3 of a sheet has values beyond the 2 columns"):
        read_xlsx(spark, str(tmp_path / "wide.xlsx")).collect()
