"""Value parsing, cleaning and projection."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colweave.functions import values as V
from colweave.operators import transform as X
from colweave.plans.core import struct


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_trim_and_null_tokens(spark):
    texts = ["\t a ", "N/A", " null ", "none", "-", "", None, "　x\x1f", "nan", "NA"]
    assert column(spark, texts, V.clean_text) == ["a", None, None, "none", "-", None, None, "x", None, "NA"]


@pytest.mark.parametrize("text, want", [
    ("12", 12.0), (" +.5 ", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("-inf", -math.inf), ("Infinity", math.inf),
    ("1_000", None), ("0x1A", None), ("1d", None), ("1f", None), ("NaN", None), ("(100)", None), ("1,000", None), ("", None), ("--1", None),
    ("0x1p3", None),
])
def test_parse_number(spark, text, want):
    assert column(spark, [text], V.parse_number) == [want]


def test_to_number(spark):
    texts = ["$1,234.50", "50%", "1 000", "1 000 €", "£ 7", "1.234,56", "(100)", "abc", None, "1e3"]
    assert column(spark, texts, V.to_number) == [1234.5, 50.0, 1000.0, 1000.0, 7.0, 1.23456, None, None, None, 1000.0]
    german = lambda c: V.to_number(c, decimal_comma=True)
    assert column(spark, ["1.234,56 €", "7", "-3,5"], german) == [1234.56, 7.0, -3.5]
    books = lambda c: V.to_number(c, accounting=True)
    assert column(spark, ["($1,200)", "5"], books) == [-1200.0, 5.0]


def test_parse_date(spark):
    texts = ["2024-01-05", "2024-1-5 10:30:01.5", "2024-01-05T08:00", "Jan 5 2024", "5 January 2024", "January 5, 2024", "01/02/2024",
             "20240115", "2024", "2024-13-01", "x", None]
    d = dt.datetime
    assert column(spark, texts, V.parse_date) == [
        d(2024, 1, 5), d(2024, 1, 5, 10, 30, 1, 500000), d(2024, 1, 5, 8), d(2024, 1, 5), d(2024, 1, 5), d(2024, 1, 5), None, None, None,
        None, None, None,
    ]
    slash = lambda c: V.parse_date(c, ["dd/MM/yyyy", "dd/MM/yyyy HH:mm"])
    assert column(spark, ["13/02/2024", "01/02/2024 23:05"], slash) == [d(2024, 2, 13), d(2024, 2, 1, 23, 5)]


def test_email_and_phone(spark):
    mails = {"a.b+c@x-y.example.org": True, "a@b": False, "a b@c.de": False, "@c.de": False, "a@c.d": False, "_ops@x.com": True, ".a@x.com": True, None: False}
    assert column(spark, list(mails), V.is_email) == list(mails.values())
    phones = {"555-1234": True, "+1 (415) 555-1234": True, "030.1234.5678": True, "20240115": True, "12345": False, "phone": False,
              "555-12": False, "030\u00a05551234": True, "(0)555-1234": False, None: False}
    assert column(spark, list(phones), V.is_phone) == list(phones.values())


def test_clean_table_is_idempotent(spark):
    df = spark.createDataFrame([(" a ", 1, ["x "]), ("NULL", 2, None)], "s string, n int, l array<string>")
    once = X.clean_table(df)
    assert [tuple(r) for r in once.collect()] == [("a", 1, ["x "]), (None, 2, None)]
    assert X.clean_table(once).collect() == once.collect()


TEMPLATE = struct({"id": "long", "amount": "double", "ok": "boolean", "at": "timestamp", "name": "string", "gone": "integer"})


def test_apply_mapping(spark):
    raw = spark.createDataFrame(
        [("7", "$1,000", "1", "2024-01-05", " x "), ("x", "N/A", "yes", "soon", "null")], "key string, amt string, ok string, d string, n string"
    )
    mapping = {"name": "n", "id": ("key", 0.9), "amount": ["amt", 0.8], "ok": ("ok", 1.0), "at": ("d", 1.0), "gone": ("absent", 1.0), "extra": None}
    out = X.apply_mapping(raw, mapping, TEMPLATE)
    assert out.columns == list(mapping)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "double", "double", "double", "timestamp_ntz", "int", "string"]
    assert [tuple(r) for r in out.collect()] == [
        ("x", 7.0, 1000.0, 1.0, dt.datetime(2024, 1, 5), None, None), (None, None, None, None, None, None, None)
    ]


def test_apply_mapping_names(spark):
    """Repeated, dotted and case-only names resolve by position; the first of equal names counts."""
    raw = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int").toDF("x.y", "A", "a", "a")
    out = X.apply_mapping(raw, {"p.q": "x.y", "B": "a", "b": "A"}, raw.schema)
    assert out.columns == ["p.q", "B", "b"] and tuple(out.first()) == (1, 3, 2)


def test_template_without_values_asks_for_no_cast(spark):
    template = spark.createDataFrame([(None, 1.0)], "name double, amount double")
    raw = spark.createDataFrame([("Ann", "5")], "n string, a string")
    untyped = X.all_null_columns(template)
    assert untyped == ["name"]
    assert tuple(X.apply_mapping(raw, {"name": "n", "amount": "a"}, template, untyped).first()) == ("Ann", 5.0)


def test_projection_is_narrow(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) a", "'x' b", "'y' unused").write.parquet(str(tmp_path / "t"))
    raw = spark.read.parquet(str(tmp_path / "t"))
    out = X.apply_mapping(raw, {"id": "a", "name": "b"}, struct({"id": "long", "name": "string"}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "unused" not in plan.split("ReadSchema")[1]


def test_cast_loss(spark):
    raw = spark.createDataFrame([("1", "a"), ("x", "N/A"), (None, "b")], "n string, s string")
    report = X.cast_loss_report(raw, {"amount": "n", "label": "s"}, struct({"amount": "double", "label": "string"}))
    assert [tuple(r) for r in report.collect()] == [("amount", "n", 2, 1, 1, 50.0), ("label", "s", 2, 2, 0, 0.0)]
    X.require_cast_quality(report, 50.0)
    with pytest.raises(ValueError, match="amount <- n"):
        X.require_cast_quality(report, 10.0)


def test_names(spark):
    assert X.dedupe_names(["a", "a", "", "a", "a.1"]) == ["a", "a.1", "Unnamed: 2", "a.2", "a.1.1"]
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF(" a ", "a")
    assert X.tidy_headers(df).columns == ["a", "a.1"]
    with pytest.raises(ValueError):
        X.require_columns(spark.createDataFrame([], T.StructType([])))
