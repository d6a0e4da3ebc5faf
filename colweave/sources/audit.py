"""Audit records: append-only table, and the text line format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of an audit line.
_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - USER: \[(.*?)\] - ACTION: (.*)$"

AUDIT_DDL = "ts timestamp_ntz, user string, action string"


def audit_line(ts: Column, user: Column, action: Column) -> Column:
    stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS")
    return F.concat(stamp, F.lit(" - USER: ["), user, F.lit("] - ACTION: "), action)


def parse_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(ts, user, action)`` of audit lines; other lines are dropped. Works on streams too."""
    text = F.col(column)
    stamp = F.translate(F.regexp_extract(text, _LINE, 1), ",", ".")
    return lines.where(text.rlike(_LINE)).select(
        stamp.cast("timestamp_ntz").alias("ts"),
        F.regexp_extract(text, _LINE, 2).alias("user"),
        F.regexp_extract(text, _LINE, 3).alias("action"),
    )


def read_audit(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_audit(spark.read.text(path))


def append_audit(events: DataFrame, path: str) -> None:
    """Add ``(ts, user, action)`` rows to the audit table."""
    events.select(F.col("ts").cast("timestamp_ntz"), F.col("user").cast("string"), "action").write.mode("append").parquet(path)


def upload_action(raw: str, template: str) -> str:
    return f"matched {raw!r} with template {template!r}"


def transform_action(output: str) -> str:
    return f"wrote {output!r}"
