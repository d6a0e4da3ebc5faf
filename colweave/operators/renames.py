"""Renamed columns between two states of many tables, by one-to-one matching of what went and what came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import fresh_dir
from ..vocab import DEFAULT_VOCABULARY, Vocabulary
from .assignment import THRESHOLD, match_catalog
from .catalog import schema_drift


def _stored(df: DataFrame, label: str) -> DataFrame:
    """Written and read back, as several uses follow."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matched_drift(
    registered: DataFrame, current: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, threshold: float = THRESHOLD
) -> DataFrame:
    """:func:`schema_drift` with renames beyond an equal normalised header.

    Columns that went and columns that came are scored against each other within each table and assigned one to one, as a source is
    mapped onto a template; tables with alike changes are solved once. Returns ``(table_id, old_column, new_column, change,
    confidence)``: 1 for a rename by equal header, the score for one by matching, null for columns added or removed.
    """
    drift = _stored(schema_drift(registered, current, vocab), "drift")
    rank = F.expr("row_number() over (partition by table_id order by column_name)").cast("int").alias("ordinal")

    def side(change: str, column: str) -> DataFrame:
        names = drift.where(F.col("change") == change).select("table_id", F.col(column).alias("column_name"))
        return names.select("table_id", "column_name", rank)

    gone, fresh = side("removed", "old_column"), side("added", "new_column")
    both = gone.select("table_id").intersect(fresh.select("table_id"))
    requests = both.select(F.col("table_id").alias("source_id"), F.col("table_id").alias("template_id"))
    found = match_catalog(fresh, gone, requests, vocab, threshold=threshold).where("raw_col is not null")
    found = found.select(F.col("template_id").alias("table_id"), F.col("raw_col").alias("old_column"), F.col("template_col").alias("new_column"), "confidence")
    found = _stored(found, "renames")
    rest = drift.join(found.select("table_id", "old_column"), ["table_id", "old_column"], "left_anti")
    rest = rest.join(found.select("table_id", "new_column"), ["table_id", "new_column"], "left_anti")
    confidence = F.when(F.col("change") == "renamed", 1.0)
    return rest.select("table_id", "old_column", "new_column", "change", confidence.alias("confidence")).unionByName(
        found.withColumn("change", F.lit("renamed"))
    )
