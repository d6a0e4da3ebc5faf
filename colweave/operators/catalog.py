"""Column catalogs: one row per table column, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import normalize_header
from ..vocab import DEFAULT_VOCABULARY, Vocabulary

CATALOG_SCHEMA = "table_id string, ordinal int, column_name string, dtype string"


def column_catalog(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Catalog of the given tables, from their schemas alone (no job runs)."""
    rows = [
        (table_id, i, f.name.strip(), f.dataType.simpleString())
        for table_id, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def schema_fingerprints(catalog: DataFrame) -> DataFrame:
    """md5 of the sorted column names joined by a pipe; the column order does not matter."""
    names = F.sort_array(F.collect_list("column_name"))
    return catalog.groupBy("table_id").agg(
        F.md5(F.concat_ws("|", names)).alias("fingerprint"), F.count("*").alias("n_columns")
    )


def table_columns(catalog: DataFrame) -> DataFrame:
    """One row per table with its columns in order: ``(table_id, columns)``, an array of ``(ordinal, column_name)``."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "column_name")))
    return catalog.where("table_id is not null").groupBy("table_id").agg(ordered.alias("columns"))


def shape_keys(catalog: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, keep_unicode: bool = False) -> DataFrame:
    """A key per table that is equal for tables with the same ordered normalised headers.

    Built from commutative aggregates, so a very wide table is combined map-side like any other.
    Returns ``(table_id, shape, n_columns)``.
    """
    norm = normalize_header(F.col("column_name"), vocab, keep_unicode)
    # The filter is what a join on the key would add; stated here, every use shares one plan.
    return (
        catalog.where("table_id is not null")
        .select("table_id", "ordinal", norm.alias("norm"))
        .groupBy("table_id")
        .agg(
            F.count("*").cast("int").alias("n_columns"),
            F.bit_xor(F.xxhash64("ordinal", "norm")).alias("h1"),
            F.bit_xor(F.xxhash64("norm", F.lit("shape"), "ordinal")).alias("h2"),
        )
        .select("table_id", F.concat_ws(":", "n_columns", "h1", "h2").alias("shape"), "n_columns")
    )


def schema_drift(registered: DataFrame, current: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Columns added to or removed from each table, with likely renames paired up.

    A rename is an added and a removed column of one table that share the normalised header.
    """

    def side(df: DataFrame) -> DataFrame:
        norm = normalize_header(F.col("column_name"), vocab)
        return df.select("table_id", "column_name", norm.alias("norm"))

    key = ["table_id", "column_name"]
    old, new = side(registered), side(current)
    gone = old.join(new.select(*key), key, "left_anti")
    fresh = new.join(old.select(*key), key, "left_anti")
    # Several columns may share a normalised header; pair them one to one, in name order.
    rank = "row_number() over (partition by table_id, norm order by column_name)"
    gone = gone.select("*", F.expr(rank).alias("k"))
    fresh = fresh.select("*", F.expr(rank).alias("k"))
    joined = gone.withColumnRenamed("column_name", "old_column").join(
        fresh.withColumnRenamed("column_name", "new_column"), ["table_id", "norm", "k"], "full_outer"
    )
    change = (
        F.when(F.col("old_column").isNull(), "added")
        .when(F.col("new_column").isNull(), "removed")
        .otherwise("renamed")
    )
    return joined.select("table_id", "old_column", "new_column", change.alias("change"))
