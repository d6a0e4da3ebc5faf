"""Profiles of table columns: patterns, completeness, schema, preview, width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.values import DATE_FORMATS, clean_text, filled, is_date_text, is_email, is_number_text, is_phone, pattern_of
from .transform import positional


def _is_date_type(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _typed_pattern(t: T.DataType) -> str | None:
    """Pattern a non-text type implies; null for text, which must be looked at."""
    if isinstance(t, T.StringType):
        return None
    if isinstance(t, T.NumericType):
        return "numeric"
    return "date" if _is_date_type(t) else "text"


def profile_patterns_full(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Pattern per column from every value, in one scan.

    Returns ``(ordinal, column_name, n_values, n_email, n_phone, n_numeric, n_date, pattern)``; missing-value
    words do not count as values. Cells are tested as rows of one long table, so the generated code
    does not grow with the columns; only a row of counts per column and task is shuffled.
    """
    inner, names, types = positional(df)
    cells = []
    for i, (c, t) in enumerate(zip(inner.columns, types)):
        is_text = isinstance(t, T.StringType)
        text = F.col(c) if is_text else F.lit(None).cast("string")
        cells.append(F.struct(F.lit(i).alias("ordinal"), text.alias("v"), F.lit(False) if is_text else filled(F.col(c), t).isNotNull()))
    long = inner.select(F.inline(F.array(*cells)).alias("ordinal", "v", "typed"))
    v = F.col("v")
    counts = long.select("ordinal", clean_text(v).alias("v"), "typed").groupBy("ordinal").agg(
        F.count_if(v.isNotNull() | F.col("typed")).alias("n"),
        F.count_if(is_email(v)).alias("email"),
        F.count_if(is_phone(v)).alias("phone"),
        F.count_if(is_number_text(v)).alias("numeric"),
        F.count_if(is_date_text(v, formats, trimmed=True)).alias("date"),
    )
    columns = df.sparkSession.createDataFrame(
        [(i, name, _typed_pattern(t)) for i, (name, t) in enumerate(zip(names, types))], "ordinal int, column_name string, kind string"
    )
    n, kind, zero = F.coalesce("n", F.lit(0).cast("long")), F.col("kind"), F.lit(0).cast("long")
    tags = ("email", "phone", "numeric", "date")
    hits = {tag: F.when(kind == tag, n).when(kind.isNotNull(), zero).otherwise(F.coalesce(tag, zero)) for tag in tags}
    pattern = F.when(n == 0, "empty").when(kind.isNotNull(), kind).otherwise(pattern_of(n, *hits.values()))
    return columns.join(counts, "ordinal", "left").select(
        "ordinal", "column_name", n.alias("n_values"), *[h.alias(f"n_{tag}") for tag, h in hits.items()], pattern.alias("pattern")
    )


def _long_values(df: DataFrame, order_by: Sequence[str], clean: bool) -> DataFrame:
    """Unpivot to ``(ordinal, order key, value text)`` without missing values."""
    inner, names, types = positional(df)
    where = {n: c for c, n in reversed(list(zip(inner.columns, names)))}
    key = F.struct(*[F.col(where[k]) for k in order_by]).alias("key")
    cells = []
    for i, (c, t) in enumerate(zip(inner.columns, types)):
        if isinstance(t, T.StringType):
            v = clean_text(F.col(c)) if clean else F.col(c)
        elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            v = F.to_json(c)
        else:
            v = filled(F.col(c), t).cast("string")
        cells.append(F.struct(F.lit(i).alias("ordinal"), v.alias("v")))
    return inner.select(key, F.inline(F.array(*cells))).where("v is not null")


def first_values(df: DataFrame, order_by: Sequence[str], n: int, clean: bool = True) -> DataFrame:
    """The first ``n`` values of each column in the caller's order.

    The rank limit is applied before the shuffle, so ``n`` rows per column and task travel.
    """
    order = W.partitionBy("ordinal").orderBy("key")
    ranked = _long_values(df, order_by, clean).withColumn("rn", F.row_number().over(order))
    return ranked.where(F.col("rn") <= n)


def profile_patterns(
    df: DataFrame, order_by: Sequence[str], n: int = 10, formats: Sequence[str] = DATE_FORMATS
) -> DataFrame:
    """Pattern per column from its first ``n`` values: ``(ordinal, column_name, pattern)``.

    ``order_by`` must name a unique key, as rows have no order of their own.
    """
    names = [f.name.strip() for f in df.schema.fields]
    kinds = [_typed_pattern(f.dataType) for f in df.schema.fields]
    v = F.col("v")
    seen = first_values(df, order_by, n).groupBy("ordinal").agg(
        F.count("*").alias("n"),
        F.count_if(is_email(v)).alias("e"),
        F.count_if(is_phone(v)).alias("p"),
        F.count_if(is_number_text(v)).alias("m"),
        F.count_if(is_date_text(v, formats, trimmed=True)).alias("d"),
    )
    columns = df.sparkSession.createDataFrame(
        list(zip(range(len(names)), names, kinds)), "ordinal int, column_name string, kind string"
    )
    joined = columns.join(seen, "ordinal", "left")
    found = (
        F.when(F.col("n").isNull(), "empty")
        .when(F.col("kind").isNotNull(), F.col("kind"))
        .otherwise(pattern_of(F.col("n"), F.col("e"), F.col("p"), F.col("m"), F.col("d")))
    )
    return joined.select("ordinal", "column_name", found.alias("pattern"))


def _sum_tree(terms: list[Column]) -> Column:
    """Sum of many columns as a balanced tree; a chain of thousands is too deep for the optimizer."""
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0).cast("long")


def completeness(df: DataFrame) -> DataFrame:
    """Rows, columns, null cells and the share of filled cells, in one scan."""
    inner, names, types = positional(df)
    in_row = _sum_tree([filled(F.col(c), t).isNull().cast("long") for c, t in zip(inner.columns, types)])
    null_cells = F.coalesce(F.sum(in_row), F.lit(0)).cast("long")
    one = inner.agg(F.count("*").alias("total_rows"), null_cells.alias("null_cells"))
    cells = F.col("total_rows") * len(names)
    return one.select(
        "total_rows", F.lit(len(names)).cast("long").alias("total_columns"), "null_cells",
        F.when(cells > 0, F.round((1 - F.col("null_cells") / cells) * 100, 1)).otherwise(100.0).alias("completeness"),
    )


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)).cast("long"))


def schema_profile(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """Type, null count and the first ``n`` values per column."""
    inner, names, types = positional(df)
    nulls = inner.agg(*[F.count_if(filled(F.col(c), t).isNull()).alias(c) for c, t in zip(inner.columns, types)])
    base = nulls.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"), F.lit(name).alias("column_name"),
                        F.lit(t.simpleString()).alias("dtype"), F.col(c).alias("null_count"),
                    )
                    for i, (c, name, t) in enumerate(zip(inner.columns, names, types))
                ]
            )
        )
    )
    samples = first_values(df, order_by, n, clean=False).groupBy("ordinal").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda s: s["v"]).alias("sample_values")
    )
    empty = F.array().cast("array<string>")
    return base.join(samples, "ordinal", "left").withColumn("sample_values", F.coalesce("sample_values", empty))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5, blank_nulls: bool = True) -> DataFrame:
    """The first ``n`` rows in the caller's order as text, nulls blank."""
    top = df.orderBy(*order_by).limit(n)
    if not blank_nulls:
        return top
    return top.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in top.columns])


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """A repeatable random sample of ``n`` rows: the smallest MD5 hashes of seed and key."""
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts).cast("binary")), *key).limit(n)


def column_width(df: DataFrame, padding: int = 4, cap: int = 60) -> DataFrame:
    """Display width per column: longest text or header, plus padding, capped."""
    inner, names, types = positional(df)

    def text(c: str, t: T.DataType) -> Column:
        if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c)
        return F.col(c).cast("string")

    one = inner.agg(*[F.max(F.length(text(c, t))).alias(c) for c, t in zip(inner.columns, types)])
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(name))) + padding, F.lit(cap)).alias("width"),
        )
        for c, name in zip(inner.columns, names)
    ]
    return one.select(F.inline(F.array(*rows)))
