"""Clean tables and project raw rows into a template's shape, as one narrow select."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import DATE_FORMATS, clean_text, filled, parse_date, to_number
from ..vocab import NULL_TOKENS
from .mapping import normalise_mapping


def positional(df: DataFrame) -> tuple[DataFrame, list[str], list[T.DataType]]:
    """The frame under unique inner names, with its stripped outer names and types.

    Outer names may repeat, differ by case only or hold dots; inner names never do.
    """
    names = [f.name.strip() for f in df.schema.fields]
    types = [f.dataType for f in df.schema.fields]
    return df.toDF(*[f"_c{i}" for i in range(len(names))]), names, types


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Unique names: repeats get ``.1``, ``.2``, ...; blanks become ``Unnamed: i``."""
    out: list[str] = []
    used: set[str] = set()
    for i, name in enumerate(names):
        base = name if name else f"Unnamed: {i}"
        candidate, k = base, 0
        while candidate in used:
            k += 1
            candidate = f"{base}.{k}"
        used.add(candidate)
        out.append(candidate)
    return out


def tidy_headers(df: DataFrame) -> DataFrame:
    """Strip every column name and make the names unique."""
    return df.toDF(*dedupe_names([c.strip() for c in df.columns]))


def clean_table(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Trim text columns and null their missing-value words; other types pass through."""
    inner, names, types = positional(df)
    return inner.select(
        *[
            (clean_text(F.col(c), tokens) if isinstance(t, T.StringType) else F.col(c)).alias(n)
            for c, n, t in zip(inner.columns, names, types)
        ]
    )


def _is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def cast_to(
    c: Column, source: T.DataType, target: T.DataType | None, formats: Sequence[str] = DATE_FORMATS,
    decimal_comma: bool = False, accounting: bool = False,
) -> Column:
    """Cast a raw value for a template type. Values that do not parse become null, never an error.

    Text to any numeric or boolean template type gives double; numbers keep their own type.
    Without a target, or for a text target, the value passes through and text is cleaned.
    """
    wants_number = isinstance(target, (T.NumericType, T.BooleanType))
    if isinstance(source, T.StringType):
        if wants_number:
            return to_number(c, decimal_comma, accounting)
        if _is_temporal(target):
            return parse_date(c, formats)
        return clean_text(c)
    if wants_number and isinstance(source, T.BooleanType):
        return c
    if wants_number and not isinstance(source, T.NumericType):
        return F.lit(None).cast("double")
    if _is_temporal(target) and isinstance(source, (T.DateType, T.TimestampType)):
        return c.cast("timestamp_ntz")
    return c


def template_types(template: DataFrame | T.StructType, untyped: Sequence[str] = ()) -> dict[str, T.DataType | None]:
    """Type per template column; the first of equal names counts. ``untyped`` ask for no cast."""
    schema = template if isinstance(template, T.StructType) else template.schema
    out: dict[str, T.DataType | None] = {}
    for f in schema.fields:
        out.setdefault(f.name.strip(), None if f.name.strip() in untyped or isinstance(f.dataType, T.NullType) else f.dataType)
    return out


def all_null_columns(template_sample: DataFrame) -> list[str]:
    """Template columns without any value; their inferred type says nothing, so they ask for no cast."""
    inner, names, types = positional(template_sample)
    row = inner.agg(*[F.count(filled(F.col(c), t)).alias(c) for c, t in zip(inner.columns, types)]).first()
    return [n for n, count in zip(names, row) if count == 0]


def mapping_columns(
    raw_names: Sequence[str], raw_types: Sequence[T.DataType], mapping: Mapping[str, object],
    template: DataFrame | T.StructType, untyped: Sequence[str] = (), **options,
) -> list[Column]:
    """One output expression per mapping entry, over the inner names of :func:`positional`."""
    wanted = template_types(template, untyped)
    position: dict[str, int] = {}
    for i, name in enumerate(raw_names):
        position.setdefault(name, i)
    out = []
    for template_col, raw_col, _ in normalise_mapping(mapping):
        target = wanted.get(template_col)
        if raw_col in position:
            i = position[raw_col]
            value = cast_to(F.col(f"_c{i}"), raw_types[i], target, **options)
        else:
            value = F.lit(None).cast(target or T.StringType())
        out.append(value.alias(template_col))
    return out


def apply_mapping(
    raw: DataFrame, mapping: Mapping[str, object], template: DataFrame | T.StructType, untyped: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Raw rows in the template's shape: columns in mapping order, cast and cleaned, row count kept.

    Unmapped template columns, and those naming an absent raw column, are all null. The result is
    a single select: no shuffle, no Python, and the scan reads mapped columns only.
    """
    inner, names, types = positional(raw)
    return inner.select(*mapping_columns(names, types, mapping, template, untyped, **options))


def cast_loss_report(
    raw: DataFrame, mapping: Mapping[str, object], template: DataFrame | T.StructType, untyped: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Per template column: values present before and after the cast, and the share lost.

    Missing-value words count as absent. One pass over the raw table.
    """
    inner, names, types = positional(raw)
    entries = [(t, r) for t, r, _ in normalise_mapping(mapping) if r in names]
    exprs = mapping_columns(names, types, {t: r for t, r in entries}, template, untyped, **options)
    aggs = []
    for k, ((_, raw_col), value) in enumerate(zip(entries, exprs)):
        i = names.index(raw_col)
        before = clean_text(F.col(f"_c{i}")) if isinstance(types[i], T.StringType) else filled(F.col(f"_c{i}"), types[i])
        aggs += [F.count(before).alias(f"b{k}"), F.count(filled(value, types[i])).alias(f"a{k}")]
    one = inner.agg(*aggs)
    rows = [
        F.struct(
            F.lit(t).alias("template_col"), F.lit(r).alias("raw_col"),
            F.col(f"b{k}").alias("n_before"), F.col(f"a{k}").alias("n_after"),
        )
        for k, (t, r) in enumerate(entries)
    ]
    loss = F.col("n_before") - F.col("n_after")
    return one.select(F.inline(F.array(*rows))).select(
        "*", loss.alias("n_lost"),
        F.when(F.col("n_before") > 0, F.round(100.0 * loss / F.col("n_before"), 4)).otherwise(0.0).alias("pct_lost"),
    )


def require_cast_quality(report: DataFrame, max_pct_lost: float) -> None:
    """Fail when a column loses more than the limit. The report has one row per template column."""
    bad = report.where(F.col("pct_lost") > max_pct_lost).collect()
    if bad:
        detail = ", ".join(f"{r['template_col']} <- {r['raw_col']}: {r['pct_lost']}%" for r in bad)
        raise ValueError(f"casts lose more than {max_pct_lost}% of the values: {detail}")


def require_columns(df: DataFrame) -> DataFrame:
    """Reject an input without any column; a schema check, no job."""
    if not df.schema.fields:
        raise ValueError("the table has no columns and no rows")
    return df
