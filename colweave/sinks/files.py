"""Write tables as CSV, JSON or Excel files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .xlsx import write_xlsx

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def _plain(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return df.select(
        *[
            (F.to_json(f"`{f.name}`") if isinstance(f.dataType, _NESTED) else F.col(f"`{f.name}`")).alias(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", sep: str = ",", encoding: str = "UTF-8") -> None:
    """CSV part files with a header each. Text is kept as it is, quotes are doubled."""
    writer = _plain(df).write.mode(mode).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    writer.csv(
        path, header=True, sep=sep, encoding=encoding, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line, nulls kept, ISO dates, full precision."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_excel(df: DataFrame, path: str, mode: str = "append") -> None:
    write_xlsx(_plain(df), path, mode)


WRITERS = {
    "csv": write_csv, "txt": write_csv, "json": write_json, "excel": write_excel, "xlsx": write_excel, "xls": write_excel,
}


def write_any(df: DataFrame, path: str, fmt: str, **options) -> None:
    """Write by format name; an unknown name is an error. ``xls`` gives xlsx files."""
    key = str(fmt).lower().strip()
    if key not in WRITERS:
        raise ValueError(f"Unsupported output format: '{fmt}'. Supported: {', '.join(WRITERS)}.")
    WRITERS[key](df, path, **options)
