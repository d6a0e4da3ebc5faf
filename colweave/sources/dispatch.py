"""Pick a reader by file extension."""

from __future__ import annotations

import os
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from ..operators.transform import require_columns, tidy_headers
from .csv import read_csv
from .json import read_json, read_ndjson
from .probe import list_files
from .xlsx import read_xlsx

READERS = {
    "csv": read_csv, "txt": read_csv, "tsv": read_csv,
    "json": read_json, "ndjson": read_ndjson, "jsonl": read_ndjson,
    "xlsx": read_xlsx, "xlsm": read_xlsx,
}


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")


def split_by_extension(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Files under a path by lower-case extension."""
    out: dict[str, list[str]] = defaultdict(list)
    for f in list_files(spark, path):
        out[extension(f)].append(f)
    return dict(out)


def read_any(spark: SparkSession, path: str | list[str], hint: str | None = None) -> DataFrame:
    """Files of one type as a table with stripped, unique column names.

    ``hint`` is a file name that tells the type when the path does not. A folder must hold one type
    of file; read mixed folders with :func:`read_each`.
    """
    ext = extension(hint) if hint else extension(path) if isinstance(path, str) else ""
    if not ext:
        kinds = split_by_extension(spark, path)
        if len(kinds) != 1:
            raise ValueError(f"expected files of one type, found: {sorted(kinds)}")
        ext, path = next(iter(kinds.items()))
    if ext not in READERS:
        raise ValueError(f"Unsupported file format: '{ext}'. Supported: {', '.join(READERS)}.")
    return require_columns(tidy_headers(READERS[ext](spark, path)))


def read_each(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """One table per file type under a folder."""
    return {ext: read_any(spark, files, hint=f"x.{ext}") for ext, files in split_by_extension(spark, path).items()}
