"""What must be known of a text file before it can be read: encoding, first line, layout."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Windows-1252 differs from Latin-1 in the bytes 0x80..0x9F only; five of them are undefined there.
_HIGH = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_UNDEFINED = "[\\u0081\\u008D\\u008F\\u0090\\u009D]"

UTF8, CP1252, LATIN1 = "utf-8", "cp1252", "latin-1"


@dataclass(frozen=True)
class FileFacts:
    path: str
    encoding: str
    first_line: str
    n_lines: int


def latin1(raw: Column) -> Column:
    """Raw bytes as Latin-1 text; every byte has a character."""
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def fix_cp1252(text: Column) -> Column:
    """Latin-1 text that was Windows-1252."""
    return F.translate(text, "".join(a for a, _ in _HIGH), "".join(b for _, b in _HIGH))


def decode_text(raw: Column) -> Column:
    """Raw line or document to text: UTF-8, else Windows-1252, else Latin-1; the byte order mark goes."""
    as_latin = latin1(raw)
    single = F.when(as_latin.rlike(_UNDEFINED), as_latin).otherwise(fix_cp1252(as_latin))
    return F.regexp_replace(F.when(F.is_valid_utf8(raw), raw).otherwise(single), "^﻿", "")


def _decode_first(line: bytes, encoding: str) -> str:
    return line.decode("utf-8-sig" if encoding == UTF8 else encoding)


def probe_files(spark: SparkSession, paths: list[str] | str) -> list[FileFacts]:
    """Facts per file from one distributed scan of its lines; only one row per file comes back.

    The text source hands lines over as raw bytes, so validity is tested on what is in the file.
    Blank lines do not count.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    content = F.trim(F.regexp_replace(latin1(F.col("value")), "^ï»¿", ""))
    filled = content != ""
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(latin1(F.col("value")).rlike(_UNDEFINED)).alias("undefined"),
        F.min_by(F.when(filled, F.col("value").cast("binary")), F.when(filled, F.struct("start", "at"))).alias("first"),
        F.count_if(filled).alias("n_lines"),
    )
    out = []
    for r in facts.orderBy("path").collect():
        encoding = UTF8 if r["utf8"] else LATIN1 if r["undefined"] else CP1252
        first = _decode_first(bytes(r["first"] or b""), encoding)
        out.append(FileFacts(unquote(r["path"]), encoding, first, r["n_lines"]))
    return out


def list_files(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Data files under a path, by Spark's own listing; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return sorted(r["path"] for r in files.collect())
