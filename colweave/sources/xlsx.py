"""Excel workbooks (xlsx, xlsm): first sheet, first row as header; one task per workbook."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, zip_longest
from xml.etree import ElementTree as ET
from xml.sax.saxutils import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.transform import dedupe_names

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILTIN_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_EPOCH = dt.datetime(1899, 12, 30)
_ESCAPED = re.compile(r"_x((?![dD][89a-fA-F])[0-9A-Fa-f]{4})_")
_TYPES = {
    "boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "string": T.StringType()
}


def _plain(text: str) -> str:
    """Text with the format's ``_xHHHH_`` forms of characters undone."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell style numbers that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ET.fromstring(book.read("xl/styles.xml"))
    dates = set(_BUILTIN_DATES)
    for f in root.iter(f"{_MAIN}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.I):
            dates.add(int(f.get("numFmtId")))
    xfs = root.find(f"{_MAIN}cellXfs")
    return {i for i, xf in enumerate(xfs if xfs is not None else []) if int(xf.get("numFmtId", 0)) in dates}


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheet = ET.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    wanted = sheet.get(f"{_REL}id")
    for rel in ET.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            target = rel.get("Target").lstrip("/")
            return target if target.startswith("xl/") else f"xl/{target}"
    raise ValueError("workbook without a first sheet")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, el in ET.iterparse(f):
            if el.tag == f"{_MAIN}si":
                out.append(_plain("".join(t.text or "" for t in el.iter(f"{_MAIN}t"))))
                el.clear()
    return out


# Cells without references, formulas or rich text, and blocks of rows of such cells only.
_CELL = rb'<c(?: (t="[A-Za-z]+"|s="[0-9]+"))?(?:/>|>(?:<v>([^<]*+)</v>|<is><t(?: xml:space="preserve")?>([^<]*+)</t></is>)?</c>)'
_CELLS = re.compile(_CELL)
_ROWS = re.compile(rb"(?:<row(?: [^<>]*+)?>(?:%s)*+</row>)*+" % _CELL.replace(b"(t=", b"(?:t=").replace(b"([^<]", b"(?:[^<]"))
_CHUNK = 4 << 20


def sheet_rows(content: bytes) -> Iterator[list]:
    """Rows of the first sheet as Python values; absent cells are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates, sheet, done = _shared_strings(book), _date_styles(book), _first_sheet(book), 0
        with book.open(sheet) as f:
            for rows in _simple_rows(f, strings, dates):
                if rows is None:
                    break
                yield from rows
                done += len(rows)
            else:
                return
        with book.open(sheet) as f:
            yield from islice(_parsed_rows(f, strings, dates), done, None)


def _parsed_rows(f, strings: list[str], dates: set[int]) -> Iterator[list]:
    for _, el in ET.iterparse(f):
        if el.tag == f"{_MAIN}row":
            row: list = []
            for i, cell in enumerate(el.iter(f"{_MAIN}c")):
                at = _column_index(cell.get("r")) if cell.get("r") else i
                row += [None] * (at + 1 - len(row))
                row[at] = _cell_value(cell, strings, dates)
            yield row
            el.clear()


def _simple_rows(f, strings: list[str], dates: set[int]) -> Iterator[list[list] | None]:
    """Rows of a sheet whose cells are simple, by the block; None where that ends and the parser must take over."""
    rest = f.read(_CHUNK)
    at = rest.find(b"<sheetData>")
    head = rest[: max(at, 0)]
    if f'xmlns="{_MAIN[1:-1]}"'.encode() not in head or b"encoding=" in head and b'encoding="UTF-8"' not in head or b"<!" in head:
        yield None
        return
    rest = rest[at + len(b"<sheetData>") :]
    while True:
        end = rest.rfind(b"</row>") + len(b"</row>")
        block = rest[:end] if end >= len(b"</row>") else b""
        if b"\r" in block or b"&#" in block or not _ROWS.fullmatch(block):
            yield None
            return
        rest = rest[len(block) :]
        yield _block_rows(block, strings, dates)
        more = f.read(_CHUNK)
        if not more:
            break
        rest += more
    if not rest.startswith(b"</sheetData>"):
        yield None


def _block_rows(block: bytes, strings: list[str], dates: set[int]) -> list[list]:
    """Rows of a block of simple cells, by column where all rows have as many."""
    rows = block.split(b"</row>")[:-1]
    widths = {row.count(b"<c") for row in rows}
    if len(widths) != 1 or widths == {0}:
        return [[_simple_value(*c, strings, dates) for c in _CELLS.findall(row)] for row in rows]
    cells, width = _CELLS.findall(block), widths.pop()
    return list(map(list, zip(*[_simple_values(cells[i::width], strings, dates) for i in range(width)], strict=True)))


def _simple_values(cells: list[tuple[bytes, bytes, bytes]], strings: list[str], dates: set[int]) -> list:
    """The values of :func:`_simple_value`; at once where the cells are all of a kind."""
    kinds, numbers, texts = zip(*cells, strict=True)
    of = set(kinds)
    if of == {b't="inlineStr"'}:
        whole = b"\0".join(texts)
        if b"&" not in whole and b"_x" not in whole:
            return whole.decode().split("\0")
    elif len(of) == 1 and b"" not in numbers:
        kind = kinds[0]
        if not kind and all([b"." in v for v in numbers]):
            return list(map(float, numbers))
        if not kind and b"".join(numbers).isdigit() and max(map(len, numbers)) < 16:
            return list(map(int, numbers))
        if kind.startswith(b"s=") and int(kind[3:-1]) in dates:
            return list(map(_date, numbers))
    return [_simple_value(*c, strings, dates) for c in cells]


def _simple_value(kind: bytes, v: bytes, text: bytes, strings: list[str], dates: set[int]):
    """The value that :func:`_cell_value` gives for the same cell."""
    if kind == b't="inlineStr"':
        return _plain(_unescaped(text))
    if not v:
        return None
    if not kind:
        return _number(v)
    if kind.startswith(b"s="):
        return _date(v) if int(kind[3:-1]) in dates else _number(v)
    if kind == b't="s"':
        return strings[int(v)]
    if kind == b't="b"':
        return v == b"1"
    if kind == b't="d"':
        return dt.datetime.fromisoformat(v.decode()).replace(tzinfo=None)
    if kind in (b't="str"', b't="e"'):
        return None if kind == b't="e"' else _plain(_unescaped(v))
    return _number(v)


def _unescaped(text: bytes) -> str:
    return unescape(text.decode(), {"&quot;": '"', "&apos;": "'"}) if b"&" in text else text.decode()


def _number(v: bytes | str):
    text = v.decode() if isinstance(v, bytes) else v
    if text.isdecimal() and len(text) < 16:
        return int(text)
    number = float(text)
    return int(number) if "." not in text and "E" not in text.upper() and number.is_integer() and abs(number) < 2**53 else number


@lru_cache(maxsize=10_000)
def _date(v: bytes | str) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=round(float(v) * 86_400_000))


def _cell_value(cell, strings: list[str], dates: set[int]):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _plain("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
    v = cell.find(f"{_MAIN}v")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind == "d":
        return dt.datetime.fromisoformat(v.text).replace(tzinfo=None)
    if kind in ("str", "e"):
        return None if kind == "e" else _plain(v.text)
    return _date(v.text) if int(cell.get("s", 0)) in dates else _number(v.text)


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    return "timestamp_ntz" if isinstance(value, dt.datetime) else "string"


def _names(header: list) -> list[str]:
    return dedupe_names(["" if h is None else str(h).strip() for h in header])


def _within(rows: Iterator[list], width: int) -> Iterator[list]:
    """The rows, an error at one with values beyond the header."""
    for nth, row in enumerate(rows, 2):
        if len(row) > width and any(value is not None and value != "" for value in row[width:]):
            raise ValueError(f"row {nth} of a sheet has values beyond the {width} columns of its header")
        yield row


def _scan_kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Column names and the kinds of value seen, one row per workbook column and kind."""
    for batch in batches:
        found = []
        for content in batch["content"]:
            rows = sheet_rows(content)
            names = _names(next(rows, []))
            kinds: list[set] = [set() for _ in names]
            within = _within(rows, len(names))
            while block := list(islice(within, 10_000)):
                for seen, column in zip(kinds, zip_longest(*block)):
                    one_each = {type(value): value for value in column if value is not None and value != ""}
                    seen.update(map(_kind, one_each.values()))
            found += [(i, n, k) for i, n in enumerate(names) for k in (kinds[i] or {"none"})]
        yield pd.DataFrame(found, columns=["ordinal", "name", "kind"])


def _merge(kinds: set[str]) -> str:
    kinds = kinds - {"none"}
    if len(kinds) == 1:
        return next(iter(kinds))
    return "double" if kinds == {"bigint", "double"} else "string"


def read_xlsx(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Workbooks as one typed table, columns united by name.

    A scan of the cells finds the types unless a schema is given. Each workbook is one task.
    """
    books = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        found = books.mapInPandas(_scan_kinds, "ordinal int, name string, kind string")
        merged = found.groupBy("name").agg(F.min("ordinal").alias("ordinal"), F.collect_set("kind").alias("kinds"))
        columns = merged.orderBy("ordinal", "name").collect()
        if not columns:
            raise ValueError("no columns: every workbook is empty")
        schema = T.StructType([T.StructField(r["name"], _TYPES[_merge(set(r["kinds"]))]) for r in columns])
    wanted = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = sheet_rows(content)
                at = {n: i for i, n in enumerate(_names(next(rows, [])))}
                within = _within(rows, len(at))
                while block := list(islice(within, 10_000)):
                    columns = list(zip_longest(*block))
                    none = (None,) * len(block)
                    yield _frame([_converted(columns[at[n]] if at.get(n, len(columns)) < len(columns) else none, t) for n, t in wanted], wanted)

    return books.mapInPandas(parse, schema)


def _convert(value, kind: str):
    if value is None or (value == "" and kind != "string"):
        return None
    if kind == "string":
        return value if isinstance(value, str) else str(value)
    return float(value) if kind == "double" else value


def _converted(column: tuple, kind: str) -> list:
    return list(column) if set(map(type, column)) <= _AS_IS.get(kind, set()) else [_convert(value, kind) for value in column]


_NONE = type(None)
_AS_IS = {"bigint": {int, _NONE}, "double": {float, _NONE}, "boolean": {bool, _NONE}, "timestamp_ntz": {dt.datetime, _NONE}, "string": {str, _NONE}}
_PANDAS = {"bigint": "Int64", "double": "Float64", "boolean": "boolean", "timestamp_ntz": "datetime64[us]", "string": "object"}


def _frame(columns: list[list], wanted: list[tuple[str, str]]) -> pd.DataFrame:
    data = {n: pd.Series(c, dtype=_PANDAS.get(t, "object")) for (n, t), c in zip(wanted, columns)}
    return pd.DataFrame(data, columns=[n for n, _ in wanted])
