"""Excel sink: ``df.write.format("colweave_xlsx").save(folder)``, workbooks written by the tasks."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from colweave.scratch import file_system, qualified

MAX_ROWS = 1_048_575  # data rows a sheet can hold below its header
_EPOCH = dt.datetime(1899, 12, 30)
_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_SPREADSHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"

_PARTS = {
    "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/>'
    f'<Override PartName="/xl/workbook.xml" ContentType="{_SPREADSHEET}.sheet.main+xml"/>'
    f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SPREADSHEET}.worksheet+xml"/>'
    f'<Override PartName="/xl/styles.xml" ContentType="{_SPREADSHEET}.styles+xml"/></Types>',
    "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
    f'<Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">'
    f'<Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
    f'<Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f"{_HEAD}<styleSheet {_NS}>"
    '<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd\\ hh:mm:ss"/></numFmts>'
    "<fonts count=\"1\"><font/></fonts><fills count=\"2\"><fill/><fill><patternFill patternType=\"gray125\"/></fill></fills>"
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="2"><xf/><xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>',
}

_UNSAFE = re.compile(r"[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


_PLAIN = re.compile(r"[^\x00-\x08\x0b-\x1f\ufffe\uffff_&<>]*+")


def _text_cell(text: str) -> str:
    """Characters XML cannot hold, or would change, take the format's form ``_xHHHH_``, as does text that looks like it."""
    if _PLAIN.fullmatch(text):
        return f'<c t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'
    held = _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(held)}</t></is></c>'


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    kind = type(value)
    if kind is str:
        return _text_cell(value)
    if kind is float and math.isfinite(value):
        return f"<c><v>{value!r}</v></c>"
    if kind is int and -(2**53) < value < 2**53:
        return f"<c><v>{value}</v></c>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, decimal.Decimal)):
        exact = abs(value) < 2**53 if isinstance(value, int) else decimal.Decimal(repr(float(value))) == value
        if not exact:
            raise ValueError(f"{value} has more digits than a cell holds; cast its column to string")
        return f"<c><v>{value}</v></c>"
    if isinstance(value, float) and math.isnan(value):
        return "<c/>"
    if isinstance(value, float) and math.isfinite(value):
        return f"<c><v>{value!r}</v></c>"
    if isinstance(value, dt.datetime) and value.microsecond % 1000:  # finer than a serial number holds
        return f'<c t="d"><v>{value.replace(tzinfo=None).isoformat()}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c s="1"><v>{(value.replace(tzinfo=None) - _EPOCH).total_seconds() / 86400!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c s="1"><v>{(value - _EPOCH.date()).days}</v></c>'
    return _text_cell(str(value))


def _cells(column: pa.Array) -> list[str]:
    """The cells of a column; values that return are written once."""
    kind = column.type
    if pa.types.is_floating(kind):
        return [f"<c><v>{v!r}</v></c>" if v is not None and math.isfinite(v) else _cell(v) for v in column.to_pylist()]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_integer(kind) or pa.types.is_temporal(kind):
        coded = column.dictionary_encode()
        distinct, places = coded.dictionary, coded.indices.to_pylist()
    else:
        distinct, places = column, None
    values = distinct.to_pylist()
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        values = [None if v is None else v.astimezone().replace(tzinfo=None) for v in values]
    cells = list(map(_cell, values))
    return cells if places is None else [_cell(None) if i is None else cells[i] for i in places]


class _Workbook:
    """One workbook written batch by batch, so memory does not grow with its rows."""

    def __init__(self, stream, names: list[str], sheet: str):
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=3)
        for name, text in _PARTS.items():
            self.zip.writestr(name, text)
        self.zip.writestr(
            "xl/workbook.xml",
            f'{_HEAD}<workbook {_NS} xmlns:r="{_OFFICE}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        self.sheet = self.zip.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f"{_HEAD}<worksheet {_NS}><sheetData>".encode())
        self.sheet.write(("<row>" + "".join(_text_cell(n) for n in names) + "</row>").encode())
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        rows = zip(*map(_cells, batch.columns), strict=True)
        self.sheet.write("".join([f"<row>{''.join(row)}</row>" for row in rows]).encode())
        self.rows += batch.num_rows

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.zip.close()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class XlsxWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the commit of the job gives them their names."""

    def __init__(self, path: str, names: list[str], sheet: str, max_rows: int, overwrite: bool):
        self.path, self.names, self.sheet, self.max_rows, self.overwrite = path, names, sheet, max_rows, overwrite

    def _fs(self):
        return file_system(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        system, root = self._fs()
        system.create_dir(root, recursive=True)
        task, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        files: list[tuple[str, str]] = []
        book = stream = None
        for batch in iterator:
            while batch.num_rows:
                if book is None:
                    hidden = f"{root}/_temporary-{tag}-{len(files):05d}"
                    files.append((hidden, f"{root}/part-{task:05d}-{len(files):05d}-{tag}.xlsx"))
                    stream = system.open_output_stream(hidden)
                    book = _Workbook(stream, self.names, self.sheet)
                part = batch.slice(0, self.max_rows - book.rows)
                batch = batch.slice(part.num_rows)
                book.add(part)
                if book.rows == self.max_rows:
                    book.close()
                    stream.close()
                    book = None
        if book is not None:
            book.close()
            stream.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = self._fs()
        if self.overwrite:
            old = [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.endswith(".xlsx")]
            for path in old:
                system.delete_file(path)
        for m in messages:
            for hidden, final in m.files if m else []:
                system.move(hidden, final)

    def abort(self, messages: list) -> None:
        system, _ = self._fs()
        for m in messages:
            for hidden, _ in m.files if m else []:
                system.delete_file(hidden)


class XlsxDataSource(DataSource):
    """Writes one workbook per partition, more when a sheet is full."""

    @classmethod
    def name(cls) -> str:
        return "colweave_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(
            self.options["path"], schema.names, self.options.get("sheet", "Data"),
            min(int(self.options.get("max_rows", MAX_ROWS)), MAX_ROWS), overwrite,
        )


def write_xlsx(df: DataFrame, path: str, mode: str = "append", sheet: str = "Data", max_rows: int = MAX_ROWS) -> None:
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(XlsxDataSource)
    df.write.format("colweave_xlsx").mode(mode).option("sheet", sheet).option("max_rows", max_rows).save(qualified(spark, path))
