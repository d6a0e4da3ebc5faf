"""Readers and writers."""

from __future__ import annotations

import datetime as dt
import io
import json
import random
import time
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colweave.sinks.files import write_any, write_csv, write_excel
from colweave.sinks.xlsx import write_xlsx
from colweave.sources import audit
from colweave.sources import json as J
from colweave.sources.csv import read_csv, sniff_delimiter
from colweave.sources.dispatch import read_any, read_each
from colweave.sources.json import documents_to_table, read_json, read_ndjson
from colweave.sources.json_blocks import array_records
from colweave.sources.xlsx import read_xlsx


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_types_and_names(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'id, Name ,,x.y,ok,code,id\n1,"a, ""b""",z,NA,True,007,5\n2, c ,z,1.5,False,008\n')
    df = read_csv(spark, p)
    assert df.columns == ["id", "Name", "Unnamed: 2", "x.y", "ok", "code", "id.1"]
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "string", "double", "boolean", "bigint", "bigint"]
    assert rows(df) == [(1, 'a, "b"', "z", None, True, 7, 5), (2, " c ", "z", 1.5, False, 8, None)]
    assert [f.dataType.simpleString() for f in read_csv(spark, p, infer_schema=False).schema] == ["string"] * 7


def test_csv_row_with_too_many_fields_fails(spark, tmp_path):
    p = put(tmp_path / "a.csv", "a,b\n1,2,3\n")
    with pytest.raises(Exception, match="more fields than the header"):
        read_csv(spark, p).collect()


def test_csv_null_words(spark, tmp_path):
    p = put(tmp_path / "a.csv", "a,b\nNA,none\nNaN,-\nnull,None\n#N/A,x\n")
    assert rows(read_csv(spark, p)) == [(None, "none"), (None, "-"), (None, None), (None, "x")]


@pytest.mark.parametrize("header, sep", [
    ("a,b;c", ","), ("a;b;c", ";"), ("a\tb", "\t"), ("a|b|c", "|"), ("single", ","), ('"a;b"', ","), ('"x,y";b', ";")])
def test_sniff(header, sep):
    assert sniff_delimiter(header) == sep


def test_csv_delimiters_and_encodings(spark, tmp_path):
    """Files of different layout in one folder; columns meet by name."""
    put(tmp_path / "1.csv", "﻿id;name\n1;Zoë\n".encode("utf-8"))
    put(tmp_path / "2.csv", "id\tname\n2\t5 €\n".encode("cp1252"))
    put(tmp_path / "3.csv", b"name|id\nna\xefve \x81|3\n")
    put(tmp_path / "4.csv", "id,extra\n4,x\n")
    put(tmp_path / "5.csv", "")
    got = read_csv(spark, str(tmp_path))
    assert sorted(rows(got.select("id", "name", "extra"))) == [
        (1, "Zoë", None), (2, "5 €", None), (3, "naïve \x81", None), (4, None, "x")
    ]


def test_csv_header_encoding(spark, tmp_path):
    p = put(tmp_path / "a.csv", "größe,x\n1,2\n".encode("cp1252"))
    assert read_csv(spark, p).columns == ["größe", "x"]


def test_csv_given_layout_needs_no_scan(spark, tmp_path):
    p = put(tmp_path / "a.csv", "a;b\n1;2\n")
    df = read_csv(spark, p, sep=";", encoding="utf-8", columns=["a", "b"], infer_schema=False)
    assert rows(df) == [("1", "2")]


JSON_CASES = {
    "array": ([{"id": 1, "user": {"mail": "x", "geo": {"lat": 1.5}}, "tags": ["a"]}, {"id": 2, "more": True}],
              {"id": 1, "user.mail": "x", "user.geo.lat": 1.5, "tags": ["a"], "more": None}),
    "wrapped": ({"meta": 1, "items": [{"id": 1, "t": 2.5}], "rows": [{"z": 1}], "data": []}, {"id": 1, "t": 2.5}),
    "any wrapper": ({"n": 1, "stuff": [{"id": 1}], "flags": [1]}, {"id": 1}),
    "record": ({"id": 1, "a": {"b": "c"}, "l": [1]}, {"id": 1, "a.b": "c", "l": [1]}),
    "two lists": ({"p": [{"x": 1}], "q": [{"y": 1}], "n": 0}, {"n": 0, "p": [(1,)], "q": [(1,)]}),
    "columnar": ({"id": [1, 2], "name": ["a", None]}, {"id": 1, "name": "a"}),
    "scalars": ([1, 2], {"0": 1}),
    "arrays": ([[1, "a"], [2]], {"0": 1, "1": "a"}),
}


@pytest.mark.parametrize("case", list(JSON_CASES))
@pytest.mark.parametrize("indent", [None, 2])
def test_json_layouts(spark, tmp_path, case, indent):
    doc, first = JSON_CASES[case]
    df = read_json(spark, put(tmp_path / "a.json", json.dumps(doc, indent=indent)))
    assert set(df.columns) == set(first)
    got = next(r for r in df.collect() if all(r[k] == v for k, v in first.items() if not isinstance(v, list)))
    assert {k: got[k] for k in first} == first
    size = {"array": 2, "columnar": 2, "scalars": 2, "arrays": 2}.get(case, 1)
    assert df.count() == size


def test_json_wrapper_priority(spark, tmp_path):
    p = put(tmp_path / "a.json", json.dumps({"entries": [{"e": 1}], "results": [{"r": 1}], "items": []}))
    assert read_json(spark, p).columns == ["r"]


def test_json_lines(spark, tmp_path):
    p = put(tmp_path / "a.json", '{"id": 1, "a": {"b": 2}}\n\n  {"id": 2}\n')
    assert sorted(rows(read_json(spark, p).select("id", "`a.b`"))) == [(1, 2), (2, None)]
    bad = put(tmp_path / "b.json", '{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):
        read_json(spark, bad).collect()
    latin = put(tmp_path / "c.json", '{"n": "Zoë"}\n{"n": "5 €"}\n'.encode("cp1252"))
    assert sorted(rows(read_json(spark, latin))) == [("5 €",), ("Zoë",)]


@pytest.mark.parametrize("text", ["3", '"x"', "{broken", '{"a": [1], "b": [1, 2]}'])
def test_json_errors(spark, tmp_path, text):
    with pytest.raises(Exception):
        read_json(spark, put(tmp_path / "a.json", text)).collect()


def test_json_empty(spark, tmp_path):
    for text in ("", "  \n", "[]"):
        assert read_json(spark, put(tmp_path / "a.json", text)).columns == []


def test_json_bom_and_mixed_folder(spark, tmp_path):
    put(tmp_path / "a.json", '﻿{"data": [{"id": 1}]}')
    put(tmp_path / "b.json", '[{"id": 2}]')
    put(tmp_path / "c.json", '{"id": 3}\n{"id": 4}\n')
    assert sorted(rows(read_json(spark, str(tmp_path)))) == [(1,), (2,), (3,), (4,)]


def test_xlsx_round_trip(spark, tmp_path):
    data = [(1, 1.5, True, "a <&> ü", dt.datetime(2024, 1, 5, 10, 30), None), (2, None, False, " x", None, None)]
    df = spark.createDataFrame(data, "id long, v double, ok boolean, s string, at timestamp_ntz, none string").repartition(1)
    write_excel(df, str(tmp_path / "x"))
    back = read_xlsx(spark, str(tmp_path / "x"))
    assert [f.dataType.simpleString() for f in back.schema] == ["bigint", "double", "boolean", "string", "timestamp_ntz", "string"]
    assert sorted(rows(back)) == data


def test_xlsx_full_sheets_go_on_in_another_workbook(spark, tmp_path):
    write_xlsx(spark.range(25).coalesce(1), str(tmp_path / "x"), max_rows=10)
    assert len(list((tmp_path / "x").glob("*.xlsx"))) == 3 and not list((tmp_path / "x").glob("_temporary*"))
    assert sorted(rows(read_xlsx(spark, str(tmp_path / "x")))) == [(i,) for i in range(25)]
    write_xlsx(spark.range(3).coalesce(1), str(tmp_path / "x"), mode="overwrite")
    assert read_xlsx(spark, str(tmp_path / "x")).count() == 3


def test_dispatch(spark, tmp_path):
    put(tmp_path / "a.CSV", " id ,b\n1,2\n")
    put(tmp_path / "b.txt", "id;b\n3;4\n")
    put(tmp_path / "c.json", '[{"id": 5, "b": 6}]')
    got = read_each(spark, str(tmp_path))
    assert {k: rows(v.select("id", "b")) for k, v in got.items()} == {"csv": [(1, 2)], "txt": [(3, 4)], "json": [(5, 6)]}
    assert rows(read_any(spark, str(tmp_path / "a.CSV"))) == [(1, 2)]
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path))
    with pytest.raises(ValueError, match="Unsupported"):
        read_any(spark, put(tmp_path / "d.xls", "x"))
    put(tmp_path / "noext", "id,b\n7,8\n")
    assert rows(read_any(spark, str(tmp_path / "noext"), hint="upload.csv")) == [(7, 8)]


def test_empty_csv_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        read_any(spark, put(tmp_path / "a.csv", ""))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ' "q", x ', [1, 2], None)], "id long, s string, l array<int>, n string")
    write_any(df, str(tmp_path / "c"), " CSV ")
    assert rows(read_csv(spark, str(tmp_path / "c"))) == [(1, ' "q", x ', "[1,2]", None)]
    write_any(df, str(tmp_path / "j"), "json")
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*.json"))
    assert json.loads(text) == {"id": 1, "s": ' "q", x ', "l": [1, 2], "n": None}
    assert read_ndjson(spark, str(tmp_path / "j")).count() == 1
    with pytest.raises(ValueError, match="Unsupported"):
        write_any(df, str(tmp_path / "p"), "pdf")
    with pytest.raises(Exception):
        write_csv(df, str(tmp_path / "c"))


def test_audit(spark, tmp_path):
    lines = ["2024-01-05 10:30:00,250 - USER: [someone new] - ACTION: matched 'a' with template 'b'", "noise", ""]
    put(tmp_path / "log.txt", "\n".join(lines))
    got = rows(audit.read_audit(spark, str(tmp_path / "log.txt")))
    assert got == [(dt.datetime(2024, 1, 5, 10, 30, 0, 250000), "someone new", audit.upload_action("a", "b"))]
    table = str(tmp_path / "audit")
    for _ in range(2):
        audit.append_audit(spark.createDataFrame(got, audit.AUDIT_DDL), table)
    assert rows(spark.read.parquet(table)) == got * 2
    assert audit.transform_action("o.csv") == "wrote 'o.csv'"


def test_csv_quoted_line_break(spark, tmp_path):
    from colweave.sources.csv import read_csv

    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,plain\n')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv")).collect())) == [(1, "two\nlines"), (2, "plain")]


def _messy_csv(rng, n):
    """Quoted cells with line breaks, separators and doubled quotes, stray quotes, blank lines, both line ends."""
    def cell():
        kind = rng.randrange(7)
        if kind < 3:
            return rng.choice(["x", "", "12", "Zoë €", "a b"])
        if kind == 3:
            return '5" pipe'
        return '"' + "".join(rng.choice(["a", ",", "\n", '""', "long " * rng.randrange(30), "\r\n", "é"]) for _ in range(rng.randrange(8))) + '"'

    lines = ["id,note,more"] + [f"{i},{cell()},{cell()}" for i in range(n)]
    return "".join(x + rng.choice(["\n", "\n", "\r\n", "\n\n"]) for x in lines)


@pytest.mark.parametrize("block", [37, 400, 1 << 20])
def test_quoted_csv_over_blocks(spark, tmp_path, block):
    """Whatever the blocks, line breaks at their edges included, the records are those of Python's reader."""
    import csv as plain
    import io
    import random

    from colweave.sources.records import quoted_records

    rng, want = random.Random(block), []
    (tmp_path / "c").mkdir()
    for i in range(3):
        text = _messy_csv(rng, 60)
        (tmp_path / "c" / f"{i}.csv").write_text(text, newline="")
        want += [tuple(r) for r in list(plain.reader(io.StringIO(text, newline="")))[1:] if r]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = read_csv(spark, str(tmp_path / "c"), tokens=(), infer_schema=False)
        got = [tuple("" if c is None else c for c in r) for r in df.collect()]
        if block < 1000:
            assert quoted_records(spark, [str(tmp_path / "c")], ",").rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted(want)


def test_quote_left_open(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'id,note\n1,x\n2,"open\nto the end\n')
    assert rows(read_csv(spark, p, infer_schema=False))[0] == ("1", "x") and read_csv(spark, p).count() == 2


def _messy_json(rng, n):
    """An array of objects with brackets, quotes and backslashes in strings, nested values and any white space."""
    texts = ['}', '{"', "\\", '\\"', "]}[{", "é €", "", "a\nb", '\\\\"}', "plain"]
    deep = lambda d: {"x": [deep(d - 1), [], {}], "y": rng.choice(texts)} if d else rng.randint(0, 9)
    rows = [{"id": i, "s": rng.choice(texts), "d": json.dumps(deep(rng.randint(0, 4))), "l": [rng.choice(texts)] * rng.randint(0, 40),
             "o": {"k": rng.choice(texts), "m": {"v": i / 4}}} for i in range(n)]
    return rows, json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("block", [37, 400, 1 << 20])
def test_json_arrays_split_over_tasks(spark, tmp_path, block):
    rng, want = random.Random(block), []
    (tmp_path / "j").mkdir()
    for i in range(4):
        made, text = _messy_json(rng, 25)
        want += made
        (tmp_path / "j" / f"{i}.json").write_text(text, newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = array_records(spark, [str(tmp_path / "j")])
        if block < 1000:
            assert spark.read.text(str(tmp_path / "j")).rdd.getNumPartitions() > 20
        got = [json.loads(r.line) for r in lines.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    text = lambda records: sorted(json.dumps(r, sort_keys=True) for r in records)
    assert text(got) == text(want)
    table = read_json(spark, str(tmp_path / "j"))
    assert table.count() == 100 and {"id", "s", "d", "l", "o.k", "o.m.v"} == set(table.columns)


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[{"a": 1}, {"a": 2}', '[{"a": 1}, 5]', '[{"a": 1}, "x"]', '[{"a": 1}, [{"a": 2}]]', '[{"a": "x\ny"}]'])
def test_json_array_errors(spark, tmp_path, text):
    with pytest.raises(Exception):
        read_json(spark, put(tmp_path / "a.json", text)).collect()


def test_json_folder_of_all_layouts(spark, tmp_path):
    for i, text in enumerate(["[1, 2, 3]", '{"id": 1}', '[{"id": 2}]', '{"id": 3}\n{"id": 4}\n', '{"id": [5, 6]}', "[[7, 8]]", "", "[]"]):
        put(tmp_path / f"{i}.json", text)
    put(tmp_path / "latin.json", '{"id": 9, "n": "Zoë"}'.encode("cp1252"))
    got = read_json(spark, str(tmp_path)).select("id", "0", "1", "n")
    assert sorted(got.collect(), key=str) == sorted(
        [(None, i, None, None) for i in (1, 2, 3)] + [(i, None, None, None) for i in range(1, 7)]
        + [(None, 7, 8, None), (9, None, None, "Zoë")], key=str)


def test_json_wide_arrays_keep_their_order(spark, tmp_path):
    p = put(tmp_path / "a.json", json.dumps([list(range(12)), [1]]))
    assert read_json(spark, p).columns == [str(i) for i in range(12)]


def test_lines_that_open_quotes_are_found_in_bulk():
    """The expression over a batch tells the same lines as going through each, and only these are looked at one by one."""
    from colweave.sources.records import _Lines, ends_inside

    rng = random.Random(21)
    for sep in (b",", b";", b"\t", b"|", b"||"):
        lines = [bytes(rng.choices(b'"",;\t|a\xe9 \\^]', k=rng.randint(0, 9))) for _ in range(4000)]
        found = _Lines(pa.array(lines, pa.binary()), sep)
        assert found.opening.tolist() == [i for i, line in enumerate(lines) if ends_inside(line, False, sep)]
    lines = [b'1,"a, ""b"""'] * 50_000
    start = time.perf_counter()
    assert _Lines(pa.array(lines, pa.binary()), b",").next_change(0, len(lines), False) == (len(lines), False)
    assert time.perf_counter() - start < 2


def test_plain_records_need_no_cutting(spark, tmp_path):
    from colweave.sources.records import quoted_records

    texts = {"plain": b'a,b\n1,"x, ""y"""\n2,z\n', "breaks": b'a,b\n1,"x\ny"\n', "returns": b"a,b\r\n1,x\r\n", "blanks": b"a,b\n  \n1,x\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text)
        assert (quoted_records(spark, [str(tmp_path / f"{name}.csv")], ",") is None) == (name == "plain")
    rows = read_csv(spark, str(tmp_path / "plain.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 'x, "y"'), (2, "z")]


def test_json_objects_by_the_text_of_their_members(spark):
    rows = '[{"a":1.50,"b":[1]},{"a":"x","b":[]}]'
    read = lambda *docs: documents_to_table(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc")
    plain = sorted(map(str, read(rows).collect()))
    for doc in ('{"n":1,"rows" : %s}' % rows, '{"n":"[{]","q":%s}' % rows, '{"n":"\\u005b{","items":%s,"other":[{"z":1}]}' % rows):
        got = sorted(map(str, read(doc).collect()))
        assert [g.replace("1.50", "1.5") for g in got] == [p.replace("1.50", "1.5") for p in plain]
    # a number among texts stays as it is written, as it does in an array
    assert sorted(r.a for r in read('{"a":1.50}', '{"a":"x"}').collect()) == ["1.50", "x"]
    cells = read('{"x":[1,null],"y":[true, false]}', '{"x":[2],"y":["a,]"]}', '{"x":[],"y":[ ]}')
    assert sorted(map(tuple, cells.collect()), key=str) == [(1, "true"), (2, "a,]"), (None, "false")]
    for bad in ('{"a":1,"a":[{"k":1}]}', '{"a":[1,2],"b":[1]}', '{"a":[1 2],"b":[1]}', '{"a":[{"k":1}}', '{"a":[NaN]}'):
        with pytest.raises(Exception):
            read(bad).collect()


def test_sheets_of_simple_cells_need_no_parser(spark, tmp_path, monkeypatch):
    from colweave.sources import xlsx

    stamp = dt.datetime(2024, 2, 29, 12, 30)
    rows = [(1, 1.0, "a&b<c", True, stamp), (None, 2.5e-9, " x_x0041_\r\n", None, None), (-(2**40), 1e16, "", False, stamp)] * 3
    write_xlsx(spark.createDataFrame(rows, "i long, f double, t string, b boolean, at timestamp_ntz").coalesce(1), str(tmp_path / "x"), max_rows=7)
    books = sorted((tmp_path / "x").glob("part-*.xlsx"))
    assert len(books) == 2
    contents = [b.read_bytes() for b in books]
    quick = [list(xlsx.sheet_rows(c)) for c in contents]
    assert [r for book in quick for r in book[1:]] == [list(r) for r in rows]
    with monkeypatch.context() as m:
        m.setattr(xlsx, "_simple_rows", lambda *_: iter([None]))
        assert [list(xlsx.sheet_rows(c)) for c in contents] == quick
    # what is not simple goes to the parser, after the blocks that are
    sheet = zipfile.ZipFile(books[0]).read("xl/worksheets/sheet1.xml")
    for odd in (b'<row><c r="B1"><v>5</v></c></row>', b"<row><c><f>1+1</f><v>2</v></c></row>", b"<row><!-- <c/> --><c><v>3</v></c></row>"):
        changed = io.BytesIO()
        with zipfile.ZipFile(books[0]) as old, zipfile.ZipFile(changed, "w") as new:
            for name in old.namelist():
                data = old.read(name)
                new.writestr(name, data.replace(b"</sheetData>", odd + b"</sheetData>") if data == sheet else data)
        for chunk in (300, 4 << 20):
            monkeypatch.setattr(xlsx, "_CHUNK", chunk)
            got = list(xlsx.sheet_rows(changed.getvalue()))
            assert got[:-1] == quick[0] and got[-1] in ([None, 5], [2], [3])
    monkeypatch.setattr(xlsx.ET, "iterparse", lambda *_: pytest.fail("parsed"))
    assert "sharedStrings" not in " ".join(zipfile.ZipFile(books[0]).namelist())
    monkeypatch.setattr(xlsx, "_CHUNK", 300)
    assert [list(xlsx.sheet_rows(c)) for c in contents] == quick


def test_documents_are_made_once(spark):
    """Blank documents are left out without a filter, which would make every document a second time."""
    docs = spark.range(4).select(F.format_string('{"a":[%d,%d],"b":[%d,%d]}', "id", F.col("id") + 10, "id", "id").alias("d"))
    plan = J._record_lines(docs, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1, plan
    rows = J.documents_to_table(docs, "d").collect()
    assert sorted(map(tuple, rows)) == sorted((i + k, i) for i in range(4) for k in (0, 10))


def test_flat_columnar_documents_by_text(spark):
    texts = [
        '{"a,b":[1, 2.5] , "c[":[true,null]}', ' {"a,b":[\n],"c[":[ \t]}', '{"a,b":[3],"c":[4]}', '{"x]":[-1e2,7]}', '{"q":[]}', "", "  ", None,
        '{"a,b":["5"],"c":[6]}', '{"c":[8],"n":9}', '{"c":[[1,2]],"a,b":[10]}',
    ]
    docs = spark.createDataFrame([(t,) for t in texts], "d string")
    lines = [json.loads(r.line) if r.line else None for r in J._record_lines(docs, "d").collect()]
    assert lines == [
        [{"a,b": 1, "c[": True}, {"a,b": 2.5, "c[": None}], [], [{"a,b": 3, "c": 4}], [{"x]": -100.0}, {"x]": 7}], [], None, None, None,
        [{"a,b": "5", "c": 6}], {"c": [8], "n": 9}, [{"c": [1, 2], "a,b": 10}],
    ]
    flat = J.documents_to_table(docs.where("d is null or trim(d) = '' or d like '%x]%' or d like '%\"c\":[4]%'"), "d")
    assert sorted(map(tuple, flat.select("`a,b`", "c", "`x]`").collect()), key=repr) == [(3, 4, None), (None, None, -100.0), (None, None, 7.0)]
