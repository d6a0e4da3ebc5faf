"""JSON documents of several layouts as flat DataFrames."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.binding import bind
from ..scratch import fresh_dir
from .json_blocks import array_records
from .probe import decode_text, latin1

# Wrapper keys looked for in a JSON object, in this order.
WRAPPER_KEYS = (
    "data", "records", "items", "results", "rows",
    "payload", "elements", "users", "clients", "customers",
    "entities", "list", "entries",
)


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as dotted columns, at any depth; arrays are kept."""

    def walk(fields: list[T.StructField], path: list[str]) -> list[Column]:
        out = []
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType.fields, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*walk(df.schema.fields, []))


def _is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def _is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _starts_with_object(v: Column) -> Column:
    return _is_object(v, "$[0]")


def _from_lines(lines: DataFrame) -> DataFrame:
    """Rows of JSON texts, column ``line``: an object gives itself, an array its objects; not flattened.

    The texts are written once, so that what made them does not run again when their types are found and when they are read.
    """
    spark = lines.sparkSession
    path = fresh_dir(spark, "json-records")
    broken = F.contains("line", F.lit("\n")) | F.contains("line", F.lit("\r"))
    lines.select(F.when(broken, F.translate("line", "\n\r", "  ")).otherwise(F.col("line")).alias("line")).write.text(path)
    return spark.read.option("mode", "FAILFAST").option("prefersDecimal", "false").json(path)


def _numbered(df: DataFrame) -> DataFrame:
    """Columns named by position in the order of their numbers; others follow as they are."""
    names = sorted(df.columns, key=lambda c: (not c.isdigit(), int(c) if c.isdigit() else 0))
    return df.select(*[F.col(f"`{c}`") for c in names])


def _array_lines(items: Column) -> Column:
    """An array document as text of an array of objects; scalars and inner arrays are named by position."""

    def text(values: Column) -> Column:
        first = F.get(F.filter(values, lambda x: ~F.is_variant_null(x)), F.lit(0))
        of_cells = F.transform(values, lambda row: F.map_from_entries(
            F.transform(row.cast("array<variant>"), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("x")))))
        scalars = F.transform(values, lambda x: F.create_map(F.lit("0"), x))
        return F.when(_is_array(first), F.to_json(of_cells)).when(_is_object(first), F.to_json(values)).otherwise(F.to_json(scalars))

    return bind(items, text)


#: Numbers and quotes as the parser of values takes them.
_STRICT = {"allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def _members(text: Column) -> Column:
    """Members of an object as their own text, null for other documents and where text does not tell a string from a list.

    Strings lose their quotes, so one that begins with a bracket would look like a list. It begins with a quote and a bracket, or with
    an escape; documents with either are not looked at. Spark writes numbers inside lists and objects anew.
    """
    unclear = F.contains(text, F.lit('"[')) | F.contains(text, F.lit('"\\'))
    return F.when(F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & ~unclear, F.from_json(text, "map<string,string>", _STRICT))


def _rows(objects: Column) -> Column:
    """Of the members that are lists of objects, that under a wrapper key or the only one."""
    only = F.when(F.size(objects) == 1, F.element_at(F.map_values(objects), 1))
    return F.coalesce(*[F.try_element_at(objects, F.lit(k)) for k in WRAPPER_KEYS], only)


def _record_lines(documents: DataFrame, column: str) -> DataFrame:
    """Every document as the text of an object or of an array of objects, column ``line``.

    An array of objects, the usual layout, is passed on as it is, as is a blank document, and so are the parts of an object whose members can be told by
    their text; only other documents are taken apart as values.
    """
    text = F.trim(F.col(column))
    # A blank document is a blank line, which is no record; a filter would make every document twice.
    docs = documents.select(F.coalesce(text, F.lit("")).alias("d"))
    docs = docs.select("d", ((F.col("d") == "") | _list_of_objects(F.col("d"))).alias("plain"))
    docs = docs.select("d", "plain", F.when(~F.col("plain"), _members(F.col("d"))).alias("p"))
    # A name given twice is left to the parser of values, which rejects it.
    once = F.size(F.array_distinct(F.map_keys("p"))) == F.size("p")
    docs = docs.select("d", "plain", F.when(once, F.col("p")).alias("p"), F.array_join(F.map_values("p"), _MARK).alias("texts"))
    # The usual columnar document is told by plain text functions; what follows per member is for the others.
    docs = docs.select("d", "plain", "p", F.coalesce(F.col("p").isNotNull() & _flat_lists(F.col("d"), F.col("texts"), F.size("p")), F.lit(False)).alias("flat"))
    lists = F.forall(F.map_values("p"), lambda x: F.coalesce(F.startswith(x, F.lit("[")), F.lit(False)))
    docs = docs.select(
        "d", "plain", "p", "flat", F.when(~F.col("flat"), (F.size("p") > 0) & lists).alias("columnar"),
        F.when(~F.col("flat"), bind(F.map_filter("p", lambda _, x: _list_of_objects(x)), _rows)).alias("rows"),
    )
    known = (
        F.when(F.col("plain"), F.col("d"))
        .when(F.col("flat"), _cells_line(F.col("p")))
        .when(F.col("rows").isNotNull(), F.col("rows"))
        .when(~F.col("columnar"), F.col("d"))
    )
    return docs.select(known.otherwise(_value_line(F.parse_json("d"))).alias("line"))


#: Parts texts of JSON, which cannot hold it.
_MARK = "\x01"


def _flat_lists(document: Column, texts: Column, n: Column) -> Column:
    """Whether all ``n`` members, given as ``texts`` with marks between them, are lists without strings, objects or lists in them.

    Cells that are numbers, true, false or null end at a comma, and names without escapes are written as they are read.
    """
    count = lambda part: (F.octet_length(texts) - F.octet_length(F.replace(texts, F.lit(part), F.lit("")))) / len(part)
    lists = F.startswith(texts, F.lit("[")) & (count("[") == n) & (count(f"{_MARK}[") == n - 1)
    return lists & ~F.contains(texts, F.lit('"')) & ~F.contains(texts, F.lit("{")) & ~F.contains(document, F.lit("\\"))


def _list_of_objects(text: Column) -> Column:
    return F.startswith(text, F.lit("[")) & (F.startswith(text, F.lit("[{")) | text.rlike(r"^\[\s*\{"))


def _cells_line(members: Column) -> Column:
    """Text of one object per position of lists of equal length, given as text without strings, objects or lists in them."""

    def cells(k: Column, x: Column) -> Column:
        """The cells of a list, each behind its name."""
        name = F.concat(F.lit('"'), k, F.lit('":'))
        inner = F.substring(x, F.lit(2), F.length(x) - 2)
        named = F.concat(name, F.replace(inner, F.lit(","), F.concat(F.lit(_MARK), name)))
        blank = ~F.contains(x, F.lit(",")) & (F.trim(x, F.lit("[] \n\r\t")) == "")
        return F.when(blank, F.array().cast("array<string>")).otherwise(F.split(named, _MARK))

    def text(lists: Column) -> Column:
        first = F.get(lists, F.lit(0))
        objects = F.transform(first, lambda _, i: F.array_join(F.transform(lists, lambda a: F.get(a, i)), ","))
        ragged = F.raise_error(F.lit("columnar JSON with lists of different length")).cast("string")
        equal = F.forall(lists, lambda a: F.size(a) == F.size(first))
        whole = F.concat(F.lit("[{"), F.array_join(objects, "},{"), F.lit("}]"))
        return F.when(~equal, ragged).when(F.size(first) == 0, F.lit("[]")).otherwise(whole)

    return bind(F.zip_with(F.map_keys(members), F.map_values(members), cells), text)


def _value_line(values: Column) -> Column:
    """The line of a document from its values."""
    bad = F.raise_error(F.lit("unsupported JSON root: expected an array or an object")).cast("string")

    def of_object(m: Column) -> Column:
        n_lists = F.size(F.map_filter(m, lambda _, x: _is_array(x)))
        columnar = (F.size(m) > 0) & (n_lists == F.size(m))
        rows = bind(F.map_filter(m, lambda _, x: _is_array(x) & _starts_with_object(x)), _rows)
        return F.coalesce(bind(rows, lambda r: F.to_json(r)), F.when(columnar, _columnar_line(m)))

    def line(v: Column) -> Column:
        in_object = F.coalesce(bind(v.cast("map<string,variant>"), of_object), F.to_json(v))
        return F.when(_is_array(v), _array_lines(v.cast("array<variant>"))).when(_is_object(v), in_object).otherwise(bad)

    return bind(values, line)


def documents_to_table(documents: DataFrame, column: str) -> DataFrame:
    """Rows of every JSON document in a column, one document per row, flattened.

    Per document: an array gives its objects, or rows of columns ``0``, ``1``, ... where it holds scalars or arrays; an object gives
    the objects under a wrapper key, or under its only list of objects, or one row per position of its equally long lists, or
    itself. Documents of different layouts may meet in one column. Blank documents give nothing; a bare scalar, broken JSON or a document
    that names a member twice fails the job; of a name given twice inside a record the last value counts. A column with values of several types is text. A raw line break inside a string is read as a blank.
    """
    return _numbered(flatten(_from_lines(_record_lines(documents, column))))


def _columnar_line(members: Column) -> Column:
    """Text of one object per position of lists of equal length; ragged lists fail the job."""

    def text(lists: Column) -> Column:
        sizes = F.transform(F.map_values(lists), lambda a: F.size(a))
        longest = F.array_max(sizes)
        ragged = F.raise_error(F.lit("columnar JSON with lists of different length")).cast("string")
        positions = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
        objects = F.transform(positions, lambda i: F.transform_values(lists, lambda _, a: F.get(a, i)))
        return F.when(F.array_min(sizes) != longest, ragged).otherwise(F.to_json(objects))

    return bind(F.transform_values(members, lambda _, x: x.cast("array<variant>")), text)


def arrays_to_table(documents: DataFrame, column: str) -> DataFrame:
    """Rows of JSON arrays of scalars (one column ``0``) or of arrays (columns ``0``, ``1``, ...); objects in cells stay whole."""
    return _numbered(_from_lines(_record_lines(documents, column)))


def read_ndjson(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One JSON object per line, flattened; blank lines are skipped, a bad line fails the job.

    The layout for large feeds: files are split, and a given schema saves the scan that infers one.
    """
    reader = spark.read.option("mode", "FAILFAST").option("prefersDecimal", "false")
    if schema is not None:
        reader = reader.schema(schema)
    return flatten(reader.json(path))


def _layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[bool, str], list[str]]:
    """Files that are not blank, by whether they are UTF-8 and by layout: ``lines``, ``array`` or ``document``.

    One scan; a first line of any length stays in the tasks, and two short values a file come back.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    content = F.trim(F.regexp_replace(latin1(F.col("value")), "^\u00ef\u00bb\u00bf", ""))
    order = F.struct("start", "at")
    filled, inner = content != "", ~content.isin("", "[")
    facts = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.count_if(filled).alias("n_lines"),
        F.min_by(F.when(filled, F.col("value")), F.when(filled, order)).alias("first"),
        F.min_by(F.when(inner, F.left(content, F.lit(1))), F.when(inner, order)).alias("inner"),
    ).where("n_lines > 0")
    first = F.trim(decode_text(F.col("first")))
    head = F.when(first == "[", F.concat(first, F.coalesce("inner", F.lit("")))).otherwise(first)
    layout = (
        F.when((F.col("n_lines") > 1) & F.try_parse_json(first).isNotNull(), "lines")
        .when(F.col("utf8") & head.rlike(r"^\[\s*\{"), "array")
        .otherwise("document")
    )
    out: dict[tuple[bool, str], list[str]] = {}
    for r in facts.select("path", "utf8", layout.alias("layout")).orderBy("path").collect():
        out.setdefault((r["utf8"], r["layout"]), []).append(unquote(r["path"]))
    return out


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON files of any supported layout, found per file; files of different layouts may share a folder.

    A file whose first line is complete JSON and that goes on cannot be one document, so it has one record per line. An array of
    objects in UTF-8 is split over tasks, line breaks or not. Anything else is one document per task; use one record per line for
    large feeds.
    """
    files = _layouts(spark, path)
    parts = []
    if (True, "lines") in files:
        parts.append(read_ndjson(spark, files[True, "lines"]))
    if (True, "array") in files:
        parts.append(flatten(_from_lines(array_records(spark, files[True, "array"]))))
    texts = []
    if (False, "lines") in files:
        texts.append(spark.read.text(files[False, "lines"]))
    documents = [f for utf8 in (True, False) for f in files.get((utf8, "document"), [])]
    if documents:
        texts.append(spark.read.text(documents, wholetext=True))
    if texts:
        parts.append(documents_to_table(reduce(DataFrame.unionAll, texts).select(decode_text(F.col("value")).alias("d")), "d"))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
