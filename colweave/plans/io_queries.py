"""Queries over sources and sinks; each writes the given tables out and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import fresh_dir
from ..sinks.files import write_any, write_csv, write_excel, write_json
from ..sources import audit as A
from ..sources import json as J
from ..sources.csv import read_csv
from ..sources.dispatch import read_any, read_each
from ..sources.xlsx import read_xlsx
from .core import query, table



@query("src_csv", """
    SELECT o_orderkey AS "Order Key", CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS "Cust",
      o_totalprice AS "Total", o_orderkey % 2 = 0 AS "Even", CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority || ', "x"' END AS "Prio",
      strftime(o_orderdate, '%Y-%m-%d') AS "Placed" FROM orders
""")
def src_csv(spark, sf_dir):
    key = F.col("o_orderkey")
    out = table(spark, sf_dir, "orders").select(
        key.alias(" Order Key "), F.when(key % 4 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("Cust"),
        F.col("o_totalprice").alias("Total"), (key % 2 == 0).alias("Even"),
        F.when(key % 3 == 0, "NULL").otherwise(F.concat("o_orderpriority", F.lit(', "x"'))).alias("Prio"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Placed"),
    )
    path = fresh_dir(spark, "src_csv")
    write_csv(out, path)
    return read_csv(spark, path)


@query("src_csv_delim", """
    SELECT p_partkey AS id, p_name AS name, p_brand || ', ' || p_type AS brand, p_retailprice AS price FROM part
""")
def src_csv_delim(spark, sf_dir):
    path = fresh_dir(spark, "src_csv_delim")
    out = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(", ", "p_brand", "p_type").alias("brand"),
        F.col("p_retailprice").alias("price"),
    )
    for i, sep in enumerate((";", "\t", "|")):
        write_csv(out.where(F.col("id") % 3 == i), f"{path}/{i}", sep=sep)
    return read_csv(spark, [f"{path}/{i}" for i in range(3)])


_FLAT_TEXT = "translate(text, chr(10) || chr(13) || '\"', '   ')"


@query("src_csv_encoding", f"SELECT doc_id, lang, {_FLAT_TEXT} AS body FROM documents")
def src_csv_encoding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.translate("text", '\n\r"', "   ").alias("body"))
    path = fresh_dir(spark, "src_csv_encoding")
    fits = docs.where(F.col("body").rlike(r"^[\x00-\xFF]*$"))
    write_csv(fits, f"{path}/latin", encoding="ISO-8859-1")
    write_csv(docs.where(~F.col("body").rlike(r"^[\x00-\xFF]*$")), f"{path}/utf8")
    return read_csv(spark, [f"{path}/latin", f"{path}/utf8"], tokens=())


@query("src_ndjson", """
    SELECT event_id AS id, event_type AS "kind.name", value AS "kind.amount", CASE WHEN event_id % 3 = 0 THEN user_id END AS "user" FROM events
""")
def src_ndjson(spark, sf_dir):
    out = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("name"), F.col("value").alias("amount")).alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user"),
    )
    path = fresh_dir(spark, "src_ndjson")
    write_json(out, path)
    return read_any(spark, path)


@query("json_flatten", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k", event_type AS "info.type", user_id AS "info.by.user" FROM events
""")
def json_flatten(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k bigint").alias("props"),
        F.struct(F.col("event_type").alias("type"), F.struct(F.col("user_id").alias("user")).alias("by")).alias("info"),
    )
    return J.flatten(nested)


def _line_documents(spark, sf_dir, shape):
    """One JSON document per line item, with two records; ``shape`` builds it from their array."""

    def record(line, part, price):
        return F.struct(
            line.alias("line"), F.col(part).alias("part"),
            F.struct(F.col("l_quantity").cast("int").alias("qty"), F.col(price).alias("price")).alias("of"),
        )

    number = F.col("l_linenumber")
    items = F.array(record(number, "l_partkey", "l_extendedprice"), record(number + 10, "l_suppkey", "l_tax"))
    return table(spark, sf_dir, "lineitem").select(F.to_json(shape(items)).alias("doc"))


_ITEMS_SQL = """
    SELECT l_linenumber::BIGINT AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS "of.qty", l_extendedprice AS "of.price" FROM lineitem
    UNION ALL SELECT l_linenumber + 10, l_suppkey, CAST(l_quantity AS BIGINT), l_tax FROM lineitem
"""


@query("src_json_array", _ITEMS_SQL)
def src_json_array(spark, sf_dir):
    return J.documents_to_table(_line_documents(spark, sf_dir, lambda items: items), "doc")


@query("src_json_wrapped", _ITEMS_SQL)
def src_json_wrapped(spark, sf_dir):
    shape = lambda items: F.struct(F.size(items).alias("entries"), items.alias("items"), F.array(F.struct(F.lit(1).alias("z"))).alias("zz"))
    return J.documents_to_table(_line_documents(spark, sf_dir, shape), "doc")


@query("src_json_wrapped_any", _ITEMS_SQL)
def src_json_wrapped_any(spark, sf_dir):
    shape = lambda items: F.struct(F.size(items).alias("n"), items.alias("order lines"), F.array(F.lit(1)).alias("flags"))
    return J.documents_to_table(_line_documents(spark, sf_dir, shape), "doc")


@query("src_json_columnar", """
    SELECT l_linenumber::BIGINT AS line, l_partkey AS part FROM lineitem UNION ALL SELECT l_linenumber + 10, l_suppkey FROM lineitem
""")
def src_json_columnar(spark, sf_dir):
    shape = lambda items: F.struct(items["line"].alias("line"), items["part"].alias("part"))
    return J.documents_to_table(_line_documents(spark, sf_dir, shape), "doc")


@query("src_json_record", """
    SELECT event_id AS id, event_type AS "at.kind", user_id AS "at.user", CAST(json_extract(props, '$.k') AS BIGINT) AS "props.k" FROM events
""")
def src_json_record(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(
            F.col("event_id").alias("id"), F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("at"),
            F.from_json("props", "k bigint").alias("props"),
        )).alias("doc")
    )
    return J.documents_to_table(docs, "doc")


@query("src_json_scalars", 'SELECT l_partkey AS "0" FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem')
def src_json_scalars(spark, sf_dir):
    return J.arrays_to_table(_line_documents(spark, sf_dir, lambda items: items["part"]), "doc")


@query("src_json_arrays", 'SELECT l_linenumber::BIGINT AS "0", l_partkey AS "1", l_tax AS "2" FROM lineitem')
def src_json_arrays(spark, sf_dir):
    rows = F.concat(F.lit("[["), F.concat_ws(",", "l_linenumber", "l_partkey", "l_tax"), F.lit("]]"))
    return J.arrays_to_table(table(spark, sf_dir, "lineitem").select(rows.alias("doc")), "doc")


_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("src_dispatch", " UNION ALL ".join(f"SELECT '{ext}' AS ext, * FROM ({_CUSTOMER_SQL})" for ext in ("csv", "json", "xlsx")))
def src_dispatch(spark, sf_dir):
    customers, path = table(spark, sf_dir, "customer"), fresh_dir(spark, "src_dispatch")
    for ext in ("csv", "json", "xlsx"):
        write_any(customers, f"{path}/{ext}", ext)
    tables = read_each(spark, path)
    names = customers.columns
    parts = [df.select(F.lit(ext).alias("ext"), *names) for ext, df in sorted(tables.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LABELLED_SQL = "SELECT c_custkey AS id, c_name || ' é' AS label, c_acctbal AS balance FROM customer"


@query("src_json_encoding", _LABELLED_SQL)
def src_json_encoding(spark, sf_dir):
    """Records in Latin-1 and in UTF-8, each in files of its own."""
    out = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" é")).alias("label"), F.col("c_acctbal").alias("balance")
    )
    path = fresh_dir(spark, "src_json_encoding")
    out.where("id % 2 = 0").write.option("encoding", "ISO-8859-1").json(f"{path}/single")
    out.where("id % 2 = 1").write.json(f"{path}/utf8")
    return J.read_json(spark, [f"{path}/single", f"{path}/utf8"])


@query("sink_formats", " UNION ALL ".join(f"SELECT '{name}' AS fmt, * FROM ({_CUSTOMER_SQL})" for name in ("csv", "json", "txt")))
def sink_formats(spark, sf_dir):
    """Format names as users write them, each written and read back by the reader of what it stands for."""
    customers, path = table(spark, sf_dir, "customer"), fresh_dir(spark, "sink_formats")
    readers, out = {"csv": read_csv, "txt": read_csv, "json": J.read_json}, None
    for spelt in (" CSV", "Json ", "txt"):
        name = spelt.strip().lower()
        write_any(customers, f"{path}/{name}", spelt)
        part = readers[name](spark, f"{path}/{name}").select(F.lit(name).alias("fmt"), *customers.columns)
        out = part if out is None else out.unionByName(part)
    return out


@query("src_xlsx", _CUSTOMER_SQL)
def src_xlsx(spark, sf_dir):
    path = fresh_dir(spark, "src_xlsx")
    write_excel(table(spark, sf_dir, "customer").repartition(4), path)
    return read_xlsx(spark, path)


_LINES_SQL = """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_extendedprice, l_returnflag, {ship} AS l_shipdate,
      CASE WHEN l_linenumber > 3 THEN l_linestatus END AS l_linestatus FROM lineitem
"""


def _lines(spark, sf_dir):
    status = F.when(F.col("l_linenumber") > 3, F.col("l_linestatus")).alias("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", status
    )


@query("sink_csv", _LINES_SQL.format(ship="strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f')"))
def sink_csv(spark, sf_dir):
    path = fresh_dir(spark, "sink_csv")
    write_any(_lines(spark, sf_dir), path, "CSV ")
    return read_csv(spark, path)


@query("sink_json", _LINES_SQL.format(ship="strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.000')"))
def sink_json(spark, sf_dir):
    path = fresh_dir(spark, "sink_json")
    write_any(_lines(spark, sf_dir), path, "json")
    return J.read_ndjson(spark, path)


@query("sink_xlsx", _LINES_SQL.format(ship="l_shipdate"))
def sink_xlsx(spark, sf_dir):
    path = fresh_dir(spark, "sink_xlsx")
    write_any(_lines(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism), path, "Excel")
    return read_xlsx(spark, path)


def _audit_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("wrote '"), "event_type", F.lit(".csv'")).alias("action"),
    )


_AUDIT_SQL = """
    SELECT date_trunc('second', ts) AS ts, 'user ' || user_id AS "user", 'wrote ''' || event_type || '.csv''' AS action FROM events
"""


@query("audit_append", f"{_AUDIT_SQL} UNION ALL {_AUDIT_SQL}")
def audit_append(spark, sf_dir):
    path = fresh_dir(spark, "audit")
    for _ in range(2):
        A.append_audit(_audit_events(spark, sf_dir), path)
    return spark.read.schema(A.AUDIT_DDL).parquet(path)


@query("audit_parse", _AUDIT_SQL)
def audit_parse(spark, sf_dir):
    lines = _audit_events(spark, sf_dir).select(A.audit_line(F.col("ts"), F.col("user"), F.col("action")).alias("value"))
    noise = table(spark, sf_dir, "events").select(F.col("event_type").alias("value"))
    return A.parse_audit(lines.union(noise))
