"""Header-like and messy text derived from the given tables, in Spark and in SQL alike.

Every expression keeps all rows and whole texts; the modulus only chooses a spelling or a place per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import table
from .sql_text import quote

RAW_SUFFIX = ["_ID", "-Qty", ".Amt", " Name", "_dt", " E-Mail", " Price", "_Addr", " Phone #", "", "_Color", " weight kg"]
TEMPLATE_SUFFIX = [" identifier", " Quantity", "s", " Total Value", ".date", " mailbox", "s cost", "", " colour", " net weight kg"]


def pick(options: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))


def sql_pick(options: list[str], by: str) -> str:
    return f"([{', '.join(quote(o) for o in options)}])[({by} % {len(options)}) + 1]"


def raw_header() -> Column:
    return F.concat("p_name", pick(RAW_SUFFIX, F.col("p_size")))


def template_header() -> Column:
    return F.concat("p_name", pick(TEMPLATE_SUFFIX, F.col("p_partkey")))


RAW_SQL = f"p_name || {sql_pick(RAW_SUFFIX, 'p_size')}"
TEMPLATE_SQL = f"p_name || {sql_pick(TEMPLATE_SUFFIX, 'p_partkey')}"


def header_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One (template header, raw header) pair per part."""
    return table(spark, sf_dir, "part").select(
        "p_partkey", template_header().alias("t_header"), raw_header().alias("r_header")
    )


PAIRS_SQL = f"SELECT p_partkey, {TEMPLATE_SQL} AS t_header, {RAW_SQL} AS r_header FROM part"


def feed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a feed whose columns are named after its parts; all rows of a feed are in one partition."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", raw_header().alias("h"))
    named = lines.join(parts, lines.l_partkey == parts.p_partkey).select("l_orderkey", "l_linenumber", "h").repartition("l_orderkey")
    return named.groupBy("l_orderkey", "l_linenumber").agg(F.max("h").alias("column_name")).select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("ordinal"), "column_name"
    )


def feed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_columns(spark, sf_dir).withColumn("table_id", F.col("table_id").cast("string"))


FEED_SQL = f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS table_id, l_linenumber AS ordinal, max({RAW_SQL}) AS column_name
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
"""


def template_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every five parts as a template whose columns are named after them, so templates grow with the parts."""
    return table(spark, sf_dir, "part").select(
        F.expr("cast(p_partkey div 5 as string)").alias("table_id"), (F.col("p_partkey") % 5).cast("int").alias("ordinal"),
        template_header().alias("column_name"),
    )


TEMPLATE_CATALOG_SQL = f"""
    SELECT CAST(p_partkey // 5 AS VARCHAR) AS table_id, CAST(p_partkey % 5 AS INTEGER) AS ordinal, {TEMPLATE_SQL} AS column_name FROM part
"""


def match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed is matched against a template chosen by its customer; there are four parts to three customers."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("source_id"),
        F.expr("cast(o_custkey * 4 div 15 as string)").alias("template_id"),
    )


REQUEST_SQL = """
    SELECT CAST(o_orderkey AS VARCHAR) AS source_id, CAST(o_custkey * 4 // 15 AS VARCHAR) AS template_id FROM orders
"""


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the text a spreadsheet export would hold."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    named = F.date_format("o_orderdate", "MMM d yyyy")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        pick_text(key, [price, F.concat(F.lit("$"), price), F.concat(F.lit(" "), price, F.lit(" €")), F.lit("N/A"),
                        F.concat(price, F.lit("%")), F.concat(F.lit("("), price, F.lit(")")), F.lit("1_000"),
                        F.concat(F.lit("\t"), price, F.lit("e1"))]).alias("amount_text"),
        pick_text(key, [iso, named, F.lit(" null "), F.concat(iso, F.lit(" 10:30:00")), F.lit("2024")]).alias("date_text"),
        pick_text(key, [F.concat(F.lit("  "), F.col("o_orderstatus")), F.lit("NULL"), F.concat(F.col("o_orderpriority"), F.lit("\t")),
                        F.lit("none"), F.lit("  "), F.lit("-")]).alias("note_text"),
        pick_text(F.col("o_custkey"), [
            F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@mail.example.com")),
            F.concat(F.lit("+1 555-"), F.lpad(F.pmod(F.col("o_custkey"), F.lit(10000)).cast("string"), 4, "0")),
            F.lit("not@valid"), F.lit("(030) 1234-5678")]).alias("contact_text"),
    )


def pick_text(by: Column, options: list[Column]) -> Column:
    return F.element_at(F.array(*options), (F.pmod(by, F.lit(len(options))) + 1).cast("int"))


def _sql_choose(by: str, options: list[str]) -> str:
    return f"([{', '.join(options)}])[({by} % {len(options)}) + 1]"


_P = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_ISO = "strftime(o_orderdate, '%Y-%m-%d')"
_NAMED = "strftime(o_orderdate, '%b %-d %Y')"

_AMOUNT = _sql_choose("o_orderkey", [
    _P, f"'$' || {_P}", f"' ' || {_P} || chr(160) || '€'", "'N/A'", f"{_P} || '%'", f"'(' || {_P} || ')'", "'1_000'",
    f"chr(9) || {_P} || 'e1'"])
_DATE = _sql_choose("o_orderkey", [_ISO, _NAMED, "' null '", f"{_ISO} || ' 10:30:00'", "'2024'"])
_NOTE = _sql_choose("o_orderkey", ["'  ' || o_orderstatus", "'NULL'", "o_orderpriority || chr(9)", "'none'", "' ' || chr(160)", "'-'"])
_CONTACT = _sql_choose("o_custkey", [
    "'user' || CAST(o_custkey AS VARCHAR) || '@mail.example.com'",
    "'+1 555-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')", "'not@valid'", "'(030) 1234-5678'"])

MESSY_SQL = f"""
    SELECT o_orderkey, {_AMOUNT} AS amount_text, {_DATE} AS date_text, {_NOTE} AS note_text, {_CONTACT} AS contact_text
    FROM orders
"""
