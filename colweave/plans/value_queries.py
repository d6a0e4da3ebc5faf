"""Queries over cleaning, casting and mapping of values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import transform as X
from ..operators.assignment import match_headers
from ..operators.mapping import mapping_dict
from . import inputs as I
from . import sql_text as Q
from .core import query, struct, table


def _messy(column: str, sql: str, fn, out: str = "value"):
    """A row-wise value function over one messy column, next to its SQL."""

    def run(spark, sf_dir):
        return I.messy_orders(spark, sf_dir).select("o_orderkey", fn(F.col(column)).alias(out))

    return run, f"SELECT o_orderkey, {sql} AS {out} FROM ({I.MESSY_SQL})"


_ROWWISE = {
    "clean_trim": ("note_text", Q.trim_text("note_text"), V.trim_text),
    "clean_null_tokens": ("note_text", Q.clean_text("note_text"), V.clean_text),
    "clean_currency": ("amount_text", Q.strip_currency("amount_text"), V.strip_currency),
    "parse_number": ("amount_text", Q.parse_number("amount_text"), V.parse_number),
    "cast_numeric": ("amount_text", Q.to_number("amount_text"), V.to_number),
    "cast_timestamp": ("date_text", Q.parse_date("date_text"), V.parse_date),
    "is_email": ("contact_text", Q.is_email("contact_text"), V.is_email),
    "is_phone": ("contact_text", Q.is_phone("contact_text"), V.is_phone),
    "is_numeric_text": ("amount_text", Q.is_number("amount_text"), V.is_number_text),
    "is_date_text": ("date_text", Q.is_date("date_text"), V.is_date_text),
}
for _name, (_column, _sql, _fn) in _ROWWISE.items():
    _run, _text = _messy(_column, _sql, _fn)
    query(_name, _text)(_run)


@query("clean_table", f"""
    SELECT o_orderkey, {', '.join(f"{Q.clean_text(c)} AS {c}" for c in ('amount_text', 'date_text', 'note_text', 'contact_text'))}
    FROM ({I.MESSY_SQL})
""")
def clean_table(spark, sf_dir):
    return X.clean_table(I.messy_orders(spark, sf_dir))


# The flagship: header scores, assignment, then one projection.
@query("map_supplier_to_customer", f"""
    SELECT s_suppkey AS c_custkey, {Q.clean_text('s_name')} AS c_name, s_nationkey AS c_nationkey,
           s_acctbal AS c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM supplier
""")
def map_supplier_to_customer(spark, sf_dir):
    raw, template = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    mapping = mapping_dict(match_headers(spark, raw.columns, template.columns))
    return X.apply_mapping(raw, mapping, template)


_ORDER_TEMPLATE = struct({"order_id": "long", "amount": "double", "placed": "timestamp_ntz", "contact": "string", "remark": "string", "region": "string"})
_ORDER_MAPPING = {
    "order_id": ("o_orderkey", 1.0), "amount": ["amount_text", 0.9], "placed": "date_text", "contact": ("contact_text", 0.7),
    "remark": ("note_text", 0.6), "region": (None, 0.0),
}


@query("null_fill", f"""
    SELECT o_orderkey AS order_id, {Q.to_number('amount_text')} AS amount, {Q.parse_date('date_text')} AS placed,
           {Q.clean_text('contact_text')} AS contact, {Q.clean_text('note_text')} AS remark, CAST(NULL AS VARCHAR) AS region
    FROM ({I.MESSY_SQL})
""")
def null_fill(spark, sf_dir):
    return X.apply_mapping(I.messy_orders(spark, sf_dir), _ORDER_MAPPING, _ORDER_TEMPLATE)


@query("project_rename", f"""
    SELECT c_mktsegment AS segment, c_custkey AS id, {Q.clean_text('c_name')} AS "full.name" FROM customer
""")
def project_rename(spark, sf_dir):
    template = struct({"segment": "string", "id": "long", "full.name": "string"})
    return X.apply_mapping(
        table(spark, sf_dir, "customer"), {"segment": "c_mktsegment", "id": "c_custkey", "full.name": "c_name"}, template
    )


_LINE_TEMPLATE = struct({"order_no": "long", "line_no": "integer", "qty": "double", "price": "double", "discount": "double", "shipped": "timestamp_ntz", "flag": "string", "note": "string"})
_LINE_MAPPING = {
    "order_no": ("l_orderkey", 0.9), "line_no": ("l_linenumber", 0.9), "qty": ("l_quantity", 0.92), "price": ("price_text", 0.9),
    "discount": ("discount_text", 0.9), "shipped": ("ship_text", 0.9), "flag": ("l_returnflag", 0.8), "note": (None, 0.0),
}


def currency_lines(spark, sf_dir):
    """Line items with prices, discounts and dates as a sheet would show them."""
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag",
        F.concat(F.lit("$"), price).alias("price_text"),
        F.concat((F.col("l_discount") * 100).cast("decimal(9,0)").cast("string"), F.lit("%")).alias("discount_text"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_text"),
    )


@query("map_lineitem", f"""
    SELECT l_orderkey AS order_no, l_linenumber AS line_no, l_quantity AS qty, {Q.to_number('price_text')} AS price,
           {Q.to_number('discount_text')} AS discount, {Q.parse_date('ship_text')} AS shipped,
           {Q.clean_text('l_returnflag')} AS flag, CAST(NULL AS VARCHAR) AS note
    FROM (SELECT *, '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
                 CAST(CAST(l_discount * 100 AS DECIMAL(9,0)) AS VARCHAR) || '%' AS discount_text,
                 strftime(l_shipdate, '%Y-%m-%d') AS ship_text FROM lineitem)
""")
def map_lineitem(spark, sf_dir):
    return X.apply_mapping(currency_lines(spark, sf_dir), _LINE_MAPPING, _LINE_TEMPLATE)


def _loss_row(template_col: str, raw_col: str, before: str, after: str) -> str:
    return f"""
      SELECT '{template_col}' AS template_col, '{raw_col}' AS raw_col, count({before}) AS n_before, count({after}) AS n_after,
        count({before}) - count({after}) AS n_lost,
        round(100.0::DOUBLE * (count({before}) - count({after})) / count({before}), 4) AS pct_lost FROM messy"""


@query("cast_loss_report", f"WITH messy AS ({I.MESSY_SQL})" + " UNION ALL ".join([
    _loss_row("order_id", "o_orderkey", "o_orderkey", "o_orderkey"),
    _loss_row("amount", "amount_text", Q.clean_text("amount_text"), Q.to_number("amount_text")),
    _loss_row("placed", "date_text", Q.clean_text("date_text"), Q.parse_date("date_text")),
    _loss_row("contact", "contact_text", Q.clean_text("contact_text"), Q.clean_text("contact_text")),
    _loss_row("remark", "note_text", Q.clean_text("note_text"), Q.clean_text("note_text")),
]))
def cast_loss_report(spark, sf_dir):
    return X.cast_loss_report(I.messy_orders(spark, sf_dir), _ORDER_MAPPING, _ORDER_TEMPLATE)


@query("map_duplicate_raw", f"SELECT c_custkey AS id, {Q.clean_text('c_name')} AS label, c_acctbal AS amount FROM customer")
def map_duplicate_raw(spark, sf_dir):
    """Of raw columns with one name the first is meant."""
    raw = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey").toDF("id", "x", "y", "x", "y")
    template = struct({"id": "long", "label": "string", "amount": "double"})
    return X.apply_mapping(raw, {"id": "id", "label": "x", "amount": "y"}, template)
