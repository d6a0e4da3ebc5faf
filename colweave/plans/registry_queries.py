"""Queries over the mapping registry, feeds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import registry as R
from ..operators.catalog import schema_fingerprints
from ..scratch import fresh_dir, stored
from ..streaming.apply import map_stream, write_mapped_stream
from . import inputs as I
from . import sql_text as Q
from .core import query, struct, table
from .match_queries import _LINE_CTE, _line_mapping

_TYPE_SQL = "CASE WHEN raw_col IS NOT NULL AND confidence >= 0.8 THEN 'automatic' ELSE 'manual' END"


@query("schema_fingerprint", f"""
    SELECT table_id, md5(string_agg(column_name, '|' ORDER BY column_name)) AS fingerprint, count(*) AS n_columns
    FROM ({I.FEED_SQL}) GROUP BY table_id
""")
def schema_fingerprint(spark, sf_dir):
    return schema_fingerprints(I.feed_catalog(spark, sf_dir))


@query("mapping_rows", f"""
    WITH RECURSIVE {_LINE_CTE} SELECT mapping_id, template_col, raw_col AS source_column, confidence AS confidence_score,
      {_TYPE_SQL} AS mapping_type FROM lm
""")
def mapping_rows(spark, sf_dir):
    return R.mapping_rows(_line_mapping(spark, sf_dir)).select(
        "mapping_id", "template_col", "source_column", "confidence_score", "mapping_type"
    )


_QUALITY_SQL = """
    SELECT mapping_id, round(count(raw_col) * 100.0::DOUBLE / count(*), 6) AS overall_score,
      round(count(raw_col) * 100.0::DOUBLE / count(*), 6) AS completeness,
      round(coalesce(avg(confidence) FILTER (raw_col IS NOT NULL), 0), 6) AS average_confidence,
      count(*) FILTER (raw_col IS NOT NULL AND confidence >= 0.8) AS high_confidence_mappings,
      count(*) AS total_mappings, count(raw_col) AS successful_mappings FROM lm GROUP BY mapping_id
"""


@query("mapping_quality", f"WITH RECURSIVE {_LINE_CTE} {_QUALITY_SQL}")
def mapping_quality(spark, sf_dir):
    q = R.mapping_quality(_line_mapping(spark, sf_dir), ["mapping_id"])
    rounded = {c: F.round(c, 6) for c in ("overall_score", "completeness", "average_confidence")}
    return q.withColumns(rounded)


def _registry(spark, sf_dir):
    """One configuration per order, from its lines' mapping; the order's parts name the raw columns."""
    mapping = _line_mapping(spark, sf_dir)
    raw = I.feed_columns(spark, sf_dir).select(F.col("table_id").alias("mapping_id"), "ordinal", "column_name")
    return R.registry_rows(mapping, raw, None, ["mapping_id"])


_FPS = f"""
    raw_fp AS (SELECT mapping_id, md5(coalesce(string_agg(column_name, '|' ORDER BY column_name), '')) AS source_fingerprint,
               count(column_name) AS n_raw
               FROM (SELECT DISTINCT mapping_id FROM lm) LEFT JOIN ({I.FEED_SQL}) ON CAST(table_id AS BIGINT) = mapping_id GROUP BY mapping_id),
    template_fp AS (SELECT mapping_id, md5(string_agg(template_col, '|' ORDER BY template_col)) AS template_fingerprint FROM lm GROUP BY ALL)
"""


_ENTRIES_SQL = f"""
    entries AS (SELECT mapping_id, string_agg(template_col || '=' || coalesce(raw_col, '') || '@' || printf('%.4f', confidence) || ':' || {_TYPE_SQL},
                '|' ORDER BY template_col) AS entries, string_agg(template_col, '|' ORDER BY t_ord) AS template_columns FROM lm GROUP BY mapping_id)
"""


def _entries(mappings):
    """Every entry of a mapping as text, by template column."""
    one = lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"]["source_column"], F.lit("")), F.lit("@"),
        F.format_string("%.4f", e["value"]["confidence_score"]), F.lit(":"), e["value"]["mapping_type"],
    )
    return F.array_join(F.transform(F.sort_array(F.map_entries(mappings)), one), "|")


@query("registry_row", f"""
    WITH RECURSIVE {_LINE_CTE}, {_FPS}, {_ENTRIES_SQL}, quality AS ({_QUALITY_SQL})
    SELECT mapping_id, source_fingerprint, template_fingerprint, entries, template_columns, n_raw, overall_score, completeness, average_confidence,
      high_confidence_mappings, total_mappings, successful_mappings, successful_mappings AS mapped_count, total_mappings - successful_mappings AS unmapped_count
    FROM quality JOIN raw_fp USING (mapping_id) JOIN template_fp USING (mapping_id) JOIN entries USING (mapping_id)
""")
def registry_row(spark, sf_dir):
    """Whole configurations, but for their times, with entries and column lists as text."""
    q = [F.col(f"statistics.mapping_quality.{c}").alias(c) for c in ("high_confidence_mappings", "total_mappings", "successful_mappings")]
    rounded = [F.round(f"statistics.mapping_quality.{c}", 6).alias(c) for c in ("overall_score", "completeness", "average_confidence")]
    return _registry(spark, sf_dir).select(
        "mapping_id", "source_fingerprint", "template_fingerprint", _entries(F.col("mappings")).alias("entries"),
        F.array_join("column_info.template_columns", "|").alias("template_columns"), F.size("column_info.raw_columns").cast("long").alias("n_raw"),
        *rounded, *q, F.col("column_info.mapped_count").alias("mapped_count"), F.col("column_info.unmapped_count").alias("unmapped_count"),
    )


@query("registry_roundtrip", f"""
    WITH RECURSIVE {_LINE_CTE}, {_FPS}, {_ENTRIES_SQL}, quality AS ({_QUALITY_SQL})
    SELECT mapping_id, source_fingerprint, template_fingerprint, average_confidence, entries,
      successful_mappings AS mapped_count, n_raw
    FROM quality JOIN raw_fp USING (mapping_id) JOIN template_fp USING (mapping_id) JOIN entries USING (mapping_id)
""")
def registry_roundtrip(spark, sf_dir):
    back = R.import_json(R.export_json(_registry(spark, sf_dir)))
    return back.select(
        "mapping_id", "source_fingerprint", "template_fingerprint",
        F.round("statistics.mapping_quality.average_confidence", 6).alias("average_confidence"),
        _entries(F.col("mappings")).alias("entries"), F.col("column_info.mapped_count").alias("mapped_count"),
        F.size("column_info.raw_columns").cast("long").alias("n_raw"),
    )


@query("reusable_mappings", f"WITH RECURSIVE {_LINE_CTE} SELECT mapping_id, template_col, raw_col FROM lm WHERE raw_col IS NOT NULL")
def reusable_mappings(spark, sf_dir):
    return R.reusable_mappings(_registry(spark, sf_dir), ["mapping_id"])


# Later state of the tables: raw names change on every third order, templates on every fifth.
@query("schema_compat", f"""
    WITH advice AS (SELECT mapping_id AS config_id, mapping_id % 3 <> 0 AS r, mapping_id % 5 <> 0 AS t FROM (SELECT o_orderkey AS mapping_id FROM orders))
    SELECT config_id, r AND t AS is_compatible, r AS raw_structure_match, t AS template_structure_match, t AS can_reuse_mappings,
      CASE {' '.join(f"WHEN r = {r} AND t = {t} THEN {Q.quote(text)}" for (r, t), text in R.ADVICE.items())} END AS recommendation
    FROM advice
""")
def schema_compat(spark, sf_dir):
    registry = _registry(spark, sf_dir).select(F.col("mapping_id").alias("config_id"), "source_fingerprint", "template_fingerprint", "column_info")
    # Both sides come from these rows: stored, configurations are made once.
    registry = stored(registry, fresh_dir(spark, "registry"))
    later = lambda names, n: F.when(F.col("config_id") % n == 0, F.array_append(names, F.lit("extra"))).otherwise(names)
    current = registry.select(
        "config_id", R.fingerprint(later(F.reverse("column_info.raw_columns"), 3)).alias("raw_fingerprint"),
        R.fingerprint(later(F.reverse("column_info.template_columns"), 5)).alias("template_fingerprint"),
    )
    return R.schema_compat(current, registry)


@query("mapping_summary", f"""
    WITH RECURSIVE {_LINE_CTE}, {_FPS}, quality AS ({_QUALITY_SQL})
    SELECT mapping_id, printf('%d of %d template columns filled from %d source columns (%.1f%%), %d of them with high confidence; %d left open',
      successful_mappings, total_mappings, n_raw, completeness, high_confidence_mappings, total_mappings - successful_mappings) AS summary
    FROM quality JOIN raw_fp USING (mapping_id)
""")
def mapping_summary(spark, sf_dir):
    return R.mapping_summary(_registry(spark, sf_dir), ["mapping_id"])


_TEMPLATE = struct({"id": "long", "label": "string", "nation": "integer", "balance": "double", "segment": "string"})


def _feeds(spark, sf_dir):
    c, s, p = (table(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    return {
        "customer_a": c, "customer_b": c.select(*reversed(c.columns)), "supplier": s,
        "parts": p.select("p_partkey", "p_name", F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("price")),
    }


_STORED = {
    "customer_a": {"id": ("c_custkey", 0.9), "label": ("c_name", 0.9), "nation": ("c_nationkey", 0.9), "balance": ("c_acctbal", 0.9),
                   "segment": ("c_mktsegment", 0.9)},
    "supplier": {"id": ("s_suppkey", 0.9), "label": ("s_name", 0.9), "nation": ("s_nationkey", 0.9), "balance": ("s_acctbal", 0.9),
                 "segment": (None, 0.0)},
    "parts": {"id": ("p_partkey", 0.9), "label": ("p_name", 0.9), "nation": (None, 0.0), "balance": ("price", 0.9), "segment": (None, 0.0)},
}


@query("registry_apply", f"""
    SELECT c_custkey AS id, {Q.clean_text('c_name')} AS label, c_nationkey AS nation, c_acctbal AS balance, {Q.clean_text('c_mktsegment')} AS segment,
      f AS feed_id FROM customer, (SELECT unnest(['customer_a', 'customer_b']) AS f)
    UNION ALL SELECT s_suppkey, {Q.clean_text('s_name')}, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier
    UNION ALL SELECT p_partkey, {Q.clean_text('p_name')}, NULL, CAST(p_retailprice AS DECIMAL(18,2))::DOUBLE, NULL, 'parts' FROM part
""")
def registry_apply(spark, sf_dir):
    feeds = _feeds(spark, sf_dir)
    rows = [R.create_metadata(spark, feeds[f].columns, _TEMPLATE.names, m) for f, m in _STORED.items()]
    registry = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return R.apply_registry(feeds, registry, _TEMPLATE)


@query("stream_apply", f"""
    SELECT event_id AS id, ts AS at, {Q.clean_text('event_type')} AS kind, coalesce(value, 0) * 0 + value AS amount, CAST(NULL AS VARCHAR) AS note FROM events
""")
def stream_apply(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    template = struct({"id": "long", "at": "timestamp_ntz", "kind": "string", "amount": "double", "note": "string"})
    mapping = {"id": "event_id", "at": "ts", "kind": "event_type", "amount": "amount_text", "note": None}
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    messy = stream.withColumn("amount_text", F.concat(F.lit("$ "), F.col("value").cast("string")))
    out = fresh_dir(spark, "stream_apply")
    write_mapped_stream(map_stream(messy, mapping, template), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(template).parquet(f"{out}/data")
