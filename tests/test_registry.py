"""Registry, feeds and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from colweave.operators import registry as R
from colweave.operators.transform import apply_mapping
from colweave.plans.core import struct
from colweave.streaming.apply import map_stream, write_mapped_stream

MAPPING = {"id": ("key", 1.0), "mail": ("e_mail", 0.88), "fon": ("tel", 0.6), "note": (None, 0.0)}
RAW, TEMPLATE = ["key", "e_mail", "tel", "spare"], ["id", "mail", "fon", "note"]


def plain_print(names):
    return hashlib.md5("|".join(sorted(names)).encode()).hexdigest()


@pytest.fixture(scope="module")
def registry(spark):
    return R.create_metadata(spark, RAW, TEMPLATE, MAPPING, {"rows": 3}, None)


def test_row(registry):
    r = registry.first()
    assert r.version == "1.0" and r.created_at == r.last_updated
    assert r.source_fingerprint == plain_print(RAW) and r.template_fingerprint == plain_print(reversed(TEMPLATE))
    assert r.mappings["mail"].asDict() == {"source_column": "e_mail", "confidence_score": 0.88, "mapping_type": "automatic"}
    assert r.mappings["fon"].mapping_type == "manual" and r.mappings["note"].source_column is None
    q = r.statistics.mapping_quality
    assert (q.completeness, q.high_confidence_mappings, q.total_mappings, q.successful_mappings) == (75.0, 2, 4, 3)
    assert q.average_confidence == pytest.approx((1 + 0.88 + 0.6) / 3)
    assert (r.column_info.raw_columns, r.column_info.mapped_count, r.column_info.unmapped_count) == (RAW, 3, 1)
    assert r.statistics.raw_data == {"rows": "3"}


def test_source_without_columns(spark):
    r = R.create_metadata(spark, [], ["id", "mail"], {"id": (None, 0.0), "mail": (None, 0.0)}).first()
    assert r.source_fingerprint == plain_print([]) and r.template_fingerprint == plain_print(["id", "mail"])
    assert (r.column_info.raw_columns, r.column_info.template_columns, r.column_info.unmapped_count) == ([], ["id", "mail"], 2)
    made = lambda rows, names: spark.createDataFrame(rows, names)
    mapping = made([("a", 0, "id", "key", 1.0), ("b", 0, "id", None, 0.0)], "k string, t_ord int, template_col string, raw_col string, confidence double")
    columns = "k string, ordinal int, column_name string"
    rows = R.registry_rows(mapping, made([("a", 0, "key")], columns), made([("a", 0, "id"), ("b", 0, "id")], columns), ["k"]).collect()
    assert {x.k: (x.column_info.raw_columns, x.mappings["id"].source_column) for x in rows} == {"a": (["key"], "key"), "b": ([], None)}


def test_json_round_trip(registry):
    texts = R.export_json(registry)
    doc = json.loads(texts.first()["config"])
    assert doc["mappings"]["note"]["source_column"] is None and doc["column_info"]["template_columns"] == TEMPLATE
    back = R.import_json(texts).select("mappings", "statistics", "column_info", "source_fingerprint").first()
    assert back == registry.select("mappings", "statistics", "column_info", "source_fingerprint").first()


@pytest.mark.parametrize("text", ["{not json", "{}", '{"mappings": 3}'])
def test_import_rejects(spark, text):
    with pytest.raises(Exception):
        R.import_json(spark.createDataFrame([(text,)], "config string")).collect()


def test_reuse_and_summary(registry):
    got = {r.template_col: r.raw_col for r in R.reusable_mappings(registry).collect()}
    assert got == {"id": "key", "mail": "e_mail", "fon": "tel"}
    text = R.mapping_summary(registry).first().summary
    assert text.startswith("3 of 4 template columns filled from 4 source columns (75.0%)") and "1 left open" in text


def test_compatibility(spark, registry):
    stored = registry.withColumn("config_id", F.lit(1))
    a, b = plain_print(RAW), plain_print(TEMPLATE)
    current = spark.createDataFrame(
        [(i, 1, r, t) for i, (r, t) in enumerate([(a, b), ("?", b), (a, "?"), ("?", "?")])] + [(4, 9, a, b)],
        "i int, config_id int, raw_fingerprint string, template_fingerprint string",
    )
    got = {r.i: (r.is_compatible, r.can_reuse_mappings, r.recommendation) for r in R.schema_compat(current, stored).collect()}
    assert got[0] == (True, True, R.ADVICE[True, True]) and got[1] == (False, True, R.ADVICE[False, True])
    assert got[2][2] == R.ADVICE[True, False] and got[3][2] == R.ADVICE[False, False] and got[4][2] == R.ADVICE[False, False]


def test_empty_mapping_summary(spark):
    quality = R.mapping_quality(spark.createDataFrame([], "raw_col string, confidence double")).first()
    assert (quality.overall_score, quality.total_mappings) == (0.0, 0)


SHAPE = struct({"id": "long", "mail": "string", "fon": "string", "note": "string"})


def test_apply_registry(spark, registry):
    a = spark.createDataFrame([(1, " a@b.cd ", "1", "s")], "key long, e_mail string, tel string, spare string")
    b = spark.createDataFrame([("x", "2", "N/A", 2)], "spare string, tel string, e_mail string, key long")
    out = R.apply_registry({"a": a, "b": b, "c": a}, registry, SHAPE)
    assert {tuple(r) for r in out.collect()} == {(1, "a@b.cd", "1", None, "a"), (2, None, "2", None, "b"), (1, "a@b.cd", "1", None, "c")}
    with pytest.raises(LookupError):
        R.apply_registry({"x": spark.range(1)}, registry, SHAPE)


def test_latest_mapping_wins(spark, registry):
    newer = R.create_metadata(spark, RAW, TEMPLATE, {"id": ("spare", 1.0)}).withColumn("last_updated", F.lit("9999"))
    got = R.stored_mappings(registry.unionByName(newer), [plain_print(RAW)], plain_print(TEMPLATE))
    assert got == {plain_print(RAW): {"id": ("spare", 1.0)}}


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.range(100).selectExpr("id as key", "concat('$', id) as price", "if(id % 3 = 0, 'N/A', 'x ') as n")
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    template = struct({"id": "long", "amount": "double", "name": "string", "gap": "integer"})
    mapping = {"id": "key", "amount": "price", "name": "n", "gap": None}
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        write_mapped_stream(map_stream(stream, mapping, template), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in apply_mapping(raw, mapping, template).collect()} and len(got) == 100
    with pytest.raises(ValueError):
        map_stream(raw, mapping, template)


def test_entries_move_without_what_follows_from_them(spark):
    made = lambda rows, names: spark.createDataFrame(rows, names)
    mapping = made([("a", 0, "id", "key", 0.9), ("a", 1, "x", None, None)], "k string, t_ord int, template_col string, raw_col string, confidence double")
    columns = made([("a", 0, "key")], "k string, ordinal int, column_name string")
    got = R.reusable_mappings(R.registry_rows(mapping, columns, columns, ["k"]), ["k"])
    assert [tuple(r) for r in got.collect()] == [("a", "id", "key")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "partial_collect_list" in line]
    assert moved and not any("automatic" in line for line in moved)


def test_configurations_without_a_template_catalog_move_a_mapping_once(spark):
    rows = [(m, t, f"t{t}", f"r{t}" if t % 2 else None, 0.9 if t % 2 else 0.0) for m in range(4) for t in (2, 0, 1)]
    mapping = spark.createDataFrame(rows, "m long, t_ord int, template_col string, raw_col string, confidence double")
    raw = spark.createDataFrame([(m, i, f"r{i}") for m in range(3) for i in range(2)], "m long, ordinal int, column_name string")
    template = mapping.select("m", F.col("t_ord").alias("ordinal"), F.col("template_col").alias("column_name"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once, twice = (R.registry_rows(mapping, raw, t, ["m"]).drop("created_at", "last_updated") for t in (None, template))
        moves = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (once, twice)]
        assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert moves == [2, 3]
    assert {r.m: (r.column_info.template_columns, r.column_info.raw_columns) for r in once.collect()}[3] == (["t0", "t1", "t2"], [])


def test_compatibility_makes_configurations_once(spark):
    from colweave.plans.registry_queries import schema_compat

    checked = schema_compat(spark, "/root/testdata/sf0.001")
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("FileScan") == 2
    assert checked.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
