"""Profiles and shared values, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colweave.operators import mapping as M
from colweave.operators import profiling as P
from colweave.operators import shared_values as S


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"u{i}@x.org", "555-1234", f"${i}.50", "2024-01-0" + str(i % 9 + 1), " N/A ", i * 100000 + 123456, None) for i in range(30)]
    return spark.createDataFrame(rows, "id int, mail string, tel string, price string, day string, blank string, big long, none string")


WANT = {"id": "numeric", "mail": "email", "tel": "phone", "price": "numeric", "day": "date", "blank": "empty", "big": "numeric", "none": "empty"}


def test_patterns(people):
    assert {r.column_name: r.pattern for r in P.profile_patterns_full(people).collect()} == WANT
    assert {r.column_name: r.pattern for r in P.profile_patterns(people, ["id"]).collect()} == WANT


def test_patterns_look_at_the_first_values_only(spark):
    rows = [(i, f"a{i}@b.cd" if i < 10 else "text") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    assert {r.column_name: r.pattern for r in P.profile_patterns(df, ["k"]).collect()}["v"] == "email"
    assert {r.column_name: r.pattern for r in P.profile_patterns_full(df).collect()}["v"] == "text"


def test_first_values_limit_before_the_shuffle(people):
    plan = P.first_values(people, ["id"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]


def test_phone_beats_numeric_for_text_only(spark):
    df = spark.createDataFrame([("20240115", 20240115)], "t string, n int")
    assert [r.pattern for r in P.profile_patterns_full(df).orderBy("ordinal").collect()] == ["phone", "numeric"]


def test_one_scan(people, spark, tmp_path):
    people.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for out in (P.profile_patterns_full(df), P.completeness(df), P.column_width(df)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1


def test_completeness_and_shape(people, spark):
    got = P.completeness(people).first()
    assert (got.total_rows, got.total_columns, got.null_cells, got.completeness) == (30, 8, 30, 87.5)
    assert P.completeness(people.limit(0)).first().completeness == 100.0
    assert tuple(P.table_shape(people).first()) == (30, 8)


def test_schema_profile_preview_width(people):
    got = {r.column_name: r for r in P.schema_profile(people, ["id"]).collect()}
    assert got["price"].sample_values == ["$0.50", "$1.50", "$2.50"] and got["none"].null_count == 30
    assert got["none"].sample_values == [] and got["id"].dtype == "int"
    first = P.preview(people, ["id"]).collect()
    assert len(first) == 5 and first[0]["none"] == "" and first[1]["id"] == "1"
    width = {r.column_name: r.width for r in P.column_width(people).collect()}
    assert width["mail"] == 13 and width["none"] == 8


def test_sample_is_repeatable(people):
    pick = lambda df: {r.id for r in P.sample_rows(df, 7, ["id"], seed=3).collect()}
    assert len(pick(people)) == 7 and pick(people) == pick(people.repartition(5))


def plain_shared(rows, names):
    cols = {}
    for i, n in enumerate(names):
        vals = [r[i] for r in rows if r[i] is not None]
        if vals and len(set(vals)) <= 0.9 * len(vals):
            cols[n] = {str(v).strip() for v in vals} - {""}
    out = set()
    keys = [n for n in names if cols.get(n)]
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common, smaller = len(cols[a] & cols[b]), min(len(cols[a]), len(cols[b]))
            if common / smaller > 0.1:
                out.add((a, b, common, smaller, int(common / smaller * 100)))
    return out


@pytest.mark.parametrize("n_cols", [6, 70])
def test_shared_values(spark, n_cols):
    """Also with more columns than one bit set holds; a third of all cells hold one value."""
    rng = random.Random(n_cols)
    names = [f"c{i}" for i in range(n_cols)]
    pool = [[f"{rng.choice(['', ' '])}{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12))] + ["", None] for _ in names]
    rows = [tuple("hot" if rng.random() < 0.33 else rng.choice(pool[i]) for i in range(n_cols - 1)) + (f"unique{k}",) for k in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    want = plain_shared(rows, names)
    assert {tuple(r) for r in S.shared_values(df).collect()} == want
    if n_cols < 10:
        sketch = {(r.col_a, r.col_b, r.n_common) for r in S.shared_values_sketch(df).collect()}
        assert sketch == {(a, b, n) for a, b, n, _, _ in want}


def test_report_and_flags(spark):
    df = spark.createDataFrame([("a", "a", "q")] * 20 + [("b", "a", "r")] * 20, "x string, y string, z string")
    shared = S.shared_values(df)
    report = {r.column_name: r.overlaps for r in S.contamination_report(shared).collect()}
    assert report == {"x": ["y (100% overlap)"], "y": ["x (100% overlap)"]}
    mapping = M.mapping_table(spark, {"t1": "x", "t2": "z"}, ["x", "y", "z"])
    assert {r.template_col: r.shares_values for r in M.mapping_flags(mapping, shared).collect()} == {"t1": True, "t2": False}


def test_cardinality(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("m"))
    for exact in (True, False):
        assert {r.column_name: r.high_cardinality for r in S.cardinality(df, exact).collect()} == {"id": True, "m": False}


def test_distinct_limit_counts_only_what_a_sketch_leaves_open(spark):
    n = 20_000
    id_ = F.col("id")
    df = spark.range(n).select(
        id_.alias("all"), (id_ % 7).alias("few"), F.lit(None).cast("int").alias("none"),
        F.least(id_, F.lit(int(0.9 * n) - 1)).alias("at_limit"), F.least(id_, F.lit(int(0.9 * n))).alias("above"),
        F.when(id_ % 2 == 0, id_.cast("string")).alias("half_null"), F.array(id_).alias("nested"),
    )
    got = {r.column_name: (r.n_values, r.high_cardinality, r.counted) for r in S.distinct_limit(df).collect()}
    assert got == {
        "all": (n, True, False), "few": (n, False, False), "none": (0, False, False), "at_limit": (n, False, True),
        "above": (n, True, True), "half_null": (n // 2, True, False),
    }
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "z double")
    assert not S.distinct_limit(zeros).first().high_cardinality
    assert S.distinct_limit(zeros.limit(0)).first().n_values == 0 and S.distinct_limit(df.select("nested")).count() == 0


def test_nested_columns_are_left_out(spark):
    df = spark.createDataFrame([("a", "a", [1])] * 5, "x string, y string, l array<int>")
    assert [(r.col_a, r.col_b) for r in S.shared_values(df).collect()] == [("x", "y")]
