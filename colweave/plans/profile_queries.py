"""Queries over column profiles and shared values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as M
from ..operators import profiling as P
from ..operators import shared_values as S
from . import inputs as I
from . import sql_text as Q
from .core import query, table


def _pattern_sql(n="n_values"):
    return f"""CASE WHEN {n} = 0 THEN 'empty' WHEN n_email = {n} THEN 'email' WHEN n_phone = {n} THEN 'phone'
               WHEN n_numeric * 2 >= {n} THEN 'numeric' WHEN n_date * 2 >= {n} THEN 'date' ELSE 'text' END"""


def _counts_sql(v: str) -> str:
    return f"""count({v}) AS n_values, count(*) FILTER ({Q.is_email(v)}) AS n_email, count(*) FILTER ({Q.is_phone(v)}) AS n_phone,
               count(*) FILTER ({Q.is_number(v)}) AS n_numeric, count(*) FILTER ({Q.is_date(v)}) AS n_date"""


_MESSY_COLS = ["amount_text", "date_text", "note_text", "contact_text"]


def _typed_row(i: int, name: str, src: str, kind: str) -> str:
    counts = ", ".join(f"{'count(' + name + ')' if kind == k else '0::BIGINT'} AS n_{k}" for k in ("email", "phone", "numeric", "date"))
    return f"""SELECT {i} AS ordinal, '{name}' AS column_name, count({name}) AS n_values, {counts},
               CASE WHEN count({name}) = 0 THEN 'empty' ELSE '{kind}' END AS pattern FROM {src}"""


def _text_row(i: int, name: str, src: str) -> str:
    return f"""SELECT {i} AS ordinal, '{name}' AS column_name, *, {_pattern_sql()} AS pattern
               FROM (SELECT {_counts_sql('v')} FROM (SELECT {Q.clean_text(name)} AS v FROM {src}))"""


@query("profile_patterns_full", f"WITH messy AS ({I.MESSY_SQL}) " + " UNION ALL ".join(
    [_typed_row(0, "o_orderkey", "messy", "numeric")] + [_text_row(i + 1, c, "messy") for i, c in enumerate(_MESSY_COLS)]))
def profile_patterns_full(spark, sf_dir):
    return P.profile_patterns_full(I.messy_orders(spark, sf_dir))


def _first_sql(src: str, key: str, cols: list[tuple[str, bool]], n: int, clean: bool = True) -> str:
    """The first n values per column, by key."""
    parts = []
    for i, (c, is_text) in enumerate(cols):
        v = Q.clean_text(c) if is_text and clean else f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT {i} AS ordinal, v, rn FROM (
            SELECT v, row_number() OVER (ORDER BY {key}) AS rn FROM (SELECT {key}, {v} AS v FROM {src}) WHERE v IS NOT NULL) WHERE rn <= {n}""")
    return " UNION ALL ".join(parts)


_PROFILE_COLS = [("o_orderkey", False)] + [(c, True) for c in _MESSY_COLS]


@query("profile_patterns", f"""
    WITH messy AS ({I.MESSY_SQL}), firsts AS ({_first_sql('messy', 'o_orderkey', _PROFILE_COLS, 10)}),
    counts AS (SELECT ordinal, {_counts_sql('v')} FROM firsts GROUP BY ordinal),
    names AS (SELECT unnest(range({len(_PROFILE_COLS)}))::INTEGER AS ordinal, unnest({[c for c, _ in _PROFILE_COLS]!r}) AS column_name)
    SELECT ordinal, column_name, CASE WHEN n_values IS NULL THEN 'empty' WHEN ordinal = 0 THEN 'numeric' ELSE {_pattern_sql()} END AS pattern
    FROM names LEFT JOIN counts USING (ordinal)
""")
def profile_patterns(spark, sf_dir):
    return P.profile_patterns(I.messy_orders(spark, sf_dir), ["o_orderkey"])


# Pattern of a text column per group: every customer's contact texts.
@query("pattern_detect", f"""
    SELECT o_custkey, {_pattern_sql()} AS pattern FROM (
      SELECT o_custkey, {_counts_sql('v')} FROM (
        SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'user' || o_custkey || '@mail.example.com'
          WHEN o_custkey % 4 = 1 THEN '+49 30 1234-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
          WHEN o_custkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%m-%d')
          WHEN o_custkey % 4 = 3 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) ELSE o_orderpriority END AS v FROM orders)
      GROUP BY o_custkey)
""")
def pattern_detect(spark, sf_dir):
    from ..functions import values as V

    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    v = (
        F.when(key % 3 == 0, F.concat(F.lit("user"), cust.cast("string"), F.lit("@mail.example.com")))
        .when(cust % 4 == 1, F.concat(F.lit("+49 30 1234-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .when(cust % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(cust % 4 == 3, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .otherwise(F.col("o_orderpriority"))
    )
    texts = table(spark, sf_dir, "orders").select("o_custkey", v.alias("v"))
    c = F.col("v")
    pattern = V.pattern_of(
        F.count("v"), F.count_if(V.is_email(c)), F.count_if(V.is_phone(c)), F.count_if(V.is_number_text(c)), F.count_if(V.is_date_text(c))
    )
    return texts.groupBy("o_custkey").agg(pattern.alias("pattern"))


def _code_table(spark, sf_dir):
    """Orders joined with their customers' codes: columns with shared and unshared values."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        "o_orderkey", "o_custkey",
        (key % 40).cast("string").alias("slot"), F.concat(F.lit(" "), (cust % 25).cast("string")).alias("zone"),
        (cust % 300 + 20).alias("batch"), "o_orderstatus", F.length("o_orderpriority").cast("string").alias("rank"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).when(key % 3 == 1, "").alias("stage"),
        F.lit(None).cast("string").alias("nothing"),
    )


_CODE_SQL = """
    SELECT o_orderkey, o_custkey, CAST(o_orderkey % 40 AS VARCHAR) AS slot, ' ' || (o_custkey % 25) AS zone, o_custkey % 300 + 20 AS batch,
      o_orderstatus, CAST(length(o_orderpriority) AS VARCHAR) AS rank,
      CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN '' END AS stage, CAST(NULL AS VARCHAR) AS nothing FROM orders
"""
_CODE_COLS = ["o_orderkey", "o_custkey", "slot", "zone", "batch", "o_orderstatus", "rank", "stage", "nothing"]

_SHARED_CTES = f"""
    codes AS ({_CODE_SQL}),
    long AS ({' UNION ALL '.join(f"SELECT {i} AS c, CAST({col} AS VARCHAR) AS v FROM codes" for i, col in enumerate(_CODE_COLS))}),
    ok AS (SELECT c FROM long GROUP BY c HAVING count(v) > 0 AND count(DISTINCT v) <= 0.9 * count(v)),
    vals AS (SELECT DISTINCT c, trim(v) AS v FROM long JOIN ok USING (c) WHERE trim(v) <> ''),
    sizes AS (SELECT c, count(*) AS n FROM vals GROUP BY c),
    meets AS (SELECT a.c AS a, b.c AS b, count(*) AS n_common FROM vals a JOIN vals b ON a.v = b.v AND a.c < b.c GROUP BY ALL),
    report AS (
      SELECT ({_CODE_COLS!r})[a + 1] AS col_a, ({_CODE_COLS!r})[b + 1] AS col_b, n_common, least(x.n, y.n) AS n_smaller,
        CAST(floor(n_common::DOUBLE / least(x.n, y.n) * 100) AS INTEGER) AS overlap_pct
      FROM meets JOIN sizes x ON x.c = a JOIN sizes y ON y.c = b WHERE n_common::DOUBLE / least(x.n, y.n) > 0.1)
"""


@query("contamination_exact", f"WITH {_SHARED_CTES} SELECT * FROM report")
def contamination_exact(spark, sf_dir):
    return S.shared_values(_code_table(spark, sf_dir))


@query("contamination_report", f"""
    WITH {_SHARED_CTES},
    notes AS (SELECT col_a AS column_name, col_b || ' (' || overlap_pct || '% overlap)' AS note FROM report
              UNION ALL SELECT col_b, col_a || ' (' || overlap_pct || '% overlap)' FROM report)
    SELECT column_name, string_agg(note, '; ' ORDER BY note) AS overlaps FROM notes GROUP BY column_name
""")
def contamination_report(spark, sf_dir):
    report = S.contamination_report(S.shared_values(_code_table(spark, sf_dir)))
    return report.select("column_name", F.array_join("overlaps", "; ").alias("overlaps"))


@query("contamination_sketch")
def contamination_sketch(spark, sf_dir):
    return S.shared_values_sketch(_code_table(spark, sf_dir))


_SAMPLE_SQL = f"codes AS (SELECT * FROM ({_CODE_SQL}) ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 100)"


@query("contamination_sampled", f"WITH {_SHARED_CTES.replace(f'codes AS ({_CODE_SQL})', _SAMPLE_SQL)} SELECT * FROM report")
def contamination_sampled(spark, sf_dir):
    return S.shared_values_sampled(_code_table(spark, sf_dir), 100, ["o_orderkey"], seed=7)


@query("high_cardinality_cols", f"""
    WITH codes AS ({_CODE_SQL}),
    long AS ({' UNION ALL '.join(f"SELECT '{col}' AS column_name, CAST({col} AS VARCHAR) AS v FROM codes" for col in _CODE_COLS)})
    SELECT column_name, count(v) AS n_values, count(DISTINCT v) AS n_distinct, count(DISTINCT v) > 0.9 * count(v) AS high_cardinality
    FROM long GROUP BY column_name
""")
def high_cardinality_cols(spark, sf_dir):
    return S.cardinality(_code_table(spark, sf_dir))


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("distinct_limit_cols", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(DISTINCT {c}) > 0.9 * count({c}) AS high_cardinality FROM orders"
    for c in _ORDER_COLS))
def distinct_limit_cols(spark, sf_dir):
    return S.distinct_limit(table(spark, sf_dir, "orders").select(*_ORDER_COLS)).drop("counted")


@query("mapping_flags", f"""
    WITH {_SHARED_CTES},
    m AS (SELECT unnest({_CODE_COLS!r}) AS raw_col)
    SELECT 'target ' || raw_col AS template_col, raw_col,
      raw_col IN (SELECT col_a FROM report UNION SELECT col_b FROM report) AS shares_values FROM m
""")
def mapping_flags(spark, sf_dir):
    codes = _code_table(spark, sf_dir)
    mapping = M.mapping_table(spark, {f"target {c}": c for c in codes.columns}, codes.columns)
    return M.mapping_flags(mapping, S.shared_values(codes)).select("template_col", "raw_col", "shares_values")


@query("sample_rows", "SELECT * FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 100")
def sample_rows(spark, sf_dir):
    return P.sample_rows(table(spark, sf_dir, "orders"), 100, ["o_orderkey"], seed=7)


_CLEAN_SQL = f"SELECT o_orderkey, {', '.join(f'{Q.clean_text(c)} AS {c}' for c in _MESSY_COLS)} FROM ({I.MESSY_SQL})"


@query("completeness", f"""
    SELECT count(*) AS total_rows, 5::BIGINT AS total_columns,
      count(*) * 4 - count(amount_text) - count(date_text) - count(note_text) - count(contact_text) AS null_cells,
      round((1 - (count(*) * 4 - count(amount_text) - count(date_text) - count(note_text) - count(contact_text))::DOUBLE / (count(*) * 5)) * 100, 1)
        AS completeness FROM ({_CLEAN_SQL})
""")
def completeness(spark, sf_dir):
    from ..operators.transform import clean_table

    return P.completeness(clean_table(I.messy_orders(spark, sf_dir)))


@query("completeness_events", """
    SELECT count(*) AS total_rows, 6::BIGINT AS total_columns,
      count(*) * 6 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props) AS null_cells,
      round((1 - (count(*) * 6 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props))::DOUBLE
        / (count(*) * 6)) * 100, 1) AS completeness FROM events
""")
def completeness_events(spark, sf_dir):
    return P.completeness(table(spark, sf_dir, "events"))


@query("table_shape", "SELECT count(*) AS total_rows, 11::BIGINT AS total_columns FROM lineitem")
def table_shape(spark, sf_dir):
    return P.table_shape(table(spark, sf_dir, "lineitem"))


_SCHEMA_COLS = [("o_orderkey", "bigint", False)] + [(c, "string", True) for c in _MESSY_COLS]


@query("schema_profile", f"""
    WITH clean AS ({_CLEAN_SQL}), firsts AS ({_first_sql('clean', 'o_orderkey', [(c, t) for c, _, t in _SCHEMA_COLS], 3, clean=False)}),
    samples AS (SELECT ordinal, string_agg(v, '|' ORDER BY rn) AS sample_values FROM firsts GROUP BY ordinal),
    base AS ({' UNION ALL '.join(f"SELECT {i} AS ordinal, '{c}' AS column_name, '{d}' AS dtype, count(*) - count({c}) AS null_count FROM clean"
                                 for i, (c, d, _) in enumerate(_SCHEMA_COLS))})
    SELECT ordinal, column_name, dtype, null_count, coalesce(sample_values, '') AS sample_values FROM base LEFT JOIN samples USING (ordinal)
""")
def schema_profile(spark, sf_dir):
    from ..operators.transform import clean_table

    profile = P.schema_profile(clean_table(I.messy_orders(spark, sf_dir)), ["o_orderkey"])
    return profile.withColumn("sample_values", F.array_join("sample_values", "|"))


@query("preview", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {', '.join(f"coalesce({c}, '') AS {c}" for c in _MESSY_COLS)}
    FROM ({_CLEAN_SQL}) t ORDER BY t.o_orderkey LIMIT 5
""")
def preview(spark, sf_dir):
    from ..operators.transform import clean_table

    return P.preview(clean_table(I.messy_orders(spark, sf_dir)), ["o_orderkey"])


_WIDTHS = ["doc_id", "text", "lang", "source", "n_chars"]


@query("column_width", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(least(greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}) + 4, 60) AS INTEGER) AS width FROM documents"
    for c in _WIDTHS))
def column_width(spark, sf_dir):
    return P.column_width(table(spark, sf_dir, "documents"))
