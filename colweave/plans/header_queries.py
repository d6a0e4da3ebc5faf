"""Queries over header text and header pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import similarity as S
from ..operators.scoring import score_matrix, score_rows
from . import inputs as I
from . import sql_text as Q
from .core import query, table

_T, _R = "t_norm", "r_norm"

_NORMED_SQL = f"SELECT *, {Q.norm('t_header')} AS t_norm, {Q.norm('r_header')} AS r_norm FROM ({I.PAIRS_SQL})"


def _normed(spark, sf_dir):
    pairs = I.header_pairs(spark, sf_dir)
    return pairs.select(
        "p_partkey", H.normalize_header(F.col("t_header")).alias(_T), H.normalize_header(F.col("r_header")).alias(_R)
    )


def _scored_sql(column: str) -> str:
    return f"""
    WITH RECURSIVE normed AS ({_NORMED_SQL}),
    {Q.score_ctes('SELECT DISTINCT t_norm, r_norm FROM normed')}
    SELECT p_partkey, round(coalesce({column}, 0), 6) AS score FROM normed JOIN scored USING (t_norm, r_norm)
    """


def _spread(df):
    """Rows over several tasks a core: a small file of parts is one block, and its alignment would be one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "p_partkey")


def _result(df, score):
    return df.select("p_partkey", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"))


@query("hdr_strip", """
    SELECT c_custkey AS customer, c_name AS "c name", trim(' ' || c_mktsegment || ' ') AS segment FROM customer
""")
def hdr_strip(spark, sf_dir):
    from ..operators.transform import tidy_headers

    c = table(spark, sf_dir, "customer")
    untidy = c.select(F.col("c_custkey").alias(" customer"), F.col("c_name").alias("c name "), F.col("c_mktsegment").alias("\tsegment "))
    return tidy_headers(untidy)


@query("hdr_normalize", f"SELECT p_partkey, t_norm, r_norm FROM ({_NORMED_SQL})")
def hdr_normalize(spark, sf_dir):
    return _normed(spark, sf_dir)


@query("hdr_tokens", f"""
    SELECT p_partkey, array_to_string(list_sort({Q.tokens('r_norm')}), '|') AS tokens, CAST(len({Q.tokens('r_norm')}) AS INTEGER) AS n_tokens
    FROM (SELECT *, {Q.norm('r_header')} AS r_norm FROM (SELECT p_partkey, r_header || ' ' || t_header AS r_header FROM ({I.PAIRS_SQL})))
""")
def hdr_tokens(spark, sf_dir):
    both = I.header_pairs(spark, sf_dir).select("p_partkey", F.concat_ws(" ", "r_header", "t_header").alias("h"))
    normed = both.select("p_partkey", H.normalize_header(F.col("h")).alias("n"))
    toks = H.tokens(F.col("n"))
    return normed.select("p_partkey", F.array_join(F.array_sort(toks), "|").alias("tokens"), F.size(toks).alias("n_tokens"))


@query("score_exact", f"""
    SELECT p_partkey, CASE WHEN t_norm = r_norm AND t_norm <> '' THEN 100.0::DOUBLE ELSE 0.0 END AS score FROM (
      SELECT p_partkey, {Q.norm("r_header")} AS t_norm, {Q.norm("upper(replace(r_header, ' ', '-'))")} AS r_norm FROM ({I.PAIRS_SQL}))
""")
def score_exact(spark, sf_dir):
    r = F.col("r_header")
    pairs = I.header_pairs(spark, sf_dir).select(
        "p_partkey", H.normalize_header(r).alias(_T), H.normalize_header(F.upper(F.translate(r, " ", "-"))).alias(_R)
    )
    return _result(pairs, S.exact_score(F.col(_T), F.col(_R)))


@query("score_synonym", _scored_sql("synonym_score"))
def score_synonym(spark, sf_dir):
    t, r = F.col(_T), F.col(_R)
    score = S.synonym_score(H.synonym_hits(t), H.synonym_exact(t), H.synonym_hits(r), H.synonym_exact(r))
    return _result(_normed(spark, sf_dir), score)


@query("score_subset", _scored_sql("subset_score"))
def score_subset(spark, sf_dir):
    return _result(_normed(spark, sf_dir), S.subset_score(H.tokens(F.col(_T)), H.tokens(F.col(_R))))


@query("score_overlap", _scored_sql("overlap_score"))
def score_overlap(spark, sf_dir):
    return _result(_normed(spark, sf_dir), S.overlap_score(H.tokens(F.col(_T)), H.tokens(F.col(_R))))


@query("score_token_sort", _scored_sql("sort_ratio"))
def score_token_sort(spark, sf_dir):
    return _result(_spread(_normed(spark, sf_dir)), S.token_sort_ratio(F.col(_T), F.col(_R)))


@query("score_token_set", _scored_sql("set_ratio"))
def score_token_set(spark, sf_dir):
    return _result(_spread(_normed(spark, sf_dir)), S.token_set_ratio(F.col(_T), F.col(_R)))


@query("score_fuzzy", _scored_sql("fuzzy_score"))
def score_fuzzy(spark, sf_dir):
    return _result(_spread(_normed(spark, sf_dir)), S.fuzzy_score(F.col(_T), F.col(_R)))


@query("score_cascade", f"""
    WITH RECURSIVE normed AS ({_NORMED_SQL}),
    {Q.score_ctes('SELECT DISTINCT t_norm, r_norm FROM normed')}
    SELECT p_partkey, round(score, 6) AS score FROM normed JOIN final USING (t_norm, r_norm)
""")
def score_cascade(spark, sf_dir):
    return _result(score_rows(I.header_pairs(spark, sf_dir), "t_header", "r_header"), F.col("score"))


@query("score_matrix", f"""
    WITH RECURSIVE normed AS ({_NORMED_SQL}),
    {Q.score_ctes('''SELECT t_norm, r_norm FROM (SELECT DISTINCT t_norm FROM normed WHERE t_norm <> '')
                     CROSS JOIN (SELECT DISTINCT r_norm FROM normed WHERE r_norm <> '')''')}
    SELECT t_norm, r_norm, round(score, 6) AS score FROM final WHERE score > 0
""")
def score_matrix_query(spark, sf_dir):
    pairs = I.header_pairs(spark, sf_dir)
    return score_matrix(pairs, pairs, "t_header", "r_header").select("t_norm", "r_norm", F.round("score", 6).alias("score"))
