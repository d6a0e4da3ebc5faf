"""Header text, pair scores and the candidate search."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from colweave.functions import headers as H
from colweave.functions import similarity as S
from colweave.operators import scoring
from colweave.operators.scoring import candidate_pairs, header_features, score_matrix, score_rows
from colweave.vocab import DEFAULT_VOCABULARY, Vocabulary


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_normalize(spark):
    got = column(spark, ["Cust_ID", " E-Mail.Addr ", "größe", "a__b c", "###", "Total ($)", "already plain"], H.normalize_header)
    assert got == ["customer id", "e mail address", "gre", "a b c", "", "total", "already plain"]


def test_normalize_keeps_letters_on_request(spark):
    assert column(spark, ["Größe_2"], lambda c: H.normalize_header(c, keep_unicode=True)) == ["größe 2"]


def test_tokens(spark):
    assert column(spark, ["a b a", ""], H.tokens) == [["a", "b"], []]


def test_hits_match_plain_search(spark):
    norms = ["hotel page", "customer id", "first name", "zip", "", "birth date"]
    terms = DEFAULT_VOCABULARY.normalised_terms()
    loose = [[i for i, ts in enumerate(terms) if any(t in n for t in ts)] for n in norms]
    whole = [[i for i, ts in enumerate(terms) if any(f" {t} " in f" {n} " for t in ts)] for n in norms]
    listed = [[i for i, ts in enumerate(terms) if n in ts] for n in norms]
    assert column(spark, norms, H.synonym_hits) == loose
    assert column(spark, norms, lambda c: H.synonym_hits(c, strict=True)) == whole
    assert column(spark, norms, H.synonym_exact) == listed


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def random_texts(n, seed, alphabet="abcde 1é", top=20):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, top))) for _ in range(n)]


def test_lcs_versions_agree(spark):
    left = random_texts(300, 1) + ["x" * 70 + "abc", "a" * 64, "", "ab" * 80]
    right = random_texts(300, 2) + ["abc" + "x" * 70, "a" * 65, "abc", "ba" * 80]
    want = [lcs(a, b) for a, b in zip(left, right)]
    assert S.lcs_lengths(left, right).tolist() == want
    df = spark.createDataFrame(list(zip(range(len(left)), left, right)), "i int, a string, b string").where("length(a) <= 40")
    for fn in (S.lcs_arrow, S.lcs_native):
        got = {r[0]: r[1] for r in df.select("i", fn(F.col("a"), F.col("b"))).collect()}
        assert got == {i: want[i] for i in got}


VECTORS = [
    ("Order-Date", "order_date", 100.0),
    ("email", "mail", 95.0),
    ("first name", "forename", 88.0),
    ("c_acctbal", "s_acctbal", 88.888889),
    ("customer id", "customer name", 79.605263),
    ("colour", "color", 90.909091),
    ("net weight", "weight", 95.0),
    ("net weight gross kg", "weight net kg", 95.0),
    ("red green blue", "red green black", 83.333333),
    ("###", "***", 0.0),
    ("alpha", "zzz", 0.0),
]


@pytest.mark.parametrize("lcs_fn", [S.lcs_arrow, S.lcs_native])
def test_score_vectors(spark, lcs_fn):
    df = spark.createDataFrame([(i, t, r) for i, (t, r, _) in enumerate(VECTORS)], "i int, t string, r string")
    got = score_rows(df, "t", "r", lcs=lcs_fn).orderBy("i").select(F.round("score", 6)).collect()
    assert [r[0] for r in got] == [v[2] for v in VECTORS]


def test_strict_mode(spark):
    df = spark.createDataFrame([(0, "customer id", "customer name"), (1, "hotel", "phone"), (2, "first name", "forename")], "i int, t string, r string")
    got = [r[0] for r in score_rows(df, "t", "r", strict=True).orderBy("i").select("score").collect()]
    assert got == [0.0, 0.0, 95.0]


def plain_ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def plain_fuzzy(t, r):
    tw, rw = set(t.split()), set(r.split())
    sort = plain_ratio(" ".join(sorted(t.split())), " ".join(sorted(r.split())))
    both, da, db = (" ".join(sorted(x)) for x in (tw & rw, tw - rw, rw - tw))
    if not tw or not rw:
        set_ = 0.0
    elif both and (not da or not db):
        set_ = 100.0
    else:
        ab, ba = (f"{both} {d}".strip() for d in (da, db))
        set_ = 100.0 * (1 - (len(da) + len(db) - 2 * lcs(da, db)) / (len(ab) + len(ba)))
        if both:
            set_ = max(set_, plain_ratio(both, ab), plain_ratio(both, ba))
    mean = (sort + set_) / 2
    return mean if mean >= 70 else 0.0


def plain_score(t, r, terms):
    if not t or not r:
        return 0.0
    if t == r:
        return 100.0
    for ts in terms:
        if any(x in t for x in ts) and any(x in r for x in ts):
            return 95.0 if t in ts and r in ts else 92.0 if t in ts or r in ts else 88.0
    tw, rw = set(t.split()), set(r.split())
    common = len(tw & rw)
    if common == min(len(tw), len(rw)):
        return 95.0
    if common / max(len(tw), len(rw)) > 0.5:
        return 70 + 20 * common / max(len(tw), len(rw))
    return plain_fuzzy(t, r)


def test_matrix_finds_every_pair_that_scores(spark):
    """Against all pairs scored in plain Python: letters, words and repeats in random mixtures."""
    rng = random.Random(5)
    stems = ["weight", "colour", "color", "net", "gross", "kg", "wieght", "flag", "fleg", "acctbal", "bal", "zone", "zoning", "a", "ab", "xy",
             "name", "id", "uuid", "town", "mail", "aaaa", "aaab", "abcabc", "cbacba", "1001", "1002", "fieldabcdefghijklmnopqrstuvwxyz"]
    make = lambda: " ".join(rng.choice(stems) for _ in range(rng.randint(1, 4)))
    left = sorted({make() for _ in range(120)}) + ["weight weight", "x" * 40, "###"]
    right = sorted({make() for _ in range(120)}) + ["weigth", "x" * 38 + "yy", ""]
    vocab = Vocabulary(abbreviations={})
    terms = vocab.normalised_terms()
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "column_name string")
    got = {(r.t_norm, r.r_norm): round(r.score, 6) for r in score_matrix(df(left), df(right), vocab=vocab).collect()}
    want = {}
    for t, r in itertools.product(left, right):
        score = plain_score(t.strip("#"), r, terms)
        if score > 0:
            want[(t, r)] = round(score, 6)
    assert got == want


def test_hot_key_parts_change_nothing(spark):
    """One word in every header: cutting its rows into parts gives the same pairs."""
    names = spark.range(300).select(F.concat(F.lit("field "), F.col("id").cast("string")).alias("norm"))
    t, r = header_features(names.where("id % 2 = 0")), header_features(names)
    whole = {(x.t_norm, x.r_norm) for x in candidate_pairs(t, r, chunk=None).collect()}
    cut = {(x.t_norm, x.r_norm) for x in candidate_pairs(t, r, chunk=7).collect()}
    assert whole == cut and len(whole) == 150 * 300


def test_no_pair_product_in_plan(spark):
    df = spark.createDataFrame([("a",)], "column_name string")
    plan = score_matrix(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert scoring.MICRO == 1_000_000


def test_vocabulary_is_data(spark):
    table = DEFAULT_VOCABULARY.synonym_table(spark)
    again = Vocabulary.from_tables(table, DEFAULT_VOCABULARY.abbreviation_table(spark))
    assert again.abbreviations == DEFAULT_VOCABULARY.abbreviations
    assert list(again.synonyms) == list(DEFAULT_VOCABULARY.synonyms)
    assert [set(x) for x in again.normalised_terms()] == [set(x) for x in DEFAULT_VOCABULARY.normalised_terms()]
    with pytest.raises(ValueError):
        Vocabulary.from_tables(table, DEFAULT_VOCABULARY.abbreviation_table(spark), max_rows=3)
    own = Vocabulary({"fruit": ["apple", "pear"]}, {})
    df = spark.createDataFrame([("apple", "pear")], "t string, r string")
    assert score_rows(df, "t", "r", own).first()["score"] == 95.0


def test_alignment_is_spread_over_tasks(spark, tmp_path):
    """A file of one row group is read by one task; aligning its headers is not left to that task."""
    from colweave.plans import load_all

    part = [(i, f"part {i % 7} name", i % 50) for i in range(500)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("score_fuzzy", "score_token_sort", "score_token_set"):
        df = load_all()[0][name](spark, str(tmp_path))
        assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n > 0).count() > 1
        assert df.count() == 500
