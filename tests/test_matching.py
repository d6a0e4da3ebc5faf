"""Assignment, promotion and review of mappings."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colweave.functions.headers import normalize_header
from colweave.operators import assignment as A
from colweave.operators import mapping as M
from colweave.operators import table_pairs
from colweave.operators.catalog import column_catalog, schema_drift, schema_fingerprints, shape_keys
from colweave.operators.scoring import SCORED, header_features, header_struct, may_score, positive_scores, requested_pairs, with_scores
from colweave.operators.sparse_matching import heaviest_matching
from colweave.operators.table_pairs import PairScores


def brute(weight):
    n, m = weight.shape
    best = None
    for choice in itertools.product(range(m + 1), repeat=n):
        used = [c for c in choice if c < m]
        if len(set(used)) < len(used) or any(c < m and weight[i, c] == 0 for i, c in enumerate(choice)):
            continue
        key = (-sum(int(weight[i, c]) for i, c in enumerate(choice) if c < m), choice)
        best = key if best is None or key < best else best
    return [c if c < m else -1 for c in best[1]]


def random_weights(n_cases, top=5):
    rng = random.Random(3)
    for _ in range(n_cases):
        n, m = rng.randint(1, top), rng.randint(1, top)
        values = rng.choice([[0, 88], [0, 88, 95], [0, 70, 88, 92, 100], list(range(5))])
        yield np.array([[rng.choice(values) for _ in range(m)] for _ in range(n)], dtype=np.int64)


def test_solver_is_best_and_first(spark):
    for w in random_weights(1500):
        want = brute(w)
        assert A.solve_component(w) == want
        edges = [(i, j, int(w[i, j])) for i, j in zip(*np.nonzero(w))]
        got = {t: r for t, r, _ in A.solve_edges(edges)} if edges else {}
        assert [got.get(i, -1) for i in range(len(w))] == want


def test_assign_prunes_without_loss(spark):
    """Wide raw tables, random partitioning; pruned assignment equals brute force."""
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(40):
        n, m = rng.randint(1, 3), rng.randint(1, 6)
        w = np.array([[rng.choice([0, 88, 92, 95]) for _ in range(m)] for _ in range(n)], dtype=np.int64)
        rows += [(g, i, j, int(w[i, j]), n, m) for i in range(n) for j in range(m) if w[i, j]]
        want[g] = {(i, j) for i, j in enumerate(brute(w)) if j >= 0}
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "g int, t_ord int, r_ord int, micro long, n_template int, n_raw int").repartition(5)
    got = {g: set() for g in want}
    for r in A.assign(edges, ["g"]).collect():
        got[r.g].add((r.t_ord, r.r_ord))
    assert got == want


def test_match_headers(spark):
    raw = ["Cust ID", "Full Name", "E-Mail", "Mobile"]
    got = M.mapping_dict(A.match_headers(spark, raw, ["identifier", "name", "email", "phone", "shoe size"]))
    assert {k: v[0] for k, v in got.items()} == {
        "identifier": "Cust ID", "name": "Full Name", "email": "E-Mail", "phone": "Mobile", "shoe size": None
    }
    assert got["shoe size"][1] == 0.0 and list(got) == ["identifier", "name", "email", "phone", "shoe size"]


def test_match_headers_tie_and_empty(spark):
    got = M.mapping_dict(
        A.match_headers(spark, ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
                        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    )
    assert [v[0] for v in got.values()] == ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", None]
    assert M.mapping_dict(A.match_headers(spark, [], ["a"])) == {"a": (None, 0.0)}
    assert M.mapping_dict(A.match_headers(spark, ["a"], [])) == {}


def test_threshold_applies_after_assignment(spark):
    got = M.mapping_dict(A.match_headers(spark, ["colour"], ["color"], threshold=95))
    assert got == {"color": (None, 0.0)}


def test_catalog_match_equals_single_matches(spark):
    feeds = {"f1": ["id", "e mail", "town"], "f2": ["town", "id"], "f3": ["ID", "E-Mail", "Town"], "f4": ["zzz"]}
    templates = {"t1": ["key", "city", "mail"], "t2": ["city"]}
    rows = lambda tables: [(t, i, c) for t, cols in tables.items() for i, c in enumerate(cols)]
    ddl = "table_id string, ordinal int, column_name string"
    requests = [(f, t) for f in feeds for t in templates if (f, t) != ("f2", "t2")]
    got = A.match_catalog(
        spark.createDataFrame(rows(templates), ddl), spark.createDataFrame(rows(feeds), ddl),
        spark.createDataFrame(requests, "source_id string, template_id string"),
    ).collect()
    assert len(got) == sum(len(templates[t]) for _, t in requests)
    for f, t in requests:
        single = M.mapping_dict(A.match_headers(spark, feeds[f], templates[t]))
        assert {r.template_col: (r.raw_col, r.confidence) for r in got if (r.source_id, r.template_id) == (f, t)} == single


def plain_promotion(mapping, t_patterns, raw):
    out = dict(mapping)
    free = [c for c, _ in raw if c not in {m for m, _ in mapping.values()}]
    patterns = dict(raw)
    for t, (match, _) in mapping.items():
        if match is not None or t_patterns[t] in ("text", "empty"):
            continue
        for c in free:
            if patterns[c] == t_patterns[t]:
                out[t] = (c, 0.6)
                free.remove(c)
                break
    return out


def test_promotion_equals_one_by_one(spark):
    rng = random.Random(4)
    kinds = ["email", "phone", "numeric", "date", "text", "empty"]
    maps, pats, raws, want = [], [], [], {}
    for g in range(30):
        raw = [(f"r{i}", rng.choice(kinds)) for i in range(rng.randint(0, 8))]
        names = [c for c, _ in raw]
        rng.shuffle(names)
        mapping = {f"t{i}": ((names.pop(), 0.9) if names and rng.random() < 0.4 else (None, 0.0)) for i in range(rng.randint(1, 8))}
        tp = {t: rng.choice(kinds) for t in mapping}
        maps += [(g, i, t, int(m[1:]) if m else None, m, c) for i, (t, (m, c)) in enumerate(mapping.items())]
        pats += [(g, t, p) for t, p in tp.items()]
        raws += [(g, i, c, p) for i, (c, p) in enumerate(raw)]
        want[g] = plain_promotion(mapping, tp, raw)
    got = M.promote_by_pattern(
        spark.createDataFrame(maps, f"g int, {M.MAPPING_DDL}"), spark.createDataFrame(pats, "g int, template_col string, pattern string"),
        spark.createDataFrame(raws, "g int, r_ord int, raw_col string, pattern string"), ["g"],
    ).collect()
    have = {g: {} for g in want}
    for r in got:
        have[r.g][r.template_col] = (r.raw_col, r.confidence)
    assert have == want


def test_veto_frees_clashing_matches(spark):
    mapping = M.mapping_table(spark, {"mail": ("contact", 0.9), "call": None}, ["contact", "other"])
    tp = spark.createDataFrame([("mail", "email"), ("call", "phone")], "template_col string, pattern string")
    rp = spark.createDataFrame([(0, "contact", "phone"), (1, "other", "email")], "r_ord int, raw_col string, pattern string")
    assert M.mapping_dict(M.promote_by_pattern(mapping, tp, rp, veto=True)) == {"mail": ("other", 0.6), "call": ("contact", 0.6)}
    assert M.mapping_dict(M.promote_by_pattern(mapping, tp, rp)) == {"mail": ("contact", 0.9), "call": (None, 0.0)}


def test_review_operators(spark):
    mapping = M.mapping_table(spark, {"a": ("x", 0.95), "b": ["y", 0.7], "c": "z", "d": None, "e": ("x", 0.5)}, ["x", "y", "z", "w"])
    raw = spark.createDataFrame([(i, c) for i, c in enumerate("xyzw")], "r_ord int, raw_col string")
    assert [r.raw_col for r in M.unused_raw(mapping, raw).collect()] == ["w"]
    assert {r.template_col for r in M.unmapped_template(mapping).collect()} == {"b", "d", "e"}
    assert {r.template_col for r in M.review_queue(mapping, show_all=True).collect()} == set("abcde")
    assert [tuple(r) for r in M.mapping_duplicates(mapping).collect()] == [("x", 2)]
    assert tuple(M.mapping_progress(mapping).first()) == (4, 5, 80, 2)
    assert {r.raw_col for r in M.available_raw(mapping, raw, "b").collect()} == {"y", "w"}
    bands = {r[0]: r[1] for r in mapping.select("template_col", M.confidence_band(F.col("confidence"))).collect()}
    assert bands == {"a": "high", "b": "medium", "c": "high", "d": "none", "e": "low"}
    over = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", None)], "template_col string, raw_col string")
    got = {r.template_col: (r.raw_col, r.confidence, r.mapping_type) for r in M.apply_overrides(mapping, over).collect()}
    assert got["a"] == ("x", 1.0, "confirmed") and got["b"] == ("w", 1.0, "manual")
    assert got["c"] == (None, 0.0, "manual") and got["e"] == ("x", 0.5, "automatic")


def test_catalog(spark):
    frames = {"p": spark.createDataFrame([(1, "x")], "b int, a string"), "q": spark.createDataFrame([("x", 1)], "a string, b int")}
    catalog = column_catalog(spark, frames)
    prints = {r.table_id: r.fingerprint for r in schema_fingerprints(catalog).collect()}
    assert prints["p"] == prints["q"]
    shapes = {r.table_id: r.shape for r in shape_keys(catalog).collect()}
    assert shapes["p"] != shapes["q"]


@pytest.mark.parametrize("old, new, want", [
    (["a", "b"], ["a", "c"], {("b", None, "removed"), (None, "c", "added")}),
    (["Cust_ID", "b"], ["cust id", "b"], {("Cust_ID", "cust id", "renamed")}),
])
def test_schema_drift(spark, old, new, want):
    df = lambda cols: spark.createDataFrame([("t", c) for c in cols], "table_id string, column_name string")
    assert {tuple(r)[1:] for r in schema_drift(df(old), df(new)).collect()} == want


def test_candidates_grow_with_requests(spark):
    """600 headers a side that all share a word: only pairs of columns that meet are built, and none of those is lost."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7))
    tables = {side: {f"{side}{i}": [f"email {word()}" for _ in range(3)] for i in range(200)} for side in ("t", "f")}
    ddl = "table_id string, ordinal int, column_name string"
    catalogs = [spark.createDataFrame([(t, i, c) for t, cols in tables[s].items() for i, c in enumerate(cols)], ddl) for s in ("t", "f")]
    sides = [header_features(c.select(normalize_header(F.col("column_name")).alias("norm"))) for c in catalogs]
    norms = [c.select("table_id", normalize_header(F.col("column_name")).alias("norm")) for c in catalogs]
    counts = []
    for n in (1, 10, 100):
        asked = spark.createDataFrame([(f"t{i}", f"f{i}") for i in range(n)], "t_shape string, f string")
        t_in = norms[0].withColumnsRenamed({"table_id": "t_shape", "norm": "t_norm"}).distinct()
        r_for = asked.join(norms[1], asked.f == norms[1].table_id).select("t_shape", F.col("norm").alias("r_norm")).distinct()
        pairs = requested_pairs(*sides, t_in, r_for).select("t_norm", "r_norm")
        want = t_in.join(r_for, "t_shape").select("t_norm", "r_norm")
        assert want.join(pairs, ["t_norm", "r_norm"], "left_anti").count() == 0  # all share a word, so all are candidates
        counts.append(pairs.count())
    few = counts[0] - 9  # pairs that a rare key gives whoever asks
    assert few < 20_000 and abs(counts[1] - few - 90) < 90 and counts[2] < few + 900 + 90 < 360_000
    requests = spark.createDataFrame([(f"f{i}", f"t{i}") for i in range(4)], "source_id string, template_id string")
    got = A.match_catalog(*catalogs, requests).collect()
    for i in range(4):
        single = M.mapping_dict(A.match_headers(spark, tables["f"][f"f{i}"], tables["t"][f"t{i}"]))
        assert {r.template_col: (r.raw_col, r.confidence) for r in got if r.source_id == f"f{i}"} == single


def random_catalog(rng, n_tables, top):
    words = ["order", "date", "cust", "customer", "name", "e-mail", "qty", "total", "amt", "phone", "nmae", "dte", "Ordr", "id", "name name", ""]
    rows = [
        (t, i, rng.choice(["", "_", " "]).join(rng.choices(words, k=rng.randint(1, 3))) + str(i))
        for t in range(n_tables) for i in range(0, 2 * rng.randint(1, top), 2)
    ]
    return rows


def test_requests_move_as_one_row_and_both_ways_agree(spark, monkeypatch):
    """A request is one row however many columns it has, and side by side or by keys the same edges are found."""
    rng = random.Random(11)
    ddl = "table_id long, ordinal int, column_name string"
    templates, sources = (spark.createDataFrame(random_catalog(rng, 12, 9), ddl) for _ in range(2))
    requests = spark.createDataFrame([(s, t) for s in range(13) for t in range(12)], "source_id long, template_id long")
    near, far, asked = A.catalog_edges(templates, sources, requests)
    assert asked.count() == 13 * 12 and far.count() == 0 and near.count() > 0
    want = [tuple(r) for r in A.match_catalog(templates, sources, requests).collect()]
    assert {r[0] for r in want if r[5] is None} >= {12}  # the source without columns stays
    monkeypatch.setattr(A, "NARROW_PRODUCT", 0)
    by_keys = A.catalog_edges(templates, sources, requests)[1]
    columns = ["p1", "p2", "t_ord", "r_ord", "micro"]
    assert sorted(map(tuple, by_keys.select(*columns).collect())) == sorted(map(tuple, near.select(*columns).collect()))
    assert sorted((tuple(r) for r in A.match_catalog(templates, sources, requests).collect()), key=repr) == sorted(want, key=repr)


def test_pairs_left_out_score_nothing(spark):
    rng = random.Random(12)
    names = sorted({r[2].lower().replace("_", " ").replace("-", " ") for r in random_catalog(rng, 30, 5)} | {"aab", "abb", "éa", "ae"})
    df = spark.createDataFrame([(n,) for n in names], "norm string").where("norm <> ''")
    side = lambda s: df.select(F.inline(F.array(header_struct(F.col("norm"), s, F.lit(0), A.DEFAULT_VOCABULARY, False))))
    scored = with_scores(side("t").crossJoin(side("r")).withColumn("may", may_score()).select(*SCORED, "may").distinct())
    found = scored.groupBy("may").agg(F.max("score").alias("top"), F.count("*").alias("n")).collect()
    assert {r.may: r.top > 0 for r in found} == {True: True, False: False}


def test_narrow_requests_are_matched_where_they_are(spark):
    """Stored requests are scored and solved without another move, however many distinct pairs of tables there are."""
    rng = random.Random(13)
    ddl = "table_id long, ordinal int, column_name string"
    templates, sources = (spark.createDataFrame(random_catalog(rng, 8, 4), ddl) for _ in range(2))
    requests = spark.createDataFrame([(s, t) for s in range(8) for t in range(8)], "source_id long, template_id long")
    for rows in (A.match_catalog(templates, sources, requests), A.catalog_assignment(templates, sources, requests)):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() > 0


@pytest.mark.parametrize("strict", [False, True])
def test_scores_of_numbered_headers_are_those_of_the_rules(spark, strict):
    rng = random.Random(14)
    names = [r[2] for r in random_catalog(rng, 25, 4)] + ["birth dte", "mail", "e mail", "my mail", "customer customer", "12", "-", "", "aab", "abb", "a b"]
    rows = [(i, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "i int, name string").withColumn("norm", normalize_header(F.col("name")))
    norms = dict(df.select("name", "norm").collect())
    side = lambda s: df.select("norm", F.inline(F.array(header_struct(F.col("norm"), s, F.col("i"), A.DEFAULT_VOCABULARY, strict)))).drop("norm")
    scored = positive_scores(side("t").crossJoin(side("r")), strict, ["t_ord", "r_ord"]).collect()
    want = np.zeros((len(names), len(names)), np.int64)
    for row in scored:
        want[row.t_ord, row.r_ord] = row.micro
    scores = PairScores(A.DEFAULT_VOCABULARY, strict)
    assert {n: scores._norm(n) for n in names} == norms
    numbers = np.array(scores.numbers(names))
    t, r = np.divmod(np.arange(len(names) ** 2), len(names))
    for _ in range(2):  # the second time from memory
        assert (scores.micros(numbers[t], numbers[r]).reshape(want.shape) == want).all()


@pytest.mark.parametrize("strict,keep_unicode", [(False, False), (True, False), (False, True)])
def test_odd_headers_match_both_ways(spark, monkeypatch, strict, keep_unicode):
    names = ["Straße", "strase", "größe", "gro e", "name\n", "name", " na\u00a0me", "tab\tname", None, "", "İd", "id", "K", "k", "数量", "a\x1fb", "a b", 'q"u', "e_mail"]
    ddl = "table_id string, ordinal int, column_name string"
    templates = spark.createDataFrame([(f"t{i // 4}", i % 4 * 3, n) for i, n in enumerate(names)], ddl)
    sources = spark.createDataFrame([(f"s{i // 6}", i % 6, n) for i, n in enumerate(reversed(names))], ddl)
    requests = spark.createDataFrame([(f"s{s}", f"t{t}") for s in range(4) for t in range(5)], "source_id string, template_id string")
    match = lambda: sorted(map(tuple, A.match_catalog(templates, sources, requests, strict=strict, keep_unicode=keep_unicode).collect()), key=repr)
    near = match()
    monkeypatch.setattr(A, "NARROW_PRODUCT", 0)
    assert near == match()
    assert any(r[5] is not None for r in near) and len(near) == 4 * len(names)


def test_remembered_scores_are_bounded(monkeypatch):
    monkeypatch.setattr(table_pairs, "_HEADERS", 10)
    monkeypatch.setattr(table_pairs, "_PAIRS", 20)
    scores = PairScores(A.DEFAULT_VOCABULARY, False)
    for k in range(30):
        scores.renew()
        n = np.array(scores.numbers([f"order {k}", f"ordr {k}", f"x{k}"]))
        assert scores.micros(n[[0, 0]], n[[1, 2]]).tolist()[0] > 0
        assert len(scores._of_name) <= 13 and len(scores._codes) <= 22


def test_sparse_matching_on_wide_sides():
    """A narrow side against thousands of equal edges, from either side, and ties that only rerouting settles."""
    for n, m in ((20, 2000), (2000, 20)):
        edges = [(i, j, 880_000) for i in range(n) for j in range(m)]
        start = time.perf_counter()
        assert heaviest_matching(edges) == [(i, i, 880_000) for i in range(20)]
        assert time.perf_counter() - start < 5
    assert heaviest_matching([(0, 0, 1), (0, 1, 1), (1, 0, 1)]) == [(0, 1, 1), (1, 0, 1)]
    assert heaviest_matching([(0, 5, 2), (1, 5, 2)]) == [(0, 5, 2)]
    assert heaviest_matching([(0, 5, 2), (1, 5, 3)]) == [(1, 5, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_sparse_matching_equals_all_choices(seed):
    rng = random.Random(seed)
    for _ in range(300):
        top, share = rng.choice([1, 2, 9]), rng.random()
        edges = [(i, j, rng.randint(1, top)) for i in range(rng.randint(1, 6)) for j in range(rng.randint(1, 6)) if rng.random() < share]
        rows = sorted({e[0] for e in edges})
        best = (-1, [])

        def go(i, total, picks, edges=edges, rows=rows):
            nonlocal best
            if i == len(rows):
                best = (total, picks) if total > best[0] else best
                return
            for r, c, w in sorted(e for e in edges if e[0] == rows[i]):
                if c not in {p[1] for p in picks}:
                    go(i + 1, total + w, [*picks, (r, c, w)])
            go(i + 1, total, picks)

        go(0, 0, [])
        assert heaviest_matching(edges) == best[1]


def test_matched_drift(spark):
    """Renames by score, within a table only and one to one; equal headers and lone columns stay what they were."""
    from colweave.operators.renames import matched_drift

    old = {"a": ["email", "first_name", "phone number", "zip", "same"], "b": ["email"], "c": ["Total"], "d": ["x1"]}
    new = {"a": ["E-Mail Address", "firstname", "phone", "qwv", "same"], "b": ["color"], "c": ["total "], "e": ["email"]}
    frame = lambda tables: spark.createDataFrame([(t, c) for t, cs in tables.items() for c in cs], "table_id string, column_name string")
    got = {(r.table_id, r.old_column, r.new_column, r.change) for r in matched_drift(frame(old), frame(new)).collect()}
    assert got == {
        ("a", "email", "E-Mail Address", "renamed"), ("a", "first_name", "firstname", "renamed"), ("a", "phone number", "phone", "renamed"),
        ("a", "zip", None, "removed"), ("a", None, "qwv", "added"), ("b", "email", None, "removed"), ("b", None, "color", "added"),
        ("c", "Total", "total ", "renamed"), ("d", "x1", None, "removed"), ("e", None, "email", "added"),
    }


def test_drift_query_joins_lines_and_parts_once(spark):
    from colweave.plans import load_all

    df = load_all()[0]["schema_drift"](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and not [f for f in df.inputFiles() if "lineitem" in f]  # both states come from the stored columns


def _by_keys_only(spark, use):
    """A mapping and a raw catalog dealt out by the key, joined without broadcasts; rows of the result, moved twice: the used names and the catalog."""
    mapping = spark.createDataFrame([(g, i, f"t{i}", None, "r0" if i == 0 else None, 0.0) for g in range(4) for i in range(3)], f"g int, {M.MAPPING_DDL}")
    mapping = mapping.withColumn("pattern", F.lit("email"))
    raw = spark.createDataFrame([(g, i, f"r{i}", "email") for g in range(3) for i in range(2)], "g int, r_ord int, raw_col string, pattern string")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = use(mapping, raw.repartition("g"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2, plan
        return df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_unused_raw_moves_the_catalog_once(spark):
    rows = _by_keys_only(spark, lambda mapping, raw: M.unused_raw(mapping, raw, ["g"]))
    assert sorted((r.g, r.raw_col) for r in rows) == [(g, "r1") for g in range(3)]


def test_promotion_moves_the_catalog_once(spark):
    rows = _by_keys_only(spark, lambda mapping, raw: M.promote_by_pattern(mapping, None, raw, ["g"]))
    # one free raw column each, for the first that waits; the fourth mapping has none
    want = {(g, t): ("r1", 1, 0.6) if t == "t1" and g < 3 else ("r0" if t == "t0" else None, None, 0.0) for g in range(4) for t in ("t0", "t1", "t2")}
    assert {(r.g, r.template_col): (r.raw_col, r.r_ord, r.confidence) for r in rows} == want


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_matching_steps_release_their_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    columns = "table_id string, ordinal int, column_name string"
    templates = spark.createDataFrame([(f"t{t}", i, c) for t in range(4) for i, c in enumerate((f"order {t}", "price"))], columns)
    sources = spark.createDataFrame([(f"s{s}", i, c) for s in range(8) for i, c in enumerate(("prices", f"Order_{s % 4}"))], columns)
    requests = spark.createDataFrame([(f"s{s}", f"t{s % 4}") for s in range(9)] + [("s1", None), (None, "t1")], "source_id string, template_id string")
    size, cleanup = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(key, None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffle_files(spark)
        matched = A.match_catalog(templates, sources, requests)
        deadline = time.time() + 20
        while (left := _shuffle_files(spark) - before) and time.time() < deadline:
            time.sleep(0.2)
        assert not left
        rows = matched.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert spark.conf.get(key, None) == cleanup
    # a source without columns and a request without a source have their template's columns, unmatched
    assert len(rows) == 2 * 10
    assert {(r.source_id, r.template_col) for r in rows if r.raw_col is None} == {(s, c) for s, o in (("s8", 0), (None, 1)) for c in (f"order {o}", "price")}
