"""Optimal one-to-one assignment per (template, source) pair, and catalog-wide matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.headers import normalize_header
from ..scratch import fresh_dir, remove_dir, stored
from ..vocab import DEFAULT_VOCABULARY, Vocabulary
from .catalog import table_columns
from .scoring import MICRO, SCORED, header_features, header_struct, may_score, positive_scores, requested_pairs, score_features
from .sparse_matching import heaviest_matching
from .table_pairs import PLAIN, matcher

THRESHOLD = 70.0

# Requests with equal values here have tables of the same ordered headers.
PAIR = ["p1", "p2"]

# Tables of at most so many column pairs have their columns put beside each other.
NARROW_PRODUCT = 4096

# Parts up to this many edges are remembered: many tables have the same few.
_REMEMBERED_EDGES = 64


def solve_component(weight: np.ndarray) -> list[int]:
    """Column per row (-1 for none) of the heaviest matching of a non-negative integer matrix.

    Among equally heavy ones: the lexicographically smallest column list, "none" last.
    """
    edges = [(int(i), int(j), int(weight[i, j])) for i, j in np.argwhere(weight > 0)]
    found = {i: j for i, j, _ in heaviest_matching(edges)}
    return [found.get(i, -1) for i in range(len(weight))]


def _components(edges: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Edges by connected component; an optimum of the whole is one of each part."""
    parent: dict[tuple[str, int], tuple[str, int]] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for t, r, _ in edges:
        a, b = root(("t", t)), root(("r", r))
        if a != b:
            parent[a] = b
    groups: dict[tuple[str, int], list] = {}
    for edge in edges:
        groups.setdefault(root(("t", edge[0])), []).append(edge)
    yield from groups.values()


@lru_cache(maxsize=50_000)
def _solve_part(part: tuple[tuple[int, int, int], ...]) -> list[tuple[int, int, int]]:
    return heaviest_matching(list(part))


def solve_edges(edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The chosen ``(t_ord, r_ord, micro)`` of one pair of tables."""
    if len(edges) == 1:
        return edges
    out = []
    for part in _components(edges):
        out += _solve_part(tuple(part)) if len(part) <= _REMEMBERED_EDGES else heaviest_matching(part)
    return out


def _solver(keys: list[str]):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            picks = [
                [dict(zip(("t_ord", "r_ord", "micro"), edge)) for edge in solve_edges(list(zip(t_ords.tolist(), r_ords.tolist(), micros.tolist())))]
                for t_ords, r_ords, micros in zip(batch["t_ords"], batch["r_ords"], batch["micros"])
            ]
            yield batch[keys].assign(picks=picks)

    return solve


def prune_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Drop edges no optimal assignment needs, so that a wide table stays a small group.

    A template of ``n`` columns never needs more than the best ``n`` edges of each of its
    columns: of those one is always free, scores no less and comes first on a tie. The same
    holds from the raw side. What is left is at most the square of the narrower side.
    """
    by_t = W.partitionBy(*keys, "t_ord").orderBy(F.col("micro").desc(), "r_ord")
    by_r = W.partitionBy(*keys, "r_ord").orderBy(F.col("micro").desc(), "t_ord")
    kept = edges.withColumn("rank_t", F.row_number().over(by_t)).where("rank_t <= n_template")
    kept = kept.withColumn("rank_r", F.row_number().over(by_r)).where("rank_r <= n_raw")
    return kept.drop("rank_t", "rank_r")


def assign_lists(edges: DataFrame, keys: list[str], prune: bool = True) -> DataFrame:
    """Optimal assignment per group of ``keys``, a row each: the keys and ``picks``, an array of ``(t_ord, r_ord, micro)``.

    ``edges`` has the keys, ``t_ord``, ``r_ord``, ``micro`` (positive) and, to prune, ``n_template`` and ``n_raw``.
    """
    edge = F.struct("t_ord", "r_ord", "micro")
    grouped = (
        (prune_edges(edges, keys) if prune else edges)
        .groupBy(*keys)
        .agg(F.collect_list(edge).alias("e"))
        .select(*keys, F.col("e.t_ord").alias("t_ords"), F.col("e.r_ord").alias("r_ords"), F.col("e.micro").alias("micros"))
    )
    key_ddl = ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    return grouped.mapInPandas(_solver(keys), f"{key_ddl}, picks array<struct<t_ord: int, r_ord: int, micro: bigint>>")


def assign(edges: DataFrame, keys: list[str], prune: bool = True) -> DataFrame:
    """Optimal assignment per group of ``keys``: those of :func:`assign_lists` as rows of the keys, ``t_ord``, ``r_ord``, ``micro``."""
    return assign_lists(edges, keys, prune).select(*keys, F.inline("picks"))


def apply_threshold(mapping: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """After assignment: drop matches below the threshold, confidence = score / 100."""
    keep = F.coalesce(F.col("micro") >= int(threshold * MICRO), F.lit(False))
    return mapping.withColumns(
        {
            "raw_col": F.when(keep, F.col("raw_col")),
            "r_ord": F.when(keep, F.col("r_ord")),
            "confidence": F.when(keep, F.col("micro") / (100.0 * MICRO)).otherwise(F.lit(0.0)),
        }
    ).drop("micro")


def asked_tables(
    templates: DataFrame, sources: DataFrame, requests: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, keep_unicode: bool = False,
) -> DataFrame:
    """One row per request with the columns of both tables in order, stored, as the rest may read it twice.

    ``(source_id, template_id, t_cols, r_cols, n_template, n_raw)``; the columns are JSON text (:func:`_columns`), which is moved in a
    third of the room that arrays take, null for a source without any. Tables with a header that is not plain have all normal forms as ``u``.
    """

    def side(catalog: DataFrame, of: str, size: str, table_id: str) -> DataFrame:
        names = F.col("columns.column_name")
        odd = ~F.array_join(names, "").rlike(PLAIN)
        norms = F.when(odd, F.transform(names, lambda n: normalize_header(n, vocab, keep_unicode)))
        return table_columns(catalog).select(
            F.col("table_id").alias(table_id), F.size("columns").alias(size),
            F.to_json(F.struct(F.col("columns.ordinal").alias("o"), names.alias("n"), norms.alias("u"))).alias(f"{of}_cols"),
        )

    # In two steps, each of which releases its shuffles: the columns of one side are stored before those of the other move.
    spark = requests.sparkSession
    path = fresh_dir(spark, "sourced")
    sourced = stored(requests.select("source_id", "template_id").join(side(sources, "r", "n_raw", "source_id"), "source_id", "left"), path)
    asked = sourced.join(side(templates, "t", "n_template", "template_id"), "template_id").select(
        "source_id", "template_id", "t_cols", "r_cols", "n_template", "n_raw"
    )
    asked = stored(asked, fresh_dir(spark, "asked"))
    remove_dir(spark, path)
    return asked


def _columns(side: str):
    """Ordinals ``o`` and names ``n`` of a table's columns in order."""
    return F.from_json(f"{side}_cols", "o array<int>, n array<string>").alias(side)


def _narrow() -> Column:
    return F.coalesce(F.col("n_template").cast("long") * F.col("n_raw"), F.lit(0)) <= NARROW_PRODUCT


def _paired(asked: DataFrame, vocab: Vocabulary, keep_unicode: bool) -> DataFrame:
    """Add ``p1`` and ``p2``, which are equal for requests whose tables have the same normalised headers in the same order."""
    norms = {f"{s}_norms": F.transform(f"{s}.n", lambda n: normalize_header(n, vocab, keep_unicode)) for s in ("t", "r")}
    named = asked.select("*", _columns("t"), _columns("r")).withColumns(norms)
    return named.select(
        *asked.columns, F.xxhash64("t_norms", "r_norms").alias("p1"), F.xxhash64("r_norms", F.lit("shape"), "t_norms").alias("p2")
    )


def catalog_edges(
    templates: DataFrame, sources: DataFrame, requests: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
    strict: bool = False, keep_unicode: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positive edges of the requested pairs of tables, per distinct pair of ordered headers (``PAIR``).

    Returns ``(near, far, asked)``, the last of :func:`asked_tables` with ``PAIR``. Ordinals of edges are places in its lists. Thousands of alike
    feeds are scored once. Columns of narrow tables are put beside each other, which makes fewer rows than headers have join
    keys: ``near``. Pairs of wide tables are found by keys, so no large product is formed: ``far``, with the tables' sizes.
    """
    return _edges(asked_tables(templates, sources, requests, vocab, keep_unicode), vocab, strict, keep_unicode)


def _edges(asked: DataFrame, vocab: Vocabulary, strict: bool, keep_unicode: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = _paired(asked, vocab, keep_unicode)

    def pairs(of):
        # One request stands for all with the same headers.
        first = asked.where("n_raw > 0").where(of).groupBy(*PAIR, "n_template", "n_raw").agg(F.first(F.concat_ws("\n", "t_cols", "r_cols")).alias("c"))
        # Few bytes but much work each: a number of tasks that Spark does not join into fewer.
        first = first.repartition(4 * asked.sparkSession.sparkContext.defaultParallelism, *PAIR)
        texts = first.select("*", F.split("c", "\n").alias("s")).select(
            *PAIR, "n_template", "n_raw", F.col("s")[0].alias("t_cols"), F.col("s")[1].alias("r_cols")
        ).select(*PAIR, "n_template", "n_raw", _columns("t"), _columns("r"))
        norms = [F.transform(f"{s}.n", lambda n: normalize_header(n, vocab, keep_unicode)).alias(f"{s}_norms") for s in ("t", "r")]
        return texts.select(*PAIR, "n_template", "n_raw", *norms)

    headers = lambda s: F.transform(f"{s}_norms", lambda n, i: header_struct(n, s, i, vocab, strict))
    few = pairs(_narrow()).select(*PAIR, headers("t").alias("t"), headers("r").alias("r"))
    beside = few.select(*PAIR, "r", F.inline("t")).where("t_norm <> ''").select("*", F.inline("r")).where("r_norm <> ''").where(may_score())
    columns = [*PAIR, "t_ord", "r_ord"]
    near = positive_scores(beside.select(*columns, *SCORED), strict, columns).drop("score")
    return near, _wide_edges(pairs(~_narrow()), vocab, strict), asked


def _wide_edges(pairs: DataFrame, vocab: Vocabulary, strict: bool) -> DataFrame:
    """Positive edges of pairs of wide tables, from header pairs with a common key."""
    side = lambda s: pairs.select(*PAIR, "n_template", "n_raw", F.posexplode(f"{s}_norms").alias(f"{s}_ord", f"{s}_norm"))
    t_cols, r_cols = side("t"), side("r")
    t_words, r_words = (
        header_features(df.select(F.col(c).alias("norm")), vocab, strict) for df, c in ((t_cols, "t_norm"), (r_cols, "r_norm"))
    )
    shape = F.struct(*PAIR).alias("t_shape")
    scores = positive_scores(
        requested_pairs(t_words, r_words, t_cols.select(shape, "t_norm").distinct(), r_cols.select(shape, "r_norm").distinct()), strict
    )
    fits = scores.join(t_cols, "t_norm").select(*PAIR, "r_norm", "t_ord", "micro")
    return r_cols.join(fits, [*PAIR, "r_norm"]).select(*PAIR, "t_ord", "r_ord", "n_template", "n_raw", "micro")


def solve_catalog(far: DataFrame) -> DataFrame:
    """:func:`assign_lists` of the far edges of :func:`catalog_edges`, stored.

    The shuffles of scoring are released before the requests move to their solutions.
    """
    return stored(assign_lists(far, PAIR), fresh_dir(far.sparkSession, "solved"))


def _matched_rows(
    templates: DataFrame, sources: DataFrame, requests: DataFrame, vocab: Vocabulary, strict: bool, keep_unicode: bool
) -> DataFrame:
    """A row per request and template column with the column assigned to it, before any threshold; ``micro`` is null where there is none.

    Requests for narrow tables are scored and solved where they are stored (:mod:`table_pairs`); those for wide ones move to the
    solutions of their pairs, a row per request until the end.
    """
    asked = asked_tables(templates, sources, requests, vocab, keep_unicode)
    kinds = {c: asked.schema[c].dataType.simpleString() for c in ("source_id", "template_id")}
    ddl = f"source_id {kinds['source_id']}, template_id {kinds['template_id']}, t_ord int, template_col string, r_ord int, raw_col string, micro bigint"
    near = asked.where(_narrow()).mapInArrow(matcher(vocab, strict, solve_edges), ddl)
    wide = asked.where(~_narrow())
    if wide.isEmpty():
        return near
    _, far, paired = _edges(wide, vocab, strict, keep_unicode)
    solved = paired.join(solve_catalog(far), PAIR, "left")
    solved = solved.select("source_id", "template_id", _columns("t"), _columns("r"), F.map_from_arrays("picks.t_ord", "picks").alias("place"))
    wanted = solved.select("*", F.posexplode("t.n").alias("i", "template_col")).withColumn("found", F.try_element_at("place", F.col("i")))
    return near.unionByName(wanted.select(
        "source_id", "template_id", F.get("t.o", F.col("i")).alias("t_ord"), "template_col", F.get("r.o", F.col("found.r_ord")).alias("r_ord"),
        F.get("r.n", F.col("found.r_ord")).alias("raw_col"), F.col("found.micro").alias("micro"),
    ))


def catalog_assignment(
    templates: DataFrame, sources: DataFrame, requests: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
    strict: bool = False, keep_unicode: bool = False,
) -> DataFrame:
    """The assigned columns of every request, before any threshold: ``(source_id, template_id, t_ord, r_ord, micro)``."""
    rows = _matched_rows(templates, sources, requests, vocab, strict, keep_unicode)
    return rows.where("micro is not null").select("source_id", "template_id", "t_ord", "r_ord", "micro")


def match_catalog(
    templates: DataFrame, sources: DataFrame, requests: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY,
    strict: bool = False, keep_unicode: bool = False, threshold: float = THRESHOLD,
) -> DataFrame:
    """Map every requested source onto its template.

    ``templates`` and ``sources`` are column catalogs ``(table_id, ordinal, column_name)``,
    ``requests`` lists distinct ``(source_id, template_id)``. One output row per request and template
    column: ``(source_id, template_id, t_ord, template_col, r_ord, raw_col, confidence)``.
    """
    out = apply_threshold(_matched_rows(templates, sources, requests, vocab, strict, keep_unicode), threshold)
    return out.select("source_id", "template_id", "t_ord", "template_col", "r_ord", "raw_col", "confidence")


def match_headers(
    spark: SparkSession, raw_columns: list[str], template_columns: list[str], vocab: Vocabulary = DEFAULT_VOCABULARY,
    strict: bool = False, keep_unicode: bool = False, threshold: float = THRESHOLD,
) -> DataFrame:
    """Map the headers of one raw table onto those of one template.

    Returns ``(t_ord, template_col, r_ord, raw_col, confidence)``, one row per template column. Both lists
    come from schemas, so this skips what a catalog needs against skew.
    """

    def side(columns: list[str], ordinal: str, name: str, norm: str) -> DataFrame:
        rows = [(i, str(c).strip()) for i, c in enumerate(columns)]
        df = spark.createDataFrame(rows, f"{ordinal} int, {name} string").coalesce(1)
        return df.withColumn(norm, normalize_header(F.col(name), vocab, keep_unicode))

    t, r = side(template_columns, "t_ord", "template_col", "t_norm"), side(raw_columns, "r_ord", "raw_col", "r_norm")
    features = [header_features(df.select(F.col(n).alias("norm")), vocab, strict) for df, n in ((t, "t_norm"), (r, "r_norm"))]
    scores = score_features(*features, strict, chunk=None)
    edges = scores.join(t, "t_norm").join(r, "r_norm").select(F.lit(0).alias("pair"), "t_ord", "r_ord", "micro")
    chosen = assign(edges, ["pair"], prune=False).drop("pair")
    mapped = t.drop("t_norm").join(chosen, "t_ord", "left").join(r.drop("r_norm"), "r_ord", "left")
    return apply_threshold(mapped, threshold).select("t_ord", "template_col", "r_ord", "raw_col", "confidence")
