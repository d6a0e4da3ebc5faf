"""What happens to a mapping after assignment: promotion, overrides, review.

A mapping table has one row per template column with ``t_ord, template_col, r_ord, raw_col,
confidence``. Functions take ``keys``, the columns that tell one mapping from another
(empty for a single mapping), so that many mappings are handled in one job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PROMOTED_CONFIDENCE = 0.6
HIGH_CONFIDENCE = 0.8

MAPPING_DDL = "t_ord int, template_col string, r_ord int, raw_col string, confidence double"


def normalise_mapping(mapping: Mapping[str, object]) -> list[tuple[str, str | None, float]]:
    """``{template: (raw, confidence)}``, ``[raw, ...]`` or a bare name, as uniform tuples."""
    out = []
    for template_col, value in mapping.items():
        confidence = None
        if isinstance(value, (tuple, list)) and value:
            raw = value[0]
            confidence = value[1] if len(value) > 1 else None
        else:
            raw = value
        if not isinstance(raw, str):
            raw = None
        if confidence is None:
            confidence = 0.0 if raw is None else 1.0
        out.append((template_col, raw, float(confidence)))
    return out


def mapping_table(spark: SparkSession, mapping: Mapping[str, object], raw_columns: list[str] | None = None) -> DataFrame:
    ordinals = {c: i for i, c in reversed(list(enumerate(raw_columns or [])))}
    rows = [(i, t, ordinals.get(r), r, c) for i, (t, r, c) in enumerate(normalise_mapping(mapping))]
    return spark.createDataFrame(rows, MAPPING_DDL)


def mapping_dict(mapping: DataFrame) -> dict[str, tuple[str | None, float]]:
    """One mapping as an ordered dict. It has one row per template column, so it is small."""
    rows = mapping.orderBy("t_ord").select("template_col", "raw_col", "confidence").collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def unused_raw(mapping: DataFrame, raw_catalog: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw columns no template column uses. ``raw_catalog`` has the keys, ``r_ord``, ``raw_col``.

    A mapping's used names meet its raw columns by the keys alone, so a catalog that is dealt out by them does not move again.
    """
    keys = keys or []
    on = [*keys, "raw_col"]
    matched = mapping.where("raw_col is not null")
    if not keys:
        return raw_catalog.join(matched.select(*on), on, "left_anti")
    used = matched.groupBy(*keys).agg(F.collect_set("raw_col").alias("used"))
    others = [c for c in raw_catalog.columns if c not in on]
    return raw_catalog.join(used, keys, "left").where(~_in_use("used", F.col("raw_col"))).select(*on, *others)


def _in_use(used: str, raw_col: Column) -> Column:
    return F.coalesce(F.array_contains(used, raw_col), F.lit(False))


def unmapped_template(mapping: DataFrame) -> DataFrame:
    """Template columns without a match, or with one below high confidence."""
    return mapping.where(F.col("raw_col").isNull() | (F.col("confidence") < HIGH_CONFIDENCE))


def promote_by_pattern(
    mapping: DataFrame, template_patterns: DataFrame | None, raw_patterns: DataFrame, keys: list[str] | None = None,
    veto: bool = False,
) -> DataFrame:
    """Give unmatched template columns the unused raw columns of the same value pattern.

    Patterns come as ``(keys, template_col, pattern)`` and ``(keys, r_ord, raw_col, pattern)``; without the former, ``mapping`` has
    them as its column ``pattern``. Within a pattern the k-th waiting template column takes the k-th free raw column, which is what
    going through them one after another gives. ``veto`` first undoes header matches whose patterns are both specific and differ.

    Only waiting columns and used names move, a row per mapping, to where the mapping's raw columns are.
    """
    keys = keys or []
    specific = ~F.col("pattern").isin("text", "empty")
    patterned = mapping
    if template_patterns is not None:
        patterned = mapping.join(template_patterns.select(*keys, "template_col", "pattern"), [*keys, "template_col"], "left")
    if veto:
        theirs = raw_patterns.select(*keys, "raw_col", F.col("pattern").alias("raw_pattern"))
        clash = specific & ~F.col("raw_pattern").isin("text", "empty") & (F.col("pattern") != F.col("raw_pattern"))
        off = F.coalesce(clash, F.lit(False))
        patterned = patterned.join(theirs, [*keys, "raw_col"], "left").withColumns(
            {
                "raw_col": F.when(~off, F.col("raw_col")),
                "r_ord": F.when(~off, F.col("r_ord")),
                "confidence": F.when(off, F.lit(0.0)).otherwise(F.col("confidence")),
            }
        ).drop("raw_pattern")
    waits = F.coalesce(F.col("raw_col").isNull() & specific, F.lit(False))
    row = ["t_ord", "template_col", "r_ord", "confidence", "pattern"]
    wanted = patterned.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(waits, F.struct(*row)))).alias("waiting"), F.collect_set("raw_col").alias("used")
    ).where("size(waiting) > 0")
    offers = raw_patterns.where(specific).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("r_ord", "raw_col", "pattern"))).alias("offers")
    )
    met = wanted.join(offers, keys, "left") if keys else wanted.crossJoin(offers)
    free = F.filter("offers", lambda o: ~_in_use("used", o["raw_col"]))
    met = met.select(*keys, "waiting", F.coalesce(free, F.array()).alias("free"))
    # The k-th of a pattern beside the k-th; what has no counterpart is beside a null.
    beside = F.transform(
        F.array_distinct("waiting.pattern"),
        lambda p: F.zip_with(
            F.filter("waiting", lambda w: w["pattern"] == p), F.filter("free", lambda o: o["pattern"] == p),
            lambda w, o: F.struct(w.alias("w"), o.alias("o")),
        ),
    )
    given = met.select(*keys, F.explode(F.flatten(beside)).alias("x")).where("x.w is not null").select(*keys, "x.w.*", F.col("x.o").alias("o"))
    promoted = F.col("o.raw_col").isNotNull()
    given = given.select(
        *keys, "t_ord", "template_col", F.coalesce("r_ord", "o.r_ord").alias("r_ord"), F.col("o.raw_col").alias("raw_col"),
        F.when(promoted, F.lit(PROMOTED_CONFIDENCE)).otherwise(F.col("confidence")).alias("confidence"), "pattern",
    )
    settled = patterned.where(~waits).select(*keys, "t_ord", "template_col", "r_ord", "raw_col", "confidence", "pattern")
    return settled.unionByName(given)


def apply_overrides(mapping: DataFrame, overrides: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace matches by the reviewer's choice: ``(keys, template_col, raw_col)``, null for no match.

    A chosen match gets confidence 1.0, no match 0.0; ``mapping_type`` tells both kinds apart.
    """
    on = [*(keys or []), "template_col"]
    chosen = overrides.select(*on, F.col("raw_col").alias("chosen_col"), F.lit(True).alias("chosen"))
    joined = mapping.join(chosen, on, "left")
    manual = F.coalesce(F.col("chosen"), F.lit(False))
    same = F.col("raw_col") == F.col("chosen_col")
    return joined.select(
        *(keys or []), "t_ord", "template_col",
        F.when(manual, F.col("chosen_col")).otherwise(F.col("raw_col")).alias("raw_col"),
        F.when(manual, F.when(F.col("chosen_col").isNull(), 0.0).otherwise(1.0))
        .otherwise(F.col("confidence")).alias("confidence"),
        F.when(manual & ~F.coalesce(same, F.lit(False)), "manual").when(manual, "confirmed").otherwise("automatic")
        .alias("mapping_type"),
    )


def available_raw(mapping: DataFrame, raw_catalog: DataFrame, template_col: str, keys: list[str] | None = None) -> DataFrame:
    """Raw columns a reviewer may pick for one template column: the unused ones and its own."""
    others = mapping.where(F.col("template_col") != template_col)
    return unused_raw(others, raw_catalog, keys)


def mapping_duplicates(mapping: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Raw columns used by more than one template column of a mapping."""
    on = [*(keys or []), "raw_col"]
    return mapping.where("raw_col is not null").groupBy(*on).agg(F.count("*").alias("n_uses")).where("n_uses > 1")


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= HIGH_CONFIDENCE, "high")
        .when(confidence >= PROMOTED_CONFIDENCE, "medium")
        .when(confidence > 0, "low")
        .otherwise("none")
    )


def mapping_progress(mapping: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Matched and total template columns, whole percent, and the count accepted unseen."""
    matched = F.count("raw_col")
    return mapping.groupBy(*(keys or [])).agg(
        matched.alias("n_matched"),
        F.count("*").alias("n_total"),
        F.floor(matched * 100 / F.count("*")).cast("long").alias("pct_complete"),
        F.count_if(F.col("raw_col").isNotNull() & (F.col("confidence") >= HIGH_CONFIDENCE)).alias("n_auto_accepted"),
    )


def review_queue(mapping: DataFrame, show_all: bool = False) -> DataFrame:
    """Rows a reviewer should see. Only a view: the mapping itself stays whole."""
    return mapping if show_all else unmapped_template(mapping)


def mapping_flags(mapping: DataFrame, shared_values: DataFrame) -> DataFrame:
    """Mark mapped raw columns that share values with others, per ``(col_a, col_b, ...)`` rows."""
    touched = (
        shared_values.select(F.explode(F.array("col_a", "col_b")).alias("raw_col")).distinct().withColumn("hit", F.lit(True))
    )
    return mapping.join(touched, "raw_col", "left").withColumn("shares_values", F.coalesce("hit", F.lit(False))).drop("hit")
