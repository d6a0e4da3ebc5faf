"""Columns that share values: exact by one grouping of values, or by sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import filled, trim_text
from .profiling import sample_rows
from .transform import positional

MIN_OVERLAP = 0.1
MAX_DISTINCT_SHARE = 0.9
_BITS = 62

_NESTED = (T.ArrayType, T.StructType, T.MapType, T.VariantType, T.BinaryType)


def _flat(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Inner frame, inner and outer names of the columns that hold plain values."""
    inner, names, types = positional(df)
    keep = [(c, n, t) for c, n, t in zip(inner.columns, names, types) if not isinstance(t, _NESTED)]
    return inner.select(*[filled(F.col(c), t).alias(c) for c, _, t in keep]), [c for c, _, _ in keep], [n for _, n, _ in keep]


def _approx_distinct(c: Column) -> Column:
    """Distinct count within about 0.8%, from one small binary sketch per column."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(c.cast("string"), 14))


def cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Non-null and distinct count per column, and whether it exceeds the distinct limit."""
    inner, cols, names = _flat(df)
    distinct = F.count_distinct if exact else _approx_distinct
    aggs = [a for c in cols for a in (F.count(c).alias(f"{c}_n"), distinct(F.col(c)).alias(f"{c}_d"))]
    one = inner.agg(*aggs)
    rows = [
        F.struct(F.lit(n).alias("column_name"), F.col(f"{c}_n").alias("n_values"), F.col(f"{c}_d").alias("n_distinct"))
        for c, n in zip(cols, names)
    ]
    return one.select(F.inline(F.array(*rows))).withColumn(
        "high_cardinality", F.col("n_distinct") > MAX_DISTINCT_SHARE * F.col("n_values")
    )


#: Relative error of a sketch's distinct count that is taken to be impossible: six standard errors of 2^14 registers.
_SKETCH_ERROR = 6 * 1.04 / 2**7


def distinct_limit(df: DataFrame, share: float = MAX_DISTINCT_SHARE) -> DataFrame:
    """Whether more than ``share`` of a column's values are distinct: ``(column_name, n_values, high_cardinality, counted)``.

    One sketch per column, a row of them per task, decides every column whose bounds lie on one side of the limit. Only the
    others are ``counted`` exactly, by a second scan of them alone, so a wide table isn't multiplied by its columns.
    A column without values is not of high cardinality. Nested and binary columns are left out.
    """
    inner, cols, names = _flat(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_values long, high_cardinality boolean, counted boolean")
    aggs = []
    for c in cols:
        # a hash, as it makes no difference between values that count as equal, such as both zeros
        aggs += [F.count(c), F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), 14))]
    row = inner.agg(*aggs).first()
    facts, undecided = {}, []
    for i, c in enumerate(cols):
        n, about = row[2 * i], row[2 * i + 1] or 0
        limit = share * n
        if about / (1 + _SKETCH_ERROR) > limit and n:
            facts[c] = (n, True, False)
        elif about / (1 - _SKETCH_ERROR) <= limit:
            facts[c] = (n, False, False)
        else:
            undecided.append(c)
            facts[c] = (n, None, True)
    if undecided:
        exact = inner.agg(*[F.count_distinct(F.col(c)) for c in undecided]).first()
        for c, d in zip(undecided, exact, strict=True):
            facts[c] = (facts[c][0], d > share * facts[c][0], True)
    rows = [(name, *facts[c]) for c, name in zip(cols, names, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column_name string, n_values long, high_cardinality boolean, counted boolean")


def _column_stats(df: DataFrame) -> tuple[list[int], list[int]]:
    """Columns with any value, and their value counts, from one scan."""
    inner, cols, _ = _flat(df)
    row = inner.agg(*[F.count(c) for c in cols]).first() if cols else ()
    keep = [i for i, n in enumerate(row) if n > 0]
    return keep, [row[i] for i in keep]


def _masks(n: int) -> list[str]:
    return [f"m{j}" for j in range((n + _BITS - 1) // _BITS)]


def _has(i: int) -> Column:
    return F.col(f"m{i // _BITS}").bitwiseAND(F.lit(1 << (i % _BITS)).cast("long")) != 0


def shared_values(df: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """Column pairs whose distinct values overlap by more than ``min_overlap`` of the smaller set.

    Returns ``(col_a, col_b, n_common, n_smaller, overlap_pct)``. Skips all-null columns and those more
    than 90% distinct. Every value is grouped once with a bit per column holding it, partly
    before the shuffle, so a value found everywhere costs one row per task; pairs are formed
    only from the few distinct bit sets.
    """
    inner, cols, names = _flat(df)
    picked, filled = _column_stats(df)
    if len(picked) < 2:
        ddl = "col_a string, col_b string, n_common long, n_smaller long, overlap_pct int"
        return df.sparkSession.createDataFrame([], ddl)
    cols, names = [cols[i] for i in picked], [names[i] for i in picked]
    masks = _masks(len(cols))

    def cell(i: int, c: str) -> Column:
        bits = [F.lit(1 << (i % _BITS) if i // _BITS == j else 0).cast("long").alias(m) for j, m in enumerate(masks)]
        return F.struct(F.col(c).cast("string").alias("v"), *bits)

    cells = F.array(*[cell(i, c) for i, c in enumerate(cols)])
    long = inner.select(*cols).select(F.inline(cells)).where("v is not null")
    held_by = [F.bit_or(m).alias(m) for m in masks]
    members = F.array_compact(F.array(*[F.when(_has(i), F.lit(i)) for i in range(len(cols))]))

    def column_sets(values: DataFrame) -> DataFrame:
        """Number of values per set of columns holding them."""
        return values.groupBy(*masks).agg(F.count("v").alias("n_values")).where("n_values > 0").select(members.alias("members"), "n_values")

    def set_sizes(sets: DataFrame, size: str) -> DataFrame:
        return sets.select(F.explode("members").alias("c"), "n_values").groupBy("c").agg(F.sum("n_values").alias(size))

    # First by the raw text, for the exact distinct limit, then by the trimmed text. Blank text becomes
    # null only at the end: a filter would move below the first grouping, which both uses share.
    raw = long.groupBy("v").agg(*held_by)
    trimmed = raw.select(trim_text(F.col("v")).alias("v"), *masks).groupBy("v").agg(*held_by)
    trimmed = trimmed.withColumn("v", F.nullif(F.col("v"), F.lit("")))
    limit = F.get(F.array(*[F.lit(n) for n in filled]), F.col("c")) * MAX_DISTINCT_SHARE
    allowed = set_sizes(column_sets(raw), "n_raw").where(F.col("n_raw") <= limit).select("c")
    sets = column_sets(trimmed)
    sizes = set_sizes(sets, "size").join(allowed, "c")
    pairs = F.flatten(
        F.transform(
            "members",
            lambda a: F.transform(F.filter("members", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))),
        )
    )
    common = sets.select(F.explode(pairs).alias("p"), "n_values").groupBy("p.a", "p.b").agg(F.sum("n_values").alias("n_common"))
    name = F.array(*[F.lit(n) for n in names])
    joined = common.join(sizes.select(F.col("c").alias("a"), F.col("size").alias("size_a")), "a").join(
        sizes.select(F.col("c").alias("b"), F.col("size").alias("size_b")), "b"
    )
    smaller = F.least("size_a", "size_b")
    share = F.col("n_common") / smaller
    return joined.where(share > min_overlap).select(
        F.get(name, F.col("a")).alias("col_a"), F.get(name, F.col("b")).alias("col_b"), "n_common",
        smaller.alias("n_smaller"), F.floor(share * 100).cast("int").alias("overlap_pct"),
    )


def shared_values_sampled(df: DataFrame, n: int, key: list[str], seed: int = 0, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The same report from a repeatable sample of ``n`` rows."""
    return shared_values(sample_rows(df, n, key, seed), min_overlap)


def shared_values_sketch(df: DataFrame, min_overlap: float = MIN_OVERLAP, lg_k: int = 14) -> DataFrame:
    """Approximate report from one theta sketch per column: one scan, nothing but sketches shuffled."""
    inner, cols, names = _flat(df)
    v = {c: trim_text(F.col(c).cast("string")) for c in cols}
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}_n"),
            F.theta_sketch_agg(F.when(v[c] != "", v[c]), lg_k).alias(f"{c}_s"),
        ]
    one = inner.agg(*aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"), F.lit(n).alias("name"), F.col(f"{c}_n").alias("n"), F.col(f"{c}_s").alias("s"),
                F.theta_sketch_estimate(f"{c}_s").alias("d"),
            )
            for i, (c, n) in enumerate(zip(cols, names))
        ]
    )
    kept = F.filter(entries, lambda e: (e["n"] > 0) & (e["d"] > 0) & (e["d"] <= MAX_DISTINCT_SHARE * e["n"]))
    left = one.select(kept.alias("kept")).select("kept", F.explode("kept").alias("a"))
    both = left.select("a", F.explode(F.filter("kept", lambda b: b["i"] > F.col("a.i"))).alias("b"))
    common = F.theta_sketch_estimate(F.theta_intersection(F.col("a.s"), F.col("b.s")))
    smaller = F.least("a.d", "b.d")
    return (
        both.select(
            F.col("a.name").alias("col_a"), F.col("b.name").alias("col_b"), common.alias("n_common"), smaller.alias("n_smaller")
        )
        .where(F.col("n_common") > min_overlap * F.col("n_smaller"))
        .withColumn("overlap_pct", F.floor(F.col("n_common") / F.col("n_smaller") * 100).cast("int"))
    )


def contamination_report(shared: DataFrame) -> DataFrame:
    """Both directions per column as text, ``other (NN% overlap)``."""
    note = lambda other: F.format_string("%s (%d%% overlap)", F.col(other), F.col("overlap_pct"))
    both = shared.select(F.col("col_a").alias("column_name"), note("col_b").alias("note")).unionByName(
        shared.select(F.col("col_b").alias("column_name"), note("col_a").alias("note"))
    )
    return both.groupBy("column_name").agg(F.array_sort(F.collect_list("note")).alias("overlaps"))
