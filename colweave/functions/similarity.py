"""Pair scores between two normalised headers, 0 or 70..100."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .headers import words

FUZZY_MIN = 70.0


def _lcs_long(a: str, b: str) -> int:
    """Longest common subsequence length, bits of one big integer per position of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def lcs_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """LCS lengths of many string pairs at once; strings up to 64 characters share uint64 lanes."""
    out = np.zeros(len(left), dtype=np.int32)
    lens = np.fromiter((len(s) for s in left), dtype=np.int64, count=len(left))
    rlens = np.fromiter((len(s) for s in right), dtype=np.int64, count=len(right))
    short = np.flatnonzero((lens > 0) & (rlens > 0) & (lens <= 64))
    for i in np.flatnonzero((lens > 64) & (rlens > 0)):
        out[i] = _lcs_long(left[i], right[i])
    if not len(short):
        return out
    width, rwidth = int(lens[short].max()), int(rlens[short].max())
    a = np.array([left[i] for i in short], dtype=f"<U{width}").view(np.uint32).reshape(-1, width)
    b = np.array([right[i] for i in short], dtype=f"<U{rwidth}").view(np.uint32).reshape(-1, rwidth)
    bits = np.left_shift(np.uint64(1), np.arange(width, dtype=np.uint64))
    inside = np.arange(width)[None, :] < lens[short][:, None]
    row = np.full(len(short), np.iinfo(np.uint64).max, dtype=np.uint64)
    for j in range(rwidth):
        same = (a == b[:, j : j + 1]) & inside & (j < rlens[short])[:, None]
        hit = row & np.where(same, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        row = (row + hit) | (row - hit)
    used = np.where(inside, bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    out[short] = np.bitwise_count(~row & used)
    return out


@F.pandas_udf(T.IntegerType())
def _lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length per row; rows with a null side are skipped and stay null."""
    todo = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.array([None] * len(a), dtype="Int32"), index=a.index)
    if todo.any():
        out[todo] = lcs_lengths(a[todo].tolist(), b[todo].tolist())
    return out


# Marked nondeterministic so that no filter above is pushed below it and runs it a second time.
lcs_arrow = _lcs_udf.asNondeterministic()


def lcs_native(a: Column, b: Column) -> Column:
    """The same LCS length with built-in higher-order functions only."""
    n = F.length(b)
    rows = F.aggregate(
        F.filter(F.split(a, ""), lambda ch: ch != ""),
        F.array_repeat(F.lit(0), n + 1),
        lambda prev, ch: F.aggregate(
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
            F.array(F.lit(0)),
            lambda cur, j: F.array_append(
                cur,
                F.when(F.substring(b, j, F.lit(1)) == ch, F.get(prev, j - 1) + 1).otherwise(
                    F.greatest(F.get(prev, j), F.get(cur, j - 1))
                ),
            ),
        ),
    )
    return F.when(a.isNotNull() & b.isNotNull(), F.element_at(rows, -1))


def exact_score(t: Column, r: Column) -> Column:
    """100 for equal headers; an empty header never matches."""
    return F.when((t == r) & (t != ""), F.lit(100.0))


def synonym_score(t_hits: Column, t_exact: Column, r_hits: Column, r_exact: Column, strict: bool = False) -> Column:
    """95 / 92 / 88 for both / one / no listed header in the deciding category."""
    common = F.array_intersect(t_hits, r_hits)
    if strict:
        both = F.arrays_overlap(t_exact, r_exact)
        one = F.arrays_overlap(t_exact, common) | F.arrays_overlap(r_exact, common)
    else:
        first = F.array_min(common)
        both = F.array_contains(t_exact, first) & F.array_contains(r_exact, first)
        one = F.array_contains(t_exact, first) | F.array_contains(r_exact, first)
    level = F.when(both, F.lit(95.0)).when(one, F.lit(92.0)).otherwise(F.lit(88.0))
    return F.when(F.size(common) > 0, level)


def subset_rule(n_common: Column, n_t: Column, n_r: Column) -> Column:
    fewer = F.least(n_t, n_r)
    return F.when((fewer > 0) & (n_common == fewer), F.lit(95.0))


def overlap_rule(n_common: Column, n_t: Column, n_r: Column) -> Column:
    share = n_common / F.greatest(n_t, n_r, F.lit(1))
    return F.when(share > 0.5, F.lit(70.0) + share * 20.0)


def subset_score(t_tokens: Column, r_tokens: Column) -> Column:
    """95 when every word of the shorter header is in the longer one."""
    return subset_rule(F.size(F.array_intersect(t_tokens, r_tokens)), F.size(t_tokens), F.size(r_tokens))


def overlap_score(t_tokens: Column, r_tokens: Column) -> Column:
    """70 + 20 * share when more than half of the words are shared."""
    return overlap_rule(F.size(F.array_intersect(t_tokens, r_tokens)), F.size(t_tokens), F.size(r_tokens))


def join_sorted(tokens_: Column) -> Column:
    return F.array_join(F.array_sort(tokens_), " ")


def sort_ratio(len_a: Column, len_b: Column, lcs: Column) -> Column:
    total = len_a + len_b
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * lcs / total)


def set_ratio(n_t: Column, n_r: Column, shared: Column, len_l: Column, len_r: Column, lcs: Column) -> Column:
    """From the length of the shared words, and lengths and LCS of the differing words, each joined."""
    gap = F.when(shared > 0, 1).otherwise(0)
    whole_l, whole_r = shared + gap + len_l, shared + gap + len_r
    # Both differing parts follow the shared part, which counts as common in full.
    by_diff = 100.0 * (1 - (len_l + len_r - 2 * lcs) / (whole_l + whole_r))
    by_left = 100.0 * (1 - (gap + len_l) / (shared + whole_l))
    by_right = 100.0 * (1 - (gap + len_r) / (shared + whole_r))
    return (
        F.when((n_t == 0) | (n_r == 0), F.lit(0.0))
        .when((shared > 0) & ((len_l == 0) | (len_r == 0)), F.lit(100.0))
        .when(shared > 0, F.greatest(by_diff, by_left, by_right))
        .otherwise(by_diff)
    )


def token_sort_ratio(t: Column, r: Column, lcs=lcs_arrow) -> Column:
    """Indel similarity of the two headers with their words sorted."""
    a, b = join_sorted(words(t)), join_sorted(words(r))
    return sort_ratio(F.length(a), F.length(b), lcs(a, b))


def token_set_ratio(t: Column, r: Column, lcs=lcs_arrow) -> Column:
    """Indel similarity over shared and differing words, duplicates ignored."""
    tw, rw = F.array_distinct(words(t)), F.array_distinct(words(r))
    left, right = join_sorted(F.array_except(tw, rw)), join_sorted(F.array_except(rw, tw))
    shared = F.length(F.array_join(F.array_intersect(tw, rw), " "))
    return set_ratio(F.size(tw), F.size(rw), shared, F.length(left), F.length(right), lcs(left, right))


def fuzzy_cut(sort: Column, set_: Column) -> Column:
    mean = (sort + set_) / 2
    return F.when(mean >= FUZZY_MIN, mean).when(mean.isNotNull(), F.lit(0.0))


def fuzzy_score(t: Column, r: Column, lcs=lcs_arrow) -> Column:
    """Mean of both ratios, 0 below the cut."""
    return fuzzy_cut(token_sort_ratio(t, r, lcs), token_set_ratio(t, r, lcs))
