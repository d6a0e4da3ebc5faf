"""Scores of all header pairs that score at all, without forming all pairs.

A score is 0 or at least 70, so only pairs able to reach 70 are built. Such a pair
shares a word, or a synonym category, or is alike letter by letter. Each case becomes
an equi-join key, and no qualifying pair lacks a common key:

* word: equal, subset, overlap and shared-word fuzzy matches;
* category: synonym matches;
* letters: without a shared word both fuzzy ratios are ``2 * LCS / (m + n)``, and the LCS
  is at most the number of common letters. With ``t`` needed letters, the first
  ``m - t + l`` letters of one header and ``n - t + l`` of the other, rarest first,
  share at least ``l`` (prefix filter). The key is a letter combination of size ``l``
  together with both lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.headers import normalize_header, sorted_text, synonym_exact, synonym_hits, tokens
from ..functions.similarity import (
    exact_score, fuzzy_cut, join_sorted, lcs_arrow, overlap_rule, set_ratio, sort_ratio, subset_rule, synonym_score,
)
from ..vocab import DEFAULT_VOCABULARY, Vocabulary

MICRO = 1_000_000

# What the scoring rules read of a pair.
SCORED = ["t_norm", "t_hits", "t_exact", "r_norm", "r_hits", "r_exact"]

# Letters from rare to common; only the speed depends on this order.
_RARITY = "zqxjkvbpygfwmucdlhrsnioate "
_SORTED = "abcdefghijklmnopqrstuvwxyz~"

# Headers of one key and side that a single join task takes on.
HOT_CHUNK = 20_000

# Where only some tables are matched, a key of more pairs than this gives those asked for only.
HOT_PAIRS = 1_000

# Beyond this combined length single letters replace pairs as keys, to bound their number.
_PAIR_KEY_LENGTH = 60


def header_features(norms: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, strict: bool = False) -> DataFrame:
    """Distinct headers of a column ``norm`` with their synonym categories: ``(norm, hits, exact)``.

    An empty header has no word and no letter, so no pair is ever built with it.
    """
    return norms.select("norm").distinct().select(
        "norm", synonym_hits(F.col("norm"), vocab, strict).alias("hits"), synonym_exact(F.col("norm"), vocab).alias("exact")
    )


def _letters(text: Column) -> Column:
    """Letters of a text, rarest first, each tagged with its running number among equals."""
    chars = F.array_sort(F.filter(F.split(F.translate(text, _RARITY, _SORTED), ""), lambda ch: ch != ""))
    return bind(
        chars, lambda cs: F.transform(cs, lambda ch, i: F.concat(ch, (i - F.array_position(cs, ch) + 1).cast("string")))
    )


def letter_mask(text: Column) -> Column:
    """A bit for every character of a text that is not empty; characters 64 apart share one."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda acc, ch: acc.bitwiseOR(F.call_function("shiftleft", one, F.ascii(ch))))


def header_struct(norm: Column, side: str, ordinal: Column, vocab: Vocabulary, strict: bool) -> Column:
    """What :func:`with_scores` and :func:`may_score` need of one header, computed once however many headers it is put beside."""
    unlike = F.array_join(tokens(norm), " ")  # repeated words shorten one of the two ratios
    return F.struct(
        ordinal.alias(f"{side}_ord"), norm.alias(f"{side}_norm"), synonym_hits(norm, vocab, strict).alias(f"{side}_hits"),
        synonym_exact(norm, vocab).alias(f"{side}_exact"), letter_mask(norm).alias(f"{side}_letters"), tokens(norm).alias(f"{side}_words"),
        F.length(norm).alias(f"{side}_long"), F.length(unlike).alias(f"{side}_short"),
    )


def may_score() -> Column:
    """False only for pairs of :func:`header_struct` that score 0: no word or category in common and too few letters for a ratio of 70.

    Letters in common are at most the common bits and the lesser number of characters without a bit of their own, and the LCS at most that.
    """
    more = [F.col(f"{s}_long") - F.bit_count(f"{s}_letters") for s in ("t", "r")]
    common = F.bit_count(F.col("t_letters").bitwiseAND(F.col("r_letters"))) + F.least(*more)
    length = F.least(F.col("t_long") + F.col("r_long"), F.col("t_short") + F.col("r_short"))
    return (20 * common >= 7 * length) | F.arrays_overlap("t_hits", "r_hits") | F.arrays_overlap("t_words", "r_words")


def _letter_keys(headers: DataFrame, is_template: bool) -> DataFrame:
    """One row per header and letter key. Each step is a row generator, so nothing is computed twice."""
    norm = F.col("norm")
    # Repeated words change one of the two ratios only, so both spellings give keys.
    texts = F.array_distinct(F.array(sorted_text(norm), F.array_join(F.array_sort(tokens(norm)), " ")))
    m, n = F.length("text"), F.col("n")
    lengths = headers.select("*", F.explode(texts).alias("text")).select(
        *headers.columns, m.alias("m"), _letters(F.col("text")).alias("letters")
    )
    shortest, longest = F.ceil(F.lit(7) * F.col("m") / 13), F.floor(F.lit(13) * F.col("m") / 7)
    per_length = lengths.select("*", F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))).alias("n"))
    need = F.ceil(F.lit(7) * (F.col("m") + n) / 20).cast("int")
    pairs = (F.col("m") + n <= _PAIR_KEY_LENGTH) & (need >= 2)
    used = F.least(F.col("m"), F.col("m") - need + F.when(pairs, 2).otherwise(1))
    both = F.shiftleft("m", 16) + n if is_template else F.shiftleft(n, 16) + F.col("m")
    first = per_length.select(
        *headers.columns, both.alias("lengths"), pairs.alias("pairs"), F.slice("letters", F.lit(1), used).alias("prefix")
    ).select("*", F.posexplode("prefix").alias("i", "one"))
    rest = F.slice("prefix", F.col("i") + 2, F.size("prefix"))
    partners = F.when(F.col("pairs"), rest).otherwise(F.array(F.lit("")))
    return first.select(*headers.columns, "lengths", "one", F.explode(partners).alias("two")).select(
        *headers.columns, F.xxhash64("lengths", "one", "two").alias("key")
    ).distinct()


def _keyed(headers: DataFrame, is_template: bool) -> DataFrame:
    """One row per header and join key."""
    named = F.concat(
        F.transform(tokens(F.col("norm")), lambda w: F.concat(F.lit("w|"), w)),
        F.transform(F.col("hits"), lambda h: F.concat(F.lit("c|"), h.cast("string"))),
    )
    broad = headers.select("*", F.explode(named).alias("text")).select(*headers.columns, F.xxhash64("text").alias("key"))
    side = "t" if is_template else "r"
    keyed = broad.unionByName(_letter_keys(headers, is_template))
    return keyed.select("key", *[F.col(c).alias(f"{side}_{c}") for c in headers.columns])


def _spread(df: DataFrame, hot: DataFrame, own: str, other: str, norm: str) -> DataFrame:
    """Give each row its own part of a hot key, and a copy for every part of the other side."""
    parts = lambda side: F.coalesce(F.col(f"{side}_parts"), F.lit(1))
    mine = F.pmod(F.xxhash64(norm), parts(own)).cast("int").alias(f"{own}_part")
    theirs = F.explode(F.sequence(F.lit(0), parts(other) - 1)).alias(f"{other}_part")
    return df.join(hot, "key", "left").select(*df.columns, mine, theirs)


def _asked_pairs(left: DataFrame, right: DataFrame, t_in: DataFrame, r_for: DataFrame, parts: int = 16) -> DataFrame:
    """The pairs of keyed headers that meet in a template's columns and those of a table to be matched with it.

    A template that very many tables are matched with has few columns: these are copied and the other side is cut into parts.
    """
    mine = t_in.join(left, "t_norm").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    theirs = r_for.join(right, "r_norm").withColumn("part", F.pmod(F.xxhash64("r_norm"), F.lit(parts)).cast("int"))
    return mine.join(theirs, ["t_shape", "key", "part"]).drop("t_shape", "key", "part")


def requested_pairs(templates: DataFrame, raws: DataFrame, t_in: DataFrame, r_for: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """Distinct header pairs that may score, for matching only some tables with some templates.

    ``t_in`` lists ``(t_shape, t_norm)``, the columns of each template, and ``r_for`` ``(t_shape, r_norm)``, the columns of tables to be matched
    with it, both distinct. A key that few headers share gives all its pairs, at most ``most``, whoever asks; a word or
    category in very many headers gives only pairs of columns that do meet, so candidates grow with what is asked, not
    with the square of a key.
    """
    left, right = _keyed(templates, True), _keyed(raws, False)
    sizes = left.selectExpr("key", "1 AS t", "0 AS r").unionByName(right.selectExpr("key", "0 AS t", "1 AS r"))
    sizes = sizes.groupBy("key").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).where("t > 0 and r > 0")
    sizes = sizes.select("key", (F.col("t") * F.col("r") > most).alias("hot"))
    left, right = left.join(sizes, "key"), right.join(sizes, "key")
    few = left.where("not hot").drop("hot").join(right.where("not hot").drop("hot"), "key").drop("key")
    hot = _asked_pairs(left.where("hot").drop("hot"), right.where("hot").drop("hot"), t_in, r_for)
    return few.unionByName(hot).distinct()


def candidate_pairs(templates: DataFrame, raws: DataFrame, chunk: int | None = HOT_CHUNK) -> DataFrame:
    """Distinct header pairs that may score. Inputs come from :func:`header_features`.

    A word may be in a third of all headers. The rows of a key are cut into parts of about ``chunk`` headers
    per side, and each pair of parts is its own join key; other keys are not copied. ``None`` is for
    the columns of two single tables, which no key can make large.
    """
    left, right = _keyed(templates, True), _keyed(raws, False)
    if chunk is None:
        return left.join(right, "key").drop("key").distinct()
    sizes = left.selectExpr("key", "1 AS t", "0 AS r").unionByName(right.selectExpr("key", "0 AS t", "1 AS r"))
    hot = sizes.groupBy("key").agg(
        F.greatest(F.ceil(F.sum("t") / chunk), F.lit(1)).cast("int").alias("t_parts"),
        F.greatest(F.ceil(F.sum("r") / chunk), F.lit(1)).cast("int").alias("r_parts"),
    ).where("t_parts > 1 or r_parts > 1")
    pairs = _spread(left, hot, "t", "r", "t_norm").join(_spread(right, hot, "r", "t", "r_norm"), ["key", "t_part", "r_part"])
    return pairs.drop("key", "t_part", "r_part").distinct()


def with_scores(pairs: DataFrame, strict: bool = False, lcs=lcs_arrow) -> DataFrame:
    """Add ``score`` to pairs with ``t_norm, t_hits, t_exact, r_norm, r_hits, r_exact``.

    The rules apply in order and the first that fires decides; with ``strict``, sharing at most
    half of the words is a veto. Only pairs left open reach the string alignment. Each step
    refers to columns of the one before, so nothing is computed twice.
    """
    t, r, tw, rw = F.col("t_norm"), F.col("r_norm"), F.col("tw"), F.col("rw")
    split = pairs.withColumns({"tw": tokens(t), "rw": tokens(r)})
    counted = split.withColumns(
        {"n_t": F.size("tw"), "n_r": F.size("rw"), "both": F.array_intersect("tw", "rw")}
    ).withColumn("n_common", F.size("both"))
    sizes = F.col("n_common"), F.col("n_t"), F.col("n_r")
    rules = [
        exact_score(t, r),
        F.when((t == "") | (r == ""), F.lit(0.0)),
        synonym_score(F.col("t_hits"), F.col("t_exact"), F.col("r_hits"), F.col("r_exact"), strict),
        subset_rule(*sizes),
        overlap_rule(*sizes),
    ]
    if strict:
        rules.append(F.when(F.col("n_common") > 0, F.lit(0.0)))
    ruled = counted.withColumn("ruled", F.coalesce(*rules))
    open_ = F.col("ruled").isNull()
    parts = ruled.withColumns(
        {
            "sort_t": F.when(open_, sorted_text(t)), "sort_r": F.when(open_, sorted_text(r)),
            "diff_t": F.when(open_, join_sorted(F.array_except(tw, rw))),
            "diff_r": F.when(open_, join_sorted(F.array_except(rw, tw))),
            "shared": F.when(open_, F.length(F.array_join("both", " "))),
        }
    )
    aligned = parts.withColumns(
        {"lcs_sort": lcs(F.col("sort_t"), F.col("sort_r")), "lcs_set": lcs(F.col("diff_t"), F.col("diff_r"))}
    )
    fuzzy = fuzzy_cut(
        sort_ratio(F.length("sort_t"), F.length("sort_r"), F.col("lcs_sort")),
        set_ratio(F.col("n_t"), F.col("n_r"), F.col("shared"), F.length("diff_t"), F.length("diff_r"), F.col("lcs_set")),
    )
    return aligned.select(*pairs.columns, F.coalesce("ruled", fuzzy).alias("score"))


def score_features(t: DataFrame, r: DataFrame, strict: bool = False, chunk: int | None = HOT_CHUNK) -> DataFrame:
    """Positive scores of two sets of :func:`header_features`: ``(t_norm, r_norm, score, micro)``."""
    return positive_scores(candidate_pairs(t, r, chunk), strict)


def positive_scores(pairs: DataFrame, strict: bool = False, keep: Sequence[str] = ("t_norm", "r_norm")) -> DataFrame:
    """Positive scores of candidate pairs: ``score`` and ``micro`` beside the columns to keep."""
    scored = with_scores(pairs, strict).where("score > 0")
    return scored.select(*keep, "score", F.round(F.col("score") * MICRO).cast("long").alias("micro"))


def score_matrix(
    templates: DataFrame, raws: DataFrame, t_col: str = "column_name", r_col: str = "column_name",
    vocab: Vocabulary = DEFAULT_VOCABULARY, strict: bool = False, keep_unicode: bool = False,
) -> DataFrame:
    """Positive scores of distinct normalised header pairs: ``(t_norm, r_norm, score, micro)``.

    A pair that is absent scores 0. ``micro`` is the score in millionths, for exact sums.
    """
    t, r = (
        header_features(df.select(normalize_header(F.col(c), vocab, keep_unicode).alias("norm")), vocab, strict)
        for df, c in ((templates, t_col), (raws, r_col))
    )
    return score_features(t, r, strict)


def score_rows(
    df: DataFrame, t_col: str, r_col: str, vocab: Vocabulary = DEFAULT_VOCABULARY, strict: bool = False, lcs=lcs_arrow
) -> DataFrame:
    """Score the two headers of each row. Distinct pairs are scored once, then joined back."""
    norms = df.withColumns(
        {"t_norm": normalize_header(F.col(t_col), vocab), "r_norm": normalize_header(F.col(r_col), vocab)}
    )
    pairs = norms.select("t_norm", "r_norm").distinct()
    for side in ("t", "r"):
        norm = F.col(f"{side}_norm")
        pairs = pairs.withColumns(
            {f"{side}_hits": synonym_hits(norm, vocab, strict), f"{side}_exact": synonym_exact(norm, vocab)}
        )
    scored = with_scores(pairs, strict, lcs).select("t_norm", "r_norm", "score")
    return norms.join(scored, ["t_norm", "r_norm"], "left")
