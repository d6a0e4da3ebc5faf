"""Header text as Column expressions: normalise, tokenise, synonym hits."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocab import DEFAULT_VOCABULARY, Vocabulary
from .binding import bind

# Java's Unicode white space plus the four separator controls Python also counts.
_WS = r"[\s\x1c-\x1f]"


def normalize_header(c: Column, vocab: Vocabulary = DEFAULT_VOCABULARY, keep_unicode: bool = False) -> Column:
    """Lower-case, separators to blanks, drop other symbols, squeeze blanks, expand abbreviations."""
    text = F.translate(F.lower(c.cast("string")), "_-.", "   ")
    keep = r"\p{L}\p{N}" if keep_unicode else "a-zA-Z0-9"
    kept = F.regexp_replace(text, rf"(?U)[^{keep}\s\x1c-\x1f]", "")
    squeezed = F.btrim(F.regexp_replace(kept, rf"(?U){_WS}+", " "))
    # Most headers are plain words already; one cheap test spares them the replacements.
    text = F.when(text.rlike(r"^[a-z0-9]+(?: [a-z0-9]+)*$"), text).otherwise(squeezed)
    if not vocab.abbreviations:
        return text
    # A constant that the optimizer folds: one map, not an expression per entry.
    table = F.from_json(F.lit(json.dumps(vocab.abbreviations)), "map<string,string>")
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " "
    )


def words(norm: Column) -> Column:
    """All words of a normalised header; an empty header has none."""
    return F.filter(F.split(norm, " "), lambda w: w != "")


def tokens(norm: Column) -> Column:
    """Distinct words of a normalised header."""
    return F.array_distinct(words(norm))


def sorted_text(norm: Column) -> Column:
    return F.array_join(F.array_sort(words(norm)), " ")


def _terms(vocab: Vocabulary) -> Column:
    """All terms with their category ordinal, in category order, as one folded constant."""
    rows = [{"c": i, "t": t} for i, terms in enumerate(vocab.normalised_terms()) for t in terms]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<c: int, t: string>>")


def synonym_hits(norm: Column, vocab: Vocabulary = DEFAULT_VOCABULARY, strict: bool = False) -> Column:
    """Ordinals of the categories a header hits.

    A hit is a listed term occurring anywhere in the header; with ``strict`` it must
    stand as whole words.
    """
    pad = (lambda x: F.concat(F.lit(" "), x, F.lit(" "))) if strict else (lambda x: x)
    return bind(
        pad(norm),
        lambda n: F.array_distinct(
            F.transform(F.filter(_terms(vocab), lambda x: F.contains(n, pad(x["t"]))), lambda x: x["c"])
        ),
    )


def synonym_exact(norm: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Ordinals of the categories that list the whole header."""
    return bind(norm, lambda n: F.transform(F.filter(_terms(vocab), lambda x: x["t"] == n), lambda x: x["c"]))
