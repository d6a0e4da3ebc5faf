"""Value cleaning, parsing and pattern tests as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import NULL_TOKENS

# The white space characters str.strip removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# One form per entry; a value takes the first form that parses.
DATE_FORMATS: tuple[str, ...] = ("MMM d yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")

_DAY, _CLOCK = r"\d{4}-\d{1,2}-\d{1,2}", r"[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
_ZONE = r"(?:Z|[+-](?:0\d|1[0-4])(?::?[0-5]\d)?)$"
_ISO, _ISO_ZONED = f"^{_DAY}(?:{_CLOCK})?$", f"^{_DAY}{_CLOCK}{_ZONE}"
_NAMED_MONTH = r"^([A-Za-z]{3,9} \d{1,2},? \d{4}|\d{1,2} [A-Za-z]{3,9} \d{4})$"
_NUMBER = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))$"

_EMAIL = r"^[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"

#: What may part the groups of a phone number, all kinds of white space among it.
PHONE_PARTING = "-." + WHITE_SPACE
#: How many digits the groups have: a prefix, an area and two local groups. Prefix and area may be absent.
PREFIX_DIGITS, AREA_DIGITS, LOCAL_DIGITS = (1, 2, 3), (2, 3, 4), (3, 4)


def _phone_outlines() -> list[str]:
    """Every outline a phone number may have: digits as 9, whatever parts groups as a blank.

    A plus may lead the prefix, a bracket may stand on either side of the area, and groups may touch.
    """
    parted = lambda group: [group, group + " "]
    prefixes = ["", *(x for n in PREFIX_DIGITS for sign in ("", "+") for x in parted(sign + "9" * n))]
    areas = ["", *(x for n in AREA_DIGITS for left in ("", "(") for right in ("", ")") for x in parted(left + "9" * n + right))]
    locals_ = [x + "9" * n for m in LOCAL_DIGITS for x in parted("9" * m) for n in LOCAL_DIGITS]
    return sorted({prefix + area + local for prefix in prefixes for area in areas for local in locals_})


PHONE_OUTLINES = _phone_outlines()


def filled(c: Column, t: T.DataType) -> Column:
    """The value, null where it is not a number: NaN is missing like null."""
    return F.when(~F.isnan(c), c) if isinstance(t, (T.FloatType, T.DoubleType)) else c


def trim_text(c: Column) -> Column:
    """Strip white space of every kind, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def null_tokens_to_null(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~c.isin(list(tokens)), c)


def clean_text(c: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Trim, then turn missing-value words into null."""
    return null_tokens_to_null(trim_text(c), tokens)


def strip_currency(c: Column) -> Column:
    """Remove currency signs, thousands commas, percent signs and white space. ``50%`` stays 50."""
    return F.translate(c, "$,£€%" + WHITE_SPACE, "")


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_number(c: Column) -> Column:
    """Strict number grammar to double: sign, decimals, exponent, infinity; else null."""
    return _number(trim_text(c))


def to_number(c: Column, decimal_comma: bool = False, accounting: bool = False) -> Column:
    """Number from text after :func:`strip_currency`, which leaves plain numbers as they are.

    ``decimal_comma`` reads ``1.234,56``; ``accounting`` reads ``(100)`` as -100.
    """
    text = c
    if accounting:
        text = F.regexp_replace(trim_text(text), r"^\((.*)\)$", "-$1")
    if decimal_comma:
        text = F.translate(text, ",.", "\u0001")
        return _number(F.translate(strip_currency(text), "\u0001", "."))
    return _number(strip_currency(text))


def _by_format(text: Column, fmt: str) -> Column:
    parsed = F.try_to_timestamp(text, F.lit(fmt))
    if "H" not in fmt and "h" not in fmt:
        parsed = parsed.cast("date")
    return parsed.cast("timestamp_ntz")


def _in_utc(text: Column) -> Column:
    """ISO date-time with a zone suffix as the UTC time it names; null for other text. The session's zone plays no part."""
    part = lambda i: F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})?$", i)
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    minutes = (60 * number(2) + number(3)) * F.when(part(1) == "-", -1).otherwise(1)
    wall = F.regexp_replace(text, _ZONE, "").try_cast("timestamp_ntz")
    return F.when(text.rlike(_ISO_ZONED), wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes))


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS, trimmed: bool = False) -> Column:
    """ISO date or date-time, else the first of ``formats`` that fits; else null.

    A time with ``Z`` or an offset becomes UTC; one without is taken as it stands.
    """
    text = c if trimmed else trim_text(c)
    iso = F.coalesce(F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz")), _in_utc(text))
    if not formats:
        return iso
    other = F.coalesce(*[_by_format(text, fmt) for fmt in formats])
    if tuple(formats) == DATE_FORMATS:
        # These forms all look alike, so one cheap test spares most values the formatters.
        other = F.when(text.rlike(_NAMED_MONTH), other)
    return F.coalesce(iso, other)


def is_email(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit("@")) & c.rlike(_EMAIL), F.lit(False))


def is_phone(c: Column) -> Column:
    """Whether the value's outline is one of ``PHONE_OUTLINES``, looked up among those of its length."""
    outline = F.translate(c, "0123456789" + PHONE_PARTING, "9" * 10 + " " * len(PHONE_PARTING))
    by_length: dict[int, str] = {}
    for o in PHONE_OUTLINES:
        by_length[len(o)] = by_length.get(len(o), "|") + o + "|"
    known = F.str_to_map(F.lit(";".join(f"{n}={text}" for n, text in by_length.items())), F.lit(";"), F.lit("="))
    alike = F.element_at(known, F.length(outline).cast("string"))
    return F.coalesce(F.contains(alike, F.concat(F.lit("|"), outline, F.lit("|"))) & ~F.contains(outline, F.lit("|")), F.lit(False))


def is_number_text(c: Column) -> Column:
    return to_number(c).isNotNull()


def is_date_text(c: Column, formats: Sequence[str] = DATE_FORMATS, trimmed: bool = False) -> Column:
    return parse_date(c, formats, trimmed).isNotNull()


def pattern_of(n: Column, n_email: Column, n_phone: Column, n_number: Column, n_date: Column) -> Column:
    """Pattern name from hit counts over ``n`` non-missing values, in fixed priority."""
    return (
        F.when(n == 0, "empty")
        .when(n_email == n, "email")
        .when(n_phone == n, "phone")
        .when(n_number * 2 >= n, "numeric")
        .when(n_date * 2 >= n, "date")
        .otherwise("text")
    )
