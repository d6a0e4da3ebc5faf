"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. DataFrame functions only.

Kinds: email, ip, card (Luhn), phone; and beyond these iban (mod 97) and ssn (only where a word nearby supports it). A kind's
pattern finds leftmost matches that do not overlap; a match that fails its check is dropped without a retry, but for iban, whose pattern finds the first four
characters: each end of a group behind them is tried, so words behind an IBAN do not hide it. The patterns are
written with possessive repeats and look-behinds, so they give the matches of the plain ones in a time linear in the text,
however long a run of digits or letters is. Places follow from splitting the text at the same pattern: a
match starts after all gaps and matches before it. Offsets are code points, ends exclusive.

Scores start at the kind's value, rise where a word of the kind stands within 40 characters before or 20 after in the text,
other matches included, and fall where a word speaks against it. Email, ip, card and phone spans stay whatever their score; others need ``LEAST``.

Null text is empty and has no spans. Each row stands for itself, so ties, repeats and other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colweave.functions.binding import bind

from .common import text_of

_LOCAL = "[A-Za-z0-9._%+-]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# An IBAN's country and check digits, and what may follow: one word, or groups of four and a rest, each a word of its own.
_IBAN = "[A-Z](?<![0-9A-Za-z][A-Z])[A-Z][0-9]{2}"
_RUN = r"(?:[0-9A-Z]{11,30}+(?![0-9A-Za-z])|(?:\x20[0-9A-Z]{4}(?![0-9A-Za-z])){2,7}+(?:\x20[0-9A-Z]{1,3}(?![0-9A-Za-z]))?+)"
# Characters of an IBAN by country.
_IBAN_LENGTHS = (
    " AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27"
    " GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22"
    " MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28"
    " TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "
)

# What must occur for a kind to be looked for, its pattern, score, supporting and opposing words nearby.
KINDS = {
    "email": ("@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "e-?mail|mailto|contact|write to", "example|noreply"),
    "ip": (".", r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}+", 0.6, "ip|address|host|server|login|client", "version|release|section"),
    "card": (None, r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])", 0.8, "card|visa|mastercard|amex|credit|debit|payment|cvv|expires", "isbn|order|tracking|serial"),
    "phone": ("+", r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])", 0.7, "phone|tel|call|mobile|fax|whatsapp", "score|total"),
    "iban": (None, rf"{_IBAN}(?={_RUN})", 0.8, "iban|account|bank|konto|transfer", "serial|key|hash"),
    "ssn": ("-", r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social security|tax id", "part|order|serial"),
}
BASE = ("email", "ip", "card", "phone")
LEAST = 0.5
#: Characters before and after a span in which words count, and those kept behind a match: the longest IBAN's rest and what follows it.
BEFORE, AFTER, AHEAD = 40, 20, 64
_TOGETHER = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = _digits(value)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + weigh(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's remainder is 1: first four characters last, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _iban(run: Column) -> Column:
    """The IBAN a run of groups begins with, null if none.

    A group may be the word behind the IBAN, so every end of a group is tried: the country's length is taken first, then the
    whole run, then, for countries not listed, the longest that passes.
    """
    plain = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    country = lambda s: F.concat(F.lit(" "), F.left(s, F.lit(2)))
    fits = lambda s: F.lit(_IBAN_LENGTHS).contains(F.concat(country(s), F.length(plain(s)).cast("string"), F.lit(" ")))
    listed = F.lit(_IBAN_LENGTHS).contains(country(run))
    shorter = F.when(run.contains(" "), F.array(*[F.left(run, F.lit(4 + 5 * k)) for k in range(7, 1, -1)])).otherwise(F.array().cast("array<string>"))
    tried = F.concat(F.array(run), F.filter(shorter, lambda s: ~listed | fits(s)))
    passed = F.filter(tried, mod97)
    return F.coalesce(F.get(F.filter(passed, fits), F.lit(0)), F.get(passed, F.lit(0)))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return luhn(value)
    if kind == "iban":
        return value.isNotNull()
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _placed(kind: str, matches: Column, text: Column) -> Column:
    """Checked and scored spans from a kind's matches."""
    _, pattern, score, support, against = KINDS[kind]
    n, gaps = F.size(matches), F.split(text, pattern, -1)
    # the text behind each match, whatever it holds: a look-ahead takes nothing away from the next match
    behind = F.regexp_extract_all(text, F.lit(rf"(?:{pattern})(?=((?s:.{{0,{AHEAD}}})))"), F.lit(1))
    # each match with the gap before it, made once for a text
    zipped = F.arrays_zip(matches.alias("match"), F.slice(gaps, F.lit(1), n).alias("gap"), behind.alias("behind"))
    value = lambda m: _iban(F.regexp_extract(F.concat(m["match"], m["behind"]), f"^{_IBAN}{_RUN}", 0)) if kind == "iban" else m["match"]
    around = F.transform(zipped, lambda m: F.struct(m["match"].alias("match"), m["gap"].alias("gap"), m["behind"].alias("behind"), value(m).alias("value")))
    around = F.transform(around, lambda m: F.struct(m["match"], m["gap"], m["behind"], m["value"], _valid(kind, m["value"]).alias("valid")))
    kind_of = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"
    zero = F.lit(0).cast("long")
    none = F.array().cast(kind_of)

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["gap"])
        before = F.right(F.concat(acc["before"], F.right(m["gap"], F.lit(BEFORE))), F.lit(BEFORE))
        # an IBAN reaches beyond its match, and what begins inside it is no span
        free = m["valid"] & (start >= acc["end"])
        after = F.substring(m["behind"], F.length(m["value"]) - F.length(m["match"]) + 1, F.lit(AFTER))
        one = F.struct(
            start.alias("start"), (start + F.length(m["value"])).alias("end"), m["value"].alias("value"), before.alias("before"), after.alias("after")
        )
        return F.struct(
            (start + F.length(m["match"])).alias("at"), F.when(free, start + F.length(m["value"])).otherwise(acc["end"]).alias("end"),
            F.right(F.concat(before, F.right(m["match"], F.lit(BEFORE))), F.lit(BEFORE)).alias("before"),
            F.when(free, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"),
        )

    # every step copies what is gathered, so matches are taken in short runs, each run's spans put away once
    numbers = F.sequence(F.lit(0), F.floor((n - 1) / _TOGETHER).cast("int"))
    runs = bind(around, lambda every: F.transform(numbers, lambda i: F.slice(every, i * _TOGETHER + 1, F.lit(_TOGETHER))))
    begin = F.struct(zero.alias("at"), zero.alias("end"), F.lit("").alias("before"), F.array().cast(f"array<{kind_of}>").alias("done"))

    def run(acc: Column, matches: Column) -> Column:
        fresh = F.struct(acc["at"].alias("at"), acc["end"].alias("end"), acc["before"].alias("before"), none.alias("out"))
        return bind(
            F.aggregate(matches, fresh, step),
            lambda r: F.struct(
                r["at"].alias("at"), r["end"].alias("end"), r["before"].alias("before"), F.concat(acc["done"], F.array(r["out"])).alias("done")
            ),
        )

    spans = F.aggregate(runs, begin, run, lambda acc: F.flatten(acc["done"]))
    near = lambda s, found: s["before"].rlike(rf"(?i)(?:{found})") | s["after"].rlike(rf"(?i)(?:{found})")
    points = lambda s: F.lit(score) + F.when(near(s, support), 0.3).otherwise(0.0) - F.when(near(s, against), 0.2).otherwise(0.0)
    scored = F.transform(
        spans,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.least(F.lit(1.0), points(s)).alias("score"),
        ),
    )
    return scored if kind in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)


_SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"


def find_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (a struct of all columns) and ``spans``: kind, start, end, value and score, by kind, then start."""
    rows = docs.select(F.struct("*").alias("row"), text_of(text).alias("t"))
    t = F.col("t")
    found = []
    for kind, (must, pattern, *_) in KINDS.items():
        matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        found.append((matches if must is None else F.when(t.contains(must), matches)).alias(kind))
    rows = rows.select("row", "t", *found)
    parts = [F.when(F.size(k) > 0, _placed(k, F.col(k), t)).otherwise(F.array().cast(_SPANS)) for k in KINDS]
    return rows.select("row", F.flatten(F.array(*parts)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
