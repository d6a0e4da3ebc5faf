"""Header vocabulary: synonym categories and abbreviations, as replaceable data.

Category order matters: the first category that both headers hit decides the
synonym score. Terms are compared after header normalisation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Own default word lists; pass another Vocabulary to replace them.
DEFAULT_SYNONYMS: dict[str, list[str]] = {
    "person_name": ["name", "full name", "display name", "contact person", "account holder"],
    "given_name": ["first name", "given name", "forename", "firstname"],
    "family_name": ["last name", "family name", "surname", "lastname"],
    "email": ["email", "mail", "e mail", "email address", "mailbox"],
    "phone": ["phone", "telephone", "mobile", "cell phone", "handset", "landline", "phone number"],
    "address": ["address", "street", "street address", "residence", "mailing address"],
    "city": ["city", "town", "municipality", "locality"],
    "region": ["state", "province", "county", "territory", "prefecture"],
    "postal_code": ["zip", "zip code", "postal code", "postcode", "pin code"],
    "country": ["country", "nation", "nationality", "country code"],
    "identifier": ["id", "key", "identifier", "uuid", "serial number", "record number"],
    "organisation": ["company", "organization", "organisation", "employer", "firm", "business"],
    "role": ["job title", "position", "occupation", "designation", "profession"],
    "division": ["department", "division", "team", "unit name"],
    "quantity": ["quantity", "count", "units", "pieces", "number of items"],
    "price": ["price", "cost", "unit price", "rate", "charge"],
    "amount": ["amount", "total", "sum", "value", "subtotal", "grand total"],
    "currency": ["currency", "currency code", "denomination"],
    "date": ["date", "day", "calendar date", "timestamp", "datetime"],
    "birth": ["birth date", "date of birth", "birthday", "born"],
    "age": ["age", "years old"],
    "gender": ["gender", "sex"],
    "status": ["status", "condition", "stage", "phase"],
    "description": ["description", "details", "notes", "remarks", "comment", "summary"],
    "product": ["product", "item", "sku", "article", "goods"],
    "category": ["category", "type", "kind", "class", "segment group"],
    "website": ["website", "url", "web page", "homepage", "link"],
}

DEFAULT_ABBREVIATIONS: dict[str, str] = {
    "acct": "account",
    "addr": "address",
    "amt": "amount",
    "avg": "average",
    "bday": "birthday",
    "cat": "category",
    "cnt": "count",
    "co": "company",
    "ctry": "country",
    "curr": "currency",
    "cust": "customer",
    "dept": "department",
    "desc": "description",
    "dob": "date of birth",
    "dt": "date",
    "emp": "employee",
    "fname": "first name",
    "ident": "identifier",
    "inv": "invoice",
    "lname": "last name",
    "max": "maximum",
    "min": "minimum",
    "mob": "mobile",
    "nbr": "number",
    "num": "number",
    "ord": "order",
    "org": "organization",
    "ph": "phone",
    "pos": "position",
    "prod": "product",
    "qty": "quantity",
    "ref": "reference",
    "st": "street",
    "tel": "telephone",
    "tot": "total",
    "yr": "year",
}

# Text that counts as missing after trimming (exact, case-sensitive).
NULL_TOKENS: tuple[str, ...] = ("", "nan", "None", "null", "NULL", "N/A", "n/a", "NoneType")

# What a CSV read turns into null (the documented default NA values of pandas.read_csv).
CSV_NULL_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class Vocabulary:
    """Synonym categories in priority order, plus word abbreviations."""

    synonyms: dict[str, list[str]] = field(default_factory=lambda: DEFAULT_SYNONYMS)
    abbreviations: dict[str, str] = field(default_factory=lambda: DEFAULT_ABBREVIATIONS)

    def normalised_terms(self) -> list[list[str]]:
        """Terms per category in header form (lower case, separators as blanks)."""
        out = []
        for terms in self.synonyms.values():
            clean = [" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in terms]
            out.append([t for t in dict.fromkeys(clean) if t])
        return out

    def synonym_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (cat, ordinal, term)
            for ordinal, (cat, terms) in enumerate(zip(self.synonyms, self.normalised_terms()))
            for term in terms
        ]
        return spark.createDataFrame(rows, "category string, cat_ord int, term string")

    def abbreviation_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.abbreviations.items()), "short string, long string")

    @classmethod
    def from_tables(cls, synonyms: DataFrame, abbreviations: DataFrame, max_rows: int = 100_000) -> Vocabulary:
        """Load a caller's vocabulary. It becomes part of the plan, so its size is checked."""
        syn = synonyms.orderBy("cat_ord", "term").limit(max_rows + 1).collect()
        abb = abbreviations.orderBy("short").limit(max_rows + 1).collect()
        if len(syn) > max_rows or len(abb) > max_rows:
            raise ValueError(f"vocabulary exceeds {max_rows} rows; it is meant to be a word list, not data")
        cats: dict[str, list[str]] = {}
        for r in syn:
            cats.setdefault(r["category"], []).append(r["term"])
        return cls(cats, {r["short"]: r["long"] for r in abb})


DEFAULT_VOCABULARY = Vocabulary()
