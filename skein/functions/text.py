"""Normalised views of names and addresses, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Legal forms taken out of names.
LEGAL = (
    "inc|incorporated|corp|corporation|ltd|limited|pvt|private|llc|llp|plc|gmbh|sarl|sas|sa|co|company|assoc|associates|"
    "partners|group|holdings|enterprises|services|solutions|technologies|technology|industries|consultants|international|dba"
)
#: Address words and what they stand for, in order of use.
ABBREVIATIONS = (
    (r"\bst\b", "street"), (r"\brd\b", "road"), (r"\bave\b", "avenue"), (r"\bblvd\b", "boulevard"), (r"\bdr\b", "drive"),
    (r"\bln\b", "lane"), (r"\bct\b", "court"), (r"\bste\b", "suite"), (r"\bapt\b", "apartment"), (r"\bp\s*o\s*box\b", "pobox"),
)
#: Letters without a decomposition.
LETTERS = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o"), ("ł", "l"), ("Æ", "AE"), ("Œ", "OE"), ("Ø", "O"), ("Ł", "L"))


def _plain() -> tuple[str, str]:
    """Latin letters with marks, and the letters they are without."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[:1]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def latin(c: Column) -> Column:
    """Latin letters without their marks, JVM-side; other scripts stay."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), LETTERS, F.translate(c, *_plain()))


def _devanagari() -> dict[str, str]:
    """Devanagari to Latin, from the letters' Unicode names: consonants end in an A that a vowel sign replaces."""
    out = {}
    for c in map(chr, range(0x900, 0x980)):
        kind, _, name = unicodedata.name(c, "").removeprefix("DEVANAGARI ").rpartition(" ")
        if kind in ("LETTER", "VOWEL SIGN", "DIGIT") or c in "ंः्":
            out[c] = str(unicodedata.digit(c)) if kind == "DIGIT" else {"ं": "n", "ः": "h", "्": ""}.get(c, name.lower())
    return out


def ascii_of(text: str | None) -> str:
    """Latin and Devanagari letters as ASCII; what has no ASCII form goes."""
    table, out = _devanagari(), []
    for c in unicodedata.normalize("NFC", text or ""):
        if c in table and "ा" <= c <= "्" and out and out[-1].endswith("a"):
            out[-1] = out[-1][:-1]
        out.append(table.get(c) if c in table else dict(LETTERS).get(c, unicodedata.normalize("NFKD", c)))
    return "".join(x for x in "".join(out) if x.isascii())


@F.pandas_udf(StringType())
def transliterated(t: pd.Series) -> pd.Series:
    """ascii_of for columns with scripts that latin() doesn't know."""
    return t.map(ascii_of)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


def name_v1(c: Column, letters=latin) -> Column:
    """'&' as a word, no leading marks, web endings as words, no punctuation or legal forms."""
    x = F.replace(F.lower(letters(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    x = F.regexp_replace(F.regexp_replace(x, r"^[^a-z0-9]+", ""), r"\.(com|net|org|io|co|in)\b", " $1")
    return squeeze(F.regexp_replace(F.regexp_replace(x, r"[^\w\s]", " "), rf"\b({LEGAL})\b", " "))


def punct(c: Column, letters=latin) -> Column:
    return squeeze(F.regexp_replace(F.lower(letters(F.coalesce(c, F.lit("")))), r"[^\w\s]", " "))


def without_legal(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, rf"\b({LEGAL})\b", " "))


def address(c: Column, letters=latin) -> Column:
    x = reduce(lambda x, r: F.regexp_replace(x, *r), ABBREVIATIONS, punct(c, letters))
    return squeeze(F.regexp_replace(x, r"(\d+)(st|nd|rd|th)\b", "$1"))


def numbers(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)")), " ")


def postal(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(\d{5,6})\b", 1)


def street_key(norm: Column, nums: Column) -> Column:
    """The numbers and the first three other words of an address; empty without both."""
    street = F.array_join(F.slice(F.filter(words(norm), lambda x: ~x.rlike(r"^\d+$")), 1, 3), " ")
    return F.when((nums != "") & (street != ""), F.concat_ws("|", nums, street)).otherwise("")


def sound(name: Column) -> Column:
    first = F.coalesce(F.get(words(name), F.lit(0)), F.lit(""))
    return F.when(first.rlike("^[A-Za-z]+$"), F.soundex(first)).otherwise("")


def trigrams(c: Column) -> Column:
    """Three-character pieces of ' name ', repeats included; none for the empty name."""
    p = F.concat(F.lit(" "), c, F.lit(" "))
    return F.when(c != "", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - 2)), lambda i: F.substring(p, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def normalised(records: DataFrame, letters=latin) -> DataFrame:
    """Records with all views; null and blank names and addresses give empty ones. `letters`: latin or transliterated."""
    one = records.withColumns(
        {"name_norm": name_v1(F.col("business_name"), letters), "name_punct": punct(F.col("business_name"), letters), "address_punct": punct(F.col("business_address"), letters),
         "address_norm": address(F.col("business_address"), letters), "country_norm": F.lower(F.trim(F.coalesce("country", F.lit(""))))}
    )
    two = one.withColumns({"name_legal": without_legal(F.col("name_punct")), "address_numbers": numbers(F.col("address_norm")), "postal_code": postal(F.col("address_norm"))})
    return two.withColumns(
        {"name_tokens": words(F.col("name_legal")), "name_sorted": F.array_join(F.array_sort(words(F.col("name_legal"))), " "), "address_tokens": words(F.col("address_norm")),
         "name_view": F.when(F.col("name_legal") != "", F.col("name_legal")).otherwise(F.col("name_punct")),
         "addr_struct_key": street_key(F.col("address_norm"), F.col("address_numbers")), "phonetic": sound(F.col("name_legal"))}
    )
