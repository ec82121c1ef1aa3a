"""Chilean tax ids (RUT): cleaning, check digits, canonical form and extraction from text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let

# How a tax id is labelled and written.
LABEL = r"R\.?U\.?T\.?\s*[:N°ºo\.]*\s*"
LABELLED = rf"(?iU){LABEL}(\d{{1,2}}\.?\d{{3}}\.?\d{{3}}[\-–—][0-9Kk])"
BARE = r"(?iU)\b(\d{1,2}\.?\d{3}\.?\d{3}[\-–—][0-9Kk])\b"
NO_CHECK = rf"(?iU){LABEL}(\d{{1,2}}(?:\.\d{{3}}){{1,2}})(?![-\dKk])"
LOOSE = rf"(?iU){LABEL}(\d[\d\.\-Kk]{{6,15}})"
CARD = r"(?U)\b\d{1,2}\.\d{3}\.\d{3}-[\dkK]\b|\b\d{7,8}-[\dkK]\b"


def clean(raw: Column) -> Column:
    """Digits and check digit only, upper-case; null unless at least two of them and K only at the end."""
    return let(F.upper(F.regexp_replace(raw, "[^0-9kK]", "")), lambda kept: F.when(kept.rlike("^[0-9]+[0-9K]$"), kept))


def check_digit(body: Column) -> Column:
    """The modulo-11 check digit of a string of digits: weights 2 to 7 from the right, over and over."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d, i: d.try_cast("int") * (2 + i % 6))
    rest = F.aggregate(digits, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 11
    return F.get(F.array(*map(F.lit, "0K987654321")), rest)


def dotted(cleaned: Column) -> Column:
    """`123456785` as `12.345.678-5`."""
    body = F.substring(cleaned, 1, F.length(cleaned) - 1)
    return F.concat(F.regexp_replace(body, r"(?<=\d)(?=(\d{3})+$)", "."), F.lit("-"), F.right(cleaned, F.lit(1)))


def validate(raw: Column) -> Column:
    """The canonical form, or null if the check digit is wrong."""
    body = lambda c: F.substring(c, 1, F.length(c) - 1)
    return let(clean(raw), lambda c: F.when(check_digit(body(c)) == F.right(c, F.lit(1)), dotted(c)))


def validation(raw: Column) -> Column:
    """input, canonical (null if not valid), valid, and the check digit that the body should have."""
    said = let(clean(raw), lambda c: F.when(F.length(c) > 1, check_digit(F.substring(c, 1, F.length(c) - 1))))
    right = validate(raw)
    return F.struct(raw.alias("input"), right.alias("canonical"), right.isNotNull().alias("valid"), said.alias("dv"))


def _valid(text: Column, pattern: str, group: int = 1) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), validate), lambda x: x.isNotNull())


def extract(text: Column) -> Column:
    """The first labelled id that validates, else the first of any, else a labelled one without check digit as it stands."""
    return F.coalesce(F.get(_valid(text, LABELLED), F.lit(0)), F.get(_valid(text, BARE), F.lit(0)), F.nullif(F.regexp_extract(text, NO_CHECK, 1), F.lit("")))


def extract_all(text: Column) -> Column:
    """All labelled ids that validate, distinct, in order."""
    return F.array_distinct(_valid(text, LOOSE))


def extract_card(text: Column) -> Column:
    """The first valid id of an identity card, without dots and hyphen."""
    return clean(F.get(_valid(text, CARD, 0), F.lit(0)))
