"""Amounts, document numbers and what an identity card says, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import digits, let, strip

# How totals and document numbers are written, in order of precedence.
TOTALS = [r"(?isU)total\b[^\d]{0,15}?([\d\.\,]{3,})", r"(?U)\bTOTAL\s+([\d\.\,]+)", r"(?isU)(?:monto|total)\s+a\s+pagar\b[^\d]{0,15}?([\d\.\,]{3,})", r"(?iU)(?<![A-Za-z0-9])\$\s*([\d\.\,]{3,})"]
FOLIOS = [
    r"(?U)\bN[°ºo\*\.]?\s*(\d{3,12})\b",
    r"(?iU)(?:factura|boleta)\s*n[°ºo\*\.]?\s*(\d{3,12})",
    r"(?iU)(?:factura|boleta)\s+(?:electr[oó]nica\s+)?n[°ºo\*\.]?\s*(\d{3,12})",
    r"(?iU)\bfolio\s*n[°ºo\*\.]?\s*(\d{1,10})",
    r"(?iU)(?:factura|boleta)\s+(\d{4,10})\b",
    r"(?iU)\bNRO\.?\s*[:N°ºo\.]*\s*(\d{2,12})\b",
]
CARD_NUMBER = r"(?U)NUMERO\s*DE\s*DOCUMENTO\s*[\n:]*\s*([\d\.]+)"
CARD_BIRTH = r"(?U)FECHA\s*DE\s*NACIMIENTO\s*[\n:]*\s*(\d{2}[\s/.-]+\w+[\s/.-]+\d{4})"


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def money(raw: Column) -> Column:
    """Whole pesos: one or two digits after a last point or comma are cents, all other points and commas separators."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(digits(raw), r"(?U)\s", ""), r"[.,]\d{1,2}$", ""), "[.,]", "").try_cast("bigint")


def anchored_money(raw: Column) -> Column:
    """As money() reads, but a lone comma is a decimal comma: the rule for amounts beside a label."""
    plain = lambda x: F.replace(x, F.lit("."), F.lit(""))
    number = let(strip(digits(raw)), lambda x: F.when(x.contains(","), F.translate(F.when(x.contains("."), plain(x)).otherwise(x), ",", ".")).otherwise(plain(x)))
    return number.try_cast("double").try_cast("bigint")


def extract_total(text: Column) -> Column:
    """The first pattern that occurs decides, even if its number can't be read."""
    found = F.lit(None).cast("bigint")
    for pattern in reversed(TOTALS):
        whole = F.regexp_extract(text, pattern, 1)  # no pattern's group can be empty
        found = let(whole, lambda said, rest=found: F.when(said != "", money(said)).otherwise(rest))
    return found


def extract_folio(text: Column) -> Column:
    return F.coalesce(*[digits(_group(text, p)).try_cast("bigint") for p in FOLIOS])


def card_number(text: Column) -> Column:
    return F.replace(_group(F.upper(text), CARD_NUMBER), F.lit("."), F.lit(""))


def card_birth(text: Column) -> Column:
    return _group(F.upper(text), CARD_BIRTH)


def pesos(amount: Column) -> Column:
    """`1234567` as `$1.234.567`; null as a dash."""
    return F.coalesce(F.concat(F.lit("$"), F.translate(F.format_number(amount, 0), ",", ".")), F.lit("—"))
