"""Dates in Spanish and English document text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let

# Month names and the short forms that documents use.
MONTHS = {
    "ene": 1, "enero": 1, "feb": 2, "febrero": 2, "mar": 3, "marzo": 3, "abr": 4, "abril": 4, "may": 5, "mayo": 5, "jun": 6, "junio": 6,
    "jul": 7, "julio": 7, "ago": 8, "agosto": 8, "sep": 9, "set": 9, "sept": 9, "septiembre": 9, "setiembre": 9, "oct": 10, "octubre": 10,
    "nov": 11, "noviembre": 11, "dic": 12, "diciembre": 12, "jan": 1, "january": 1, "february": 2, "march": 3, "april": 4, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
# The forms of dates, in order of precedence.
NUMERIC = [r"(?U)\b(\d{1,2})[\/\-\.](\d{1,2})[\/\-\.](\d{2,4})(?=[^\d]|$)", r"(?U)\b(\d{1,2})[\/\-\.](\d{1,2})[\/\-\.](\d{4})\d{2}:\d{2}:\d{2}"]
HYPHENED = rf"(?iU)\b(\d{{1,2}})[\-–—]({_NAMES})[\-–—](\d{{2,4}})\b"
WORDED = rf"(?iU)\b(\d{{1,2}})\s*(?:de\s+)?({_NAMES})\b(?:\s*(?:de\s+)?(?:del?\s+)?(\d{{2,4}}))?"
ENGLISH = rf"(?iU)\b({_NAMES})\b\s+(\d{{1,2}})(?:st|nd|rd|th)?[\,\s]+(\d{{2,4}})"


def _date(day: Column, month: Column, year: Column) -> Column:
    whole = let(year.try_cast("int"), lambda y: y + F.when(y < 70, 2000).when(y < 100, 1900).otherwise(0))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), two(month), two(day)).try_cast("date")


def _numeric(pattern: str) -> Callable[[Column], Column]:
    return lambda written: _date(*(F.regexp_extract(written, pattern, g) for g in (1, 2, 3)))


def _named(text: Column, pattern: str, day: int, month: int, year: Column | None = None) -> Column:
    numbers = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def parts(said: Column) -> Column:  # the text is searched once: what was found is short
        written = F.nullif(F.regexp_extract(said, pattern, 3), F.lit(""))
        number = numbers[F.lower(F.regexp_extract(said, pattern, month))]
        return F.when(said != "", _date(F.regexp_extract(said, pattern, day), number, written if year is None else F.coalesce(written, year)))

    return let(F.regexp_extract(text, pattern, 0), parts)


def extract(text: Column, this_year: Column | None = None) -> Column:
    """The first valid numeric date, else the first date with a month's name; day before month.

    A date without a year is of `this_year` (the current one, by default).
    """
    this_year = F.year(F.current_date()) if this_year is None else this_year
    found = []
    for pattern, parts in zip(NUMERIC, (r"^(\d+)\D(\d+)\D(\d+)$", NUMERIC[1])):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.get(F.filter(F.transform(whole, _numeric(parts)), lambda d: d.isNotNull()), F.lit(0)))
    return F.coalesce(*found, _named(text, HYPHENED, 1, 2), _named(text, WORDED, 1, 2, this_year.cast("string")), _named(text, ENGLISH, 2, 1))


def month_of(iso: Column) -> Column:
    """`yyyy-MM` of an ISO date text."""
    return F.when(F.length(iso) >= 7, F.substring(iso, 1, 7))
