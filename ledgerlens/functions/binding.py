"""A name for a value within an expression."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What Unicode counts as space: the characters that are stripped from the ends of texts.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without space of any kind at its ends."""
    return F.trim(text, F.lit(SPACE))


@cache
def _digits() -> tuple[str, str]:
    """All decimal digits of other scripts, and what they are worth."""
    found = [(chr(c), unicodedata.decimal(chr(c), None)) for c in range(128, sys.maxunicode + 1)]
    return "".join(c for c, n in found if n is not None), "".join(str(n) for _, n in found if n is not None)


def digits(text: Column) -> Column:
    """text with decimal digits of any script as 0 to 9."""
    return F.translate(text, *_digits())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once, however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
