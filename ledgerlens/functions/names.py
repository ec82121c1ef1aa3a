"""Supplier names and document types, as columns."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.binding import let, strip
from ledgerlens.functions.tax_id import LABEL

# Words kept in lower case, words that begin lines without a name, and words that no name has.
SMALL = ["de", "del", "la", "las", "los", "y", "e", "s.a.", "s.a", "spa", "ltda", "cia"]
STOPPERS = (
    r"(?iu)^(BOLETA|FACTURA|GIRO|DIRECCI[ÓO]N|COMUNA|CIUDAD|S\.?I\.?I\.?|FECHA|R\.?U\.?T\.?|TEL[EÉ]FONO|E-?MAIL|SEÑOR|SE[ÑN]OR\(?ES\)?|CONTACTO|COMPRA|"
    r"ART[IÍ]CULO|VALOR|EFECTIVO|TARJETA|D[EÉ]BITO|C[RÉ]EDITO|CAJA|NETO|IVA|TOTAL|SUBTOTAL|DESCUENTO|RECARGO|CANCEL|ARTURO|HOSPITAL|SERVICIO|M[OÓ]NTO|CANTIDAD|N[°ºo\*\.]?)"
)
BAD = ["VERIFIQUE", "DOCUMENTO", "WWW", "SII", "RES.", "RESOL", "TIMBRE", "CONTRIBUYENTE", "DECRETO", "TRANSACCION", "TRANSACCIÓN", "PAGUESE", "PÁGUESE", "EFECTIVO", "DEBITO", "DÉBITO", "CREDITO", "CRÉDITO", "VALOR", "FECHA", "TOTAL", "IVA"]
# What each document type says of itself, with weights; on ties the first type wins.
KEYWORDS = {
    "factura_electronica": {"FACTURA ELECTRONICA": 10, "FACTURA ELECTRÓNICA": 10, "FACTURA DE COMPRA": 5, "FACTURA DE VENTA": 5, "FACTURA EXENTA": 8},
    "boleta_electronica": {"BOLETA ELECTRONICA": 10, "BOLETA ELECTRÓNICA": 10, "BOLETA DE VENTA": 5, "BOLETA EXENTA": 6, "BOLETA HONORARIOS": 4},
    "nota_credito": {"NOTA DE CREDITO": 10, "NOTA DE CRÉDITO": 10, "NOTA CREDITO": 8, "NOTA CRÉDITO": 8},
    "guia_despacho": {"GUIA DE DESPACHO": 10, "GUÍA DE DESPACHO": 10},
    "cedula": {"CEDULA DE IDENTIDAD": 10, "CÉDULA DE IDENTIDAD": 10, "REPUBLICA DE CHILE": 5, "REPÚBLICA DE CHILE": 5, "SERVICIO DE REGISTRO CIVIL": 8},
    "invoice_extranjera": {"INVOICE": 10, "RECEIPT": 10, "GOOGLE PLAY": 10},
}
MARKERS = ["RUT", "FOLIO", "S.I.I", "SII"]
STRONG = 8
# Misreadings and what they stand for, replaced in this order.
TYPOS = [
    (r"(?iu)[ELT][Ll]?[EÉ]?[Cc]?[TC]?[TC]?[R]?[OÓ]?[N]?[C][AÁ]", "ELECTRONICA"),
    (r"(?iu)\bFACTUR[ÁA]\b", "FACTURA"),
    (r"(?iu)\bBOLET[ÁA]\b", "BOLETA"),
    (r"(?iu)\bCR[EÉ]DIT[OÓ]\b", "CREDITO"),
    (r"(?iu)\bBO[Ll][CE]?[TC]?[TC]?[AÁ]\b", "BOLETA"),
    (r"(?iu)\bF[AE]S?T?U[RN][AÁ]\b", "FACTURA"),
    (r"(?U)\s+", " "),
]
# What Unicode's compatibility form (NFKC) makes of single characters, and the letters that it composes with their marks.
_FORMS = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0x10000)])}
_PLAIN = {c: x for c, x in _FORMS.items() if x != c}
_ALIKE = {c: x for c, x in _PLAIN.items() if len(x) == 1}
_LONGER = {c: x for c, x in _PLAIN.items() if len(x) != 1}
_COMPOSED = {unicodedata.normalize("NFD", c): c for c, x in _FORMS.items() if x == c and c < "\u2000" and len(unicodedata.normalize("NFD", c)) > 1}


def plain(text: Column) -> Column:
    """Compatibility characters as plain ones (ligatures, circled and full-width forms, odd spaces), letters joined with their marks."""
    table = F.from_json(F.lit(json.dumps(_LONGER | _COMPOSED)), "map<string,string>")  # a constant
    odd = lambda a: a.rlike(r"\p{M}") | (F.length(F.translate(a, "".join(_LONGER), "")) < F.length(a))

    def longer(alike: Column) -> Column:
        pieces = F.regexp_extract_all(alike, F.lit(r"(?s).\p{M}*"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")

    alike = F.translate(text, "".join(_ALIKE), "".join(_ALIKE.values()))
    return F.when(text.rlike(r"[^\x00-\x7F]"), let(alike, lambda a: F.when(odd(a), longer(a)).otherwise(a))).otherwise(text)


def normalize_name(raw: Column) -> Column:
    """Compatibility characters plain, spaces collapsed, each word capitalised but the small ones."""
    text = strip(F.regexp_replace(plain(raw), r"(?U)\s+", " "))
    words = F.transform(F.split(text, " "), lambda w: F.when(F.lower(w).isin(SMALL), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def looks_like_name(line: Column) -> Column:
    letters, upper = F.length(F.regexp_replace(line, r"\P{L}+", "")), F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    bad = F.upper(line).rlike("|".join(w.replace(".", r"\.") for w in BAD))
    return F.length(line).between(4, 80) & ~bad & (letters >= 3) & (upper / F.greatest(letters, F.lit(1)) >= 0.7)


def extract_supplier(text: Column, rut: Column) -> Column:
    """The first name below the line of this tax id, else the first line in capitals that may be a name."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    return normalize_name(let(lines, lambda found: let(rut, lambda r: _supplier(found, r))))


def _supplier(lines: Column, rut: Column) -> Column:
    body = F.upper(F.substring(F.translate(rut, ".-", ""), 1, 8))
    # a line without the id's digits needs no search for its label, which is a pattern of its own for each id
    place = F.array_position(F.transform(lines, lambda x: F.upper(x).contains(body) & F.regexp_like(x, F.concat(F.lit(f"(?iU){LABEL}"), body))), True)
    below = F.filter(F.slice(lines, (place + 1).cast("int"), F.lit(4)), lambda x: ~x.rlike(STOPPERS) & ~x.rlike(r"(?i)R\.?U\.?T\.?") & ~x.rlike(r"\d{4,}") & looks_like_name(x))
    first = F.when(rut.isNotNull() & (place > 0), F.get(below, F.lit(0)))
    other = F.get(F.filter(lines, lambda x: ~x.rlike(STOPPERS) & ~x.rlike(r"\d") & looks_like_name(x)), F.lit(0))
    return F.coalesce(first, other)


def read_typos(text: Column) -> Column:
    for pattern, plain in TYPOS:
        text = F.regexp_replace(text, pattern, plain)
    return text


def _score(text: Column, words: dict[str, int]) -> Column:
    return sum((F.when(text.contains(w), n).otherwise(0) for w, n in words.items()), F.lit(0))


def document_type(text: Column) -> Column:
    """The type with the largest score in the text as it is or with typos read; else generic with two markers, else unknown."""
    both = let(F.upper(F.coalesce(text, F.lit(""))), lambda upper: F.array(upper, read_typos(upper)))
    most = lambda texts, words: F.greatest(*(_score(F.get(texts, F.lit(i)), words) for i in (0, 1)))
    scored = let(both, lambda texts: F.array(*(most(texts, words) for words in KEYWORDS.values()), most(texts, dict.fromkeys(MARKERS, 1))))

    def decide(scores: Column) -> Column:
        kinds = F.slice(scores, 1, len(KEYWORDS))
        first = F.get(F.array(*map(F.lit, KEYWORDS)), (F.array_position(kinds, F.array_max(kinds)) - 1).cast("int"))
        return F.when(F.array_max(kinds) >= STRONG, first).when(F.get(scores, F.lit(len(KEYWORDS))) >= 2, "dte_generico").otherwise("desconocido")

    return let(scored, decide)
