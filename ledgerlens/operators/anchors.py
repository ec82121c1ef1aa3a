"""Fields beside anchor words, from tokens with coordinates: array<struct<text, left, top, width, height>>, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates
from ledgerlens.functions.binding import let, strip
from ledgerlens.functions.names import BAD

# Words that announce a field, words that end one, and what isn't a supplier's name.
ANCHORS = {
    "total": ["TOTAL"], "neto": ["NETO", "MONTO", "VALOR"], "iva": ["IVA"], "rut": ["RUT", "R.U.T", "R.U.T."], "factura": ["FACTURA"], "boleta": ["BOLETA"],
    "fecha": ["FECHA"], "emision": ["EMISION", "EMISIÓN"], "folio": ["FOLIO", "N°", "Nº", "N*"], "proveedor": ["RAZÓN", "RAZON", "EMPRESA", "NOMBRE"],
}
STOPPERS = [
    "BOLETA", "FACTURA", "GIRO", "DIRECCION", "DIRECCIÓN", "COMUNA", "CIUDAD", "S.I.I", "S.I.I.", "FECHA", "TELEFONO", "TELÉFONO", "EMAIL", "E-MAIL", "SEÑOR", "SEÑORES", "CONTACTO", "COMPRA", "ARTICULO",
    "ARTÍCULO", "VALOR", "EFECTIVO", "TARJETA", "DEBITO", "DÉBITO", "CREDITO", "CRÉDITO", "CAJA", "NETO", "IVA", "TOTAL", "SUBTOTAL", "DESCUENTO", "RECARGO", "CANCEL", "ARTURO", "HOSPITAL", "SERVICIO",
    "MONTO", "CANTIDAD", "RUT", "R.U.T", "R.U.T.", "FOLIO",
]
NOT_NAMES = [*BAD, "BOLETA", "FACTURA", "ELECTRONICA", "ELECTRÓNICA", "TRAD", "S.I.I", "CURICO", "CURICÓ"]
WITH_LINES = {"rut", "fecha", "emision", "folio"}
#: How far to the right of an anchor a value may begin.
REACH = 250


def word(text: Column) -> Column:
    return F.regexp_replace(F.upper(strip(F.coalesce(text, F.lit("")))), r"[.,:;]+$", "")


def _below(later: Column, top: Column, tolerance: Column) -> Column:
    """The words of the two lines that follow: a fold over the tokens after the anchor."""
    state = F.struct(F.lit(None).cast("int").alias("y"), F.lit(1).alias("more"), F.array().cast("array<string>").alias("words"))

    def take(s: Column, y: Column, more: Column, text: Column) -> Column:
        return F.struct(y.cast("int").alias("y"), more.cast("int").alias("more"), F.concat(s["words"], F.array(text)).alias("words"))

    def step(s: Column, t: Column) -> Column:
        y, text = t["top"], t["text"]
        over = (s["more"] < 0) | (text == "")
        first = s["y"].isNull()
        ended = F.struct(s["y"].alias("y"), F.lit(-1).alias("more"), s["words"].alias("words"))
        return (
            F.when(over | (first & (y <= top + tolerance)), s)
            .when(first, take(s, y, s["more"], text))
            .when(F.abs(y - s["y"]) <= tolerance, take(s, s["y"], s["more"], text))
            .when(y < s["y"], s)
            .when(s["more"] == 0, ended)
            .otherwise(take(s, y, s["more"] - 1, text))
        )

    return F.aggregate(later, state, step, lambda s: s["words"])


def spelled(name: str) -> list[str]:
    return sorted({k.rstrip(".") for k in ANCHORS[name]} | set(ANCHORS[name]))


def stripped(tokens: Column) -> Column:
    """The tokens with their texts stripped, null ones empty."""
    return F.transform(tokens, lambda t: F.struct(strip(F.coalesce(t["text"], F.lit(""))).alias("text"), t["left"].alias("left"), t["top"].alias("top"), t["height"].alias("height")))


def hit(tokens: Column, reversed_words: Column, name: str) -> Column:
    """right (the next word on the line, null if there is none) and below, of the last anchor of this name; null without one.

    `reversed_words` are the tokens' words from the last to the first, so the place of a spelling in
    them tells its last one.
    """
    places = F.array(*[F.array_position(reversed_words, F.lit(k)) for k in spelled(name)])
    nearest = F.array_min(F.filter(places, lambda p: p > 0))

    def beside(at: Column) -> Column:
        later = F.slice(tokens, at + 2, F.size(tokens))
        return let(F.struct(F.get(tokens, at).alias("anchor"), later.alias("later")), lambda x: _beside(x["anchor"], x["later"], name in WITH_LINES))

    return F.when(nearest.isNotNull(), let((F.size(tokens) - nearest).cast("int"), beside))


def _beside(anchor: Column, later: Column, with_lines: bool) -> Column:
    height = F.coalesce(F.nullif(anchor["height"], F.lit(0)), F.lit(20))
    tolerance = F.greatest(F.lit(8), F.floor(height / 2).cast("int"))
    events = F.filter(later, lambda t: (t["text"] != "") & ((F.abs(t["top"] - anchor["top"]) > tolerance) | (t["left"] - anchor["left"]).between(0, REACH)))
    right = let(F.get(events, F.lit(0)), lambda e: F.when((F.abs(e["top"] - anchor["top"]) <= tolerance) & ~word(e["text"]).isin(STOPPERS), F.regexp_replace(e["text"], r"^[\$:N°ºo\*\.]+(?U)\s*", "")))
    below = _below(later, anchor["top"], tolerance) if with_lines else F.array().cast("array<string>")
    return F.struct(right.alias("right"), below.alias("below"))


def _candidates(h: Column) -> Column:
    return F.concat(F.when(h["right"] != "", F.array(h["right"])).otherwise(F.array().cast("array<string>")), h["below"])


def fields(docs: DataFrame, tokens: str = "tokens", this_year: Column | None = None) -> DataFrame:
    """docs with anchor_rut, anchor_total, anchor_neto, anchor_iva, anchor_fecha, anchor_folio and anchor_proveedor."""
    names = ["rut", "total", "neto", "iva", "fecha", "emision", "folio", "proveedor"]
    docs = docs.withColumn("_tokens", stripped(F.col(tokens)))
    docs = docs.withColumn("_words", F.reverse(F.transform("_tokens", lambda t: F.regexp_replace(F.upper(t["text"]), r"[.,:;]+$", ""))))
    docs = docs.withColumns({f"_{n}": hit(F.col("_tokens"), F.col("_words"), n) for n in names})
    empty = F.array().cast("array<string>")
    every = {n: F.coalesce(_candidates(F.col(f"_{n}")), empty) for n in names}
    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    rut = first(F.transform(every["rut"], lambda c: F.nullif(F.regexp_extract(F.replace(c, F.lit(" "), F.lit("")), r"\d{1,2}\.?\d{3}\.?\d{3}-[0-9Kk]", 0), F.lit(""))))
    folio = first(F.transform(every["folio"], lambda c: F.nullif(F.regexp_extract(F.regexp_replace(c, "[.,]", ""), r"\d{3,12}", 0), F.lit("")).try_cast("bigint")))
    listed = F.transform(F.concat(F.when(F.col("_proveedor.right") != "", F.array("_proveedor.right")).otherwise(empty), F.coalesce(F.col("_rut.below"), empty)), lambda c: strip(c))
    named = F.filter(listed, lambda c: ~F.upper(c).rlike("|".join(w.replace(".", r"\.") for w in NOT_NAMES)) & F.length(c).between(4, 60) & ~c.rlike(r"\d{4,}"))
    docs = docs.withColumns({
        "anchor_rut": rut, "anchor_folio": folio, "anchor_proveedor": F.get(named, F.lit(0)),
        "anchor_fecha": dates.extract(F.array_join(F.concat(every["fecha"], every["emision"]), " "), this_year),
        **{f"anchor_{n}": amounts.anchored_money(F.col(f"_{n}.right")) for n in ("total", "neto", "iva")},
    })
    return docs.drop("_tokens", "_words", *(f"_{n}" for n in names))


#: Words after a keyword among which its value is looked for, and the keywords.
AFTER, KEYWORDS = 5, ["TOTAL", "NETO", "RUT", "FACTURA"]


def next_words(texts: Column, keywords: list[str] = KEYWORDS, after: int = AFTER) -> Column:
    """For each keyword, the first word that isn't blank among those after it: of its first place that has one; else an empty text."""

    def value(said: Column, keyword: str) -> Column:
        follows = F.transform(said, lambda w, i: F.when(F.upper(w) == keyword, F.get(F.filter(F.slice(said, i + 2, F.lit(after)), lambda x: x != ""), F.lit(0))))
        return F.coalesce(F.get(F.filter(follows, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))

    said = F.transform(texts, lambda w: strip(F.coalesce(w, F.lit(""))))
    return let(said, lambda s: F.create_map(*[x for k in keywords for x in (F.lit(k), value(s, k))]))


def token_score(confidence: Column) -> Column:
    """A reader's confidence in percent as a share; a half where it tells none."""
    share = confidence.try_cast("double") / 100
    return F.when(share.isNull() | (share < 0), 0.5).otherwise(share)
