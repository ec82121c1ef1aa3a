"""From document text to records: fields, completeness and review state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates, names, tax_id
from ledgerlens.functions.binding import strip

# What is said of records that nothing could be read of.
NOTHING = "OCR no extrajo ningún campo crítico (imagen ilegible o sin texto)"
# Types that are tax documents.
TAX_DOCUMENTS = ["factura_electronica", "boleta_electronica", "nota_credito", "guia_despacho", "dte_generico", "invoice_extranjera"]
# The fields that each document type requires, in order.
REQUIRED = {
    "factura_electronica": ["folio", "rut_emisor", "razon_social", "fecha_emision", "neto", "iva", "total"],
    "boleta_electronica": ["folio", "rut_emisor", "razon_social", "fecha_emision", "total"],
    "nota_credito": ["folio", "rut_emisor", "razon_social", "fecha_emision", "total"],
    "guia_despacho": ["folio", "rut_emisor", "razon_social", "fecha_emision"],
    "dte_generico": ["rut_emisor", "fecha_emision", "total"],
    "invoice_extranjera": ["fecha_emision", "total"],
    "desconocido": ["rut_emisor", "fecha_emision", "total"],
}


# How sure a field is that its text tells; anchors are at 0.7, what follows from others at 0.5.
SURE = {"rut_emisor": 0.8, "razon_social": 0.7, "folio": 0.8, "fecha_emision": 0.85, "total": 0.8}


def parse(docs: DataFrame, text: str = "text", this_year: Column | None = None) -> DataFrame:
    """docs with doc_type, the fields of a tax document, and `<field>_score` for how sure each is.

    Columns `anchor_total`, `anchor_folio`, `anchor_proveedor`, `anchor_fecha`, `anchor_rut`,
    `anchor_neto` and `anchor_iva`, where docs has them, fill what the text doesn't tell.
    """
    t = F.col(text)
    anchor = lambda name, kind: F.col(f"anchor_{name}").cast(kind) if f"anchor_{name}" in docs.columns else F.lit(None).cast(kind)
    docs = docs.withColumns({"doc_type": names.document_type(t), "rut_emisor": tax_id.extract(t), "folio": amounts.extract_folio(t), "fecha_emision": dates.extract(t, this_year), "total": amounts.extract_total(t)})
    docs = docs.withColumn("razon_social", names.extract_supplier(t, F.col("rut_emisor")))
    falsy = lambda c: F.nullif(F.col(c), F.lit(0))
    read = {"total": F.col("total").isNotNull(), "folio": falsy("folio").isNotNull(), "razon_social": F.col("razon_social").isNotNull(), "fecha_emision": F.col("fecha_emision").isNotNull(), "rut_emisor": F.col("rut_emisor").isNotNull()}
    beside = {"total": falsy("total").isNull() & anchor("total", "bigint").isNotNull(), "folio": falsy("folio").isNull() & (anchor("folio", "bigint") != 0), "razon_social": F.col("razon_social").isNull() & (anchor("proveedor", "string") != ""), "fecha_emision": F.col("fecha_emision").isNull() & anchor("fecha", "date").isNotNull(), "rut_emisor": F.col("rut_emisor").isNull() & tax_id.validate(anchor("rut", "string")).isNotNull()}
    foreign = F.col("doc_type") == "invoice_extranjera"
    sure = {f"{c}_score": F.when(F.coalesce(beside[c], F.lit(False)), 0.7).when(read[c], SURE[c]).when(foreign if c == "rut_emisor" else F.lit(False), 1.0).otherwise(0.0) for c in read}
    docs = docs.withColumns(sure).withColumns({
        "total": F.coalesce(falsy("total"), anchor("total", "bigint"), F.col("total")),
        "folio": F.coalesce(falsy("folio"), F.nullif(anchor("folio", "bigint"), F.lit(0)), F.col("folio")),
        "razon_social": F.coalesce("razon_social", names.normalize_name(anchor("proveedor", "string"))),
        "fecha_emision": F.coalesce("fecha_emision", anchor("fecha", "date")),
        "rut_emisor": F.coalesce("rut_emisor", tax_id.validate(anchor("rut", "string")), F.when(F.col("doc_type") == "invoice_extranjera", "EXTRANJERO")),
    })
    factura = F.col("doc_type") == "factura_electronica"
    every = tax_id.extract_all(t)
    other = F.when(F.size(every) >= 2, F.get(F.filter(every, lambda r: r != F.col("rut_emisor")), F.lit(0)))
    docs = docs.withColumns({"rut_receptor": F.when(factura, other), "neto": F.when(factura, F.nullif(anchor("neto", "bigint"), F.lit(0))), "iva": F.when(factura, F.nullif(anchor("iva", "bigint"), F.lit(0)))})
    rest = F.col("total") - F.col("iva")
    told = F.when(F.col("neto").isNotNull(), 0.7).when(rest > 0, 0.5).otherwise(0.0)
    of = lambda c: F.when(F.col(c).isNotNull(), 0.7).otherwise(0.0)
    docs = docs.withColumns({"neto_score": told, "iva_score": of("iva"), "rut_receptor_score": of("rut_receptor")})
    return docs.withColumn("neto", F.coalesce("neto", F.when(rest > 0, rest)))


def assess(fields: DataFrame) -> DataFrame:
    """fields with missing (required fields without a value), completeness, estado and motivo."""
    lacks = {f: F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED["factura_electronica"]}
    missing, needed = F.array().cast("array<string>"), F.lit(0)
    for kind, wanted in REQUIRED.items():
        missing = F.when(F.col("doc_type") == kind, F.array_compact(F.array(*(lacks[f] for f in wanted)))).otherwise(missing)
        needed = F.when(F.col("doc_type") == kind, len(wanted)).otherwise(needed)
    fields = fields.withColumns({"missing": missing, "_needed": needed})
    fields = fields.withColumn("completeness", F.when(F.col("_needed") > 0, (F.col("_needed") - F.size("missing")) / F.col("_needed")).otherwise(0.0)).drop("_needed")
    some = (F.col("rut_emisor") != "") | (F.col("razon_social") != "") | F.col("fecha_emision").isNotNull() | (F.col("total") != 0) | (F.col("folio") != 0)
    state = F.when(~F.coalesce(some, F.lit(False)), "REJECTED").when(F.size("missing") == 0, "OK").otherwise("QUARANTINE")
    reason = F.concat(F.lit("Faltan: "), F.array_join("missing", ", "), F.format_string(" | Completitud: %.0f%%", F.col("completeness") * 100))
    return fields.withColumn("estado", state).withColumn("motivo", F.when(F.col("estado") == "REJECTED", NOTHING).when(F.col("estado") == "QUARANTINE", reason))


def native_records(docs: DataFrame, text: str = "text", this_year: Column | None = None) -> DataFrame:
    """Records of documents with a text layer: OK with a date, a tax id and a total."""
    fields = parse(docs, text, this_year)
    good = valid(F.col("fecha_emision"), F.col("rut_emisor"), F.col("total"))
    return fields.withColumns({"mes": F.date_format("fecha_emision", "yyyy-MM"), "estado": F.when(good, "OK").otherwise("QUARANTINE"), "motivo": F.when(~good, lacking(F.col("fecha_emision"), F.col("rut_emisor"), F.col("total")))})


def _there(value: Column) -> Column:
    return F.coalesce(value.cast("string") != "", F.lit(False))


def valid(date: Column, rut: Column, total: Column) -> Column:
    """Whether a record may go to the sheet without review."""
    return _there(date) & _there(rut) & total.isNotNull()


def lacking(date: Column, rut: Column, total: Column) -> Column:
    """The reason for review: a total of nought counts as lacking."""
    lacks = [F.when(~there, name) for name, there in (("fecha", _there(date)), ("rut", _there(rut)), ("total", F.coalesce(total != 0, F.lit(False))))]
    return F.concat(F.lit("Faltan: "), F.array_join(F.array_compact(F.array(*lacks)), ", "))


def complete(records: DataFrame) -> Column:
    """Whether date, number, supplier, tax id and total are all there; a nought isn't."""
    numbers = F.coalesce((F.col("folio") != 0) & (F.col("total") != 0), F.lit(False))
    return _there(F.col("fecha_emision")) & _there(F.col("razon_social")) & _there(F.col("rut_emisor")) & numbers


def is_tax_document(doc_type: Column) -> Column:
    return F.coalesce(doc_type.isin(TAX_DOCUMENTS), F.lit(False))


def key_flags(fecha: str = "fecha_emision", rut: str = "rut_emisor", total: str = "total", proveedor: str = "razon_social", folio: str = "folio") -> dict[str, Column]:
    """Columns that tell which key fields a record has."""
    found = {"fecha": _there(F.col(fecha)), "rut": _there(F.col(rut)), "total": F.col(total).isNotNull(), "proveedor": _there(F.col(proveedor)), "nro_documento": F.col(folio).isNotNull()}
    return {f"tiene_{k}": v for k, v in found.items()}


def with_box(box: Column, text: Column) -> Column:
    """The text of a box that was read on its own, if any, before the whole text."""
    return F.when(_there(box), F.concat_ws("\n", box, text)).otherwise(text)


def join_pages(pages: Column) -> Column:
    """The texts of pages, but of empty ones, as one."""
    return F.array_join(F.filter(pages, lambda p: p != ""), "\n")


def join_lines(lines: DataFrame, key: str = "doc_id", order: str = "at", text: str = "text") -> DataFrame:
    """key and text: the lines of each document in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("text"))


def preview(text: Column, most: int = 1_500) -> Column:
    return F.coalesce(F.substring(text, 1, most), F.lit(""))


def shortened(text: Column, most: int = 40) -> Column:
    """A text that is too long with an ellipsis for its last letters; none as a dash."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).when(_there(text), text).otherwise("—")


def cards(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with rut, numero_documento, fecha_nacimiento, completeness and estado of an identity card."""
    docs = docs.withColumns({"rut": tax_id.extract_card(F.upper(F.col(text))), "numero_documento": amounts.card_number(F.col(text)), "fecha_nacimiento": amounts.card_birth(F.col(text))})
    has = F.col("rut").isNotNull().cast("int") + (F.col("numero_documento") != "").cast("int")
    return docs.withColumns({"completeness": F.coalesce(has, F.col("rut").isNotNull().cast("int")) / 4, "estado": F.when(F.col("rut").isNotNull() & (F.col("numero_documento") != ""), "OK").otherwise("QUARANTINE")})


# What a merged text is called by the reader that it begins with.
ENGINES = ["dual_paddle_priority", "dual_tess_priority"]


def text_quality(text: Column, this_year: Column | None = None) -> Column:
    """How much a reader's text tells: 5 for a labelled tax id, 3 for a date, 4 for a total, 1 for length."""
    total = F.coalesce(amounts.extract_total(text), F.lit(0)) != 0
    points = [(text.rlike(tax_id.LABELLED), 5), (dates.extract(text, this_year).isNotNull(), 3), (total, 4), (F.length(strip(text)) > 50, 1)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def merge_readers(first: DataFrame, second: DataFrame, key: str, this_year: Column | None = None) -> DataFrame:
    """One text of two readers' (key, text, score) for each document: the better one, then the other; ties to the first.

    Where both have `lines`, these are the first reader's and then the second's, whichever is better.
    """
    lines = ["lines"] if "lines" in first.columns and "lines" in second.columns else []
    a = first.select(key, F.col("text").alias("_a"), F.col("score").alias("_sa"), *[F.col(c).alias("_la") for c in lines])
    both = a.join(second.select(key, F.col("text").alias("_b"), F.col("score").alias("_sb"), *[F.col(c).alias("_lb") for c in lines]), key)
    second_wins = text_quality(F.col("_b"), this_year) > text_quality(F.col("_a"), this_year)
    return both.select(
        key,
        F.when(second_wins, F.concat_ws("\n", "_b", "_a")).otherwise(F.concat_ws("\n", "_a", "_b")).alias("text"),
        ((F.col("_sa") + F.col("_sb")) / 2).alias("score"),
        F.when(second_wins, ENGINES[1]).otherwise(ENGINES[0]).alias("engine"),
        *[F.concat("_la", "_lb").alias(c) for c in lines],
    )
