"""Registry of the engine's named queries and their reference SQL.

The queries read documents rendered from the order tables (`sources.render`); the SQL tells from
the order columns what they must find, without reading a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates, names, tax_id
from ledgerlens.operators import anchors, dispatch, jobs, metrics, records, templates
from ledgerlens.sources import files
from ledgerlens.sources.render import cards, documents, odd_texts, table, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The year of dates without one: fixed, so that results are.
YEAR = 2024

# What is known of each document: k key, st order status, tot total, sub subtotal, d date, region, the id's digits and check digits.
KNOWN = """
WITH base AS (
  SELECT o_orderkey k, o_custkey c, o_orderstatus st, CAST(floor(o_totalprice) AS BIGINT) tot, CAST(floor(o_totalprice / 2) AS BIGINT) sub, CAST(o_orderdate AS DATE) d, r_name region, CAST(10000000 + o_custkey AS VARCHAR) body,
    11 - list_sum(list_transform(range(8), lambda i: ((10000000 + o_custkey) // CAST(pow(10, i) AS BIGINT)) % 10 * (2 + i % 6))) % 11 rest
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
known AS (
  SELECT *, substr(body, 1, 2) || '.' || substr(body, 3, 3) || '.' || substr(body, 6, 3) dotted, CASE rest WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(rest AS VARCHAR) END dv,
    CASE st WHEN 'F' THEN 'factura_electronica' WHEN 'O' THEN 'boleta_electronica' ELSE 'nota_credito' END doc_type,
    'Comercial ' || CASE region WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE substr(region, 1, 1) || lower(substr(region, 2)) END || ' Limitada' supplier,
    'doc_' || k || CASE WHEN k % 3 = 0 THEN '.jpg' ELSE '.pdf' END archivo
  FROM base),
found AS (
  SELECT *, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 11 = 0 THEN substr(dotted, 1, 6) ELSE dotted || '-' || dv END rut_emisor, CASE WHEN k % 10 <> 3 THEN k + 100000 END folio, CASE WHEN k % 10 <> 4 THEN supplier END razon_social,
    CASE WHEN k % 10 <> 1 THEN d END fecha_emision, CASE WHEN k % 13 = 0 THEN sub WHEN k % 10 <> 2 THEN tot END total
  FROM known),
listed AS (
  SELECT *, list_filter([CASE WHEN folio IS NULL THEN 'folio' END, CASE WHEN rut_emisor IS NULL THEN 'rut_emisor' END, CASE WHEN razon_social IS NULL THEN 'razon_social' END, CASE WHEN fecha_emision IS NULL THEN 'fecha_emision' END,
      CASE WHEN st = 'F' THEN 'neto' END, CASE WHEN st = 'F' THEN 'iva' END, CASE WHEN total IS NULL THEN 'total' END], lambda x: x IS NOT NULL) missing, CASE WHEN st = 'F' THEN 7 ELSE 5 END needed
  FROM found),
recs AS (
  SELECT *, (needed - len(missing)) / CAST(needed AS DOUBLE) completeness, CASE WHEN len(missing) = 0 THEN 'OK' ELSE 'QUARANTINE' END estado FROM listed)
"""


def query(sql: str | None = None, known: bool = True):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (KNOWN if known else "") + sql
        return f

    return register


def made_once(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns of rows, behind a generator: filters on them don't go below it, where they would have the text read again."""
    return rows.select(F.inline(F.array(F.struct(*columns))))


def _records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return made_once(records.assess(records.parse(documents(spark, sf_dir), this_year=F.lit(YEAR))), *columns)


# --- tax ids ---


@query("SELECT c_custkey, body || '-' || dv AS canonical_input, substr(body, 1, 2) || '.' || substr(body, 3, 3) || '.' || substr(body, 6, 3) || '-' || dv AS canonical, body || dv AS cleaned, dv, CAST(NULL AS VARCHAR) AS wrong FROM (SELECT c_custkey, body, CASE rest WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(rest AS VARCHAR) END dv FROM (SELECT c_custkey, CAST(10000000 + c_custkey AS VARCHAR) body, 11 - list_sum(list_transform(range(8), lambda i: ((10000000 + c_custkey) // CAST(pow(10, i) AS BIGINT)) % 10 * (2 + i % 6))) % 11 rest FROM customer))", known=False)
def rut_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") + 10_000_000).cast("string").alias("body"))
    rows = rows.withColumn("dv", tax_id.check_digit(F.col("body"))).withColumn("canonical_input", F.concat_ws("-", "body", "dv"))
    wrong = F.concat("body", F.lit("-"), F.when(F.col("dv") == "5", "6").otherwise("5"))
    return rows.select("c_custkey", "canonical_input", tax_id.validate(F.col("canonical_input")).alias("canonical"), tax_id.clean(F.col("canonical_input")).alias("cleaned"), "dv", tax_id.validate(wrong).alias("wrong"))


@query("SELECT k AS doc_id, rut_emisor AS rut FROM found")
def rut_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tax_id.extract(F.col("text")).alias("rut"))


@query("SELECT k AS doc_id, '76.192.083-9' || CASE WHEN k % 10 = 0 OR k % 11 = 0 THEN '' ELSE ',' || dotted || '-' || dv END AS ruts FROM known")
def rut_all_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = F.concat_ws("\n", F.lit("R.U.T.: 76192083-9"), "text", "text")
    return documents(spark, sf_dir).select("doc_id", F.array_join(tax_id.extract_all(twice), ",").alias("ruts"))


@query("SELECT c_custkey, body || '-' || wrong AS input, CAST(NULL AS VARCHAR) AS canonical, false AS valid, dv FROM (SELECT c_custkey, body, dv, CASE dv WHEN '5' THEN '6' ELSE '5' END wrong FROM (SELECT c_custkey, body, CASE rest WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(rest AS VARCHAR) END dv FROM (SELECT c_custkey, CAST(10000000 + c_custkey AS VARCHAR) body, 11 - list_sum(list_transform(range(8), lambda i: ((10000000 + c_custkey) // CAST(pow(10, i) AS BIGINT)) % 10 * (2 + i % 6))) % 11 rest FROM customer)))", known=False)
def rut_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") + 10_000_000).cast("string").alias("body"))
    wrong = F.concat("body", F.lit("-"), F.when(tax_id.check_digit(F.col("body")) == "5", "6").otherwise("5"))
    return rows.select("c_custkey", tax_id.validation(wrong).alias("v")).select("c_custkey", "v.*")


# --- dates, amounts, numbers ---


@query("SELECT k AS doc_id, fecha_emision AS fecha FROM found")
def date_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", dates.extract(F.col("text"), F.lit(YEAR)).alias("fecha"))


@query("SELECT k AS doc_id, d AS glued, d AS short_year FROM known")
def date_glued_and_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    glued = F.concat(F.lit("99/99/1999 x "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("09:29:50"))
    short = F.concat(F.lit("dia "), F.date_format("o_orderdate", "d.M.yy"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), dates.extract(glued).alias("glued"), dates.extract(short).alias("short_year"))


@query("SELECT strftime(fecha_emision, '%Y-%m') AS mes, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM found WHERE fecha_emision IS NOT NULL GROUP BY 1")
def month_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(dates.extract(F.col("text"), F.lit(YEAR)).alias("fecha"), amounts.extract_total(F.col("text")).alias("total"))
    months = rows.groupBy(dates.month_of(F.col("fecha").cast("string")).alias("mes")).agg(F.count("*").alias("n"), F.sum("total").alias("total"))
    return made_once(months, "mes", "n", "total").where("mes is not null")  # after grouping: the date isn't read twice


@query("SELECT k AS doc_id, total FROM found")
def total_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", amounts.extract_total(F.col("text")).alias("total"))


@query("SELECT k AS doc_id, tot AS main, tot AS cents, CAST(tot // 1000 AS BIGINT) AS anchored_comma, tot AS anchored_dot FROM known")
def money_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.floor("o_totalprice").alias("t"))
    dotted = F.translate(F.format_number("t", 0), ",", ".")
    comma = F.format_string("%d,%03d", F.floor(F.col("t") / 1000), F.col("t") % 1000)
    return rows.select("doc_id", amounts.money(dotted).alias("main"), amounts.money(F.concat(dotted, F.lit(",50"))).alias("cents"), amounts.anchored_money(comma).alias("anchored_comma"), amounts.anchored_money(F.concat(dotted, F.lit(",00"))).alias("anchored_dot"))


@query("SELECT k AS doc_id, folio FROM found")
def folio_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", amounts.extract_folio(F.col("text")).alias("folio"))


# --- types and names ---


@query("SELECT k AS doc_id, doc_type FROM known")
def classify_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", names.document_type(F.col("text")).alias("doc_type"))


@query("SELECT k AS doc_id, CASE k % 4 WHEN 0 THEN 'factura_electronica' WHEN 1 THEN 'dte_generico' WHEN 2 THEN 'invoice_extranjera' ELSE 'desconocido' END AS doc_type FROM known")
def classify_ties_and_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, "nota de credito\nref. factura electronica").when(key % 4 == 1, "rut y folio").when(key % 4 == 2, "Your receipt").otherwise("hola")
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), names.document_type(text).alias("doc_type"))


@query("SELECT k AS doc_id, razon_social AS proveedor FROM found")
def supplier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, sf_dir).select("doc_id", names.extract_supplier(text, tax_id.extract(text)).alias("proveedor"))


@query("SELECT c_custkey, 'Cliente de ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' ltda' AS name FROM customer", known=False)
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  CLIENTE  DE\t"), F.col("c_mktsegment"), F.lit(" LTDA "))
    return table(spark, sf_dir, "customer").select("c_custkey", names.normalize_name(raw).alias("name"))


# --- records ---


@query("SELECT k AS doc_id, archivo, strftime(fecha_emision, '%Y-%m') AS mes, fecha_emision, folio, razon_social, rut_emisor, total, doc_type, CASE WHEN fecha_emision IS NOT NULL AND rut_emisor IS NOT NULL AND total IS NOT NULL THEN 'OK' ELSE 'QUARANTINE' END AS estado FROM found")
def records_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.native_records(documents(spark, sf_dir), this_year=F.lit(YEAR))
    return rows.select("doc_id", "archivo", "mes", "fecha_emision", "folio", "razon_social", "rut_emisor", "total", "doc_type", "estado")


@query("SELECT k AS doc_id, doc_type, array_to_string(missing, ',') AS missing, completeness, estado, CASE WHEN estado = 'QUARANTINE' THEN 'Faltan: ' || array_to_string(missing, ', ') || ' | Completitud: ' || CAST(CAST(round(completeness * 100) AS INTEGER) AS VARCHAR) || '%' END AS motivo FROM recs")
def records_assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, "doc_id", "doc_type", "missing", "completeness", "estado", "motivo").select("doc_id", "doc_type", F.array_join("missing", ",").alias("missing"), "completeness", "estado", "motivo")


@query("SELECT k AS doc_id, CASE WHEN k % 10 <> 0 AND k % 11 <> 0 THEN body || dv END AS rut, CASE WHEN k % 10 <> 3 THEN CAST(100000000 + k AS VARCHAR) END AS numero_documento, '05 MAR 1990' AS fecha_nacimiento, (CAST(k % 10 <> 0 AND k % 11 <> 0 AS INTEGER) + CAST(k % 10 <> 3 AS INTEGER)) / 4.0::DOUBLE AS completeness, CASE WHEN k % 10 NOT IN (0, 3) AND k % 11 <> 0 THEN 'OK' ELSE 'QUARANTINE' END AS estado FROM known")
def records_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("doc_id") % 10 != 3, F.concat(F.lit("Numero de documento: "), F.translate(F.format_number(F.col("doc_id") + 100_000_000, 0), ",", ".")))
    text = F.concat_ws("\n", F.lit("REPUBLICA DE CHILE"), F.regexp_extract("text", r"RUT: (\S+)", 1), number, F.lit("Fecha de nacimiento\n05 Mar 1990"))
    return records.cards(documents(spark, sf_dir).select("doc_id", text.alias("text"))).drop("text")


@query("SELECT k AS doc_id, CAST(CASE WHEN k % 10 <> 0 THEN 5 ELSE 0 END + CASE WHEN k % 10 <> 1 THEN 3 ELSE 0 END + CASE WHEN total IS NOT NULL THEN 4 ELSE 0 END + 1 AS INTEGER) AS quality FROM found")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", records.text_quality(F.concat("text", F.lit("\n" + "·" * 60)), F.lit(YEAR)).alias("quality"))


@query("SELECT k AS doc_id, 'dual_' || CASE WHEN k % 2 = 0 THEN 'tess' ELSE 'paddle' END || '_priority' AS engine, 0.75::DOUBLE AS score FROM known")
def reader_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    whole = F.concat_ws("\n", "text", F.lit("RUT: 11.111.111-1 Total 5.000 01/02/2020"))
    reading = lambda worse, score: docs.select("doc_id", F.when(worse, F.lit("nada")).otherwise(whole).alias("text"), F.lit(score).alias("score"))
    merged = records.merge_readers(reading(F.col("doc_id") % 2 == 0, 0.5), reading(F.col("doc_id") % 2 == 1, 1.0), "doc_id", F.lit(YEAR))
    return merged.select("doc_id", "engine", "score")


# --- anchors and templates ---


@query("SELECT k AS doc_id, CASE WHEN k % 10 = 0 THEN NULL ELSE dotted || '-' || CASE WHEN k % 11 = 0 THEN substr('0123456789K', strpos('0123456789K', dv) % 11 + 1, 1) ELSE dv END END AS rut, CASE WHEN k % 10 <> 2 THEN tot END AS total, folio, CASE WHEN k % 5 < 3 THEN fecha_emision END AS fecha, CASE k % 10 WHEN 0 THEN NULL WHEN 4 THEN 'EMISION:' ELSE 'COMERCIAL' END AS proveedor FROM found")
def anchor_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = anchors.fields(tokens(documents(spark, sf_dir)), this_year=F.lit(YEAR))
    return rows.select("doc_id", *[F.col(f"anchor_{c}").alias(c) for c in ("rut", "total", "folio", "fecha", "proveedor")])


#: Templates of two suppliers; a text that holds both keywords is of the first.
SUPPLIERS = [
    templates.Template("Comercial Asia", ["comercial asia"], "76.000.000-1", {"total": r"regex: TOTAL \$\s*([\d\.]+)", "fecha": r"regex: EMISION:\s*(\S+)"}),
    templates.Template("Comercial Europa", ["COMERCIAL EUROPE"]),
    templates.Template("Cualquiera", ["limitada"], "77.000.000-2"),
]


@query("SELECT k AS doc_id, CASE WHEN k % 10 = 4 THEN NULL WHEN region = 'ASIA' THEN 'Comercial Asia' WHEN region = 'EUROPE' THEN 'Comercial Europa' ELSE 'Cualquiera' END AS template, CASE WHEN k % 10 = 4 THEN NULL WHEN region = 'ASIA' THEN '76.000.000-1' WHEN region = 'EUROPE' THEN 'EXTRANJERO' ELSE '77.000.000-2' END AS template_rut, CASE WHEN k % 10 <> 4 AND region = 'ASIA' THEN CASE WHEN k % 13 = 0 THEN sub WHEN k % 10 <> 2 THEN tot END END AS template_total, CASE WHEN k % 10 NOT IN (1, 4) AND region = 'ASIA' AND k % 5 < 3 THEN d END AS template_fecha FROM known")
def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.apply(documents(spark, sf_dir), SUPPLIERS, this_year=F.lit(YEAR)).select("doc_id", "template", "template_rut", "template_total", "template_fecha")


# --- figures ---


@query("SELECT estado, count(*) AS n FROM recs GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(_records(spark, sf_dir, "estado"))


@query("SELECT estado, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM recs GROUP BY ROLLUP (estado)")
def status_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_sums(_records(spark, sf_dir, "estado", "total"))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(missing) AS field FROM recs WHERE estado = 'QUARANTINE') GROUP BY 1")
def missing_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing_frequency(_records(spark, sf_dir, "estado", "missing"))


@query("SELECT doc_type, count(*) FILTER (estado = 'OK') AS ok, count(*) FILTER (estado = 'QUARANTINE') AS quarantine, count(*) FILTER (estado = 'REJECTED') AS rejected, count(*) AS n, round(avg(completeness), 9) AS completeness FROM recs GROUP BY 1")
def doc_type_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_type(_records(spark, sf_dir, "doc_type", "estado", "completeness")).withColumn("completeness", F.round("completeness", 9))


@query("SELECT CASE WHEN k % 3 = 0 THEN '.jpg' ELSE '.pdf' END AS extension, count(*) AS n FROM known GROUP BY 1")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_extension(documents(spark, sf_dir))


@query("SELECT n, pct_ok, pct_usable, CASE WHEN pct_ok >= 95 THEN 'go' WHEN pct_ok >= 90 THEN 'watch' ELSE 'stop' END AS verdict FROM (SELECT count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (estado = 'OK') / count(*), 2) AS pct_ok, 100.0::DOUBLE AS pct_usable FROM recs)")
def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.readiness(_records(spark, sf_dir, "estado"))


@query("SELECT o_orderkey AS doc_id, CAST(2 AS INTEGER) AS mode, greatest(CAST(o_orderkey % 7 AS DOUBLE), 3.0::DOUBLE) AS score, CASE WHEN o_orderkey % 7 > 3 THEN 'c' ELSE 'b' END AS text FROM orders WHERE false UNION ALL SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 7 > 3 THEN 3 ELSE 1 END AS INTEGER), greatest(CAST(o_orderkey % 7 AS DOUBLE), 3.0::DOUBLE), CASE WHEN o_orderkey % 7 > 3 THEN 'c' ELSE 'a' END FROM orders", known=False)
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    modes = [(1, F.lit(3.0), "a"), (2, F.lit(3.0), "b"), (3, (F.col("doc_id") % 7).cast("double"), "c")]
    readings = orders.select("doc_id", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), s.alias("score"), F.lit(t).alias("text")) for m, s, t in modes])).alias("r")).select("doc_id", "r.*")
    return metrics.best_reading(readings).select("doc_id", "mode", "score", "text")


@query("SELECT o_orderkey AS doc_id, array_to_string(list_transform(kept, lambda x: 'l' || x), chr(10)) AS kept_text, CASE WHEN len(kept) = 0 THEN 0.0::DOUBLE ELSE list_sum(kept) / 10.0::DOUBLE / len(kept) END AS kept_score FROM (SELECT o_orderkey, list_filter(range(o_orderkey % 10), lambda x: x >= 3) AS kept FROM orders)", known=False)
def confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    lines = F.transform(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: i < F.col("doc_id") % 10), lambda i: F.struct(F.concat(F.lit("l"), i.cast("string")).alias("text"), (i / 10).alias("score")))
    found = orders.withColumn("lines", lines).withColumns(metrics.confident()).drop("lines")
    return found.withColumn("kept_score", F.round("kept_score", 9))


ORACLES["confident_lines"] = ORACLES["confident_lines"].replace("CASE WHEN len(kept)", "round(CASE WHEN len(kept)").replace("/ len(kept) END", "/ len(kept) END, 9)")


# --- views and sheets ---


@query("SELECT k AS doc_id, archivo, estado FROM recs WHERE estado = 'QUARANTINE' AND (contains(lower(archivo), '12') OR contains(lower(coalesce(rut_emisor, '')), '12') OR contains(lower(coalesce(razon_social, '')), '12') OR contains(CAST(coalesce(folio, 0) AS VARCHAR), '12'))")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.lit(False)
    for c in ("archivo", "rut_emisor", "razon_social", "folio"):
        wanted = wanted | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains("12")
    return _records(spark, sf_dir, "doc_id", "archivo", "estado", "rut_emisor", "razon_social", "folio").where((F.coalesce("estado", F.lit("QUARANTINE")) == "QUARANTINE") & wanted).select("doc_id", "archivo", "estado")


@query("SELECT archivo AS \"Archivo\", CAST(folio AS VARCHAR) AS \"Nro Boleta Factura\", razon_social AS \"PROVEEDOR\", rut_emisor AS \"RUT\", CAST(total AS VARCHAR) AS \"Total\", '' AS \"Observaciones\" FROM recs WHERE estado = 'OK'")
def sheet_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sheet(_records(spark, sf_dir, "estado", "archivo", "folio", "razon_social", "rut_emisor", "total"), ["Archivo", "Nro Boleta Factura", "PROVEEDOR", "RUT", "Total", "Observaciones"])


@query("SELECT estado, coalesce(CASE WHEN estado = 'QUARANTINE' THEN 'Faltan: ' || array_to_string(missing, ', ') || ' | Completitud: ' || CAST(CAST(round(completeness * 100) AS INTEGER) AS VARCHAR) || '%' END, '') AS motivo_revision, archivo AS \"Archivo\", coalesce(CAST(total AS VARCHAR), '') AS \"Total\" FROM recs")
def sheet_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sheet(_records(spark, sf_dir, "estado", "motivo", "archivo", "total"), ["Archivo", "Total"], review=True)


@query("SELECT k AS doc_id, CASE k % 5 WHEN 0 THEN 'pdf' WHEN 4 THEN 'unknown' ELSE 'image' END AS file_type, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'pdf_native' ELSE 'pdf_image' END WHEN k % 5 = 4 THEN 'unknown' ELSE 'image' END AS route, k % 3 <> 2 AS supported FROM known")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    head = F.when(key % 5 == 0, "255044462D312E34").when(key % 5 == 1, "FFD8FFE0").when(key % 5 == 2, "89504E470D0A1A0A00").when(key % 5 == 3, "524946460000000057454250").otherwise("00")
    path = F.concat(F.lit("/in/a.b/f"), F.when(key % 3 == 0, ".PDF").when(key % 3 == 1, ".tiff").otherwise(".txt"))
    pages = F.array(F.lit(""), F.when(key % 2 == 0, F.lit("x" * 50)).otherwise(F.lit(" " * 60 + "y")))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), files.file_type(F.unhex(head)).alias("file_type"), files.has_text(pages).alias("t"), files.supported(path).alias("supported"))
    return rows.select("doc_id", "file_type", files.route(F.col("file_type"), F.col("t")).alias("route"), "supported")


# --- jobs ---


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS status FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1", known=False)
def jobs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(_states(spark, sf_dir).drop("created_at"))


@query("SELECT id, version FROM (SELECT o_custkey AS id, o_orderkey AS version, o_orderdate AS created_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ORDER BY created_at DESC, id LIMIT 50", known=False)
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.newest(jobs.latest(_states(spark, sf_dir))).select("id", "version")


@query("SELECT c_custkey AS id, CAST(count(o_orderkey) AS INTEGER) AS n_records, coalesce(string_agg(o_orderstatus, '' ORDER BY lpad(CAST(o_orderkey AS VARCHAR), 12, '0')), '') AS statuses FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", known=False)
def job_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("archivo"), F.col("o_orderstatus").alias("estado"))
    found = jobs.detail(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), kept)
    return found.select("id", F.size("records").alias("n_records"), F.array_join(F.transform("records", lambda r: r["estado"]), "").alias("statuses"))


@query("SELECT c_custkey AS id, 'old' AS status FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, min(o_orderstatus) FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1", known=False)
def job_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("status"))
    return jobs.insert_new(known, _states(spark, sf_dir).select("id", "status"))


@query("SELECT c % 97 AS job_id, count(*) FILTER (estado IN ('OK', 'QUARANTINE')) AS processed, count(*) FILTER (estado NOT IN ('OK', 'QUARANTINE')) AS failed FROM recs GROUP BY 1")
def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 97).alias("job_id"))
    return jobs.counters(_records(spark, sf_dir, "doc_id", "estado").join(people, "doc_id"))


# --- odd texts, by case ---


#: What each case of `render.odd_texts` holds: type, id, other id, number, date, total, supplier, missing, state, text on a page, points for telling much.
ODD = """
WITH c AS (SELECT c_custkey k, c_custkey % 12 odd, CAST(10000000 + c_custkey AS VARCHAR) body, 11 - list_sum(list_transform(range(8), lambda i: ((10000000 + c_custkey) // CAST(pow(10, i) AS BIGINT)) % 10 * (2 + i % 6))) % 11 rest FROM customer),
ids AS (SELECT k, odd, substr(body, 1, 2) || '.' || substr(body, 3, 3) || '.' || substr(body, 6, 3) || '-' || CASE rest WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(rest AS VARCHAR) END rut FROM c),
cases(odd, doc_type, rut_emisor, rut_receptor, folio, fecha, total, proveedor, missing, estado, has_text, quality) AS (VALUES
  (0, 'desconocido', NULL, NULL, NULL, NULL, NULL, NULL, 'rut_emisor,fecha_emision,total', 'REJECTED', false, 0),
  (1, 'factura_electronica', 'own', NULL, -1, '2021-03-05', 5000, 'Comercial Ñandú ltda', 'neto,iva', 'QUARANTINE', true, 13),
  (2, 'desconocido', 'own', NULL, NULL, '2020-01-01', 12500, 'Ferretería Nueva spa', '', 'OK', true, 13),
  (3, 'factura_electronica', 'own', '76.192.083-9', 77, NULL, 1190, NULL, 'razon_social,fecha_emision,neto,iva', 'QUARANTINE', true, 10),
  (4, 'boleta_electronica', NULL, NULL, NULL, NULL, NULL, NULL, 'folio,rut_emisor,razon_social,fecha_emision,total', 'REJECTED', false, 0),
  (5, 'boleta_electronica', NULL, NULL, NULL, NULL, -1, NULL, NULL, NULL, false, -1),
  (6, 'nota_credito', NULL, NULL, NULL, '2019-02-01', 3300, 'Comercial Andina Limitada', 'folio,rut_emisor', 'QUARANTINE', true, 8),
  (7, 'guia_despacho', NULL, NULL, NULL, '0202-01-01', 999, 'Guia de Despacho', 'folio,rut_emisor', 'QUARANTINE', false, 7),
  (8, 'boleta_electronica', NULL, NULL, NULL, NULL, 0, NULL, 'folio,rut_emisor,razon_social,fecha_emision', 'REJECTED', false, 0),
  (9, 'dte_generico', 'cut', NULL, NULL, '2022-03-03', 100, NULL, '', 'OK', true, 13),
  (10, 'guia_despacho', NULL, NULL, 5555, '2020-01-15', NULL, 'Guía de Despacho', 'rut_emisor', 'QUARANTINE', true, 4),
  (11, 'invoice_extranjera', 'EXTRANJERO', NULL, NULL, '2021-03-03', 9, 'Invoice', '', 'OK', false, 7))
SELECT k AS doc_id, doc_type, CASE rut_emisor WHEN 'own' THEN rut WHEN 'cut' THEN substr(rut, 1, 6) ELSE rut_emisor END AS rut_emisor, rut_receptor, CAST(CASE WHEN folio = -1 THEN k + 1000 ELSE folio END AS BIGINT) AS folio, fecha,
  CAST(CASE WHEN total = -1 THEN CASE WHEN k // 12 % 2 = 1 THEN 50 END ELSE total END AS BIGINT) AS total, proveedor,
  CASE WHEN odd = 5 THEN 'folio,rut_emisor,razon_social,fecha_emision' || CASE WHEN k // 12 % 2 = 1 THEN '' ELSE ',total' END ELSE missing END AS missing,
  CASE WHEN odd = 5 THEN CASE WHEN k // 12 % 2 = 1 THEN 'QUARANTINE' ELSE 'REJECTED' END ELSE estado END AS estado, has_text, CAST(CASE WHEN quality = -1 THEN CASE WHEN k // 12 % 2 = 1 THEN 4 ELSE 0 END ELSE quality END AS INTEGER) AS quality
FROM ids JOIN cases USING (odd)
"""


@query(ODD, known=False)
def records_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.assess(records.parse(odd_texts(spark, sf_dir), this_year=F.lit(YEAR)))
    return found.select("doc_id", "doc_type", "rut_emisor", "rut_receptor", "folio", F.col("fecha_emision").cast("string").alias("fecha"), "total", F.col("razon_social").alias("proveedor"), F.array_join("missing", ",").alias("missing"), "estado", files.has_text(F.array("text")).alias("has_text"), records.text_quality(F.col("text"), F.lit(YEAR)).alias("quality"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Fina I VIII ' WHEN 1 THEN '1 Ñandú ' ELSE 'Ámbar No. ' END || lower(c_mktsegment) AS name FROM customer", known=False)
def name_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey") % 3
    said = F.concat(F.when(key == 0, "\ufb01na \u2160 \u2167 ").when(key == 1, "\u2460 N\u0303andu\u0301 ").otherwise("A\u0301mbar \u2116. "), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", names.plain(said).alias("raw")).select("c_custkey", F.concat(F.upper(F.substring("raw", 1, 1)), F.substring("raw", 2, 100)).alias("name"))


@query("SELECT k AS doc_id, CASE WHEN k % 10 NOT IN (0) AND k % 11 <> 0 THEN dotted || '-' || dv END AS rut, CASE WHEN k % 10 <> 2 THEN tot END AS total, CASE WHEN k % 10 <> 3 THEN k + 100000 END AS folio, CASE WHEN k % 10 <> 1 AND k % 5 < 3 THEN d END AS fecha, CASE WHEN st = 'F' THEN CASE WHEN k % 2 = 0 THEN tot + 1 ELSE CASE WHEN k % 10 <> 2 AND tot > 1900 THEN tot - 1900 END END END AS neto, CAST(CASE WHEN st = 'F' THEN 1900 END AS BIGINT) AS iva, CASE WHEN k % 10 <> 2 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS total_score, CASE WHEN k % 10 NOT IN (0) AND k % 11 <> 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS rut_emisor_score, CASE WHEN st <> 'F' THEN 0.0::DOUBLE WHEN k % 2 = 0 THEN 0.7::DOUBLE WHEN k % 10 <> 2 AND tot > 1900 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS neto_score FROM (SELECT k, dotted, dv, CAST(tot AS BIGINT) AS tot, d, st FROM known)")
def records_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that only the words beside anchors tell: the text holds the document's type alone."""
    docs = documents(spark, sf_dir)
    total = F.regexp_replace(F.regexp_extract("text", r"(?m)^TOTAL \$ (\S+)$", 1), "[.]", "")
    extra = F.when(F.col("o_orderstatus") == "F", F.concat_ws("\n", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("NETO $ "), (F.floor("o_totalprice") + 1).cast("string"))), F.lit("IVA $ 1900")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_totalprice")
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.startswith("SUBTOTAL") & ~x.startswith("TOTAL")), "\n")
    docs = docs.join(orders, "doc_id").withColumn("text", F.concat_ws("\n", plain, F.when(total != "", F.concat(F.lit("TOTAL $ "), total)), extra))
    found = anchors.fields(tokens(docs), this_year=F.lit(YEAR)).withColumn("text", F.element_at(F.split("text", "\n"), 1))
    found = records.parse(found, this_year=F.lit(YEAR))
    return found.select("doc_id", F.col("rut_emisor").alias("rut"), "total", "folio", F.col("fecha_emision").alias("fecha"), "neto", "iva", "total_score", "rut_emisor_score", "neto_score")


@query("SELECT k AS doc_id, CASE WHEN k % 10 <> 2 THEN '$' || replace(format('{:,}', tot), ',', '.') ELSE '' END AS total_word, '' AS rut_word, '' AS neto_word FROM known")
def keyword_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anchors.next_words(F.transform("tokens", lambda t: t["text"]))
    return tokens(documents(spark, sf_dir)).select("doc_id", found.alias("m")).select("doc_id", F.col("m.TOTAL").alias("total_word"), F.col("m.RUT").alias("rut_word"), F.col("m.NETO").alias("neto_word"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 0.87::DOUBLE ELSE 0.5::DOUBLE END AS score FROM orders", known=False)
def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("doc_id"), anchors.token_score(F.when(key % 4 == 0, "87").when(key % 4 == 1, "-1").when(key % 4 == 2, "x")).alias("score"))


@query("SELECT k AS doc_id, CASE WHEN k % 10 <> 0 THEN 'RUT: ' || dotted || '-' || CASE WHEN k % 11 = 0 THEN substr('0123456789K', instr('0123456789K', dv) % 11 + 1, 1) ELSE dv END END AS sii_raw, CASE WHEN k % 13 = 0 THEN 'TOTAL $ ' || replace(format('{:,}', sub), ',', '.') WHEN k % 10 <> 2 THEN 'TOTAL $ ' || replace(format('{:,}', tot), ',', '.') END AS totals_raw, CASE WHEN k % 10 <> 1 AND k % 5 = 0 THEN strftime(d, '%d/%m/%Y') WHEN k % 10 <> 1 AND k % 5 = 1 THEN strftime(d, '%d-%m-%Y') END AS fecha_raw, CASE WHEN k % 10 <> 3 THEN 'N° ' || (k + 100000) END AS nro_raw, CAST(NULL AS VARCHAR) AS provider_raw FROM known")
def raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *[v.alias(c) for c, v in files.raw_keys(F.col("text")).items()])


@query("SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'caja' || chr(10) || 'uno' || chr(10) || 'dos' WHEN 1 THEN 'uno' ELSE '' END AS text, CASE WHEN o_orderkey % 3 = 0 THEN 'caja' || chr(10) || 'un…' WHEN o_orderkey % 3 = 1 THEN 'uno' ELSE '—' END AS short, CASE o_orderkey % 3 WHEN 0 THEN 'caja' ELSE 'uno' END AS start FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT o_orderkey, '', '—', '' FROM orders WHERE o_orderkey % 3 = 2", known=False)
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pages = F.when(key % 3 == 0, F.array(F.lit("uno"), F.lit(""), F.lit("dos"))).when(key % 3 == 1, F.array(F.lit(""), F.lit("uno"))).otherwise(F.array(F.lit("")))
    rows = table(spark, sf_dir, "orders").select(key.alias("doc_id"), records.with_box(F.when(key % 3 == 0, "caja").otherwise(""), records.join_pages(pages)).alias("text"))
    return rows.select("doc_id", "text", records.shortened(F.col("text"), 8).alias("short"), records.preview(F.col("text"), 4).alias("start"))


@query("SELECT l_orderkey AS doc_id, string_agg(l_linestatus || l_linenumber, chr(10) ORDER BY l_linenumber, l_linestatus) AS text FROM lineitem GROUP BY 1", known=False)
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("at"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"))
    return records.join_lines(lines)


@query("SELECT k AS doc_id, fecha_emision IS NOT NULL AS tiene_fecha, rut_emisor IS NOT NULL AS tiene_rut, total IS NOT NULL AS tiene_total, razon_social IS NOT NULL AS tiene_proveedor, folio IS NOT NULL AS tiene_nro_documento, fecha_emision IS NOT NULL AND rut_emisor IS NOT NULL AND total IS NOT NULL AND razon_social IS NOT NULL AND folio IS NOT NULL AS completo, true AS dte FROM recs")
def key_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir, "doc_id", "doc_type", "fecha_emision", "rut_emisor", "total", "razon_social", "folio")
    return rows.select("doc_id", *[v.alias(c) for c, v in records.key_flags().items()], records.complete(rows).alias("completo"), records.is_tax_document(F.col("doc_type")).alias("dte"))


@query("SELECT k AS doc_id, archivo, CASE WHEN fecha_emision IS NULL OR rut_emisor IS NULL OR total IS NULL THEN 'Faltan: ' || array_to_string(list_filter([CASE WHEN fecha_emision IS NULL THEN 'fecha' END, CASE WHEN rut_emisor IS NULL THEN 'rut' END, CASE WHEN total IS NULL THEN 'total' END], lambda x: x IS NOT NULL), ', ') END AS motivo FROM found")
def native_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.native_records(documents(spark, sf_dir), this_year=F.lit(YEAR)).select("doc_id", "archivo", "motivo")


# --- dispatch ---


#: Records of `_dispatched`: what is known of the document, and its route by its key.
DISPATCHED = KNOWN.rstrip() + """,
dealt AS (
  SELECT *, k % 7 AS m, CASE k % 7 WHEN 0 THEN 'native' WHEN 1 THEN 'read' WHEN 5 THEN 'rejected' WHEN 6 THEN 'rejected' ELSE CASE WHEN region = 'ASIA' AND k % 10 <> 4 THEN 'template' ELSE 'read' END END AS how,
    CASE WHEN k % 13 = 0 THEN sub WHEN k % 10 <> 2 THEN tot END AS t_total, CASE WHEN k % 10 <> 1 AND k % 5 < 3 THEN d END AS t_fecha, 'Faltan: ' || array_to_string(missing, ', ') || ' | Completitud: ' || CAST(CAST(round(completeness * 100) AS INTEGER) AS VARCHAR) || '%' AS m_read
  FROM recs),
filled AS (
  SELECT *, CASE how WHEN 'native' THEN fecha_emision WHEN 'template' THEN t_fecha WHEN 'read' THEN CASE WHEN m = 3 AND estado = 'QUARANTINE' THEN coalesce(fecha_emision, DATE '2020-02-01') ELSE fecha_emision END END AS f,
    CASE how WHEN 'native' THEN total WHEN 'template' THEN t_total WHEN 'read' THEN CASE WHEN m = 3 AND estado = 'QUARANTINE' THEN coalesce(total, 9999) ELSE total END END AS t, CASE how WHEN 'template' THEN '76.000.000-1' WHEN 'rejected' THEN NULL ELSE rut_emisor END AS r
  FROM dealt),
done AS (
  SELECT k AS doc_id, archivo, how, m, CASE WHEN m = 0 THEN 'pdf_native' WHEN m = 1 THEN 'pdf_image' WHEN m = 5 THEN 'zip' WHEN m = 6 THEN 'image' ELSE 'image' END AS route, strftime(f, '%Y-%m-%d') AS fecha, CASE how WHEN 'template' THEN strftime(t_fecha, '%Y-%m') WHEN 'rejected' THEN NULL ELSE strftime(fecha_emision, '%Y-%m') END AS mes, CAST(t AS BIGINT) AS total, r AS rut,
    CASE how WHEN 'template' THEN 'Comercial Asia' WHEN 'rejected' THEN NULL ELSE razon_social END AS proveedor, CASE WHEN how IN ('native', 'read') THEN folio END AS nro_documento,
    CASE WHEN how = 'rejected' THEN 'REJECTED' WHEN how = 'read' AND m = 1 THEN estado WHEN how = 'read' AND estado = 'OK' THEN 'OK' WHEN f IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL THEN 'OK' ELSE 'QUARANTINE' END AS estado,
    CASE WHEN m = 5 THEN 'Ruta desconocida: zip' WHEN m = 6 THEN 'Excepción: OSError: damaged' WHEN how = 'template' THEN CASE WHEN f IS NOT NULL AND t IS NOT NULL THEN 'Plantilla Automática: Comercial Asia' ELSE 'Plantilla detectada pero faltan campos críticos' END
      WHEN how = 'native' THEN CASE WHEN f IS NULL OR r IS NULL OR t IS NULL THEN 'Faltan: ' || array_to_string(list_filter([CASE WHEN f IS NULL THEN 'fecha' END, CASE WHEN r IS NULL THEN 'rut' END, CASE WHEN t IS NULL THEN 'total' END], lambda x: x IS NOT NULL), ', ') END
      WHEN estado = 'QUARANTINE' THEN CASE WHEN m > 1 AND f IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL THEN 'Rescatado por IA (Donut)' ELSE m_read END END AS motivo_revision,
    CASE WHEN how = 'native' THEN 'pdf_native' WHEN how = 'rejected' THEN NULL WHEN m = 1 THEN 'pdf_image' ELSE 'image_dual' END AS ruta_extraccion, CASE WHEN how = 'read' THEN CASE WHEN m = 1 THEN 'pdf_image_fallback' ELSE 'dual' END END AS ocr_engine,
    CASE WHEN how = 'read' THEN completeness END AS completeness, CASE WHEN how <> 'rejected' THEN doc_type END AS doc_type
  FROM filled)
"""


def _dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, m = documents(spark, sf_dir), F.col("doc_id") % 7
    route = F.when(m == 0, "pdf_native").when(m == 1, "pdf_image").when(m == 5, "zip").otherwise("image")
    rescue = F.when(m == 3, F.create_map(F.lit("total_price"), F.lit("9.999"), F.lit("date"), F.lit("01/02/2020"), F.lit("other"), F.lit("x")))
    given = docs.select("doc_id", "archivo", "text", route.alias("route"), rescue.alias("rescue"), F.when(m == 6, "Excepción: OSError: damaged").alias("error"))
    return dispatch.process(given, SUPPLIERS[:1], F.lit(YEAR))


@query(DISPATCHED + "SELECT doc_id, archivo, route, fecha, mes, total, rut, proveedor, nro_documento, estado, motivo_revision, ruta_extraccion, ocr_engine, completeness, doc_type FROM done", known=False)
def dispatch_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatched(spark, sf_dir).select("doc_id", "archivo", "route", "fecha", "mes", "total", "rut", "proveedor", "nro_documento", "estado", "motivo_revision", "ruta_extraccion", "ocr_engine", "completeness", "doc_type")


@query(DISPATCHED + "SELECT archivo, coalesce(doc_type, 'desconocido') AS doc_type, coalesce(ocr_engine, ruta_extraccion, 'unknown') AS ocr_engine, CASE WHEN how = 'read' AND m = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS ocr_avg_score, nro_documento AS folio, CAST(fecha AS DATE) AS fecha_emision, rut AS rut_emisor, proveedor AS razon_social, total, estado, coalesce(completeness, CASE WHEN estado = 'OK' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS completeness FROM done", known=False)
def api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.responses(_dispatched(spark, sf_dir)).select("archivo", "doc_type", "ocr_engine", "ocr_avg_score", "folio", "fecha_emision", "rut_emisor", "razon_social", "total", "estado", "completeness")


CARDS = """people AS (SELECT c_custkey p, CAST(10000000 + c_custkey AS VARCHAR) body, 11 - list_sum(list_transform(range(8), lambda i: ((10000000 + c_custkey) // CAST(pow(10, i) AS BIGINT)) % 10 * (2 + i % 6))) % 11 rest FROM customer)
SELECT 'card_' || p || '.png' AS archivo, CASE WHEN p % 11 <> 0 THEN body || CASE rest WHEN 11 THEN '0' WHEN 10 THEN 'K' ELSE CAST(rest AS VARCHAR) END END AS rut, '05 MAR 1990' AS fecha, CASE WHEN p % 10 <> 3 THEN CAST(100000000 + p AS BIGINT) END AS folio, 'cedula' AS doc_type, CASE WHEN p % 10 <> 3 AND p % 11 <> 0 THEN 'OK' ELSE 'QUARANTINE' END AS estado, '[]' AS missing_fields, 'image_dual' AS ocr_engine FROM people
UNION ALL SELECT archivo, rut, fecha, nro_documento, coalesce(doc_type, 'desconocido'), estado, CASE WHEN how = 'read' THEN '[' || array_to_string(list_transform(miss, lambda x: '"' || x || '"'), ',') || ']' ELSE '[]' END, ocr_engine FROM done JOIN (SELECT k, missing AS miss FROM recs) ON k = doc_id
"""


@query(DISPATCHED.rstrip() + ",\n" + CARDS, known=False)
def job_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = dispatch.process(cards(spark, sf_dir), this_year=F.lit(YEAR))
    found = _dispatched(spark, sf_dir).drop("doc_id").unionByName(people)
    return dispatch.job_records(found).select("archivo", "rut", "fecha", "folio", "doc_type", "estado", "missing_fields", "ocr_engine")


@query(DISPATCHED + "SELECT archivo AS archivo_origen, estado, motivo_revision, coalesce(fecha, '') AS fecha, coalesce(CAST(nro_documento AS VARCHAR), '') AS nro_documento, coalesce(proveedor, '') AS proveedor, coalesce(rut, '') AS rut, coalesce(CAST(total AS VARCHAR), '') AS total, '' AS observaciones FROM done WHERE estado = 'QUARANTINE'", known=False)
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dispatched(spark, sf_dir)
    return files.quarantine(made_once(found, *[c for c in found.columns if c not in ("raw_text", "missing")]))


@query(DISPATCHED + "SELECT archivo AS archivo_origen, estado, coalesce(motivo_revision, '') AS motivo_revision, coalesce(mes, '') AS mes, coalesce(fecha, '') AS fecha, coalesce(CAST(nro_documento AS VARCHAR), '') AS nro_documento, coalesce(proveedor, '') AS proveedor, coalesce(rut, '') AS rut, coalesce(CAST(total AS VARCHAR), '') AS total FROM done", known=False)
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.review_rows(_dispatched(spark, sf_dir))


@query(DISPATCHED + "SELECT estado, archivo, CAST(fecha AS DATE) AS dia, CAST(nro_documento AS BIGINT) AS numero, total, proveedor FROM done", known=False)
def sheet_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = files.typed_sheet(_dispatched(spark, sf_dir), ["Archivo", "Fecha", "Nro Boleta Factura", "Total", "PROVEEDOR"])
    return cells.select("estado", F.col("Archivo.text").alias("archivo"), F.col("Fecha.day").alias("dia"), F.col("Nro Boleta Factura.number").alias("numero"), F.col("Total.number").alias("total"), F.col("PROVEEDOR.text").alias("proveedor"))


@query(DISPATCHED + "SELECT 'otro' AS tipo, count(*) AS n FROM done", known=False)
def name_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_name(_dispatched(spark, sf_dir))


@query(DISPATCHED + "SELECT route AS ruta, count(*) FILTER (estado = 'OK') AS ok, count(*) FILTER (estado = 'QUARANTINE') AS quarantine, count(*) FILTER (estado = 'REJECTED') AS rejected FROM done GROUP BY 1", known=False)
def route_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_route(_dispatched(spark, sf_dir))


@query(DISPATCHED + "SELECT count(*) FILTER (estado <> 'OK') AS errors, CASE WHEN count(*) FILTER (estado <> 'OK') <= 2 THEN 'listo' WHEN count(*) FILTER (estado <> 'OK') <= 5 THEN 'fragil' WHEN count(*) FILTER (estado <> 'OK') <= 8 THEN 'expuesto' ELSE 'reestructurar' END AS level, CAST(CASE WHEN count(*) FILTER (estado = 'OK') * 100.0 / count(*) >= 95 THEN 0 WHEN count(*) FILTER (estado = 'OK') * 100.0 / count(*) >= 80 THEN 1 ELSE 2 END AS INTEGER) AS exit_code FROM done", known=False)
def readiness_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.diagnosis(_dispatched(spark, sf_dir))


@query(DISPATCHED + "SELECT archivo, substr(archivo, length(archivo) - 3) AS ext, route AS ruta, estado, doc_type, fecha, rut, total, proveedor, nro_documento, motivo_revision AS motivo, ruta_extraccion FROM done", known=False)
def report_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detail(_dispatched(spark, sf_dir)).drop("raw_text_preview")


@query(DISPATCHED + "SELECT count(*) AS total, count(*) FILTER (estado = 'OK') AS ok, count(*) FILTER (estado = 'QUARANTINE') AS quarantine, count(*) FILTER (estado = 'REJECTED') AS rejected, round(100.0::DOUBLE * count(*) FILTER (estado = 'OK') / count(*), 2) AS pct_ok, count(*) FILTER (estado = 'QUARANTINE' AND fecha IS NULL) AS sin_fecha, count(*) FILTER (route = 'zip' AND estado = 'REJECTED') AS zip_rejected, count(*) FILTER (archivo LIKE '%.jpg' AND estado = 'OK') AS jpg_ok FROM done", known=False)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = metrics.report(_dispatched(spark, sf_dir), "in")
    at = lambda m, *keys: F.coalesce(F.try_element_at(F.try_element_at(F.col(m), F.lit(keys[0])), F.lit(keys[1])), F.lit(0).cast("bigint"))
    return row.select("total", "ok", "quarantine", "rejected", "pct_ok", F.coalesce(F.try_element_at("faltantes_quarantine", F.lit("fecha")), F.lit(0).cast("bigint")).alias("sin_fecha"), at("por_ruta", "zip", "rejected").alias("zip_rejected"), at("por_extension", ".jpg", "ok").alias("jpg_ok"))


# --- job tables ---


@query("SELECT o_custkey AS id, arg_max(CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus END, o_orderkey) FILTER (o_orderkey % 3 = 0) AS status, CAST(arg_max(o_orderkey, o_orderkey) FILTER (o_orderkey % 3 <> 1) AS BIGINT) AS processed, max(o_orderkey) AS version FROM orders GROUP BY 1", known=False)
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return jobs.state(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("status"), F.when(key % 3 != 1, key).alias("processed"), key.alias("version")))


@query("SELECT c_custkey AS id, 'queued' AS status, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '-' END AS original FROM customer", known=False)
def job_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("total_files"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("original_name"), F.col("c_name"))).alias("metadata"))
    made = jobs.decoded(jobs.created(given, F.lit("2024-01-01T00:00:00")))
    return made.select("id", "status", F.coalesce(F.try_element_at("metadata", F.lit("original_name")), F.lit("-")).alias("original"))


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS archivo, CASE WHEN o_orderkey % 2 = 0 THEN 'total,neto' ELSE '' END AS missing FROM orders WHERE o_custkey = 7", known=False)
def job_records_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("job_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("archivo"), F.when(F.col("o_orderkey") % 2 == 0, '["total","neto"]').alias("missing_fields"))
    return jobs.records_of(kept, "7").select("archivo", F.array_join("missing_fields", ",").alias("missing"))


@query("SELECT c_custkey AS id, o IS NOT NULL AS found, o AS raw_text FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus || o_orderkey) AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) ON o_custkey = c_custkey", known=False)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("archivo"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("raw_text"))
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("a").alias("archivo"))
    return jobs.corrected(said, kept).select(F.col("job_id").alias("id"), "found", "raw_text")


@query("SELECT name, size, \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY \"at\") n FROM (SELECT 'f' || o_custkey || CASE o_orderkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.bmp' ELSE '.png' END AS name, o_custkey % 5 AS size, o_orderkey AS \"at\" FROM orders) WHERE lower(name) NOT LIKE '%.bmp') WHERE n = 1 ORDER BY \"at\" LIMIT 100", known=False)
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.when(key % 3 == 0, ".PDF").when(key % 3 == 1, ".bmp").otherwise(".png"))
    return jobs.accepted(table(spark, sf_dir, "orders").select(name.alias("name"), (F.col("o_custkey") % 5).alias("size"), key.alias("at")))


@query("SELECT o_orderkey AS path FROM orders WHERE o_custkey % 2 = 0", known=False)
def existing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    there = orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("path"))
    return jobs.existing(orders.select(F.col("o_orderkey").alias("path")), there)


@query("SELECT c_custkey AS id, least(95.0::DOUBLE, 100.0::DOUBLE * n / greatest(c_custkey % 40, 1)) AS percent, bytes FROM (SELECT c_custkey, count(o_orderkey) AS n, coalesce(CAST(sum(o_orderkey) AS BIGINT), 0) AS bytes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)", known=False)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum("o_orderkey"), F.lit(0)).alias("bytes"))
    return done.select(F.col("c_custkey").alias("id"), metrics.progress(F.col("n"), F.col("c_custkey") % 40).alias("percent"), "bytes")


@query("SELECT o_orderpriority AS clave, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1", known=False)
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("clave")).agg(F.count("*").alias("n")), "clave")


@query("SELECT o_orderkey AS doc_id, '$' || replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') AS pesos FROM orders", known=False)
def peso_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), amounts.pesos(F.floor("o_totalprice")).alias("pesos"))
