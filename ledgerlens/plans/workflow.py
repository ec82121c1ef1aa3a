"""Named queries of jobs, templates, search and sinks that keep tables or streams; registered beside those of `catalogue`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import boxes, dispatch, metrics, pixels, records, search_index, template_index
from ledgerlens.plans.catalogue import DISPATCHED, KNOWN, SUPPLIERS, YEAR, _dispatched, _records, query
from ledgerlens.sources import books, files, keyed, shared
from ledgerlens.sources.render import documents, spread, table, tokens
from ledgerlens.streaming import lifecycle

# --- the life of jobs ---

#: Days by which events may be late, for which results are kept, and of one delivery of events.
LATE, KEEP, DELIVERY = 400, 600, 1_300
EVENTS = """
WITH files AS (SELECT o_custkey AS job, 'doc_' || o_orderkey AS archivo, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'QUARANTINE' ELSE 'REJECTED' END AS estado, date_diff('day', DATE '1994-12-31', CAST(o_orderdate AS DATE)) AS day,
  CASE WHEN o_orderkey % 70 = 0 THEN 900 WHEN o_orderkey % 50 = 0 THEN 200 ELSE 0 END AS lag, o_orderkey AS k FROM orders),
events AS (
  SELECT c_custkey AS job, 'created' AS kind, 0 AS day, 0 AS arrives, count(archivo) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS total, NULL AS archivo, NULL AS estado, NULL AS error FROM customer LEFT JOIN files ON job = c_custkey GROUP BY c_custkey
  UNION ALL SELECT job, 'file', day, day + lag, NULL, archivo, estado, NULL FROM files
  UNION ALL SELECT job, 'file', day, day + lag + 300, NULL, archivo, estado, NULL FROM files WHERE k % 20 = 0
  UNION ALL SELECT job, 'ended', max(day), max(day), NULL, NULL, NULL, CASE WHEN job % 7 = 0 THEN 'Excel export failed: disk full' END FROM files WHERE job % 7 < 2 GROUP BY job)
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one job for each customer, with a file for each order, and the delivery that they come with; some late, some twice, some jobs a file short."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", key, F.datediff(F.col("o_orderdate").cast("date"), F.lit("1994-12-31").cast("date")).alias("day"), F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "QUARANTINE").otherwise("REJECTED").alias("estado"))
    lag = F.when(key % 70 == 0, 900).when(key % 50 == 0, 200).otherwise(0)
    none = lambda kind: F.lit(None).cast(kind)
    file = [F.col("o_custkey").alias("job"), F.lit("file").alias("kind"), "day", none("int").alias("total_files"), F.concat(F.lit("doc_"), key.cast("string")).alias("archivo"), "estado", none("string").alias("error")]
    files = orders.select(*file, (F.col("day") + lag).alias("arrives"))
    again = orders.where(key % 20 == 0).select(*file, (F.col("day") + lag + 300).alias("arrives"))
    counted = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("day").alias("day"))
    people = table(spark, sf_dir, "customer").select("c_custkey").join(counted, F.col("o_custkey") == F.col("c_custkey"), "left")
    total = (F.coalesce("n", F.lit(0)) + F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0)).cast("int")
    created = people.select(F.col("c_custkey").alias("job"), F.lit("created").alias("kind"), F.lit(0).alias("day"), total.alias("total_files"), none("string").alias("archivo"), none("string").alias("estado"), none("string").alias("error"), F.lit(0).alias("arrives"))
    error = F.when(F.col("o_custkey") % 7 == 0, "Excel export failed: disk full")
    ended = counted.where("o_custkey % 7 < 2").select(F.col("o_custkey").alias("job"), F.lit("ended").alias("kind"), "day", none("int").alias("total_files"), none("string").alias("archivo"), none("string").alias("estado"), error.alias("error"), F.col("day").alias("arrives"))
    events = created.unionByName(files).unionByName(again).unionByName(ended)
    at = F.date_add(F.lit("1994-12-31").cast("date"), F.col("day")).cast("timestamp")
    return events.select(F.col("job").cast("string").alias("job_id"), "kind", at.alias("at"), "total_files", "archivo", "estado", "error", F.floor(F.col("arrives") / DELIVERY).cast("int").alias("delivery"))


@query(EVENTS.rstrip() + f""",
delivered AS (SELECT *, arrives // {DELIVERY} AS delivery FROM events),
marks AS (SELECT delivery, max(max(day)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE} AS mark FROM delivered GROUP BY delivery),
taken AS (SELECT * FROM delivered JOIN marks USING (delivery) WHERE mark IS NULL OR day >= mark),
summed AS (SELECT job, max(total) AS total, count(DISTINCT archivo) FILTER (estado IN ('OK', 'QUARANTINE')) AS processed, count(DISTINCT archivo) FILTER (estado = 'REJECTED') AS failed, max(error) AS error, bool_or(kind = 'ended') AS ended, max(day) AS last FROM taken GROUP BY job),
judged AS (SELECT *, ended OR (total > 0 AND processed + failed >= total) AS over FROM summed)
SELECT CAST(job AS VARCHAR) AS job_id, CASE WHEN over AND last + {KEEP} < (SELECT max(day) - {LATE} FROM events) THEN 'expired' WHEN error IS NOT NULL THEN 'failed' WHEN over THEN 'done' WHEN processed + failed > 0 THEN 'processing' ELSE 'queued' END AS status,
  CAST(total AS INTEGER) AS total_files, CAST(processed AS INTEGER) AS processed, CAST(failed AS INTEGER) AS failed, error FROM judged""", known=False)  # fmt: skip
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = shared.stored(job_events(spark, sf_dir), "events")
    folder, out, checkpoint = (shared.folder(spark, name) for name in ("inbox", "states", "stream"))
    for delivery in range(1 + (events.agg(F.max("delivery")).first()[0] or 0)):  # each restarts the stream from its checkpoint
        events.where(F.col("delivery") == delivery).drop("delivery").write.mode("append").parquet(folder)
        lifecycle.follow(spark, folder, out, checkpoint, f"{LATE} days 1 second", KEEP * 86_400, partitions=min(16, spark.sparkContext.defaultParallelism)).awaitTermination()
    return lifecycle.states(spark, out).select("job_id", "status", "total_files", "processed", "failed", "error")


# --- tables of jobs ---


@query("""
WITH changes AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'failed' END END AS status, CASE WHEN o_orderkey % 3 <> 1 THEN CAST(o_orderkey AS INTEGER) END AS processed, CASE WHEN o_orderkey % 11 = 0 THEN o_orderpriority END AS error, o_orderkey AS v FROM orders
  UNION ALL SELECT c_custkey, 'queued', 0, NULL, 0 FROM customer)
SELECT CAST(id AS VARCHAR) AS id, arg_max(status, v) FILTER (status IS NOT NULL) AS status, CAST(max(total) AS INTEGER) AS total_files, arg_max(processed, v) FILTER (processed IS NOT NULL) AS processed, arg_max(error, v) FILTER (error IS NOT NULL) AS error
FROM changes LEFT JOIN (SELECT c_custkey, c_custkey % 40 AS total FROM customer) ON c_custkey = id GROUP BY id""", known=False)  # fmt: skip
def job_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    job = F.when(key % 97 == 0, F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")).cast("string")
    changes = table(spark, sf_dir, "orders").select(job.alias("id"), F.when(key % 3 == 0, status).alias("status"), F.when(key % 3 != 1, key.cast("int")).alias("processed"), F.when(key % 11 == 0, F.col("o_orderpriority")).alias("error"), key.alias("version"))
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("queued").alias("status"), (F.col("c_custkey") % 40).cast("int").alias("total_files"), F.lit(0).alias("processed"), F.lit(None).cast("string").alias("error"))
    path = shared.folder(spark, "jobs")
    keyed.create(first, path, ["id"], buckets=16)
    for batch in (1, 0, 1):  # the later one first, and once again
        keyed.upsert(spark, path, changes.where(F.col("version") % 2 == batch))
    return keyed.read(spark, path)


# --- templates as a table ---


def _suppliers_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each supplier and each part, by its name and number."""
    supplier = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("place"), F.col("s_name").alias("name"))
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") * 2 + 1).alias("place"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    none = F.create_map().cast("map<string,string>").alias("rules")
    return supplier.unionByName(part).select("place", "name", F.array(F.upper("name")).alias("keywords"), F.lit("EXTRANJERO").alias("rut"), none)


@query("""
WITH items AS (SELECT l_orderkey AS k, string_agg('item ' || p_name || ' ' || p_partkey || CASE WHEN l_orderkey % 5 = 0 THEN ' of ' || s_name ELSE '' END, chr(10) ORDER BY l_linenumber, p_partkey, s_suppkey) AS text FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey % 3 <> 0 OR l_linenumber < 3 GROUP BY 1),
words AS (SELECT s_suppkey * 2 AS place, s_name AS name FROM supplier UNION ALL SELECT p_partkey * 2 + 1, p_name || ' ' || p_partkey FROM part),
met AS (SELECT k, min(place) AS place FROM items JOIN words ON contains(lower(text), lower(name)) GROUP BY k)
SELECT k AS doc_id, CAST(place AS BIGINT) AS place FROM items LEFT JOIN met USING (k)""", known=False)  # fmt: skip
def template_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0 or l_linenumber < 3")
    lines = lines.join(table(spark, sf_dir, "part").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.select("l_orderkey", "l_linenumber", "p_name", "p_partkey", F.when(F.col("l_orderkey") % 5 == 0, F.col("s_name")).alias("of")).repartition("l_orderkey")
    said = F.concat(F.lit("item "), "p_name", F.lit(" "), F.col("p_partkey").cast("string"), F.coalesce(F.concat(F.lit(" of "), "of"), F.lit("")))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", said.alias("said")))), lambda x: x["said"]), "\n").alias("text"))
    found = template_index.first_places(docs, _suppliers_and_parts(spark, sf_dir))
    return found.select("doc_id", F.col("_place").alias("place"))


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people said of each rendered document with a total: its supplier, total and tax id."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("total"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    known = orders.join(people.select("c_custkey", "r_name", "r_regionkey"), F.col("c_custkey") == F.col("o_custkey"))
    name = F.concat(F.lit("COMERCIAL "), "r_name", F.lit(" LIMITADA"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.lower(name)).otherwise(name)
    said = known.select(F.col("o_orderkey").alias("doc_id"), name.alias("supplier"), "total", F.concat(F.lit("76.000.00"), F.col("r_regionkey").cast("string"), F.lit("-1")).alias("rut"))
    return said.join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of templates after what all corrections teach; one supplier's was there before, with an old rule and another word."""
    old = spark.createDataFrame([("comercial asia limitada", "COMERCIAL ASIA LIMITADA", ["comercial asia"], "76.000.009-9", {"total": "regex: Total:(\\d+"})], "key string, name string, keywords array<string>, rut string, rules map<string,string>")
    rules = lambda rows: rows.withColumn("rules", F.to_json("rules"))  # noqa: E731  maps have no order, as versions of equal age need
    path = shared.folder(spark, "templates")
    keyed.create(rules(old), path, ["key"], buckets=4)
    taught = template_index.learned(_corrections(spark, sf_dir))
    # what a correction doesn't teach stays: the words and the tax id of a supplier that is known
    there = keyed.read(spark, path).select("key", F.lit(True).alias("there"))
    taught = rules(taught.withColumn("key", F.lower("name"))).join(there, "key", "left")
    first = lambda c: F.when(F.col("there").isNull(), F.col(c)).alias(c)
    keyed.upsert(spark, path, taught.select("key", first("name"), first("keywords"), first("rut"), "rules", F.lit(1).alias("version")))
    return template_index.ordered(keyed.read(spark, path).withColumn("rules", F.from_json("rules", "map<string,string>")))


@query("""
SELECT CASE WHEN r_name = 'ASIA' THEN 'COMERCIAL ASIA LIMITADA' ELSE 'COMERCIAL ' || r_name || ' LIMITADA' END AS name, CASE WHEN r_name = 'ASIA' THEN 'comercial asia' ELSE 'COMERCIAL ' || r_name || ' LIMITADA' END AS keyword,
  CASE WHEN r_name = 'ASIA' THEN '76.000.009-9' ELSE '76.000.00' || r_regionkey || '-1' END AS rut, '(?i)(?m)^\\s*TOTAL\\s+\\$?\\s*([\\d\\.]+)' AS total, 0 AS problems FROM region""", known=False)  # fmt: skip
def templates_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_index.checked(_learned(spark, sf_dir))
    return found.select("name", F.get("keywords", F.lit(0)).alias("keyword"), "rut", F.try_element_at("patterns", F.lit("total")).alias("total"), F.size("problems").alias("problems"))


@query("SELECT k AS doc_id, CASE WHEN k % 10 <> 4 THEN 'COMERCIAL ' || region || ' LIMITADA' END AS template, CASE WHEN k % 10 NOT IN (2, 4) THEN tot END AS template_total FROM known")
def templates_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_index.apply(documents(spark, sf_dir), _learned(spark, sf_dir))
    return found.select("doc_id", "template", "template_total")


# --- sinks and reports ---


@query(DISPATCHED + """
SELECT CASE WHEN estado = 'OK' THEN 'Procesados' ELSE 'Revisión Manual' END AS sheet, CASE WHEN estado <> 'OK' THEN estado END AS estado, CASE WHEN estado <> 'OK' THEN motivo_revision END AS motivo, archivo, mes, fecha, CAST(nro_documento AS VARCHAR) AS numero, proveedor, rut, CAST(total AS VARCHAR) AS total FROM done
UNION ALL SELECT 'Revisión', estado, motivo_revision, archivo, NULL, fecha, CAST(nro_documento AS VARCHAR), proveedor, rut, CAST(total AS VARCHAR) FROM done WHERE estado = 'QUARANTINE'""", known=False)  # fmt: skip
def workbooks_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records through workbooks: the two sheets for review, and the quarantine book, written and read back."""
    found = shared.stored(_dispatched(spark, sf_dir), "records")
    path = shared.folder(spark, "books")
    books.write(files.workbooks(found, period="2024-05", rows=2_000), path)
    books.write(books.quarantine_books(found, rows=3_000), path)
    cell = lambda *names: F.coalesce(*[F.try_element_at("cells", F.lit(n)) for n in names])
    return books.read(spark, path).select(
        "sheet", cell("estado").alias("estado"), cell("motivo_revision").alias("motivo"), cell("Archivo", "archivo_origen").alias("archivo"), cell("Mes").alias("mes"), cell("Fecha", "fecha").alias("fecha"),
        cell("Nro Boleta Factura", "nro_documento").alias("numero"), cell("PROVEEDOR", "proveedor").alias("proveedor"), cell("RUT", "rut").alias("rut"), cell("Total", "total").alias("total"),
    )


@query(DISPATCHED + """
SELECT side, value, count(*) FILTER (estado = 'OK') AS ok, count(*) FILTER (estado = 'QUARANTINE') AS quarantine, count(*) FILTER (estado = 'REJECTED') AS rejected FROM (
  SELECT 'total' AS side, '' AS value, estado FROM done UNION ALL SELECT 'por_ruta', CASE WHEN route = 'zip' THEN 'other' ELSE route END, estado FROM done UNION ALL SELECT 'por_doc_type', coalesce(doc_type, '?'), estado FROM done UNION ALL SELECT 'por_extension', substr(archivo, length(archivo) - 3), estado FROM done)
GROUP BY ALL
UNION ALL SELECT 'faltantes', field, 0, count(*), 0 FROM (SELECT unnest(list_filter([CASE WHEN fecha IS NULL THEN 'fecha' END, CASE WHEN rut IS NULL THEN 'rut' END, CASE WHEN total IS NULL THEN 'total' END, CASE WHEN proveedor IS NULL THEN 'proveedor' END, CASE WHEN nro_documento IS NULL THEN 'nro_documento' END], lambda x: x IS NOT NULL)) AS field FROM done WHERE estado = 'QUARANTINE') GROUP BY field""", known=False)  # fmt: skip
def report_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's figures as rows, observed while the records were written."""
    found, seen = metrics.observed(_dispatched(spark, sf_dir))
    found.write.parquet(shared.folder(spark, "records"))
    row = metrics.observed_report(seen.get, sf_dir)
    states = [s.lower() for s in metrics.STATES]
    told = [("total", "", *(row[s] for s in states)), *(("faltantes", k, 0, n, 0) for k, n in row["faltantes_quarantine"].items())]
    told += [(side, value, *(by.get(s, 0) for s in states)) for side in metrics.SIDES for value, by in row[side].items()]
    return spark.createDataFrame(told, "side string, value string, ok bigint, quarantine bigint, rejected bigint")


# --- search ---

NEEDLES = ["123", "doc_1", "c_99", "ASIA", "ial am", "limitada", "10.00", "0.1", "1-k", "345", "001", "7.jpg", "777", "europe", "middle east", "555", "ia limi", "10012", "zzz", "2.5"]


@query(f"""
SELECT needle, k AS doc_id FROM recs JOIN (SELECT unnest({NEEDLES!r}) AS needle) ON contains(lower(archivo), lower(needle)) OR contains(lower(coalesce(rut_emisor, '')), lower(needle)) OR contains(lower(coalesce(razon_social, '')), lower(needle)) OR contains(CAST(coalesce(folio, 0) AS VARCHAR), lower(needle))
WHERE estado = 'QUARANTINE'""")  # fmt: skip
def search_index_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _records(spark, sf_dir, "doc_id", "archivo", "estado", "rut_emisor", "razon_social", "folio").where("estado = 'QUARANTINE'")
    path = shared.folder(spark, "search")
    search_index.build(found.withColumn("folio", F.coalesce("folio", F.lit(0))), path, "doc_id", ["archivo", "rut_emisor", "razon_social", "folio"], buckets=16)
    return search_index.search(spark, path, NEEDLES).withColumnRenamed("key", "doc_id")


# --- geometry ---

# The lines of each rendered document, as its word boxes have them.
LINES = """
rendered AS (
  SELECT k, list_filter([
    CASE WHEN k % 7 = 0 THEN replace(kind, 'ELECTRONICA', 'ELECTRONCA') ELSE kind END,
    CASE WHEN k % 10 <> 0 THEN 'RUT: ' || dotted || '-' || CASE WHEN k % 11 = 0 THEN substr('0123456789K', instr('0123456789K', dv) % 11 + 1, 1) ELSE dv END END,
    CASE WHEN k % 10 <> 3 THEN 'N° ' || (k + 100000) END, CASE WHEN k % 10 <> 4 THEN 'COMERCIAL ' || region || ' LIMITADA' END,
    CASE WHEN k % 10 <> 1 THEN 'FECHA EMISION: ' || CASE k % 5 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%d-%m-%Y') WHEN 2 THEN strftime(d, '%d') || '-' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(d)] || '-' || year(d)
      WHEN 3 THEN day(d) || ' de ' || ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(d)] || ' de ' || year(d) ELSE ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][month(d)] || ' ' || day(d) || ', ' || year(d) END END,
    CASE WHEN k % 13 = 0 THEN 'SUBTOTAL $' || replace(format('{:,}', sub), ',', '.') END, CASE WHEN k % 10 <> 2 THEN 'TOTAL $' || replace(format('{:,}', tot), ',', '.') END], lambda x: x IS NOT NULL) AS lines
  FROM (SELECT *, CASE st WHEN 'F' THEN 'FACTURA ELECTRONICA' WHEN 'O' THEN 'BOLETA ELECTRONICA' ELSE 'NOTA DE CREDITO' END AS kind FROM known))
"""


@query(KNOWN.rstrip() + "," + LINES + """
SELECT k AS doc_id, CAST(i AS BIGINT) AS line, lines[i] AS text, round(list_avg(list_transform(range(len(string_split(lines[i], ' '))), lambda j: CASE WHEN (k + i + j) % 11 = 0 THEN 0.5::DOUBLE ELSE ((k + i + j) % 11 - 1) / 10.0::DOUBLE END)), 6) AS score
FROM (SELECT k, lines, unnest(range(1, len(lines) + 1)) AS i FROM rendered)""", known=False)  # fmt: skip
def lines_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the words of all documents, as loose rows in no order, each some pixels off its line."""
    words = tokens(documents(spark, sf_dir)).select("doc_id", F.posexplode("tokens").alias("at", "t")).select("doc_id", "t.*")
    key, i, j = F.col("doc_id"), F.floor(F.col("top") / 30) + 1, F.floor(F.col("left") / 100)
    off = (key * 7 + i * 3 + j * 5) % 9 - 4
    words = words.withColumns({"top": F.col("top") + off, "left": F.col("left") + off, "score": ((key + i + j) % 11 - 1) / 10})
    return boxes.lines(words.repartition(8, "text")).withColumns({"line": F.col("line").cast("bigint"), "score": F.round("score", 6)})


def red_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of the pixel rows of a page for each order, with a red box of eight kinds by its key, and the pages' sizes."""
    key = F.col("o_orderkey")
    x, y, w, h = 20 + key % 50, 12 + key % 30, 60 + key % 40, 24 + key % 10
    half = F.floor(w / 2)
    rect = lambda *v, hue=F.when(key % 2 == 0, 5).otherwise(175): F.struct(*[F.lit(c).cast("int").alias(n) for c, n in zip((*v, hue), ("x", "y", "w", "h", "hue"))])
    kinds = [
        [rect(x, y, w, h)],
        [rect(x, y, w, 3), rect(x, y + h - 3, w, 3), rect(x, y, 3, h), rect(x + w - 3, y, 3, h)],
        [rect(x, y, half, h), rect(x + half + 4, y, w - half - 4, h)],
        [rect(x, y, half, h), rect(x + half + 10, y, w - half - 10, h)],
        [rect(x, y, w, h, hue=F.lit(60))],
        [rect(x, y, w, h), rect(x, y + h + 3, w, h)],
        [rect(x, y, w, h), rect(x + 150, y + 60, 100 + key % 20, 40)],
        [rect(x, y, 20, 10)],
    ]
    drawn = F.array(rect(5, 2, 300, 3, hue=F.lit(100)))
    for m, parts in enumerate(kinds):
        drawn = F.when(key % 8 == m, F.array(*parts)).otherwise(drawn)
    orders = table(spark, sf_dir, "orders")
    pages = spread(orders.select("o_orderkey"), orders).select(key.alias("doc_id"), F.explode(F.concat(F.array(rect(5, 2, 300, 3, hue=F.lit(100))), drawn)).alias("r")).select("doc_id", "r.*")
    runs = pages.select("doc_id", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)).alias("y"), F.col("x").alias("x0"), (F.col("x") + F.col("w") - 1).alias("x1"), "hue", F.lit(200).alias("saturation"), F.lit(200).alias("value"))
    return runs, orders.select(key.alias("doc_id"), F.lit(400).alias("width"), F.lit(300).alias("height"))


@query("""
WITH page AS (SELECT o_orderkey AS k, 20 + o_orderkey % 50 AS x, 12 + o_orderkey % 30 AS y, 60 + o_orderkey % 40 AS w, 24 + o_orderkey % 10 AS h FROM orders),
seen AS (
  SELECT k, x, y, w, h FROM page WHERE k % 8 IN (0, 1, 2, 6)
  UNION ALL SELECT k, x, y, w // 2, h FROM page WHERE k % 8 = 3 UNION ALL SELECT k, x + w // 2 + 10, y, w - w // 2 - 10, h FROM page WHERE k % 8 = 3
  UNION ALL SELECT k, x, y, w, 2 * h + 3 FROM page WHERE k % 8 = 5 UNION ALL SELECT k, x + 150, y + 60, 100 + k % 20, 40 FROM page WHERE k % 8 = 6 UNION ALL SELECT k, x, y, 20, 10 FROM page WHERE k % 8 = 7),
fits AS (SELECT *, (w + 3) * (h + 3) AS area FROM seen WHERE (w + 3) * (h + 3) >= 1000 AND (w + 4) / CAST(h + 4 AS DOUBLE) BETWEEN 1.5 AND 3.5)
SELECT k AS doc_id, CAST(x - 12 AS INTEGER) AS x, CAST(y - 12 AS INTEGER) AS y, CAST(w + 24 AS INTEGER) AS w, CAST(h + 24 AS INTEGER) AS h FROM fits QUALIFY row_number() OVER (PARTITION BY k ORDER BY area DESC, y, x) = 1""", known=False)  # fmt: skip
def red_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, sizes = red_pages(spark, sf_dir)
    return boxes.red_boxes(runs, sizes, lambda rows: shared.stored(rows, "boxes"), least_area=1_000)


# --- more of the dispatcher, readers and files ---


# Beside the date's label of images without a supplier, the words' places tell one.
BOXED = DISPATCHED.replace("THEN supplier END razon_social", "THEN supplier WHEN k % 7 IN (2, 3, 4) THEN 'Emision:' END razon_social")


@query(BOXED + "SELECT doc_id, archivo, route, fecha, mes, total, rut, proveedor, nro_documento, estado, motivo_revision, ruta_extraccion, ocr_engine, completeness, doc_type FROM done", known=False)
def dispatch_boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `dispatch_records`, but the tax id of images is in a box that was read on its own, and their words have places."""
    docs, m = tokens(documents(spark, sf_dir)), F.col("doc_id") % 7
    route = F.when(m == 0, "pdf_native").when(m == 1, "pdf_image").when(m == 5, "zip").otherwise("image")
    image = m.isin(2, 3, 4)
    parted = F.split("text", "\n")
    of = lambda inside: F.array_join(F.filter(parted, lambda x: x.startswith("RUT") == F.lit(inside)), "\n")
    rescue = F.when(m == 3, F.create_map(F.lit("total_price"), F.lit("9.999"), F.lit("date"), F.lit("01/02/2020"), F.lit("other"), F.lit("x")))
    given = docs.select("doc_id", "archivo", F.when(image, of(False)).otherwise(F.col("text")).alias("text"), F.when(image, of(True)).alias("box_text"), "tokens", route.alias("route"), rescue.alias("rescue"), F.when(m == 6, "Excepción: OSError: damaged").alias("error"))
    return dispatch.process(given, SUPPLIERS[:1], F.lit(YEAR)).select("doc_id", "archivo", "route", "fecha", "mes", "total", "rut", "proveedor", "nro_documento", "estado", "motivo_revision", "ruta_extraccion", "ocr_engine", "completeness", "doc_type")


@query(DISPATCHED + """SELECT doc_id, '{"archivo":"' || archivo || '","estado":"' || estado || '","total":' || coalesce(CAST(total AS VARCHAR), 'null') || ',"rut":' || coalesce('"' || rut || '"', 'null') || ',"timestamp_proceso":"2024-05-06T07:08:09"}' AS body FROM done""", known=False)
def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dispatched(spark, sf_dir).select("doc_id", "archivo", "estado", "total", "rut")
    return found.select("doc_id", dispatch.to_json(found.drop("doc_id"), F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("body"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey % 1000 + 12) AS BIGINT) AS bytes FROM orders", known=False)
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.file_sizes(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000 + 12).alias("length")))


@query("""SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 'TOTAL 5.000' || chr(10) || 'borroso' ELSE 'borroso' || chr(10) || 'otro' END AS text, (k % 10 / 10.0::DOUBLE + 0.5::DOUBLE) / 2 AS score, CASE WHEN k % 2 = 0 THEN 'dual_tess_priority' ELSE 'dual_paddle_priority' END AS engine, 'a' || k || ',b,c' || k AS lines FROM known""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(key.alias("doc_id"))
    name = lambda c: F.concat(F.lit(c), F.col("doc_id").cast("string"))
    first = orders.select("doc_id", F.lit("borroso").alias("text"), (F.col("doc_id") % 10 / 10).alias("score"), F.array(name("a"), F.lit("b")).alias("lines"))
    second = orders.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "TOTAL 5.000").otherwise("otro").alias("text"), F.lit(0.5).alias("score"), F.array(name("c")).alias("lines"))
    return records.merge_readers(first, second, "doc_id", F.lit(YEAR)).withColumn("lines", F.array_join("lines", ","))


# --- pages ---


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey % 41 - 20 AS DOUBLE) / 2 AS angle FROM orders", known=False)
def skew_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angles of pages with three lines of marks, drawn at half degrees from -10 to 10, one for each order."""
    angle = F.radians((F.col("o_orderkey") % 41 - 20) / 2)
    orders = table(spark, sf_dir, "orders")
    marks = spread(orders.select("o_orderkey"), orders).select(F.col("o_orderkey").alias("doc_id"), F.tan(angle).alias("tan"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("i"))
    x0 = 20 + 56 * (F.col("i") % 10)
    y = 150 + 60 * F.floor(F.col("i") / 10) + F.round((x0 + 3) * F.col("tan"))
    return pixels.skew(marks.select("doc_id", y.cast("int").alias("y"), x0.cast("int").alias("x0"), (x0 + 6).cast("int").alias("x1")))


@query("""
WITH page AS (SELECT c_custkey AS k, x, y, (c_custkey * 7 + x * x * 3 + y * 11 + (x * y) % 13 * 17) % 256 AS v FROM customer, (SELECT unnest(range(30)) AS x), (SELECT unnest(range(20)) AS y)),
across AS (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS n FROM page WINDOW w AS (PARTITION BY k, y ORDER BY x RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
around AS (SELECT *, sum(s) OVER w AS ss, sum(n) OVER w AS nn FROM across WINDOW w AS (PARTITION BY k, x ORDER BY y RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT k AS doc_id, CAST(sum(CASE WHEN v * nn > ss - 10 * nn THEN 1 ELSE 0 END) AS BIGINT) AS light, CAST(sum(CASE WHEN v * nn > ss - 10 * nn THEN x + 100 * y ELSE 0 END) AS BIGINT) AS places FROM around GROUP BY k""", known=False)  # fmt: skip
def local_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of a page for each customer are light, and where; pages are cut into four tiles at places of their own."""
    key = F.col("c_custkey")
    cut_x, cut_y = (5 + key % 20).cast("int"), (3 + key % 15).cast("int")
    corner = lambda x, y, w, h: F.struct(x.cast("bigint").alias("x0"), y.cast("bigint").alias("y0"), w.cast("bigint").alias("width"), h.cast("bigint").alias("height"))
    none = F.lit(0)
    tiles = F.array(corner(none, none, cut_x, cut_y), corner(cut_x, none, 30 - cut_x, cut_y), corner(none, cut_y, cut_x, 20 - cut_y), corner(cut_x, cut_y, 30 - cut_x, 20 - cut_y))
    people = table(spark, sf_dir, "customer")
    rows = spread(people.select("c_custkey"), people).select(key.alias("doc_id"), F.explode(tiles).alias("t")).select("doc_id", "t.*")
    y, x = np.mgrid[:20, :30]
    plain = (x * x * 3 + y * 11 + (x * y) % 13 * 17).astype(np.uint8)  # of the page with the key 0; others are lighter by a step, modulo 256

    def drawn(batches):
        for batch in batches:
            at = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([(plain[y : y + h, x : x + w] + np.uint8(k * 7 % 256)).tobytes() for k, x, y, w, h in at], pa.binary())], names=[*batch.schema.names, "pixels"])

    def told(batches):
        for batch in batches:
            x0, y0, width = (c.to_numpy() for c in batch.columns[1:4])
            said = batch.column(4).to_pylist()
            ends = np.cumsum([len(t) for t in said])
            on = np.flatnonzero(np.frombuffer(b"".join(said), np.uint8))
            tile = np.searchsorted(ends, on, "right")
            i = on - (ends[tile] - (ends - np.append(0, ends[:-1]))[tile])
            place = x0[tile] + i % width[tile] + 100 * (y0[tile] + i // width[tile])
            sums = [np.bincount(tile, w, len(said)).astype(np.int64) for w in (None, place)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["doc_id", "light", "places"])

    box = "doc_id bigint, x0 bigint, y0 bigint, width bigint"
    found = pixels.local_threshold(rows.mapInArrow(drawn, f"{box}, height bigint, pixels binary"), window=9)
    lit = found.select("doc_id", "x0", "y0", "width", "light").mapInArrow(told, "doc_id bigint, light bigint, places bigint")
    return lit.groupBy("doc_id").agg(F.sum("light").alias("light"), F.sum("places").alias("places"))
