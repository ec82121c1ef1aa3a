"""Tax documents rendered from the order tables: a corpus whose fields are known.

Which parts a document lacks, how its date is written and where it is misspelt follow from its
order key, so that expected results can be told without reading the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import tax_id

# Short month names of documents.
SHORT = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
LONG = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
ENGLISH = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, source: DataFrame) -> DataFrame:
    """rows over all cores, where the files of their source give fewer partitions: their texts are much more work than they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if source.rdd.getNumPartitions() < cores else rows


def _written_date(day: Column, style: Column) -> Column:
    month = lambda names: F.get(F.array(*map(F.lit, names)), F.month(day) - 1)
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    return (
        F.when(style == 0, F.date_format(day, "dd/MM/yyyy"))
        .when(style == 1, F.date_format(day, "dd-MM-yyyy"))
        .when(style == 2, F.concat_ws("-", F.date_format(day, "dd"), month(SHORT), y))
        .when(style == 3, F.concat(d, F.lit(" de "), month(LONG), F.lit(" de "), y))
        .otherwise(F.concat(month(ENGLISH), F.lit(" "), d, F.lit(", "), y))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, archivo and text of one document for each order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    regions = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(regions), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = spread(orders.join(people, F.col("o_custkey") == F.col("c_custkey")), orders)
    key = F.col("o_orderkey")
    lacks = lambda n: key % 10 == n
    line = lambda there, *parts: F.when(there, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    body = (F.col("o_custkey") + 10_000_000).cast("string")
    right = tax_id.check_digit(body)
    digits = F.lit("0123456789K")
    wrong = F.substring(digits, F.instr(digits, right) % 11 + 1, F.lit(1))
    rut = tax_id.dotted(F.concat(body, F.when(key % 11 == 0, wrong).otherwise(right)))
    total = F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    part = F.translate(F.format_number(F.floor(F.col("o_totalprice") / 2), 0), ",", ".")
    kind = F.when(F.col("o_orderstatus") == "F", "FACTURA ELECTRONICA").when(F.col("o_orderstatus") == "O", "BOLETA ELECTRONICA").otherwise("NOTA DE CREDITO")
    text = F.concat_ws(
        "\n",
        F.when(key % 7 == 0, F.replace(kind, F.lit("ELECTRONICA"), F.lit("ELECTRONCA"))).otherwise(kind),
        line(~lacks(0), "RUT: ", rut),
        line(~lacks(3), "N° ", (key + 100_000).cast("string")),
        line(~lacks(4), "COMERCIAL ", F.col("r_name"), " LIMITADA"),
        line(~lacks(1), "FECHA EMISION: ", _written_date(F.col("day"), key % 5)),
        line(key % 13 == 0, "SUBTOTAL $ ", part),
        line(~lacks(2), "TOTAL $ ", total),
    )
    return rows.select(key.alias("doc_id"), F.concat(F.lit("doc_"), key.cast("string"), F.when(key % 3 == 0, ".jpg").otherwise(".pdf")).alias("archivo"), text.alias("text"))


def tokens(docs: DataFrame) -> DataFrame:
    """docs with tokens: the words of the text on a grid, as a reader with coordinates gives them."""
    words = F.transform(
        F.split(F.replace("text", F.lit("$ "), F.lit("$")), "\n"),
        lambda line, i: F.transform(F.split(line, " "), lambda w, j: F.struct(w.alias("text"), (10 + 100 * j).alias("left"), (10 + 30 * i).alias("top"), F.lit(90).alias("width"), F.lit(20).alias("height"))),
    )
    return docs.withColumn("tokens", F.flatten(words))


def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of one document for each customer, of twelve kinds by its key: blank pages, odd spaces, ids without dots and so on."""
    key = F.col("c_custkey")
    body = (key + 10_000_000).cast("string")
    right = tax_id.check_digit(body)
    dotted = tax_id.dotted(F.concat(body, right))
    wrong = tax_id.dotted(F.concat(body, F.substring(F.lit("0123456789K"), F.instr(F.lit("0123456789K"), right) % 11 + 1, F.lit(1))))
    texts = [
        ["\n" * 60],
        ["FACTURA ELECTRÓNICA\nRUT:\u00a0", dotted, "\nN°\u00a0", (key + 1_000).cast("string"), "\nCOMERCIAL ÑANDÚ LTDA\nFECHA EMISIÓN:\u00a005/03/2021\nTOTAL\u00a0$\u00a05.000"],
        ["RUT: ", body, "-", right, "\nGIRO: VENTAS\nFERRETERÍA NUEVA SPA\nTotal 12.500\nFecha 1-1-2020"],
        ["FACTURA ELECTRONICA\nRUT: ", dotted, "\nR.U.T.: 76.192.083-9\nFOLIO N° 77\nTOTAL 1.190"],
        ["BOLETA ELECTRONICA\nTotal ...\nTOTAL 8.000"],
        ["BOLETA ELECTRONICA\n", F.when(F.floor(key / 12) % 2 == 1, "TOTAL").otherwise("Total"), " 50"],
        ["NOTA DE CREDITO\nNUEVA COMERCIAL LIMITADA\nCOMERCIAL ANDINA LIMITADA\nTOTAL $ 3.300\n01.02.2019"],
        ["GUIA DE DESPACHO\nFECHA 1/1/202\nTOTAL 999"],
        ["BOLETA ELECTRONICA\nTOTAL 000"],
        ["S.I.I.\nRUT: ", wrong, "\nTOTAL $ 100\n3 de marzo de 2022"],
        ["GUÍA DE DESPACHO\nN° 5555\nCOMERCIAL SUR S.A.\n15-ene-20"],
        ["INVOICE\nGOOGLE PLAY\nMarch 3, 2021\nTotal $ 9,90"],
    ]
    text = F.lit(None).cast("string")
    for i, parts in enumerate(texts):
        text = F.when(key % len(texts) == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(text)
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return spread(people, people).select(key.alias("doc_id"), text.alias("text"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """archivo, route and text of one identity card for each customer; some have a wrong id or no number."""
    key = F.col("c_custkey")
    body = (key + 10_000_000).cast("string")
    right = tax_id.check_digit(body)
    id_text = tax_id.dotted(F.concat(body, F.when(key % 11 == 0, F.when(right == "1", "2").otherwise("1")).otherwise(right)))
    number = F.when(key % 10 != 3, F.concat(F.lit("Numero de documento: "), F.translate(F.format_number(key + 100_000_000, 0), ",", ".")))
    text = F.concat_ws("\n", F.lit("CEDULA DE IDENTIDAD"), id_text, number, F.lit("Fecha de nacimiento\n05 Mar 1990"))
    people = table(spark, sf_dir, "customer").select("c_custkey")
    return spread(people, people).select(F.concat(F.lit("card_"), key.cast("string"), F.lit(".png")).alias("archivo"), F.lit("image").alias("route"), text.alias("text"))
