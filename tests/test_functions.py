import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates, names, tax_id
from ledgerlens.operators import anchors, records, templates
from ledgerlens.sources import files
from ledgerlens.streaming import inbox


# Fixed values throughout: texts, and what must be read of them.


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("raw, clean", [("12345678-5", "123456785"), ("12.345.678-5", "123456785"), ("12345678k", "12345678K"), ("", None), (None, None), ("abc", None)])
def test_clean(spark, raw, clean):
    assert one(spark, tax_id.clean, raw) == clean


@pytest.mark.parametrize("raw, canonical", [("12345678-5", "12.345.678-5"), ("11111111-1", "11.111.111-1"), ("40K", "40-K"), ("40-k", "40-K"), ("12345678-9", None), ("99999999-0", None), ("1234", None), ("", None), ("abcdefg-h", None)])
def test_validate(spark, raw, canonical):
    assert one(spark, tax_id.validate, raw) == canonical


@pytest.mark.parametrize("text, rut", [("RUT: 12.345.678-5", "12.345.678-5"), ("R.U.T.: 22.222.222-2", "22.222.222-2"), ("Hola mundo sin RUT", None), ("Telefono 111111111", None), ("RUT: 76.000.000 x", "76.000.000"), ("RUT: 12.345.678-9", "12.345"), (None, None)])
def test_extract_rut(spark, text, rut):
    assert one(spark, tax_id.extract, text) == rut


@pytest.mark.parametrize("text, day", [("Fecha: 15/03/2024", (2024, 3, 15)), ("Emitida 03-08-2023", (2023, 8, 3)), ("DIA 7.11.2024", (2024, 11, 7)), ("12 de marzo de 2024", (2024, 3, 12)), ("5 de ene 2025", (2025, 1, 5)), ("99/99/2024", None), ("", None), (None, None), ("01-dic-2025", (2025, 12, 1)), ("March 5th, 1999", (1999, 3, 5)), ("31/02/2020 y 1/2/70", (1970, 2, 1)), ("25/04/202209:29:50", (2022, 4, 25)), ("3 de mayo", (2001, 5, 3))])
def test_extract_date(spark, text, day):
    assert one(spark, lambda t: dates.extract(t, F.lit(2001)), text) == (day and datetime.date(*day))


@pytest.mark.parametrize("text, total", [("TOTAL: $1.234.567", 1234567), ("Total 1234567", 1234567), ("TOTAL $12.500", 12500), ("Importe total  9.999", 9999), ("", None), (None, None), ("Total 50", None), ("TOTAL 50", 50), ("Subtotal 5.000 Total 5.950", 5000), ("$ 1.000,50", 1000)])
def test_extract_total(spark, text, total):
    assert one(spark, amounts.extract_total, text) == total


@pytest.mark.parametrize("text, folio", [("Factura N° 12345", 12345), ("BOLETA 9876543", 9876543), ("N° 555111", 555111), ("", None), ("NRO: 77", 77)])
def test_extract_folio(spark, text, folio):
    assert one(spark, amounts.extract_folio, text) == folio


@pytest.mark.parametrize("text, kind", [("Factura Electrónica", "factura_electronica"), ("BOLETA ELECTRONCA", "boleta_electronica"), ("nada", "desconocido"), (None, "desconocido"), ("", "desconocido"), ("RUT FOLIO", "dte_generico")])
def test_document_type(spark, text, kind):
    assert one(spark, names.document_type, text) == kind


def test_supplier_below_its_id(spark):
    text = "FACTURA\nRUT 12345678-5\nGIRO X\nACME SPA\nOTRA EMPRESA"
    assert one(spark, lambda t: names.extract_supplier(t, F.lit("12.345.678-5")), text) == "Acme spa"
    assert one(spark, lambda t: names.extract_supplier(t, F.lit(None).cast("string")), "NADA\nＡＣＭＥ  LTDA") == "Acme ltda"


def test_anchor_lines_and_states(spark):
    token = "struct<text:string,left:int,top:int,width:int,height:int>"
    rows = [(1, [("RUT:", 0, 0, 9, 20), ("x", 400, 0, 9, 20), ("12.345.678-5", 0, 40, 9, 20), ("EMPRESA", 0, 80, 9, 20), ("late", 0, 120, 9, 20)]), (2, []), (3, None)]
    found = {r["k"]: r for r in anchors.fields(spark.createDataFrame(rows, f"k int, tokens array<{token}>")).collect()}
    assert found[1]["anchor_rut"] == "12.345.678-5" and found[1]["anchor_proveedor"] == "12.345.678-5"  # a dotted id passes for a name
    assert found[2]["anchor_rut"] is None and found[3]["anchor_total"] is None
    states = records.assess(records.parse(spark.createDataFrame([("nada",), ("INVOICE 01/02/2020 total 5.000",)], "text string")))
    assert [r["estado"] for r in states.collect()] == ["REJECTED", "OK"]


def test_learned_template_reads_the_next_total(spark):
    learned = templates.learn([], "Acme", "ACME\nMonto final $ 12.345 pesos", 12345)
    row = templates.apply(spark.createDataFrame([("acme\nMonto final $ 99.100",)], "text string"), learned).first()
    assert (row["template"], row["template_total"]) == ("Acme", 99100)


def test_files_sheets_and_inbox(spark, tmp_path):
    folder = tmp_path / "in" / "job_id=7"
    folder.mkdir(parents=True)
    (folder / "a.PDF").write_bytes(b"%PDF-1.4")
    (folder / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (folder / "c.tiff").write_bytes(b"II*\x00")
    (folder / "d.txt").write_bytes(b"%PDF-")
    assert [r["file_type"] for r in files.scan(spark, str(tmp_path / "in")).orderBy("path").collect()] == ["pdf", "image"]
    query = inbox.process(inbox.watch(spark, str(tmp_path / "in")), lambda f: f.select("job_id", F.lit("OK").alias("estado")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    done = spark.read.parquet(str(tmp_path / "out" / "records"))
    assert inbox.running_counters(done).collect() == [("7", 2, 0)]
    table = files.sheet(spark.createDataFrame([("OK", "a;b", 5), ("REJECTED", "c", None)], "estado string, archivo string, total int"), ["Archivo", "Total"])
    files.write_csv(table, str(tmp_path / "csv"), parts=1)
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes() == '﻿Archivo;Total\r\n"a;b";5\r\n'.encode()
