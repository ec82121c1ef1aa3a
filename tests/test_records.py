"""Text functions against Python's own engine, records by route, and what is written of them."""

import json
import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlens import settings
from ledgerlens.functions import amounts, names, tax_id
from ledgerlens.operators import anchors, dispatch, jobs, metrics, records, templates
from ledgerlens.sources import books, files
from ledgerlens.streaming import inbox

NBSP = " "


def column(spark, texts, f):
    rows = spark.createDataFrame([*enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("text"))).collect()]


def test_odd_spaces_and_accents_are_read(spark):
    texts = [f"N°{NBSP}12345", f"RUT:{NBSP}12.345.678-5 x", "FACTURA ELECTRÓNICA n° 777", f"TOTAL{NBSP}5.000", f"RUT:{NBSP}76.000.000 x"]
    assert column(spark, texts, amounts.extract_folio)[0] == 12345
    assert column(spark, texts, amounts.extract_folio)[2] == 777
    assert column(spark, texts, tax_id.extract)[1] == "12.345.678-5" and column(spark, texts, tax_id.extract)[4] == "76.000.000"
    assert column(spark, texts, amounts.extract_total)[3] == 5000
    blank = ["\n" * 60, NBSP * 60, " x" * 40, None]
    assert column(spark, blank, lambda t: files.has_text(F.array(t))) == [False, False, True, False]
    assert column(spark, blank, records.text_quality) == [0, 0, 1, 0]


def test_compatibility_characters_equal_nfkc(spark):
    deal = random.Random(3)
    odd = "ﬁﬂ①Ⅷ½ＡＢ　№ªº℡㎏ é́ñ" + "éñÅ" + NBSP + "Ω"
    pieces = [*(c for c in odd if not unicodedata.combining(c)), "e\u0301", "n\u0303", "A\u030a", *"abc XYZ."]
    texts = ["".join(deal.choices(pieces, k=12)) for _ in range(200)]
    assert column(spark, texts, names.plain) == [unicodedata.normalize("NFKC", t) for t in texts]
    assert column(spark, ["ﬁna ① Ⅷ"], names.normalize_name) == ["Fina 1 Viii"]


def test_totals_against_the_patterns(spark):
    deal = random.Random(8)
    said = ["Total", "TOTAL", "total a pagar", "Monto a pagar", "$", " ", ": ", "5.000", "12,50", "...", "50", "1.234.567", "\n", "SUBTOTAL", NBSP, "x"]
    texts = ["".join(deal.choice(said) for _ in range(7)) for _ in range(300)]

    def money(raw):
        kept = re.sub("[.,]", "", re.sub(r"[.,]\d{1,2}$", "", re.sub(r"\s", "", raw)))
        return int(kept) if kept else None

    def total(text):
        for p in amounts.TOTALS:
            flags = re.IGNORECASE * ("i" in p.split(")")[0]) | re.DOTALL * ("s" in p.split(")")[0])
            found = re.search(p.split(")", 1)[1], text, flags)
            if found:
                return money(found[1])
        return None

    assert column(spark, texts, amounts.extract_total) == [total(t) for t in texts]


def test_digits_of_other_scripts(spark):
    texts = ["Total \u0661\u0662\u0663\u0664", "TOTAL $ \uff11.\uff12\uff13\uff14", "N\u00b0 \u0967\u0968\u0969\u096a", "Total \u00b2\u00b3"]
    assert column(spark, texts, amounts.extract_total) == [1234, 1234, None, None]
    assert column(spark, texts, amounts.extract_folio) == [None, None, 1234, None]
    assert column(spark, ["$\u0661,\u0665"], lambda t: amounts.anchored_money(F.replace(t, F.lit("$")))) == [1]


def test_listings_are_ordered(spark, tmp_path):
    for name in ("b.pdf", "c.txt", "a.PNG", "sub/d.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    found = [(r["path"].rpartition("/")[2], r["length"]) for r in files.listing(spark, str(tmp_path)).collect()]
    assert found == [("a.PNG", 5), ("b.pdf", 5), ("d.jpg", 5)]


def test_amounts_in_pesos_and_validation(spark):
    assert column(spark, ["1234567", None], lambda t: amounts.pesos(t.cast("bigint"))) == ["$1.234.567", "—"]
    found = column(spark, ["12.345.678-5", "12.345.678-9", "x"], tax_id.validation)
    assert [(r["valid"], r["dv"], r["canonical"]) for r in found] == [(True, "5", "12.345.678-5"), (False, "5", None), (False, None, None)]


def test_words_after_keywords(spark):
    rows = spark.createDataFrame([(["total", "", None, " ", " 9 ", "NETO", "x", "TOTAL", "7"],), (["TOTAL", "", "", "", "", "", "far", "Total", "near"],), ([],)], "words array<string>")
    found = [r[0] for r in rows.select(anchors.next_words(F.col("words"))).collect()]
    assert [m["TOTAL"] for m in found] == ["9", "near", ""] and found[0]["NETO"] == "x" and found[2]["RUT"] == ""


TEXTS = {
    "pdf_native": "FACTURA ELECTRONICA\nRUT: 12.345.678-5\nTOTAL 000\n01/02/2020",
    "pdf_image": "BOLETA ELECTRONICA\nRUT: 12.345.678-5\nTOTAL 9.000",
    "image": "NOTA DE CREDITO\nTOTAL 1.000\n01/02/2020",
}


def given(spark):
    rows = [(f"{r}.pdf", r, t, None, None, None) for r, t in TEXTS.items()]
    rows += [("a.png", "image", "Mi Tienda\nTOTAL 700 el 3/4/2021", None, None, None), ("b.png", "image", "Mi Tienda", None, None, None)]
    rows += [("c.png", "image", "BOLETA ELECTRONICA\nRUT: 12.345.678-5", "caja 5/6/2019", {"total_price": "8.000", "date": "1/1/2001"}, None)]
    rows += [("d.zip", "zip", "x", None, None, None), ("e.pdf", "pdf_image", None, None, None, "Excepción: OSError: bad"), ("f.png", "image", None, None, None, None), ("g.png", None, None, None, None, None)]
    return spark.createDataFrame(rows, "archivo string, route string, text string, box_text string, rescue map<string,string>, error string")


SHOP = [templates.Template("Mi Tienda", ["mi tienda"], "76.000.000-1", {"total": r"regex: TOTAL\s*([\d\.]+)", "fecha": r"regex: el (\S+)"})]


def test_records_by_route(spark):
    found = {r["archivo"]: r for r in dispatch.process(given(spark), SHOP, F.lit(2024)).collect()}
    native = found["pdf_native.pdf"]
    assert (native["estado"], native["total"], native["mes"], native["ruta_extraccion"], native["completeness"]) == ("OK", 0, "2020-02", "pdf_native", None)
    assert found["pdf_image.pdf"]["motivo_revision"].startswith("Faltan: folio, razon_social, fecha_emision |") and found["pdf_image.pdf"]["ocr_avg_score"] == 0.5
    assert (found["image.pdf"]["estado"], found["image.pdf"]["ocr_engine"]) == ("QUARANTINE", "dual")
    assert (found["a.png"]["estado"], found["a.png"]["motivo_revision"], found["a.png"]["total"], found["a.png"]["fecha"]) == ("OK", "Plantilla Automática: Mi Tienda", 700, "2021-04-03")
    assert found["b.png"]["motivo_revision"] == dispatch.TEMPLATE_LACKS and found["b.png"]["estado"] == "QUARANTINE"
    rescued = found["c.png"]
    assert (rescued["estado"], rescued["motivo_revision"], rescued["total"], rescued["fecha"]) == ("OK", "Rescatado por IA (Donut)", 8000, "2019-06-05")
    assert rescued["raw_text"].startswith("caja 5/6/2019\nBOLETA")
    assert found["d.zip"]["motivo_revision"] == "Ruta desconocida: zip" and found["e.pdf"]["motivo_revision"] == "Excepción: OSError: bad"
    assert found["f.png"]["estado"] == "REJECTED" and found["f.png"]["motivo_revision"] == records.NOTHING and found["g.png"]["estado"] == "REJECTED"
    assert dispatch.process(given(spark).where("archivo = 'none'"), SHOP).count() == 0
    body = json.loads(dispatch.process(given(spark), SHOP, F.lit(2024)).where("archivo = 'a.png'").transform(lambda d: d.select(dispatch.to_json(d))).first()[0])
    assert body["rut"] == "76.000.000-1" and body["folio" if "folio" in body else "nro_documento"] is None and len(body["timestamp_proceso"]) == 19


def test_sheets_and_reports_are_written(spark, tmp_path):
    found = dispatch.process(given(spark), SHOP, F.lit(2024))
    found.write.parquet(str(tmp_path / "r"))
    found = spark.read.parquet(str(tmp_path / "r"))
    files.write_csv(files.sheet(found.withColumnsRenamed({"nro_documento": "folio"}), ["Archivo", "Total"]), str(tmp_path / "csv"), parts=1)
    raw = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert raw.startswith("﻿Archivo;Total".encode()) and b"a.png;700" in raw
    (tmp_path / "books").mkdir()
    files.write_workbooks(found.coalesce(1), str(tmp_path / "books"), period="2024-05", rows=4)
    books = sorted((tmp_path / "books").glob("*.xlsx"))
    assert len(books) == 3 and books[0].name.startswith("Rendicion_Gastos_OCR_2024-05_")
    sheets = "".join(zipfile.ZipFile(b).read(f"xl/worksheets/sheet{i}.xml").decode() for b in books for i in (1, 2))
    assert "<v>700</v>" in sheets and "Ruta desconocida: zip" in sheets and "Revisión Manual" in zipfile.ZipFile(books[0]).read("xl/workbook.xml").decode()
    assert {r["archivo_origen"] for r in files.quarantine(found).collect()} == {r["archivo"] for r in found.where("estado = 'QUARANTINE'").collect()}
    report = metrics.report(found, "in").first()
    assert report["total"] == 10 and report["rejected"] == 4 and report["por_ruta"]["zip"] == {"rejected": 1} and report["faltantes_quarantine"]["nro_documento"] >= 2
    assert metrics.diagnosis(found).first()["exit_code"] == 2 and metrics.report(found.where("archivo = ''"), "in").first()["total"] == 0
    assert {r["tipo"]: r["n"] for r in metrics.by_name(found).collect()} == {"otro": 10}


def test_a_folder_becomes_records(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "one.PDF").write_bytes(b"%PDF-1.4 RUT: 12.345.678-5 TOTAL 5.000 1/2/2020")
    (tmp_path / "in" / "sub" / "two.png").write_bytes(b"\x89PNG\r\n\x1a\n nothing")
    (tmp_path / "in" / "three.txt").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "four.pdf").write_bytes(b"no pdf")
    reader = lambda f: f.select(F.regexp_extract("path", "[^/]+$", 0).alias("archivo"), F.when(F.col("file_type") == "pdf", "pdf_native").otherwise("image").alias("route"), F.when(F.col("file_type") == "pdf", F.decode("content", "ISO-8859-1")).alias("text"))
    found = {r["archivo"]: r["estado"] for r in dispatch.directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), reader).collect()}
    assert found == {"one.PDF": "OK", "two.png": "REJECTED"}
    (tmp_path / "in" / "five.pdf").write_bytes(b"%PDF-1.4 RUT: 12.345.678-5 TOTAL 7.000")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    once = lambda f: reader(f).mapInArrow(counted, "archivo string, route string, text string")
    written = dispatch.directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), once)
    assert read.value == 3 == written.count()
    left = metrics.report(written, str(tmp_path / "in")).first().asDict(recursive=True)
    right = files.read_report(spark, f"{tmp_path}/out/report/*.json", metrics.REPORT).first().asDict(recursive=True)
    assert {k: v for k, v in right.items() if k != "path"} == left
    booked = {(r["sheet"], r["cells"]["Archivo"], r["cells"].get("Total")) for r in books.read(spark, f"{tmp_path}/out/books").collect()}
    assert booked == {("Procesados", "one.PDF", "5000"), ("Revisión Manual", "two.png", None), ("Revisión Manual", "five.pdf", "7000")}
    assert [r["cells"]["archivo_origen"] for r in books.read(spark, f"{tmp_path}/out/quarantine/books").collect()] == ["five.pdf"]
    schema = "total long, ok long, por_extension map<string,map<string,long>>"
    assert files.read_report(spark, f"{tmp_path}/out/report/*.json", schema).first()["ok"] == 1
    (tmp_path / "old.json").write_bytes('{"total": 3, "ok": 1, "por_extension": {"ñ": {"ok": 1}}}'.encode("latin-1"))
    assert "ñ" in files.read_report(spark, str(tmp_path / "old.json"), schema).first()["por_extension"]


def test_a_stream_of_files_keeps_job_states(spark, tmp_path):
    (tmp_path / "in" / "job_id=7").mkdir(parents=True)
    for i, text in enumerate(["RUT: 12.345.678-5 TOTAL 5.000 1/2/2020", "", "RUT"]):
        (tmp_path / "in" / "job_id=7" / f"{i}.pdf").write_bytes(b"%PDF-1.4 " + text.encode())
    bad = F.when(F.col("path").endswith("2.pdf"), "Excepción: OSError: damaged")
    to_records = lambda f: dispatch.process(f.select("job_id", F.regexp_extract("path", "[^/]+$", 0).alias("archivo"), F.lit("pdf_image").alias("route"), F.decode("content", "UTF-8").alias("text"), bad.alias("error")))
    inbox.process(inbox.watch(spark, str(tmp_path / "in"), 1), to_records, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "records")).count() == 3
    states = spark.read.parquet(str(tmp_path / "out" / "jobs"))
    expected = spark.createDataFrame([("7", 3), ("8", 1), ("9", 0)], "id string, total_files int")
    assert {r["id"]: (r["status"], r["processed"], r["failed"]) for r in inbox.statuses(states, expected).collect()} == {"7": ("done", 1, 2), "8": ("queued", 0, 0), "9": ("done", 0, 0)}


def test_templates_are_kept_in_order(spark, tmp_path):
    many = [templates.Template(f"Proveedor {i}", [f"clave{i:04d}"], f"{i}-1", {"total": r"regex: T([\d]+)"} if i % 2 else {}) for i in range(300)]
    rows = spark.createDataFrame([(1, "CLAVE0007 y clave0003 T55"), (2, "nada"), (3, None), (4, "clave0298")], "doc_id int, text string")
    by_table = [tuple(r)[2:] for r in templates.apply(rows, many).orderBy("doc_id").collect()]
    by_conditions = [tuple(r)[2:] for r in templates.apply(rows, many[:150] + many[298:]).orderBy("doc_id").collect()]
    assert by_table == by_conditions and by_table[0] == ("Proveedor 3", "3-1", 55, None) and by_table[1] == (None,) * 4 and by_table[3][0] == "Proveedor 298"
    templates.save(spark, many, str(tmp_path / "t"))
    assert templates.load(spark, str(tmp_path / "t")) == many and templates.load(spark, str(tmp_path / "none")) == []
    assert templates.apply(rows, []).where("template is not null").count() == 0


def test_job_tables(spark):
    jobs.create_tables(spark)
    jobs.create_tables(spark)
    assert spark.table("jobs").columns[:2] == ["id", "status"] and "missing_fields" in spark.table("job_records").columns
    given = spark.createDataFrame([("a", 2, {"files": "x"}), ("b", 1, None)], "id string, total_files int, metadata map<string,string>")
    first = jobs.created(given, F.lit("2024-01-01T00:00:00"))
    change = first.where("id = 'a'").select("id", F.lit("done").alias("status"), *[F.lit(None).cast(first.schema[c].dataType).alias(c) for c in first.columns[2:-1]], F.lit(1).cast("bigint").alias("version"))
    after = {r["id"]: r for r in jobs.decoded(jobs.state(first.unionByName(change))).collect()}
    assert (after["a"]["status"], after["a"]["total_files"], after["a"]["metadata"]) == ("done", 2, {"files": "x"}) and after["b"]["metadata"] == {}
    assert jobs.get(first, "b").count() == 1


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"input_dir": "a", "output_dir": "b", "unknown": 1}))
    with pytest.warns(UserWarning, match="unknown"):
        found = settings.load(str(tmp_path / "s.json"), {"CAPTURADOR_INPUT_DIR": "env", "CAPTURADOR_OUTPUT_DIR": "", "REDIS_URL": "redis://x", "TESSERACT_CMD": "t", "TESSDATA_PREFIX": "p"})
    assert (found.input_dir, found.output_dir, found.quarantine_dir, found.ignored) == ("env", "b", "quarantine", ["unknown"])
    assert (found.redis_url, found.tesseract_cmd, found.tessdata_prefix) == ("redis://x", "t", "p")
    assert settings.load(None, {"CAPTURADOR_INPUT_DIR": "old", "LEDGERLENS_INPUT_DIR": "new"}).input_dir == "new"
    with pytest.raises(ValueError):
        settings.Settings(reds=[[[200, 0, 0], [10, 255, 255]]])
    assert settings.load(None, {}) == settings.Settings()
    with pytest.raises(ValueError):
        settings.Settings(columns=["other"])


def test_merged_readers_keep_lines_of_both(spark):
    a = spark.createDataFrame([(1, "nada", 0.5, ["a1", "a2"])], "doc_id int, text string, score double, lines array<string>")
    b = spark.createDataFrame([(1, "Total 5.000", 1.0, ["b1"])], "doc_id int, text string, score double, lines array<string>")
    merged = records.merge_readers(a, b, "doc_id").first()
    assert (merged["text"], merged["engine"], merged["lines"]) == ("Total 5.000\nnada", "dual_tess_priority", ["a1", "a2", "b1"])
