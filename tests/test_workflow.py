"""Job life, keyed tables, template tables, search, sinks and lines: what their queries can't show."""

import datetime as dt
import glob
import json
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boxes, metrics, pixels, search_index, template_index, templates
from ledgerlens.plans import workflow
from ledgerlens.sources import books, files, keyed, shared
from ledgerlens.streaming import lifecycle


def event(job, kind, hour, total=None, archivo=None, estado=None, error=None):
    return (job, kind, dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour), total, archivo, estado, error)


def test_job_life_is_the_same_after_restarts(spark, tmp_path):
    first = [event("a", "created", 0, 2), event("b", "created", 0, 3), event("c", "created", 0, 1), event("a", "file", 1, archivo="x", estado="OK"), event("d", "file", 1, archivo="x", estado="REJECTED")]
    then = [event("a", "file", 1, archivo="x", estado="OK"), event("a", "file", 2, archivo="y", estado="REJECTED"), event("b", "file", 2, archivo="x", estado="QUARANTINE"), event("b", "ended", 3, error="Excel export failed: x"), event("d", "created", 1, 5)]
    last = [event("e", "created", 30, 1), event("c", "file", 0, archivo="late", estado="OK"), (None, "file", dt.datetime(2024, 1, 1), None, "x", "OK", None), ("f", "file", None, None, "x", "OK", None)]

    def run(name, deliveries):
        folder, out = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
        for rows in deliveries:
            spark.createDataFrame(rows, lifecycle.EVENTS).write.mode("append").parquet(folder)
            lifecycle.follow(spark, folder, out, f"{tmp_path}/{name}-checkpoint", "2 hours", 3_600).awaitTermination()
        return {r["job_id"]: (r["status"], r["total_files"], r["processed"], r["failed"], r["error"]) for r in lifecycle.states(spark, out).collect()}

    found = run("parts", [first, then, last])
    assert found == {"a": ("expired", 2, 1, 1, None), "b": ("expired", 3, 1, 0, "Excel export failed: x"), "c": ("queued", 1, 0, 0, None), "d": ("processing", 5, 0, 1, None), "e": ("queued", 1, 0, 0, None)}
    assert run("whole", [first + then, last]) == found


def test_job_state_is_asked_for_by_bucket():
    calls, timers, state = [], set(), {}

    class Value:
        exists = lambda self: bool(state)
        get = lambda self: calls.append("get") or state["now"]
        update = lambda self, row: calls.append("update") or state.update(now=row)
        clear = lambda self: state.clear()

    class Handle:
        getValueState = lambda self, *_: Value()
        registerTimer = timers.add
        deleteTimer = timers.remove

    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    life = lifecycle.Lifecycle(100)
    life.init(Handle())
    said = lambda *events: iter([pd.DataFrame({"event": [json.dumps(e) for e in events]})])
    told = lambda frames: {r.job_id: (r.status, r.processed, r.version) for f in frames for r in f.itertuples()}
    made = [{"job_id": str(j), "kind": "created", "ms": j, "total_files": 20} for j in range(50)]
    sent = [{"job_id": str(j), "kind": "file", "ms": j, "archivo": f"f{i % 20}", "estado": "OK"} for j in range(40) for i in range(30)]
    assert told(life.handleInputRows((7,), said(*made, *sent), None)) == {str(j): ("done", 20, 1) if j < 40 else ("queued", 0, 1) for j in range(50)}
    assert len(calls) <= 4 and timers == {100}
    assert told(life.handleInputRows((7,), said({"job_id": "0", "kind": "ended", "ms": 500, "error": "x"}), None)) == {"0": ("failed", 20, 2)} and timers == {101}
    timers.clear()
    assert told(life.handleExpiredTimer((7,), At(110), At(101))) == {str(j): ("expired", 20, 2) for j in range(1, 10)} and timers == {110}
    timers.clear()
    assert len(told(life.handleExpiredTimer((7,), At(10_000), At(110)))) == 31 and not timers and len(json.loads(state["now"][0])) == 10
    assert told(life.handleInputRows((7,), said({"job_id": "5", "kind": "file", "ms": 900, "archivo": None}), None)) == {"5": ("processing", 0, 1)}


def names(path):
    return {f.split("_bucket=")[1] for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_keyed_table_writes_only_changed_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), "queued", i, None) for i in range(200)], "id string, status string, n int, error string")
    changes = spark.createDataFrame([("7", "done", None, None, 5), ("7", "processing", None, "x", 3), ("900", "new", 1, None, 2), (None, "lost", 1, None, 9)], "id string, status string, n int, error string, version bigint")
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    for path, batches in ((a, (3, 5, 2)), (b, (5, 2, 3, 5))):
        keyed.create(rows, path, ["id"], buckets=8)
        before = names(path)
        for v in batches:
            written = keyed.upsert(spark, path, changes.where(F.col("version") == v))
            assert len(written) <= 1
        assert len(before & names(path)) >= 6
        kept = names(path)
        assert keyed.upsert(spark, path, changes) == [] and names(path) == kept
        assert keyed.upsert(spark, path, spark.createDataFrame([("901", "x", 9)], "id string, status string, version bigint"), insert=False) == []
    found = {r["id"]: tuple(r)[1:] for r in keyed.read(spark, a).collect()}
    assert found["7"] == ("done", 7, "x") and found["900"] == ("new", 1, None) and len(found) == 201
    assert found == {r["id"]: tuple(r)[1:] for r in keyed.read(spark, b).collect()}
    one = keyed.lookup(spark, a, id="7")
    assert [tuple(r) for r in one.collect()] == [("7", "done", 7, "x")] and "PartitionFilters: [isnotnull(_bucket" in one._jdf.queryExecution().toString()


def test_templates_are_found_by_rarest_grams(spark):
    rng = [f"Proveedor {i * 7919 % 100_003:06d}" for i in range(100_000)]
    rows = [(i, n, [n.upper(), "zz" if i == 50_000 else n], "1", {}) for i, n in enumerate(rng)]
    table = spark.createDataFrame(rows, "place int, name string, keywords array<string>, rut string, rules map<string,string>")
    texts = [None, "", "no one", "x ZZ y", f"a {rng[5].lower()} b {rng[3]}", f"{rng[77]}9", rng[99_999][:-1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, texts[4])], "doc_id int, text string").withColumn("place", F.lit(1))
    found = template_index.first_places(docs, table)
    assert {r["doc_id"]: r["_place"] for r in found.collect()} == {0: None, 1: None, 2: None, 3: 50_000, 4: 3, 5: 77, 6: None, 9: 3}
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    every = spark.createDataFrame([(3, "e", [""], "1", {}), (1, "f", ["zz"], "2", {})], table.schema)
    assert {r["doc_id"]: r["_place"] for r in template_index.first_places(docs, every).collect()} == {0: None, 1: None, 2: 3, 3: 1, 4: 3, 5: 3, 6: 3, 9: 3}
    assert template_index.first_places(docs, table.where("place < 0")).where("_place is not null").count() == 0


def test_templates_of_any_size_are_found(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("aáB 1ñ€\U0001f600\0"), n))
    rows = [(int(p), [word(n) for n in rng.integers(1, 18, 3)] + [None]) for p in rng.permutation(60)] + [(77, None), (78, [])]
    texts = [word(n) for n in rng.integers(0, 90, 400)] + [word(300_000), "ÁÁ" + rows[0][1][0].upper()]
    table = spark.createDataFrame(rows, "place int, keywords array<string>").repartition(3)
    docs = spark.createDataFrame(list(enumerate(texts + texts[:100])), "id int, text string").repartition(5)
    known = [(p, k.lower()) for p, words in rows for k in words or [] if k is not None]
    want = {i: min((p for p, k in known if k in t.lower()), default=None) if t else None for i, t in enumerate(texts + texts[:100])}
    assert {r["id"]: r["_place"] for r in template_index.first_places(docs, table).collect()} == want


def test_no_index_is_broadcast(spark):
    plan = workflow.template_index_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2  # with the suppliers, a table as it is, in each of two branches


@pytest.mark.parametrize("pattern, text, said", [
    (r"total (?P<the_total>\d+)", "Total 12", "12"), (r"(?P<a>x)(?P=a) (\d)", "xx 3", "x"), (r"[[&&]+(\d+)\Z", "&[5", "5"), (r"[]x](\d)", "]4", "4"), (r"[^]x](\d)", "y4", "4"), (r"\$\s*([\d\.]+)", "$ 1.2", "1.2"),
])
def test_rules_are_translated(spark, pattern, text, said):
    found, why = template_index.java_pattern(pattern)
    assert why is None and spark.range(1).select(F.regexp_extract(F.lit(text), "(?i)" + found, 1)).first()[0] == said


def test_bad_rules_reject_themselves(spark):
    bad = {"total": "regex: total (?P<x>\\d+", "fecha": "regex: emision:\\s*(\\S+)"}
    kept = [templates.Template("a", ["alfa"], rules=bad), templates.Template("b", ["beta"], rules={"total": "regex: total \\d+"}), templates.Template("c", ["gama"], rules={"total": r"regex: total (?P<x>\d+)"})]
    assert "missing )" in kept[0].problems()["total"] and kept[1].problems() == {"total": "no group to read"} and not kept[2].problems()
    docs = spark.createDataFrame([(1, "alfa total 5 emision: 01/02/2020"), (2, "beta total 5"), (3, "gama total 5")], "doc_id int, text string")
    few = {r["doc_id"]: (r["template"], r["template_total"], str(r["template_fecha"])) for r in templates.apply(docs, kept).collect()}
    assert few == {1: ("a", None, "2020-02-01"), 2: ("b", None, "None"), 3: ("c", 5, "None")}
    more = kept + [templates.Template(f"n{i}", [f"none{i}"]) for i in range(templates.MOST)]
    assert {r["doc_id"]: (r["template"], r["template_total"], str(r["template_fecha"])) for r in templates.apply(docs, more).collect()} == few
    judged = {r["name"]: r["problems"] for r in template_index.checked(templates.as_table(spark, kept)).collect()}
    assert judged["c"] == {} and "missing )" in judged["a"]["total"]


def test_learning_settles_conflicts_by_support(spark):
    rows = [("Acme", "ACME\nDoc 17 Monto final:  $ 1.200\n", 1200, "2-7"), ("ACME", "ACME\nDoc 18 Monto final: $ 3400", 3400, "1-9"), ("Acme", "saldo 77", 77, None), ("Solo", "Total   a pagar $ 5.000 CLP", 5000, None), ("None", "no number", 5, None), (None, "Total 5", 5, None), ("Zero", "Total 0", 0, None), ("Zero", None, None, None)]
    said = spark.createDataFrame(rows, "supplier string, text string, total bigint, rut string")
    found = {r["name"]: (r["keywords"], r["rut"], r["rules"].get("total"), r["support"]) for r in template_index.learned(said).collect()}
    assert found == {
        "ACME": (["ACME"], "1-9", r"regex: (?<!\w)Monto\s+final:\s+\$?\s*([\d\.]+)", 2), "Solo": (["Solo"], "EXTRANJERO", r"regex: (?m)^\s*Total\s+a\s+pagar\s+\$?\s*([\d\.]+)", 1),
        "None": (["None"], "EXTRANJERO", None, 0), "Zero": (["Zero"], "EXTRANJERO", None, 0),
    }
    read = template_index.apply(said.where("supplier is not null"), template_index.ordered(template_index.learned(said)))
    totals = {r["text"]: r["template_total"] for r in read.collect()}
    assert totals[rows[0][1]] == 1200 and totals[rows[1][1]] == 3400


def test_only_attempts_that_commit_leave_files(tmp_path):
    batch = lambda *rows: pa.RecordBatch.from_pydict({"name": [n for n, _ in rows], "content": [c for _, c in rows]})
    there = lambda: {p.name: p.read_bytes() for p in tmp_path.iterdir()}
    writer = books.FilesWriter(str(tmp_path), False)

    def fails():
        yield batch(("a.xlsx", b"half"))
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(fails())
    twice = [writer.write(iter([batch(("a.xlsx", b"whole"))])) for _ in range(2)]
    writer.commit([twice[1], writer.write(iter([])), None])
    assert there() == {"a.xlsx": b"whole"}
    other = books.FilesWriter(str(tmp_path), False)
    other.write(iter([batch(("b.xlsx", b"x"))]))
    other.abort([])
    assert there() == {"a.xlsx": b"whole"}
    new = books.FilesWriter(str(tmp_path), True)
    new.commit([new.write(iter([batch(("c.xlsx", b"y"))]))])
    assert there() == {"c.xlsx": b"y"}


def test_books_are_written_and_read(spark, tmp_path):
    content = files.workbook({"One & two": [["a", "b", "c"], [1, None, dt.date(2024, 2, 29)], ["x <y>", 2.5, "  z"]], "Empty": [["a"]]})
    rows = spark.createDataFrame([("x.xlsx", bytearray(content)), ("y.xlsx", bytearray(content))], "name string, content binary").repartition(2)
    books.write(rows, f"file://{tmp_path}/books")
    found = sorted((r["book"], r["sheet"], r["row"], tuple(r["cells"].items())) for r in books.read(spark, f"{tmp_path}/books").collect())
    sheet = [("One & two", 1, (("a", "1"), ("b", None), ("c", "2024-02-29"))), ("One & two", 2, (("a", "x <y>"), ("b", "2.5"), ("c", "  z")))]
    assert found == [(f"{n}.xlsx", *r) for n in "xy" for r in sheet]
    assert books.read(spark, f"{tmp_path}/none").count() == 0
    books.write(rows.where("name = ''"), f"{tmp_path}/nothing")
    assert books.read(spark, f"{tmp_path}/nothing").count() == 0


def test_streams_tell_their_figures(spark, tmp_path):
    schema = "archivo string, route string, doc_type string, estado string, fecha string, rut string, total bigint, proveedor string, nro_documento bigint"
    spark.createDataFrame([("a.pdf", "image", "cedula", "OK", "x", "x", 1, "x", 1), ("b.JPG", None, None, "QUARANTINE", None, "x", None, "x", 1)], schema).write.parquet(f"{tmp_path}/in")
    figures = metrics.BatchFigures()
    spark.streams.addListener(figures)
    found, _ = metrics.observed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    found.writeStream.queryName("told").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    until = time.time() + 30
    while not figures.seen and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(figures)
    report = metrics.observed_report(figures.seen["told", 0], "in")
    assert report["pct_ok"] == 50.0 and report["por_extension"] == {".pdf": {"ok": 1}, ".jpg": {"quarantine": 1}} and report["por_ruta"] == {"image": {"ok": 1}, "?": {"quarantine": 1}}
    assert report["faltantes_quarantine"] == {"fecha": 1, "total": 1}


def test_search_reads_its_own_postings(spark, tmp_path):
    rows = [(1, "Comercial ÑANDÚ", "aaaa"), (2, None, "aaab"), (3, "", "xaay"), (4, "ab", "baaaa b"), (5, "comer", "cial")]
    path = f"{tmp_path}/index"
    search_index.build(spark.createDataFrame(rows, "id int, name string, note string"), path, "id", ["name", "note"], buckets=8)
    needles = ["ñandú", "aaa", "AAAA", "comercial", "aa b", "none", "aab"]
    found = search_index.search(spark, path, needles)
    wanted = {(n, r[0]) for n in needles for r in rows for c in r[1:] if n.lower() in (c or "").lower()}
    assert {tuple(r) for r in found.collect()} == wanted and ("comercial", 5) not in wanted and ("aa b", 4) in wanted
    plan = search_index.search(spark, path, ["comercial"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "PartitionFilters: [bucket" in plan
    assert search_index.search(spark, path, ["zzz"]).count() == 0
    with pytest.raises(ValueError):
        search_index.search(spark, path, ["ab"])


def test_lines_of_odd_boxes(spark):
    words = [("a", "x", 50, 12, 9, 10, 0.5), ("a", "y", 10, 10, 9, 10, -1.0), ("a", "z", 90, 14, 9, 10, None), ("a", " ", 1, 10, 9, 10, 1.0), ("a", None, 1, 10, 9, 10, 1.0), ("a", "low", 1, 40, 9, 10, 0.9), ("a", "low", 1, 40, 9, 10, 0.9), (None, "alone", 0, 0, 1, 0, 0.2), ("a", "nowhere", None, 10, 9, 10, 1.0)]
    tokens = spark.createDataFrame(words, "doc_id string, text string, left int, top int, width int, height int, score double")
    found = boxes.lines(tokens.repartition(3))
    assert sorted(((r["doc_id"] or "", r["line"], r["text"], round(r["score"], 6)) for r in found.collect())) == [("", 1, "alone", 0.2), ("a", 1, "y x z", 0.5), ("a", 2, "low low", 0.9)]
    assert {r["doc_id"]: r["text"] for r in boxes.full_text(found).collect()} == {"a": "y x z\nlow low", None: "alone"}
    assert boxes.lines(tokens.where("left = 7")).count() == 0


def test_red_boxes(spark):
    keep = lambda rows: shared.stored(rows, "boxes")
    red = (0, 204, 200)  # of a page of 600 x 400 with a box of 300 x 150 in its middle
    rows = [(1, y, 0, 599, 0, 0, 255) for y in range(400)] + [(1, y, 150, 449, *red) for y in range(120, 270)]
    rows += [(2, y, 0, 599, 0, 0, 255) for y in range(300)]
    rows += [(3, y, 100 + 2 * y, 100 + 2 * y + 119, *red) for y in range(100)]  # a slanted one: its rows hang together, each with other ends
    rows += [(4, y, 0, 199, *red) for y in range(100)] + [(4, y, 300, 599, *red) for y in range(200, 300)]
    runs = spark.createDataFrame(rows + rows[:50], "doc_id int, y int, x0 int, x1 int, hue int, saturation int, value int")
    sizes = spark.createDataFrame([(i, 600, 400) for i in (1, 2, 3, 4)], "doc_id int, width int, height int")
    found = {r["doc_id"]: tuple(r)[1:] for r in boxes.red_boxes(runs.repartition(3), sizes, keep).collect()}
    assert found == {1: (138, 108, 324, 174), 3: (88, 0, 342, 112), 4: (288, 188, 312, 124)}


def by_flooding(image, least_area, aspect):
    """The box of the pixels that hang together, also at corners."""
    found, left = [], set(zip(*np.nonzero(image)))
    while left:
        some, todo = [], [left.pop()]
        while todo:
            some.append(todo.pop())
            near = {(some[-1][0] + i, some[-1][1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        rows = {}
        for y, x in some:
            rows.setdefault(y, []).append(x)
        spans = [max(rows[y]) - min(rows[y]) for y in sorted(rows)]
        x, w = min(map(min, rows.values())), max(map(max, rows.values())) - min(map(min, rows.values())) + 1
        area = sum(spans) - (spans[0] + spans[-1]) / 2
        if area >= least_area and aspect[0] <= w / len(spans) <= aspect[1]:
            found.append((-area, min(rows), x, w, len(spans)))
    return tuple(min(found)[i] for i in (2, 1, 3, 4)) if found else None


def test_red_boxes_of_any_shape(spark):
    keep = lambda rows: shared.stored(rows, "boxes")
    rng, runs, want, high, wide = np.random.default_rng(7), [], {}, 40, 60
    for page in range(120):
        image = np.zeros((high, wide), bool)
        for _ in range(rng.integers(1, 9)):
            y, x = rng.integers(0, high), rng.integers(0, wide)
            image[y : y + rng.integers(1, 12), x : x + rng.integers(1, 25)] = True
        image &= rng.random(image.shape) < 0.9
        runs += [(page, int(y), int(x), int(x)) for y, x in zip(*np.nonzero(image))]
        grown = np.zeros_like(image)
        for y, x in zip(*np.nonzero(image)):
            grown[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2] = True
        want[page] = by_flooding(grown, 20, (0.5, 3.5))
    dots = [(500, 8 * i, 8 * j, 8 * j) for i in range(135) for j in range(130)]  # more rectangles than a task works on by itself
    runs += dots + [(500, y, 2_000, 2_199) for y in range(300, 400)] + [(1, 50, 0, 9), (2, 5, 61, 70)]  # two are outside their pages
    want[500] = (1_999, 299, 202, 102)
    assert len(dots) > boxes.MOST
    rows = spark.createDataFrame([(*runs[i], 5, 200, 200) for i in rng.permutation(len(runs))], "doc_id int, y int, x0 int, x1 int, hue int, saturation int, value int")
    sizes = spark.createDataFrame([(p, *((wide, high) if p < 500 else (2_500, 1_200))) for p in want], "doc_id int, width int, height int")
    found = boxes.red_boxes(rows.repartition(5), sizes, keep, least_area=20, aspect=(0.5, 3.5), padding=0, reach=1)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == {p: box for p, box in want.items() if box}


def test_runs_become_rectangles_where_they_are(spark):
    runs = spark.range(0, 40_000, 1, 4).selectExpr("cast(id div 200 as int) as doc_id", "cast(id % 200 as int) as y", "5 as x0", "90 as x1")
    found = boxes.rectangles(runs)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() <= 210 and found.selectExpr("sum(y1 - y0 + 1)").first()[0] == 40_000


def test_rectangles_of_long_pages_go_through():
    batch = lambda keys: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(range(len(keys)), pa.int64())] * 6], names=["page", "x0", "x1", "y0", "y1", "width", "height"])
    n = boxes.MOST
    keys = [1] * 5 + [2] * (n + 1) + [None] * 3 + [3] * n + [4] * (2 * n) + [5] * 2
    for size in (n // 3, 2 * n, len(keys)):
        out = [b for b in boxes._pages((batch(keys[i : i + size]) for i in range(0, len(keys), size)), 10**9, (1, 2))]
        through = [k for b in out for k, x in zip(b.column(0).to_pylist(), b.column(7).to_pylist()) if x is None]
        assert through == [2] * (n + 1) + [4] * (2 * n)


def test_skew_of_odd_pages(spark):
    rows = [("flat", y, x, x + 9) for y in (10, 50, 90) for x in range(0, 600, 30)]
    rows += [("steep", 100 + round(x * np.tan(np.radians(7.5))) + y, x, x + 3) for y in (0, 40, 80) for x in range(0, 600, 25)]
    rows += [("little", 0, 0, 5), (None, 5, 0, 200)]
    found = pixels.skew(spark.createDataFrame([(p, int(y), x0, x1) for p, y, x0, x1 in rows], "doc_id string, y int, x0 int, x1 int").repartition(3))
    got = {r["doc_id"]: r["angle"] for r in found.collect()}
    assert got["flat"] == 0.0 and got["steep"] == 7.5 and got["little"] == 0.0 and None in got
    assert pixels.skew(spark.createDataFrame([], "doc_id string, y int, x0 int, x1 int")).count() == 0


def test_skew_counts_votes_without_a_row_for_each(spark):
    rng = np.random.default_rng(4)
    drawn = {None: 90, "few": 3, "wide": 40, **{f"p{i}": 60 for i in range(50)}, "long": 40_000}  # the last one goes on over several blocks
    runs = [(p, int(y) * (10_000 if p == "wide" else 1), int(x), int(x + w)) for p, n in drawn.items() for y, x, w in zip(rng.integers(0, 400, n), rng.integers(0, 300, n), rng.integers(0, 9, n))]
    odd = [("p1", None, 0, 5), ("p1", 3, None, 5), ("empty", None, 0, None), ("few", None, 0, 200)]
    want = {"empty": 0.0}
    for p in drawn:
        y, x0, x1 = (np.array(c, float) for c in list(zip(*[r for r in runs if r[0] == p]))[1:])
        ink = (x1 - x0 + 1).sum() + (201 if p == "few" else 0)
        sharp = {}
        for i in range(-20, 21):
            offset = np.floor((y * np.cos(np.radians(i / 2)) - (x0 + x1) / 2 * np.sin(np.radians(i / 2))) / 2)
            sharp[i] = (np.bincount(np.unique(offset, return_inverse=True)[1], x1 - x0 + 1) ** 2).sum()
        want[p] = min(sharp, key=lambda i: (-sharp[i], abs(i), i)) / 2 if ink >= 100 else 0.0
    mixed = [(runs + odd)[i] for i in rng.permutation(len(runs) + len(odd))]
    found = pixels.skew(spark.createDataFrame(mixed, "doc_id string, y int, x0 int, x1 int"))
    assert {r["doc_id"]: r["angle"] for r in found.collect()} == want
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_thresholds_are_the_same_however_tiles_are_cut(spark):
    page = np.random.default_rng(2).integers(0, 256, (40, 300)).astype(np.uint8)
    reach = 4
    want = np.zeros_like(page)
    for y in range(40):
        for x in range(300):
            around = page[max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1].astype(int)
            want[y, x] = 255 * (int(page[y, x]) * around.size > around.sum() - 10 * around.size)
    tile = lambda doc, y0, y1, x0, x1: (doc, x0, y0, x1 - x0, y1 - y0, page[y0:y1, x0:x1].tobytes())
    cuts = {"whole": [(0, 40, 0, 300)], "tiny": [(y, y + 10, x, x + 3) for y in range(0, 40, 10) for x in range(0, 300, 3)], "uneven": [(0, 1, 0, 300), (1, 40, 0, 257), (1, 40, 257, 300)]}
    rows = [tile(doc, *c) for doc, parts in cuts.items() for c in parts] + [("none", 0, 0, 2, 2, None), ("short", 0, 0, 2, 2, b"x")]
    tiles = spark.createDataFrame(rows, "doc_id string, x0 bigint, y0 bigint, width bigint, height bigint, pixels binary").repartition(3)
    found = pixels.local_threshold(tiles, window=9).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] in cuts:
            assert bytes(r["light"]) == want[r["y0"] : r["y0"] + r["height"], r["x0"] : r["x0"] + r["width"]].tobytes()
        else:
            assert r["light"] is None


def test_thresholds_of_large_and_scattered_pages(spark):
    page, reach = np.random.default_rng(3).integers(0, 256, (700, 4_500)).astype(np.uint8), 4
    sums = lambda a: np.pad(a, ((reach + 1, reach), (reach + 1, reach))).cumsum(axis=0).cumsum(axis=1)
    around = lambda t, n=2 * reach + 1: t[n:, n:] - t[:-n, n:] - t[n:, :-n] + t[:-n, :-n]
    n = around(sums(np.ones(page.shape, int)))
    want = np.where(page * n > around(sums(page.astype(int))) - 10 * n, 255, 0).astype(np.uint8)
    down, across = [0, 100, 128, 130, 500, 700], [0, 2_047, 2_050, 4_500]
    cuts = [(y0, y1, x0, x1) for y0, y1 in zip(down, down[1:]) for x0, x1 in zip(across, across[1:])]
    rows = [("a", x0, y0, x1 - x0, y1 - y0, page[y0:y1, x0:x1].tobytes()) for y0, y1, x0, x1 in cuts]
    rows += [("a", 10**9, 690, 1, 1, b"z"), ("b", -300, -700, 2, 700, page[:, :2].tobytes()), (None, 0, 0, 1, 1, b"z"), ("b", None, 0, 1, 1, b"z")]
    tiles = spark.createDataFrame(rows, "doc_id string, x0 long, y0 long, width long, height long, pixels binary").repartition(4)
    found = {tuple(r)[:4]: r["light"] for r in pixels.local_threshold(tiles, window=9).select("doc_id", "x0", "y0", "width", "light").collect()}
    assert len(found) == len(rows) and found["a", 10**9, 690, 1] == b"\xff" and found[None, 0, 0, 1] is None and found["b", None, 0, 1] is None
    for y0, y1, x0, x1 in cuts:
        assert bytes(found["a", x0, y0, x1 - x0]) == want[y0:y1, x0:x1].tobytes()
    edge = around(sums(np.ones((700, 2), int)))
    assert bytes(found["b", -300, -700, 2]) == np.where(page[:, :2] * edge > around(sums(page[:, :2].astype(int))) - 10 * edge, 255, 0).astype(np.uint8).tobytes()


def test_no_tile_is_broadcast(spark):
    found = workflow.local_thresholds(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
