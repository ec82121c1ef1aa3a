"""Figures about a batch of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ledgerlens.operators.records import TAX_DOCUMENTS, key_flags, preview
from ledgerlens.sources.files import SUFFIXES


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("estado").agg(F.count("*").alias("n"))


def status_sums(records: DataFrame) -> DataFrame:
    """Documents and pesos by state, and of all (estado null)."""
    return records.rollup("estado").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def missing_frequency(records: DataFrame) -> DataFrame:
    """How often each required field lacks among quarantined records."""
    return records.where("estado = 'QUARANTINE'").select(F.explode("missing").alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def by_type(records: DataFrame) -> DataFrame:
    states = {s: F.count_if(F.col("estado") == s).alias(s.lower()) for s in ("OK", "QUARANTINE", "REJECTED")}
    return records.groupBy(F.coalesce("doc_type", F.lit("?")).alias("doc_type")).agg(*states.values(), F.count("*").alias("n"), F.avg("completeness").alias("completeness"))


def by_extension(files: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("archivo", r"(\.[^./]+)$", 1))
    return files.groupBy(F.coalesce(F.nullif(ending, F.lit("")), F.lit("(sin ext)")).alias("extension")).agg(F.count("*").alias("n"))


def readiness(records: DataFrame) -> DataFrame:
    """Shares of OK and usable records in percent, and what they say: go, watch or stop."""
    row = records.agg(F.count("*").alias("n"), F.count_if(F.col("estado") == "OK").alias("ok"), F.count_if(F.col("estado").isin("OK", "QUARANTINE")).alias("usable"))
    share = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.round(100.0 * F.col(c) / F.col("n"), 2))
    row = row.select("n", share("ok").alias("pct_ok"), share("usable").alias("pct_usable"))
    return row.withColumn("verdict", F.when(F.col("pct_ok") >= 95, "go").when(F.col("pct_ok") >= 90, "watch").otherwise("stop"))


def by_name(records: DataFrame) -> DataFrame:
    """How many records are cards, or of files whose names say what they are."""
    name = F.lower("archivo")
    kind = F.when(F.col("kind") == "card", "cedula").when(name.contains("factura"), "factura").when(name.contains("boleta"), "boleta").otherwise("otro")
    return records.groupBy(kind.alias("tipo")).agg(F.count("*").alias("n"))


def by_route(records: DataFrame) -> DataFrame:
    """Records of each route by state."""
    states = {s: F.count_if(F.col("estado") == s).alias(s.lower()) for s in ("OK", "QUARANTINE", "REJECTED")}
    return records.groupBy(F.coalesce("route", F.lit("?")).alias("ruta")).agg(*states.values())


def ranked(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts as reports list them: the largest first, ties by key."""
    return counts.orderBy(F.desc(n), key)


# Errors that a level of readiness allows, and the exit codes of shares of OK records.
LEVELS, EXIT_CODES = [(2, "listo"), (5, "fragil"), (8, "expuesto")], [(95, 0), (80, 1)]


def diagnosis(records: DataFrame) -> DataFrame:
    """errors (records not OK), level of readiness, and exit code."""
    row = records.agg(F.count_if(F.col("estado") != "OK").alias("errors"), F.count("*").alias("n"), F.count_if(F.col("estado") == "OK").alias("ok"))
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.round(100.0 * F.col("ok") / F.col("n"), 2))
    level, code = F.lit("reestructurar"), F.lit(2)
    for most, name in reversed(LEVELS):
        level = F.when(F.col("errors") <= most, name).otherwise(level)
    for least, number in reversed(EXIT_CODES):
        code = F.when(share >= least, number).otherwise(code)
    return row.select("errors", level.alias("level"), code.alias("exit_code"))


def file_sizes(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def progress(done: Column, total: Column) -> Column:
    """Percent of files done, 95 at most until a job ends."""
    return F.least(F.lit(95.0), 100.0 * done / F.greatest(total, F.lit(1)))


def detail(records: DataFrame) -> DataFrame:
    """What a report says of each document."""
    ending = F.lower(F.regexp_extract("archivo", r"(\.[^./]+)$", 1))
    plain = ["estado", "doc_type", "fecha", "rut", "total", "proveedor", "nro_documento"]
    return records.select("archivo", ending.alias("ext"), F.coalesce("route", F.lit("?")).alias("ruta"), *plain, F.col("motivo_revision").alias("motivo"), "ruta_extraccion", preview(F.col("raw_text")).alias("raw_text_preview"))


def report(records: DataFrame, folder: str) -> DataFrame:
    """A row with the figures of a batch: totals, and maps of what lacks and of records by route, type and extension."""
    flags = key_flags("fecha", "rut", "total", "proveedor", "nro_documento")
    quarantined = F.col("estado") == "QUARANTINE"
    ending = F.coalesce(F.nullif(F.lower(F.regexp_extract("archivo", r"(\.[^./]+)$", 1)), F.lit("")), F.lit("(sin ext)"))
    sides = {"por_ruta": F.coalesce("route", F.lit("?")), "por_doc_type": F.coalesce("doc_type", F.lit("?")), "por_extension": ending}
    # one pass: counts by side, value and state, of which the figures are sums
    side = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), v.alias("value")) for k, v in sides.items()])).alias("s")
    counted = records.select(side, F.lower("estado").alias("estado")).groupBy("s.side", "s.value", "estado").agg(F.count("*").alias("n"))
    by_value = counted.groupBy("side", "value").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("estado", "n")))).alias("states"))
    by_side = by_value.groupBy("side").agg(F.map_from_entries(F.collect_list(F.struct("value", "states"))).alias("m"))
    maps = by_side.groupBy().agg(*[F.max_by("m", F.when(F.col("side") == k, 1)).alias(k) for k in sides])
    lacks = F.create_map(*[x for name, there in flags.items() for x in (F.lit(name.removeprefix("tiene_")), F.count_if(quarantined & ~there))])
    n = {s: F.count_if(F.col("estado") == s).alias(s.lower()) for s in ("OK", "QUARANTINE", "REJECTED")}
    totals = records.agg(F.count("*").alias("total"), *n.values(), F.map_filter(lacks, lambda k, v: v > 0).alias("faltantes_quarantine"))
    share = lambda c: F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * c / F.col("total"), 2))
    totals = totals.withColumns({"input_dir": F.lit(folder), "pct_ok": share(F.col("ok")), "pct_usable": share(F.col("ok") + F.col("quarantine"))})
    return totals.join(maps, F.lit(True), "left")  # one row each


def best_reading(readings: DataFrame, key: str = "doc_id", score: str = "score", order: str = "mode") -> DataFrame:
    """The reading of each document with the largest score; ties to the first mode."""
    rest = [c for c in readings.columns if c not in (key, score, order)]
    best = readings.groupBy(key).agg(F.max(F.struct(F.col(score), (-F.col(order)).alias("_o"), *rest)).alias("_b"))
    return best.select(key, F.col(f"_b.{score}").alias(score), (-F.col("_b._o")).alias(order), *[F.col(f"_b.{c}").alias(c) for c in rest])


def confident(lines: str = "lines", least: float = 0.3) -> dict:
    """Columns kept_text and kept_score of array<struct<text, score>>: the lines read with confidence, and their mean."""
    kept = F.filter(lines, lambda x: x["score"] >= least)
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["score"]) / F.size(kept)).otherwise(0.0)
    return {"kept_text": F.array_join(F.transform(kept, lambda x: x["text"]), "\n"), "kept_score": mean}


# --- figures observed while records are written ---

STATES = ("OK", "QUARANTINE", "REJECTED")
#: Values that reports tell apart; what is none of them counts as `other`.
SIDES = {
    "por_ruta": ["image", "pdf_image", "pdf_native", "unknown", "?"],
    "por_doc_type": [*TAX_DOCUMENTS, "cedula", "desconocido", "?"],
    "por_extension": [*(f".{s}" for s in SUFFIXES), "(sin ext)"],
}


def observed(records: DataFrame, more: dict[str, list[str]] | None = None) -> tuple[DataFrame, Observation | None]:
    """records, and the figures of `report`, which are there once records were written; more: further values of a side.

    Of a stream, each batch's figures go to a listener, as `BatchFigures` is one.
    """
    domain = {k: [*v, *(x for x in (more or {}).get(k, []) if x not in v)] for k, v in SIDES.items()}
    ending = F.coalesce(F.nullif(F.lower(F.regexp_extract("archivo", r"(\.[^./]+)$", 1)), F.lit("")), F.lit("(sin ext)"))
    sides = {"por_ruta": F.coalesce("route", F.lit("?")), "por_doc_type": F.coalesce("doc_type", F.lit("?")), "por_extension": ending}
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("estado") == s).alias(s.lower()) for s in STATES]]
    for name, there in key_flags("fecha", "rut", "total", "proveedor", "nro_documento").items():
        counts.append(F.count_if((F.col("estado") == "QUARANTINE") & ~there).alias(f"lacks {name.removeprefix('tiene_')}"))
    for side, values in domain.items():
        for state in STATES:
            mine = F.col("estado") == state
            counts += [F.count_if(mine & (sides[side] == v)).alias(f"{side} {state} {v}") for v in values]
            counts.append(F.count_if(mine & ~sides[side].isin(values)).alias(f"{side} {state} other"))
    if records.isStreaming:
        return records.observe("figures", *counts), None
    seen = Observation()
    return records.observe(seen, *counts), seen


def observed_report(figures: dict[str, int], folder: str) -> dict:
    """The row of `report` from the figures of an observation; it waits for none, as a write that ended has told them."""
    total = figures.get("total", 0)
    share = lambda n: round(100.0 * n / total, 2) if total else 0.0
    n = {s.lower(): figures.get(s.lower(), 0) for s in STATES}
    maps: dict[str, dict[str, dict[str, int]]] = {side: {} for side in SIDES}
    for key, count in figures.items():
        side, _, rest = key.partition(" ")
        if side in maps and count:
            state, _, value = rest.partition(" ")
            maps[side].setdefault(value, {})[state.lower()] = count
    lacks = {k.removeprefix("lacks "): v for k, v in figures.items() if k.startswith("lacks ") and v}
    return {"total": total, **n, "faltantes_quarantine": lacks, "input_dir": folder, "pct_ok": share(n["ok"]), "pct_usable": share(n["ok"] + n["quarantine"]), **maps}


REPORT = "total bigint, ok bigint, quarantine bigint, rejected bigint, faltantes_quarantine map<string,bigint>, input_dir string, pct_ok double, pct_usable double, por_ruta map<string,map<string,bigint>>, por_doc_type map<string,map<string,bigint>>, por_extension map<string,map<string,bigint>>"


class BatchFigures(StreamingQueryListener):
    """The observed figures of each batch of the session's streams, by stream name and batch number."""

    def __init__(self):
        self.seen: dict[tuple[str, int], dict] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            self.seen[event.progress.name, event.progress.batchId] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
