"""Supplier templates: the first whose keyword a text holds gives its supplier, tax id and reading rules."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates
from ledgerlens.operators import template_index
from ledgerlens.operators.template_index import java_pattern

#: Templates whose keywords are looked for by conditions in the plan; those of more are matched as a table.
MOST = 200


@dataclass
class Template:
    name: str
    keywords: list[str]
    rut: str = "EXTRANJERO"
    rules: dict[str, str] = field(default_factory=dict)

    def pattern(self, rule: str) -> str | None:
        """What a rule looks for; none if it isn't usable, which `problems` tells."""
        written = self.rules.get(rule, "")
        found = java_pattern(written.removeprefix("regex:").strip())[0] if written.startswith("regex:") else None
        return found and "(?i)" + found

    def problems(self) -> dict[str, str]:
        """Why rules aren't used, by field."""
        written = {k: v.removeprefix("regex:").strip() for k, v in self.rules.items() if v.startswith("regex:")}
        return {k: why for k, v in written.items() if (why := java_pattern(v)[1])}


def _places(templates: list[Template], t: Column) -> Column:
    """The place of the first template of which the text holds a keyword."""
    lower = F.lower(t)
    fits = [reduce(or_, [lower.contains(k.lower()) for k in x.keywords], F.lit(False)) for x in templates]
    return F.coalesce(*[F.when(f, i) for i, f in enumerate(fits)], F.lit(None).cast("int"))


def as_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    rows = [(i, x.name, x.keywords, x.rut, x.rules) for i, x in enumerate(templates)]
    return spark.createDataFrame(rows, "place int, name string, keywords array<string>, rut string, rules map<string,string>")


def apply(docs: DataFrame, templates: list[Template], text: str = "text", this_year: Column | None = None) -> DataFrame:
    """docs with template, template_rut, template_total and template_fecha; null where no template fits."""
    if len(templates) > MOST:
        return template_index.apply(docs, as_table(docs.sparkSession, templates), text, this_year)
    t = F.col(text)
    docs = docs.withColumn("_which", _places(templates, t) if templates else F.lit(None).cast("int"))
    rows = json.dumps([{"name": x.name, "rut": x.rut, "total": x.pattern("total"), "fecha": x.pattern("fecha")} for x in templates])
    table = F.from_json(F.lit(rows), "array<struct<name:string,rut:string,total:string,fecha:string>>")
    docs = docs.withColumn("_template", F.get(table, F.col("_which")))
    # the pattern is the row's own: it is compiled where a template fits, and again only if the next one's differs
    read = lambda rule: F.when(F.col(f"_template.{rule}").isNotNull(), F.nullif(F.call_function("regexp_extract", t, F.col(f"_template.{rule}"), F.lit(1)), F.lit("")))
    total = amounts.money(read("total"))
    return docs.withColumns({
        "template": F.col("_template.name"), "template_rut": F.col("_template.rut"),
        "template_total": F.nullif(total, F.lit(0)), "template_fecha": dates.extract(read("fecha"), this_year),
    }).drop("_which", "_template")


def save(spark: SparkSession, templates: list[Template], path: str) -> None:
    """The templates as a small table, in their order."""
    as_table(spark, templates).coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[Template]:
    """The saved templates, in order; none if there is no table."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [Template(r["name"], list(r["keywords"]), r["rut"], dict(r["rules"])) for r in table.orderBy("place").collect()]


def learn(templates: list[Template], supplier: str, text: str, total: int | None, rut: str | None = None) -> list[Template]:
    """templates with what a corrected record teaches: its supplier, and what stands before its total."""
    mine = next((x for x in templates if x.name.lower() == supplier.lower()), None) or Template(supplier, [supplier], rut or "EXTRANJERO")
    if total:
        number = "|".join(map(re.escape, (f"{total:,}".replace(",", "."), str(total))))
        for line in text.splitlines():
            before = re.match(rf"(.*?)(?:{number})", " ".join(line.split()))
            if before and before[1].strip():
                rule = re.escape(before[1].strip()).replace(r"\$", r"\$?")
                mine = Template(mine.name, mine.keywords, mine.rut, mine.rules | {"total": rf"regex: {rule}\s*([\d\.]+)"})
                break
    return [*(x for x in templates if x.name.lower() != supplier.lower()), mine] if all(x.name.lower() != supplier.lower() for x in templates) else [mine if x.name.lower() == supplier.lower() else x for x in templates]
