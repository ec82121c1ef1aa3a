"""Templates as a table: found by an index of their keywords' rarest grams, learned from corrections by aggregation.

A table of templates has place (their order), name, keywords, rut and rules (by field). A text belongs
to the first template of which it holds a keyword, in any case.

The index has one row for each different keyword: its rarest gram, of `GRAM` bytes (or the whole
keyword, if that is shorter), as a number (grams that share it are only
looked for in vain); how often grams are is counted in a table of fixed size. A
text's grams are joined to it, so only keywords whose rarest gram stands in the text are looked for;
the cost doesn't grow with the number of templates. Only grams that pass a bit filter of the index,
the one thing that all tasks get, go into the join. Null and empty texts belong to none; an empty
keyword is in every other text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, dates
from ledgerlens.functions.binding import let

#: Bytes of a gram at most; bits of places in the table of counts, and of those in the filter at most (128 MiB); grams at a time.
GRAM, COUNTS, MOST_BITS, SOME = 12, 22, 30, 262_144
PRIME = np.uint64(0x100000001B3)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, one after another, and where each text ends."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def _codes(data: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Numbers of the grams of these sizes in bytes, some at a time, with the size and the place of the first."""
    for start in range(0, len(data), SOME):
        part = data[start : start + SOME + GRAM - 1]
        code = np.zeros(len(part), np.uint64)
        for j in range(min(max(sizes, default=0), len(part))):
            code = code[: len(part) - j] * PRIME + part[j:]
            if j + 1 in sizes:
                yield start, j + 1, code[:SOME]


def _rows(ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each of these places, and which grams don't go beyond their text."""
    row = np.searchsorted(ends, at, "right")
    return row, at + size <= ends[row]


def _mixed(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _keyword_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and gram of all keywords' grams, and the keywords' sizes."""
    data, ends = _bytes(words)
    sizes = np.minimum(np.diff(ends, prepend=0), GRAM)
    rows, codes = [np.flatnonzero(sizes == 0)], [np.zeros((sizes == 0).sum(), np.uint64)]
    for start, size, code in _codes(data, np.unique(sizes).tolist()):
        row, whole = _rows(ends, start + np.arange(len(code)), size)
        whole &= sizes[row] == size
        rows.append(row[whole])
        codes.append(code[whole])
    return np.concatenate(rows), np.concatenate(codes), sizes


def index(templates: DataFrame) -> DataFrame:
    """gram, size, keyword and place (of the first template that has it) of each different keyword."""
    words = templates.select("place", F.explode("keywords").alias("keyword")).where("keyword is not null").select("place", F.lower("keyword").alias("keyword"))
    words = words.groupBy("keyword").agg(F.min("place").alias("place")).select("keyword", "place")

    def count(batches):
        for batch in filter(len, batches):
            slot, n = np.unique(_mixed(_keyword_grams(batch.column(0))[1], COUNTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    seen = words.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(2**COUNTS, np.int32)
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    often = templates.sparkSession.sparkContext.broadcast(counts)

    def rarest(batches):
        for batch in filter(len, batches):
            row, code, sizes = _keyword_grams(batch.column(0))
            order = np.lexsort((code, often.value[_mixed(code, COUNTS)], row))
            first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
            yield pa.RecordBatch.from_arrays([pa.array(code[first].view(np.int64)), pa.array(sizes.astype(np.int32)), *batch.columns], names=["gram", "size", *batch.schema.names])

    return words.mapInArrow(rarest, f"gram bigint, size int, keyword string, place {dict(words.dtypes)['place']}")


def _marks(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter that each gram has, and its three bits there."""
    at = _mixed(code, bits)
    other = code * np.uint64(0xC2B2AE3D27D4EB4F)
    mask = np.uint64(1) << (at & 63).astype(np.uint64)
    for shift in (40, 50):
        mask |= np.uint64(1) << (other >> np.uint64(shift) & np.uint64(63))
    return at >> 6, mask.view(np.int64)


def _filter(known: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Words with three bits set for each gram of the index, how many bits tell a place among them, and the grams' sizes."""
    n, sizes = known.agg(F.count("*"), F.collect_set("size")).first()  # GRAM of them and one more, at most
    bits = min(max((32 * n).bit_length(), 6), MOST_BITS)

    def words(batches):
        for batch in filter(len, batches):
            word, mask = _marks(batch.column(0).to_numpy().view(np.uint64), bits)
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(word[order][starts].astype(np.int32)), pa.array(np.bitwise_or.reduceat(mask[order], starts))], names=["word", "said"])

    found = known.select("gram").mapInArrow(words, "word int, said bigint").groupBy("word").agg(F.bit_or("said").alias("said")).toArrow()
    there = np.zeros(2 ** (bits - 6), np.int64)
    there[found["word"].to_numpy()] = found["said"].to_numpy()
    return there, bits, sorted(sizes)


def first_places(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """docs with _place: that of the first template of which the text holds a keyword."""
    known = index(templates)
    there, bits, sizes = _filter(known)
    told = docs.sparkSession.sparkContext.broadcast(there)
    lower = F.lower(F.col(text))
    docs = docs.withColumn("_h", F.xxhash64(lower))  # of texts that share it, each is compared with what was met of all

    def grams(batches):
        for batch in filter(len, batches):
            batch = batch.take(pa.array(np.unique(batch.column(1).dictionary_encode().indices.to_numpy(), return_index=True)[1]))  # copies once
            data, ends = _bytes(batch.column(1))
            found = [(np.arange(len(ends)), np.zeros(len(ends), np.uint64))] if 0 in sizes else []
            for start, size, code in _codes(data, sizes):
                word, mask = _marks(code, bits)
                met = np.flatnonzero(told.value[word] & mask == mask)
                row, whole = _rows(ends, start + met, size)
                found.append((row[whole], code[met[whole]]))
            for row, code in found:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(code.view(np.int64))], names=["_h", "gram"])

    spread = docs.where(F.length(lower) > 0).select("_h", lower.alias("_lower")).mapInArrow(grams, "_h bigint, gram bigint")
    # an index and what is met of it come to much more than their tables' files tell: neither is broadcast
    met = spread.join(known.hint("merge"), "gram").select("_h", "place", "keyword").repartition("_h").groupBy("_h").agg(F.array_sort(F.collect_set(F.struct("place", "keyword"))).alias("_met"))
    joined = docs.join(met.hint("merge"), "_h", "left")
    first = F.get(F.filter("_met", lambda m: lower.contains(m["keyword"])), F.lit(0))["place"]
    return joined.withColumn("_place", first).drop("_h", "_met")


def java_pattern(pattern: str) -> tuple[str | None, str | None]:
    """A rule's pattern in the form that Spark compiles, or why there is none."""
    try:
        groups = re.compile(pattern).groups
    except (re.error, RecursionError, OverflowError) as e:
        return None, f"{type(e).__name__}: {e}"
    if not groups:
        return None, "no group to read"
    out, i, within = [], 0, False
    plain = lambda name: re.sub(r"[^A-Za-z0-9]", lambda m: f"x{ord(m[0]):x}", name)
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            out.append({"\\Z": "\\z"}.get(rest[:2], rest[:2]) if not within else rest[:2])
            i += 2
        elif within:
            within = c != "]" or out[-1] in ("[", "[^")
            out.append("\\" + c if c in "[&" or (c == "]" and within) else c)
            i += 1
        elif c == "[":
            out.append("[^" if rest[1:2] == "^" else "[")
            i += len(out[-1])
            within = True
        elif m := re.match(r"\(\?P<(\w+)>", rest):
            out.append(f"(?<{plain(m[1])}>")
            i += m.end()
        elif m := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(f"\\k<{plain(m[1])}>")
            i += m.end()
        elif re.match(r"\(\?(\(|[aiLmsux-]*[aL])", rest) or rest.startswith("{,"):
            return None, f"not supported: {rest[:3]}"
        else:
            out.append(c)
            i += 1
    return "".join(out), None


def checked(templates: DataFrame) -> DataFrame:
    """templates with patterns: what their rules look for, by field, and problems: why a rule isn't used, by field."""

    @F.pandas_udf("struct<patterns:map<string,string>,problems:map<string,string>>")
    def judge(rules: pd.Series) -> pd.DataFrame:
        good, bad = [], []
        for row in rules:
            found = {k: java_pattern(v.removeprefix("regex:").strip()) for k, v in (() if row is None else row) if isinstance(v, str) and v.startswith("regex:")}
            good.append({k: f"(?i){p}" for k, (p, _) in found.items() if p})
            bad.append({k: why for k, (_, why) in found.items() if why})
        return pd.DataFrame({"patterns": good, "problems": bad})

    entries = F.transform(F.map_entries("rules"), lambda e: F.array(e["key"], e["value"]))
    return templates.withColumn("_judged", judge(F.coalesce(entries, F.array().cast("array<array<string>>")))).select(*templates.columns, "_judged.*")


def apply(docs: DataFrame, templates: DataFrame, text: str = "text", this_year: Column | None = None) -> DataFrame:
    """docs with template, template_rut, template_total and template_fecha; null where no template fits, or its rule isn't usable."""
    known = checked(templates).select(F.col("place").alias("_place"), F.col("name").alias("template"), F.col("rut").alias("template_rut"), "patterns")
    t = F.col(text)
    found = first_places(docs, templates, text).join(known, "_place", "left")
    pattern = lambda rule: F.try_element_at("patterns", F.lit(rule))
    read = lambda rule: F.when(pattern(rule).isNotNull(), F.nullif(F.call_function("regexp_extract", t, pattern(rule), F.lit(1)), F.lit("")))
    return found.withColumns({"template_total": F.nullif(amounts.money(read("total")), F.lit(0)), "template_fecha": dates.extract(read("fecha"), this_year)}).drop("_place", "patterns")


# --- learning ---


def before_total(text: Column, total: Column) -> Column:
    """What stands before the total in the first line that has it and something before it; spaces are single ones."""
    plain, grouped = total.cast("string"), F.translate(F.format_number(total, 0), ",", ".")
    line = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    place = lambda x: F.least(F.nullif(F.instr(x, plain), F.lit(0)), F.nullif(F.instr(x, grouped), F.lit(0)))
    found = F.transform(F.split(text, r"\R"), lambda x: let(line(x), lambda y: F.trim(F.substring(y, F.lit(1), F.coalesce(place(y), F.lit(1)) - 1))))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def common_beginning(a: Column, b: Column) -> Column:
    ends = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda n: F.left(a, n) == F.left(b, n))
    return F.left(a, F.array_max(ends))


def rule(before: Column, whole: Column) -> Column:
    """The rule that reads the number after a beginning of a line, or after the end of one; `$` may be missing."""
    escaped = F.regexp_replace(before, r"([\\.\[\](){}*+?^$|#&~-])", r"\\$1")
    loose = F.replace(F.replace(escaped, F.lit("\\$"), F.lit("\\$?")), F.lit(" "), F.lit("\\s+"))
    return F.concat(F.lit("regex: "), F.when(whole, "(?m)^\\s*").otherwise("(?<!\\w)"), loose, F.lit("\\s*([\\d\\.]+)"))


def learned(corrections: DataFrame) -> DataFrame:
    """name, keywords, rut, rules and support of the templates that corrections (supplier, text, total and rut) teach.

    Corrections of a supplier (in any case) are put together by the last word before their total.
    What all of one such family have before it, from the number backwards to the last whole word, is
    the family's rule; it is told by the least and the largest of the reversed beginnings, and so by a
    partial aggregation. The rule of the family with the most corrections is the supplier's (ties:
    the first family). A supplier without a total that stands in a text has no rule; rut is the least
    one given. Corrections without a supplier teach nothing.
    """
    rows = corrections.where("trim(supplier) <> ''").select(F.lower("supplier").alias("_who"), "supplier", "rut", before_total(F.col("text"), F.when(F.col("total") > 0, F.col("total"))).alias("_before"))
    family = F.regexp_extract(F.lower("_before"), r"(\p{L}+)\P{L}*$", 1)
    back = F.reverse("_before")
    kinds = rows.groupBy("_who", family.alias("_family")).agg(F.count("_before").alias("n"), F.min(back).alias("lo"), F.max(back).alias("hi"), F.min("supplier").alias("name"), F.min("rut").alias("rut"))
    whole = F.col("lo") == F.col("hi")
    shared = F.reverse(common_beginning(F.col("lo"), F.col("hi")))
    cut = F.trim(F.when(whole, shared).when(F.left(shared, F.lit(1)) == " ", shared).otherwise(F.regexp_replace(shared, r"^\S*(\s+|$)", "")))
    told = kinds.withColumn("_said", cut).withColumn("_rule", F.when(F.col("_said") != "", rule(F.col("_said"), whole)))
    best = F.min(F.when(F.col("_rule").isNotNull(), F.struct((-F.col("n")).alias("n"), "_family", F.col("_rule").alias("rule"))))
    found = told.groupBy("_who").agg(F.min("name").alias("name"), F.min("rut").alias("rut"), best.alias("best"))
    none = F.create_map().cast("map<string,string>")
    rules = F.when(F.col("best").isNotNull(), F.create_map(F.lit("total"), F.col("best.rule"))).otherwise(none)
    return found.select("name", F.array("name").alias("keywords"), F.coalesce("rut", F.lit("EXTRANJERO")).alias("rut"), rules.alias("rules"), F.coalesce(-F.col("best.n"), F.lit(0)).alias("support"))


def ordered(templates: DataFrame, by: str = "name") -> DataFrame:
    """templates with a place by a column's order, without one task for all of them."""
    return templates.repartitionByRange(by).sortWithinPartitions(by).withColumn("place", F.monotonically_increasing_id())
