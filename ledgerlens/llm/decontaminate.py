"""Benchmark decontamination: a broadcast hash set of normalised benchmark windows.

Words are the runs of letters, digits and non-ASCII characters, A-Z lower-cased. A benchmark item
gives its windows of `n` consecutive words; an item of fewer words, but not none, is one window.
Each task scans the word windows of its documents against the set, verifies each hit word by word,
and marks the words inside it. A document is contaminated if it has a hit and at least one word
in `1 / share` is hit.

The set is broadcast only up to `block_words` benchmark words. The windows of a larger benchmark stay
a table: what is broadcast is a bit filter of their hashes, 128 MiB at most, made on the executors.
One scan of the documents yields the places that pass the filter, with their words, and these are
joined to the table, by hash and word by word. Windows that very many documents hold are dealt to
several tasks. The result is that of the broadcast set.

Null texts have no words; null item ids count for hits, not as items; copies of an item are one item
if they share the id. Rows are judged one by one, also those that repeat an id. Texts are read in
windows of about a megabyte. Result columns take the place of columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import HOT_KEYS, HOT_ROWS, cut, ddl, map_texts, positional, quoted, renamed, with_text, without

N, SHARE, BLOCK_WORDS = 13, 20, 2_000_000
#: The filter of a large benchmark has eight bits a window, as a power of two from 2**22 to 2**30, in blocks of 2**16.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 22, 30, 16

RESULTS = ["n_words", "spans", "item_ids", "n_hit", "contaminated"]
FOUND = "n_words bigint, spans array<struct<first:int,last:int>>, item_ids array<string>"


@dataclass
class WindowSet:
    """Windows of items by their size: sorted hashes with the item and the place in `words` of each, and marks of the hashes."""

    entries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words: bytes
    ids: list[str | None]
    marks: np.ndarray


def _marks(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def window_set(items: list[tuple[object, str]], n: int = N) -> WindowSet:
    ids = list(dict.fromkeys(None if i is None else str(i) for i, _ in items))
    number = {x: i for i, x in enumerate(ids)}
    spelled, length, parts = [], 0, {}
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        low, starts, ends, _ = _text.words(data, np.array([0, len(data)]))
        if not len(starts):
            continue
        size = min(n, len(starts))
        last = length + np.cumsum(ends - starts + 1) - 1  # where each word ends in `words`
        first = last - (ends - starts)
        h = _text.gram_hash(_text.word_hash(low, starts, ends), size)
        parts.setdefault(size, []).append((h, np.full(len(h), number[None if item_id is None else str(item_id)]), first[: len(h)], last[size - 1 :]))
        spelled += [low[a:b].tobytes() for a, b in zip(starts, ends)]
        length = int(last[-1]) + 1
    marks = np.zeros(1 << 22, bool)
    entries = {}
    for size, some in parts.items():
        h, item, first, last = (np.concatenate(x) for x in zip(*some))
        order = np.lexsort((item, h))
        entries[size] = tuple(x[order] for x in (h, item, first, last))
        marks[_marks(h)] = True
    return WindowSet(entries, b" ".join(spelled), ids, np.packbits(marks))


def _scan(column: pa.Array, windows: WindowSet, marks: np.ndarray, n: int) -> tuple[np.ndarray, list[list[dict]], list[list[str]]]:
    counts = np.zeros(len(column), np.int64)
    hits: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    for lo, _, data, offsets, again in _text.windows(column, _text.ALNUM, n - 1):
        low, starts, ends, first = _text.words(data, offsets)
        before = int(counts[lo]) - again  # words of the row before this window of it
        counts[lo : lo + len(offsets) - 1] += np.diff(first) - again
        if not len(starts):
            continue
        h = _text.word_hash(low, starts, ends)
        for size, (known, item, begin, end) in windows.entries.items():
            grams = _text.gram_hash(h, size)
            near = np.flatnonzero(marks[_marks(grams)] & _text.grams_within_rows(first, size))
            left, right = np.searchsorted(known, grams[near]), np.searchsorted(known, grams[near], "right")
            for at, a, b in zip(near[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist()):
                said = b" ".join(low[x:y].tobytes() for x, y in zip(starts[at : at + size], ends[at : at + size]))
                same = [k for k in range(a, b) if windows.words[begin[k] : end[k]] == said]
                if same:
                    row = int(np.searchsorted(first, at, "right")) - 1
                    place = at - int(first[row]) + (before if row == 0 else 0)
                    hits.setdefault(lo + row, []).append((place, place + size - 1))
                    items.setdefault(lo + row, set()).update(windows.ids[i] for i in {int(item[k]) for k in same} if windows.ids[i] is not None)
    return counts, [_joined(hits.get(i, [])) for i in range(len(column))], [sorted(items.get(i, ())) for i in range(len(column))]


def _joined(places: list[tuple[int, int]]) -> list[dict]:
    """Overlapping and touching places (first, last) joined to spans, in order."""
    spans: list[dict] = []
    for a, b in sorted(places):
        if spans and a <= spans[-1]["last"] + 1:
            spans[-1]["last"] = max(b, spans[-1]["last"])
        else:
            spans.append({"first": a, "last": b})
    return spans


def _scan_with(docs: DataFrame, text: str, windows: WindowSet, keep: list[str], n: int) -> DataFrame:
    docs, kept = with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast((windows.entries, windows.words, windows.ids, windows.marks))

    def run(batches):
        windows = WindowSet(*shared.value)
        marks = np.unpackbits(windows.marks).view(bool)
        for batch in batches:
            counts, spans, items = _scan(batch.column(len(keep)), windows, marks, n)
            found = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names=[*keep, "n_words", "spans", "item_ids"])

    return map_texts(docs, run, kept + FOUND)


KEY = ["gram", "said"]


def _window_table(items: DataFrame, n: int) -> DataFrame:
    """item_id, size, gram (the hash) and said (the words) of each window of the items (item_id, text)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for _, _, data, offsets in _text.pieces(batch.column(1).slice(i, 1)):
                    low, starts, ends, _ = _text.words(data, offsets)
                    size = min(n, len(starts))
                    if size:
                        grams = _text.gram_hash(_text.word_hash(low, starts, ends), size)
                        spelled = [low[a:b].tobytes() for a, b in zip(starts, ends)]
                        said = [b" ".join(spelled[j : j + size]) for j in range(len(grams))]
                        ids = batch.column(0).take(pa.array(np.full(len(grams), i)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.view(np.int64)), pa.array(said, pa.binary())], names=["item_id", "size", *KEY])

    return map_texts(items, run, "item_id string, size int, gram bigint, said binary")


def _filter(windows: DataFrame, bits: int) -> np.ndarray:
    """The bits, packed, of the first `bits` bits of the windows' hashes."""
    bit = F.shiftrightunsigned("gram", 64 - bits)
    placed = windows.select(F.shiftright(bit, BLOCK_BITS).alias("block"), bit.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("bit")).distinct()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(1 << BLOCK_BITS, bool)
        block[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"block": rows["block"].iloc[:1], "packed": [np.packbits(block).tobytes()]})

    packed = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for r in placed.groupBy("block").applyInPandas(pack, "block bigint, packed binary").toLocalIterator():
        packed[r["block"]] = np.frombuffer(r["packed"], np.uint8)
    return packed.reshape(-1)


def _near(docs: DataFrame, text: str, keep: list[str], sizes: list[int], packed: np.ndarray, bits: int, n: int) -> DataFrame:
    """The columns `keep` with n_words and the places whose hashes pass the filter: at, size, gram, said."""
    docs, kept = with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    kind = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("gram", pa.int64()), ("said", pa.binary())])

    def run(batches):
        packed = shared.value
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            places: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for lo, _, data, offsets, again in _text.windows(batch.column(len(keep)), _text.ALNUM, n - 1):
                low, starts, ends, first = _text.words(data, offsets)
                before = int(counts[lo]) - again  # words of the row before this window of it
                counts[lo : lo + len(offsets) - 1] += np.diff(first) - again
                h = _text.word_hash(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
                for size in sizes:
                    grams = _text.gram_hash(h, size)
                    bit = (grams >> np.uint64(64 - bits)).astype(np.int64)
                    passed = (packed[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
                    near = np.flatnonzero(passed & _text.grams_within_rows(first, size))
                    rows = np.searchsorted(first, near, "right") - 1
                    for at, row, gram in zip(near.tolist(), rows.tolist(), grams[near].view(np.int64).tolist()):
                        said = b" ".join(low[x:y].tobytes() for x, y in zip(starts[at : at + size], ends[at : at + size]))
                        places[lo + row].append((at - int(first[row]) + (before if row == 0 else 0), size, gram, said))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts), pa.array(places, pa.list_(kind))], names=[*keep, "n_words", "places"])

    return map_texts(docs, run, kept + "n_words bigint, places array<struct<at:int,size:int,gram:bigint,said:binary>>")


def _find_joined(docs: DataFrame, text: str, items: DataFrame, keep: list[str], n: int) -> DataFrame:
    """What `_scan_with` finds, for items (item_id, text) of any number."""
    windows = cut(_window_table(items, n).distinct())
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * windows.count()).bit_length()))
    rows = cut(_near(docs.withColumn("_row", F.monotonically_increasing_id()), text, [*keep, "_row"], sizes, _filter(windows, bits), bits, n))
    near = rows.select("_row", F.inline("places"))
    counts = cut(near.groupBy(*KEY).agg(F.count("*").alias("held")))
    bound = max(HOT_ROWS, (counts.agg(F.sum("held")).first()[0] or 0) // HOT_KEYS + 1)  # HOT_KEYS windows at most are held by more places
    parts = F.ceil(F.col("held") / bound).cast("int")
    hot = F.broadcast(counts.where(F.col("held") > bound).select(*KEY, parts.alias("_parts")))
    near = near.join(hot, KEY, "left").withColumn("_part", F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int"))
    table = windows.select(*KEY, "item_id").distinct().join(counts, KEY).select(*KEY, "item_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    hits = near.join(table, [*KEY, "_part"]).groupBy("_row")
    hits = hits.agg(F.collect_set(F.struct("at", (F.col("at") + F.col("size") - 1).alias("last"))).alias("places"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    found = rows.drop("places").join(hits, "_row", "left").select(*keep, "n_words", "places", "item_ids")

    def run(batches):
        for batch in batches:
            spans = [_joined([(p["at"], p["last"]) for p in places or []]) for places in batch.column(len(keep) + 1).to_pylist()]
            items = [ids or [] for ids in batch.column(len(keep) + 2).to_pylist()]
            found = [pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *found], names=[*keep, "n_words", "spans", "item_ids"])

    kept = ddl(found.select(*quoted(*keep)))
    return map_texts(found, run, (kept + ", " if kept else "") + FOUND)


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns `keep` of docs (all, by default) with n_words, spans of hit words, item_ids, n_hit and contaminated."""
    keep = without(docs.columns if keep is None else keep, RESULTS)
    names = [f"_{i}" for i in range(len(keep))]  # which no column of ours has
    docs = docs.select(*quoted(*keep), F.col(quoted(text)[0])).toDF(*names, "_text")
    items = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.size(F.split("text", " ")) + F.length("text") / 8)).first()[0] or 0  # at least its words
    if size <= block_words:
        found = _scan_with(docs, "_text", window_set([(r[0], r[1]) for r in items.collect()], n), names, n)
    else:
        found = _find_joined(docs, "_text", items, names, n)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"] + 1), F.lit(0))
    found = found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
    return found.select(*names, *RESULTS).toDF(*keep, *RESULTS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text: str = "text", **how) -> DataFrame:
    """docs without contaminated documents, or (mode="span") with the hit words of contaminated documents cut out."""
    if mode not in ("document", "span"):
        raise ValueError(mode)
    at = docs.columns.index(text)
    docs, names = positional(docs)
    found = find(docs, benchmark, text=f"_{at}", **how)
    if mode == "document":
        return renamed(found.where(~F.col("contaminated")), names)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (bad, spans) in enumerate(zip(batch.column("contaminated").to_pylist(), batch.column("spans").to_pylist())):
                if bad:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    _, starts, ends, _ = _text.words(data, np.array([0, len(data)]))
                    kept, begin = [], 0
                    for s in spans:
                        kept.append(data[begin : starts[s["first"]]].tobytes())
                        begin = ends[s["last"]]
                    texts[i] = b"".join([*kept, data[begin:].tobytes()]).decode()
            arrays = [batch.column(c) for c in columns]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return renamed(map_texts(found, run, docs.schema), names)
