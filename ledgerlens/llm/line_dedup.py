"""Line dedup by a segment-partition edit join.

A line is dropped where it repeats an earlier line, at every length but blank, or, at its first
place, if an earlier line is within edit distance `EDITS` of it. Lines of at least `LEAST` characters
take part in the edit join; `repeats` is the least length at which repeats are dropped. Earlier means
a smaller document id (null ids first), then row, then line number.

Of two lines within the distance, one of the `EDITS + 1` segments into which the one is split
stands unchanged in the other, near its own place. So each line is indexed by its segments and
probes with the substrings of the lengths and places that are possible, by the multi-match-aware
windows for each length of the other line. Lines that meet under a key are candidates; a count of
letters discards most, and a banded bit-parallel edit distance verifies the rest.

Lines of a candidate key are compared in their order, so each finds its earliest partner; keys
over `GROUP` lines are cut into chunks, every two of which meet in a task of their own. Only hashes
of lines are shuffled, but for candidates, and the places of a line that very many documents have
are dealt to several tasks. Null texts have no lines and stay as they are. Rows are told apart by
their place: docs must be read alike each time, as tables are. Other columns may have any names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import cut, in_chunks, join_dealt, map_texts, positional, quoted, renamed

#: Characters of a line that takes part at least, and edits between near copies at most.
LEAST, EDITS = 20, 2
#: Lines of a chunk of a candidate key, rows held of one key, and lines whose hashes may be broadcast.
GROUP, HELD, SMALL = 2_048, 1 << 16, 1_000_000
#: Bins of the count of letters.
BINS = 32


def segments(length: np.ndarray, edits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Starts and lengths of the edits + 1 segments of lines of these lengths; later ones are longer by one if need be."""
    n = edits + 1
    short = n - length % n
    sizes = [length // n + (i >= short) for i in range(n)]
    starts = [np.zeros_like(length)]
    for size in sizes[:-1]:
        starts.append(starts[-1] + size)
    return starts, sizes


def keys(sums: np.ndarray, begin: np.ndarray, length: np.ndarray, edits: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(lines, keys, whether they index the line) of lines given by their first characters and lengths."""
    every = np.arange(len(begin))

    def key(lines, start, size, indexed, i):
        at = begin[lines] + start
        return _text.mix(_text.span_hash(sums, at, at + size) + _text.mix((indexed * 64 + i).astype(np.uint64)))

    for shorter in range(edits + 1):
        indexed = length - shorter
        starts, sizes = segments(indexed, edits)
        for i in range(edits + 1):
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                start = starts[i] + shift
                ok = every[(indexed >= least) & (start >= 0) & (start + sizes[i] <= length)]
                yield ok, key(ok, start[ok], sizes[i][ok], indexed[ok], i), shorter == 0 and shift == 0


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: bit-parallel, over a band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    common = len(os.path.commonprefix((a, b)))
    a, b = a[common:], b[common:]
    common = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - common], b[: len(b) - common]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= edits:
        return True
    # bit k of the band in column j is row j - edits + k of a; `up` and `down` are vertical differences of 1
    width, distance = 2 * edits + 1, edits
    every = (1 << width) - 1
    up, down = every & ~((1 << edits) - 1), 0
    for j, c in enumerate(b):
        low = j - edits
        equal = 0
        for k in range(max(0, -low), min(width, len(a) - low)):
            if a[low + k] == c:
                equal |= 1 << k
        same = ((((equal & up) + up) ^ up) | equal | down) & every
        rise = (down | ~(same | up)) & every
        fall = same & up
        row = j + edits  # the lowest row of the band
        if row < len(a):
            distance += not same >> (width - 1) & 1
        else:
            bit = len(a) - 1 - low
            distance += (rise >> bit & 1) - (fall >> bit & 1)
        same >>= 1
        up, down = (fall | ~(same | rise)) & every, same & rise
    return distance <= edits


def _letters(lines: list[str]) -> np.ndarray:
    counts = np.zeros((len(lines), BINS), np.int16)
    for i, line in enumerate(lines):
        counts[i] = np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) % BINS, minlength=BINS)
    return counts


def earliest(lines: list[str], edits: int) -> list[int]:
    """For each of the lines, which are in order, the first earlier one within the distance, or -1."""
    counts = _letters(lines)
    found = [-1] * len(lines)
    for i in range(1, len(lines)):
        for j in np.flatnonzero(np.abs(counts[:i] - counts[i]).sum(axis=1) <= 2 * edits).tolist():
            if within(lines[i], lines[j], edits):
                found[i] = j
                break
    return found


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """row, doc, at, h, h2 and line of docs with row, doc and text."""
    lines = docs.select("row", "doc", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.length("line") >= least)
    return lines.select("row", "doc", "at", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _place():
    return F.struct("doc", "row", "at")


def _keyed(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """key, tagged: the hash of a line with its last bit telling whether the key indexes it."""

    def pieces(column: pa.Array) -> Iterator[list[str]]:
        part, size = [], 0
        for x in column:
            text = x.as_py() or ""
            part.append(text)
            size += len(text)
            if size >= _text.PIECE:
                yield part
                part, size = [], 0
        if part:
            yield part

    def run(batches):
        for batch in batches:
            for texts in pieces(batch.column(0)):
                joined = "\n".join(texts)
                code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                ends = np.concatenate((np.flatnonzero(code == 10), [len(code)]))
                begin = np.concatenate(([0], ends[:-1] + 1))
                length = ends - begin
                long = np.flatnonzero(length >= least)
                lines = joined.split("\n")
                h = np.fromiter((xxhash.xxh64_intdigest(lines[i].encode(), 42) for i in long.tolist()), np.uint64, len(long))
                h, one = np.unique(h, return_index=True)
                begin, length = begin[long[one]], length[long[one]]
                sums = _text.prefix_sums(_text.mix(code.astype(np.uint64) + np.uint64(1)) | np.uint64(1))
                found = list(keys(sums, begin, length, edits, least))
                key = np.concatenate([k for _, k, _ in found]).view(np.int64)
                tagged = np.concatenate([h[i] & ~np.uint64(1) | np.uint64(indexed) for i, _, indexed in found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(tagged)], names=["key", "tagged"])

    return map_texts(docs.select("text"), run, "key bigint, tagged bigint")


def _candidates(keyed: DataFrame) -> DataFrame:
    """key, half: the keys that index a line and that another line has, with all their lines (hashes without the last bit).

    The lines of a key with over HELD of them may come more than once.
    """
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches):
        empty = np.zeros(0, np.int64)
        held_key, held, shown = empty, empty, None  # shown: a key with so many lines that they are passed on as they come

        def out(key, tagged):
            order = np.lexsort((tagged, key))
            key, tagged = key[order], tagged[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            half = tagged >> 1
            good = np.minimum.reduceat(half, first) != np.maximum.reduceat(half, first)
            good &= np.maximum.reduceat(tagged & 1, first) > 0
            keep = np.repeat(good | (key[first] == shown), np.diff(np.concatenate((first, [len(key)]))))
            keep &= np.concatenate(([True], (key[1:] != key[:-1]) | (half[1:] != half[:-1])))
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(half[keep])], names=["key", "half"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, tagged = np.concatenate((held_key, batch.column(0).to_numpy())), np.concatenate((held, batch.column(1).to_numpy()))
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield out(key[:last], tagged[:last])
            held_key, held = key[last:], np.unique(tagged[last:])
            held_key = held_key[: len(held)]
            if len(held) > HELD:
                shown = held_key[0]
                yield out(held_key, held)
                held_key, held = held_key[:1], held[:1]
        if len(held):
            yield out(held_key, held)

    return keyed.mapInArrow(run, "key bigint, half bigint")


def _nearest(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """h, h2 and near: the earliest place of the earlier lines within the distance of a line that has any."""
    met = cut(_candidates(_keyed(docs, edits, least)).distinct())
    wanted = cut(met.select("half").distinct())
    few = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    lines = _lines(docs, least).withColumn("half", F.shiftright("h", 1)).join(few, "half")
    # places and texts of the candidates' first occurrences
    lines = lines.groupBy("half", "h", "h2").agg(F.min(_place()).alias("place"), F.first("line").alias("line"))
    members = in_chunks(met.join(lines, "half").select("key", "h", "h2", "place", "line"), "h", GROUP)
    members = members.repartition("key").sortWithinPartitions("key", "place")

    def run(batches):
        held = None

        def out(table: pa.RecordBatch):
            key = table.column("key").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            lines = table.column("line")
            rows, partners = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    for i, j in enumerate(earliest(lines.slice(a, b - a).to_pylist(), edits)):
                        if j >= 0:
                            rows.append(a + i)
                            partners.append(a + j)
            rows, partners = pa.array(rows, pa.int64()), pa.array(partners, pa.int64())
            return pa.RecordBatch.from_arrays([table.column("h").take(rows), table.column("h2").take(rows), table.column("place").take(partners)], names=["h", "h2", "near"])

        for batch in batches:
            table = batch if held is None or not held.num_rows else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not table.num_rows:
                continue
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield out(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield out(held)

    kind = members.schema["place"].dataType.simpleString()
    found = members.mapInArrow(run, f"h bigint, h2 bigint, near {kind}")
    return found.groupBy("h", "h2").agg(F.min("near").alias("near"))


def dropped_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, repeats: int = 1) -> DataFrame:
    """row, dropped (line numbers, from 0) and partners (ids that have the earlier lines) of docs with row, doc and text."""
    near = cut(_nearest(docs, edits, least))
    places = _lines(docs, min(repeats, least)).where((F.length("line") >= least) | F.col("line").rlike(r"\S")).drop("line")
    firsts = places.groupBy("h", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    marked = cut(firsts.join(near, ["h", "h2"], "left").where("n > 1 or near is not null"))
    gone = join_dealt(places, marked, ["h", "h2"], ["row", "at"]).where((_place() != F.col("first")) | (F.col("near") < F.col("first")))
    partner = F.when(F.col("near") < F.col("first"), F.col("near")).otherwise(F.col("first"))["doc"]
    return gone.groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("dropped"), F.array_sort(F.collect_set(partner)).alias("partners"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, repeats: int = 1) -> DataFrame:
    """key, n_lines, n_dropped, dropped and partners of each row."""
    docs = docs.select(F.col(quoted(key)[0]).alias("doc"), F.col(quoted(text)[0]).alias("text")).withColumn("row", F.monotonically_increasing_id())
    gone = dropped_lines(docs, edits, least, repeats)
    count = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    rows = docs.select("row", "doc", F.when(F.col("text").isNull(), 0).otherwise(count).alias("n_lines")).join(gone, "row", "left")
    none = F.array()
    return rows.select(F.col("doc").alias(key), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none.cast("array<int>")).alias("dropped"), F.coalesce("partners", none.cast(gone.schema["partners"].dataType)).alias("partners"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, repeats: int = 1) -> DataFrame:
    """docs without their dropped lines, and without the documents of which nothing but space is left then."""
    doc, at = (f"_{docs.columns.index(c)}" for c in (key, text))
    docs, names = positional(docs)
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    gone = dropped_lines(docs.select(F.col(doc).alias("doc"), F.col(at).alias("text"), F.col("_row").alias("row")), edits, least, repeats)
    docs = docs.join(gone.select(F.col("row").alias("_row"), F.col("dropped").alias("_dropped")), "_row", "left")
    left = F.array_join(F.filter(F.split(at, "\n", -1), lambda line, i: ~F.array_contains("_dropped", i)), "\n")
    docs = docs.withColumn(at, F.when(F.col("_dropped").isNull(), F.col(at)).otherwise(left))
    return renamed(docs.where(F.col("_dropped").isNull() | F.col(at).rlike(r"\S")), names)
