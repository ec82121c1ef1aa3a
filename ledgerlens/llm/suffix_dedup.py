"""Removal of repeated byte strings by suffix arrays, sorted in two stages.

Each byte that a string of `length` bytes covers which also starts anywhere else, in the same text or
another one, is removed; overlaps count, strings don't cross texts, and all are judged on the input.

Which strings may be equal is told by their least gram: of the hashes of all `GRAM`-byte grams in a
string the smallest. Equal strings have equal ones, so runs of neighbouring strings with the same
least gram (a segment: their bytes) go to one task if their gram is that of several segments, or has
several places in one. Equal
segments are counted before they are shuffled; a segment that occurs more often stands in its task's
text twice, whatever the number. A task joins segments of about `BATCH` bytes into a text and sorts
the suffixes at which a string begins, by their first `length` bytes, in two stages: those smaller
than their successor are sorted directly; the others, larger than the suffix that follows them in the
text, are induced by one scan over the buckets of first bytes, in ascending order, from suffixes that
have their place already. Then strings are repeated where the common prefix of two adjacent suffixes
is as long as a string. So the sum of suffixes sorted grows with the text that may be repeated, and no
task's with that of any string, source or text.

Segments of a gram with over `CROWD` different segments are dealt to several tasks by the hashes of
their strings: each task sorts the strings that are its own. Places of a segment that very many texts
have are dealt to several tasks too. Segments are told apart by two 64-bit hashes.

Null texts count as empty. Texts of under `length` bytes lose nothing, texts of one repeated byte are
cut into segments as any other, and long ones are read in stripes; what is removed of a text comes
together in its row. Repeated rows repeat each other's strings. An empty table gives an empty one.
Rows are told apart by their place: docs must be read alike each time, as tables are. Result columns
take the place of columns of the same name.
"""

from __future__ import annotations

import uuid
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import HOT_KEYS, HOT_ROWS, cut, join_dealt, map_texts, quoted, with_text, without

#: Bytes of a string and of a gram, strings of a segment at most, segments of a gram in one task, bytes of a suffix array's text.
LENGTH, GRAM, RUN, CROWD, BATCH = 200, 32, 192, 4_096, 1 << 19
#: Byte between segments, which UTF-8 has nowhere.
END = 255
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept"]


def least_grams(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the least gram of the string at each place is (the first of equal ones), its hash, and the sums for `span_hash`; for less than 2 MiB."""
    gram = min(GRAM, length)
    sums = _text.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h, width, low = _text.span_hash(sums, at, at + gram), length - gram + 1, np.uint64((1 << 21) - 1)
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = (h & ~low) | at.astype(np.uint64)
    blocks = padded.reshape(-1, width)  # the least of a window is that of the end of a block or of the next one's beginning
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    found = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    return found, h[found], sums


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, least gram, hash, whether its strings may repeat one another) of the segments of rows of text.

    Two equal strings have their least gram at the same place in them, so not at one place of the text.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none > 0
    where, least, sums = least_grams(data, length)
    inside = np.arange(len(least)) + length <= np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(fresh)
    ends = np.flatnonzero(inside & np.append(fresh[1:] | ~inside[1:], True)) + 1
    pieces = -(-(ends - starts) // RUN)
    first = np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(starts, pieces) + (np.arange(len(first)) - first) * RUN
    end = np.minimum(begin + RUN, np.repeat(ends, pieces)) + length - 1
    return begin, end, least[begin], _text.span_hash(sums, begin, end), where[begin] != where[end - length]


def suffix_array(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The places `wanted` (a mask) in the order of the suffixes there, by their first `length` bytes.

    text ends with `length` bytes more than any suffix that is wanted needs, and each place wanted has a
    suffix smaller than its successor after it, as every segment's last byte before END is.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]  # where the bytes after a place first differ from it
    smaller = np.append(np.append(step, -1)[change] > 0, False)
    following = np.minimum.accumulate(np.where(smaller, np.arange(n), n - 1)[::-1])[::-1]
    # a larger suffix is induced from its successor, so these are needed as far as to the next smaller one
    places = np.flatnonzero(wanted)
    needed = np.cumsum(np.bincount(places, minlength=n + 1) - np.bincount(following[places] + 1, minlength=n + 1))[:n] > 0
    direct = np.flatnonzero(needed & smaller)
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[direct]).view(f"S{length}").ravel()
    direct = direct[np.argsort(strings, kind="stable")]
    begin = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []

    def scan(places: np.ndarray, byte: int) -> np.ndarray:
        """Places in their order: gives the larger suffixes before them their places in their buckets; returns those of this bucket."""
        order.append(places)
        before = places[places > 0] - 1
        before = before[needed[before] & (text[before] >= byte)]
        first = text[before]
        if len(before):
            by = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.diff(first[by])) + 1
            for part in np.split(before[by], cuts):
                if text[part[0]] > byte:
                    induced[text[part[0]]].append(part)
        return before[first == byte]

    for byte in np.unique(text[needed]).tolist():
        here = np.concatenate(induced[byte]) if induced[byte] else direct[:0]
        while len(here):  # longer runs of the bucket's byte come after shorter ones
            here = scan(here, byte)
        if begin[byte] < begin[byte + 1]:
            scan(direct[begin[byte] : begin[byte + 1]], byte)
    found = np.concatenate(order) if order else direct
    return found[wanted[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each suffix of the order has in common with the next one, up to `length`."""
    words = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    a, b = order[:-1], order[1:]
    found, alive = np.full(len(a), length), np.arange(len(a))
    for at in range(0, length, 8):
        apart = words[a[alive] + at] ^ words[b[alive] + at]
        ends = np.flatnonzero(apart)
        low = apart[ends] & (~apart[ends] + np.uint64(1))
        found[alive[ends]] = np.minimum(length, at + np.bitwise_count(low - np.uint64(1)) // 8)
        alive = alive[apart == 0]
    return found


def repeated(texts: list[bytes], often: list[bool], part: np.ndarray, parts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment, which of its strings occur more than once among the segments; those that occur often stand there twice.

    Of segments in several parts, only strings whose hash falls in the part count.
    """
    end = bytes([END])
    twice = [t for t, o in zip(texts, often) if o]
    text = np.frombuffer(end.join([*texts, *twice, end * (2 * length + 8)]), np.uint8)
    sizes = np.array([len(t) for t in texts] + [len(t) for t in twice])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    strings = sizes - length + 1
    first = np.concatenate(([0], np.cumsum(strings)))
    places = np.arange(first[-1]) + np.repeat(starts - first[:-1], strings)
    if (parts > 1).any():
        of = np.concatenate((np.arange(len(texts)), np.flatnonzero(often)))
        mine = _string_parts(text, places, np.repeat(parts[of], strings), length) == np.repeat(part[of], strings)
    else:
        mine = np.ones(len(places), bool)
    wanted = np.zeros(len(text), bool)
    wanted[places[mine]] = True
    order = suffix_array(text, wanted, length)
    equal = common_prefixes(text, order, length) == length
    marked = np.zeros(len(text), bool)
    marked[order[:-1][equal]] = marked[order[1:][equal]] = True
    return [marked[s : s + k] for s, k in zip(starts[: len(texts)], strings[: len(texts)])]


def _string_parts(data: np.ndarray, places: np.ndarray, parts: np.ndarray, length: int) -> np.ndarray:
    return (_text.span_hash(_text.prefix_hash(data), places, places + length) % parts.astype(np.uint64)).astype(np.int64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _segmented(docs: DataFrame, length: int) -> DataFrame:
    """p, start, size, h, s and own of all segments of docs (p, text)."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for lo, hi, data, offsets in _text.pieces(batch.column(1)):
                for base in range(0, max(1, len(data)), 1 << 20) if hi - lo == 1 else [0]:  # a long text by stripes, which share all but one byte of a string
                    part = data[base : base + (1 << 20) + length - 1] if hi - lo == 1 else data
                    begin, end, h, s, own = segments(part, offsets if hi - lo > 1 else np.array([0, len(part)]), length)
                    row = np.searchsorted(offsets, begin + base, "right") - 1
                    columns = [pa.array(rows[lo + row]), pa.array((begin + base - offsets[row]).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, names=["p", "start", "size", "h", "s", "own"])

    return map_texts(docs, run, "p bigint, start int, size int, h bigint, s bigint, own boolean")


def _stored(df: DataFrame) -> DataFrame:
    """As `cut`, but written in columns: smaller where rows are short and many."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut(df.sparkSession.range(0))  # sets the folder
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/segments-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _fetched(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """h, part, parts, s, n and the bytes of the segments asked for, from their texts."""
    listed = asked.groupBy("p").agg(F.collect_list(F.struct("start", "size", "h", "s", "n", "parts", "length")).alias("asked"))
    others = [c for c in docs.columns if c not in ("p", "text")]  # so that the texts' exchange is the one that `remove` has, and is made once
    rows = docs.join(listed.hint("shuffle_hash"), "p").select("text", "asked", "p", *others)
    names = ["h", "part", "parts", "s", "n", "said"]

    def run(batches):
        for batch in batches:
            data, offsets = _text.utf8(batch.column(0))
            listed = batch.column(1)
            flat = listed.flatten()
            start, size, h, s, n, parts, length = (flat.field(i).to_numpy() for i in range(7))
            at = np.repeat(offsets[:-1], listed.value_lengths().to_numpy()) + start
            ends = at + size
            which, part = np.arange(len(at)), np.zeros(len(at), np.int64)
            crowded = np.flatnonzero(parts > 1)
            if len(crowded):
                extra = []
                for i in crowded.tolist():
                    strings = np.arange(size[i] - length[i] + 1)
                    mine = np.unique(_string_parts(data[at[i] : ends[i]], strings, np.full(len(strings), parts[i]), int(length[i])))
                    extra.append((np.full(len(mine), i), mine))
                keep = np.flatnonzero(parts <= 1)
                which = np.concatenate((keep, *(w for w, _ in extra)))
                part = np.concatenate((np.zeros(len(keep), np.int64), *(m for _, m in extra)))
            whole = data.tobytes()
            said = pa.array([whole[a:b] for a, b in zip(at[which].tolist(), ends[which].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[which]), pa.array(part.astype(np.int32)), pa.array(parts[which]), pa.array(s[which]), pa.array(n[which]), said], names=names)

    return rows.mapInArrow(run, "h bigint, part int, parts int, s bigint, n bigint, said binary")


def _judged(found: DataFrame, length: int) -> DataFrame:
    """h, s, lo, hi: the bytes of each segment that its repeated strings cover."""
    wanted = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = found.repartition(wanted, "h", "part").sortWithinPartitions("h", "part")

    def answers(held: list[tuple]):
        h, part, parts, s, n, said = (list(c) for c in zip(*held))
        masks = repeated(said, [x > 1 for x in n], np.array(part), np.array(parts), length)
        out: list[list[int]] = [[], [], [], []]
        for key, own, mask in zip(h, s, masks):
            for lo, hi in zip(*(x.tolist() for x in runs(mask))):
                for column, value in zip(out, (key, own, lo, hi + length - 1)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["h", "s", "lo", "hi"])

    def run(batches):
        held, size = [], 0
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, group in groupby(rows, lambda r: r[:2]):
            if size >= BATCH:
                yield answers(held)
                held, size = [], 0
            for r in group:
                held.append(r)
                size += len(r[5])
        if held:
            yield answers(held)

    return dealt.mapInArrow(run, "h bigint, s bigint, lo int, hi int")


def spans(docs: DataFrame, texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """p and spans: array of lo and hi, the repeated bytes of each text of docs (p, text) that has some. texts: docs, dealt by p."""
    found = _segmented(docs, length)
    shared = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 or own").drop("own"))
    places = _stored(join_dealt(found.drop("own"), shared, ["h"], ["p", "start"]).drop("n"))
    first = F.min(F.struct("p", "start", "size")).alias("at")
    kinds = _stored(places.groupBy("h", "s").agg(F.count("*").alias("n"), first))
    crowded = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where(F.col("kinds") > CROWD))
    parts = F.coalesce(F.ceil(F.col("kinds") / CROWD), F.lit(1)).cast("int").alias("parts")
    asked = kinds if crowded.isEmpty() else join_dealt(kinds, crowded, ["h"], ["s"], "left", "kinds")
    asked = asked.select("h", "s", "n", "at.*", parts if "kinds" in asked.columns else F.lit(1).alias("parts"), F.lit(length).alias("length"))
    known = _judged(_fetched(texts, asked), length)
    # a segment's places are dealt to several tasks if there are many of them
    total = kinds.agg(F.sum("n")).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_KEYS + 1)
    hot = F.broadcast(kinds.where(F.col("n") > bound).select("h", "s", F.ceil(F.col("n") / bound).cast("int").alias("tasks")))
    known = known.join(hot, ["h", "s"], "left").withColumn("task", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    places = places.join(hot, ["h", "s"], "left").withColumn("task", F.pmod(F.xxhash64("p", "start"), F.coalesce("tasks", F.lit(1))).cast("int"))
    covered = places.join(known, ["h", "s", "task"]).select("p", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return covered.groupBy("p").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def remove(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """The columns `keep` of docs (all, by default), n_bytes, n_removed, n_spans (maximal runs removed) and kept: the bytes that stay."""
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keep = without(docs.columns if keep is None else keep, RESULTS)
    rows, kinds = with_text(docs, keep, text)
    rows = rows.toDF(*(f"_{i}" for i in range(len(keep))), "text").withColumn("p", F.monotonically_increasing_id())
    texts = rows.repartition(wanted, "p")
    found = spans(rows.select("p", "text"), texts, length)
    joined = texts.join(found.hint("shuffle_hash"), "p", "left").select(*(f"_{i}" for i in range(len(keep))), "text", "spans")
    at = len(keep)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in _text.pieces(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                listed, kept, counts = part.column(at + 1), [], np.zeros((3, hi - lo), np.int64)
                for i, (begin, end) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = data[begin:end]
                    counts[0, i] = len(own)
                    if listed[i].is_valid:
                        first, last = (listed[i].values.field(k).to_numpy() for k in (0, 1))
                        edge = np.bincount(first, minlength=len(own) + 1) - np.bincount(last, minlength=len(own) + 1)
                        gone = np.cumsum(edge[:-1]) > 0
                        counts[1, i], counts[2, i] = gone.sum(), len(runs(gone)[0])
                        own = own[~gone]
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *(pa.array(c) for c in counts), pa.array(kept, pa.binary())], names=[*keep, *RESULTS])

    return map_texts(joined, run, f"{kinds}n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
