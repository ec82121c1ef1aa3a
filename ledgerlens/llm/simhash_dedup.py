"""Near-duplicates by SimHash, with pivot distance tables.

A text's fingerprint has a bit for each bit of its shingles' hashes: 1 if set in over half of
them. Fingerprints of at most `DISTANCE` differing bits are linked, and documents are grouped by
the components of these links.

Equal fingerprints are one. Each has a row in a table of its Hamming distances to many reference
fingerprints, worked out once. Two fingerprints that may link agree in whole blocks of bits
(pigeonhole), so they meet in a bucket of some choice of blocks, where they stand in the order of
the table's first coordinate. By the triangle inequality, only pairs near in that order are looked
at, those of which any coordinate differs by more than `DISTANCE` are discarded, and the survivors
verified bit by bit. A bucket links its fingerprints as a forest: the components stay those of all
links. Buckets over `BUCKET` are cut into chunks, and every two chunks meet in a task of their own.

Null texts and texts without words have fingerprint zero and are linked like any other. Null ids
never name a component unless all its ids are null. Repeated rows are rows of the same component.
Texts are read in windows of about a megabyte. Columns may have any names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._graph import components, forest
from ledgerlens.llm._spark import cut, ddl, in_chunks, join_dealt, map_texts, positional, quoted, renamed

#: Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Reference fingerprints, fingerprints of a chunk, and of a bucket whose pairs are compared at once (twice the room of block_masks).
PIVOTS, BUCKET, SMALL = 32, 4_096, 128
#: Bytes of text split into words at a time.
WINDOW = 1 << 20

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACE = regex.compile(rb"[\x20\x09-\x0D]")
REFERENCES = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about WINDOW bytes."""
    data = (text or "").encode().translate(LOWER)
    at = 0
    while at < len(data):
        cut_at = SPACE.search(data, at + WINDOW) if len(data) - at > WINDOW else None
        end = cut_at.start() if cut_at else len(data)
        yield data[at:end].split()
        at = end


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), WINDOW):
        counts += np.unpackbits(h[lo : lo + WINDOW].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes of which so many have each bit set."""
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    n, counts, words = 0, np.zeros(64, np.int64), []
    for more in word_lists(text):
        words = words[max(0, len(words) - size + 1) :] + more
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
        n += len(h)
        counts += ones(h)
    if n == 0 and words:
        n, counts = 1, ones(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    return majority(counts, n)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", size: int = SHINGLE) -> DataFrame:
    """The columns of docs but its text, and `out`: bigint with the bits of the fingerprint."""
    kept = [c for c in docs.columns if c != text]
    docs = docs.select(*quoted(*kept, text))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column(len(kept))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found.view(np.int64))], names=[*kept, out])

    return map_texts(docs, run, f"{ddl(docs.select(*quoted(*kept)))}, `{out}` bigint")


def block_masks(n: int, distance: int = DISTANCE, room: int = 64) -> list[int]:
    """Masks of the block choices: the fewest for which n random fingerprints leave about `room` in a bucket."""
    for blocks in range(distance + 1, 2 * distance + 2):
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        each = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
        masks = [sum(m) for m in itertools.combinations(each, blocks - distance)]
        if n <= room << min(m.bit_count() for m in masks):
            break
    return masks


PIVOT_COLUMNS = [f"pivots{i}" for i in range(PIVOTS // 8)]


def with_pivots(distinct: DataFrame) -> DataFrame:
    """distinct (fp) with its distances to the references, eight to a bigint."""

    def packed(references: np.ndarray):
        away = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(r)))).cast("bigint") for r in references.view(np.int64)]
        return sum((F.shiftleft(x, 8 * i) for i, x in enumerate(away[1:], 1)), away[0])

    return distinct.withColumns({c: packed(REFERENCES[8 * i : 8 * i + 8]) for i, c in enumerate(PIVOT_COLUMNS)})


def near_pairs(fp: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs (left, right) are links: no table coordinate far apart, and few differing bits."""
    open_pairs = np.arange(len(left))
    for column in table:
        open_pairs = open_pairs[np.abs(column[left[open_pairs]] - column[right[open_pairs]]) <= distance]
    return open_pairs[np.bitwise_count(fp[left[open_pairs]] ^ fp[right[open_pairs]]) <= distance]


def bucket_links(fp: np.ndarray, table: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (rows from each start to the next; a last entry ends them), each in the order of the table's first row, as forests."""
    first = table[0]
    size = np.diff(starts)
    end = np.repeat(starts[1:], size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(np.repeat(size <= SMALL, size))
    for step in range(1, SMALL):
        rows = rows[rows + step < end[rows]]
        rows = rows[first[rows + step] - first[rows] <= distance]  # in order: what is too far now stays so
        if not len(rows):
            break
        near = near_pairs(fp, table, rows, rows + step, distance)
        found.append((fp[rows[near]], fp[rows[near] + step]))
    if found:
        found = [forest(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))]
    for i in np.flatnonzero(size > SMALL):
        rest = np.arange(starts[i], starts[i + 1])
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            reached = [root]
            while reached and len(rest):
                x = reached.pop()
                lo, hi = np.searchsorted(first[rest], [first[x] - distance, first[x] + distance + 1])
                near = lo + near_pairs(fp, table, rest[lo:hi], np.full(hi - lo, x), distance)
                if len(near):
                    found.append((fp[rest[near]], np.full(len(near), fp[root])))
                    reached += rest[near].tolist()
                    rest = np.delete(rest, near)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def links(distinct: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """a, b: enough of the links of n distinct fingerprints (`fp`) that the components are those of all links."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(n, distance)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    keyed = with_pivots(distinct.select("fp")).select("fp", *PIVOT_COLUMNS, F.explode(keys).alias("key"))
    keyed = in_chunks(keyed, "fp", BUCKET)
    keyed = keyed.withColumn("_first", F.col(PIVOT_COLUMNS[0]).bitwiseAND(F.lit(255))).repartition("key").sortWithinPartitions("key", "_first")

    def run(batches):
        held = np.zeros((2 + len(PIVOT_COLUMNS), 0), np.int64)

        def out(rows):
            if not rows.shape[1]:  # a batch of one bucket ends none
                return
            key = rows[0]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            several = np.repeat(np.diff(starts) > 1, np.diff(starts))
            rows = rows[:, several]
            if not rows.shape[1]:
                return
            key, fp = rows[0], rows[1].view(np.uint64)
            table = np.ascontiguousarray(np.ascontiguousarray(rows[2:].T).view(np.int8).T)
            a, b = bucket_links(fp, table, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))), distance)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield from out(rows[:, :last])
            held = rows[:, last:]
        yield from out(held)

    return keyed.select("key", "fp", *PIVOT_COLUMNS).mapInArrow(run, "a bigint, b bigint")


def group(rows: DataFrame, key: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """rows (with fp), root (a fingerprint for each component) and component_id: the smallest key that its links reach, its own included."""
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("_least"), F.count("*").alias("n")))
    linked = components(links(distinct, distinct.count(), distance))
    rooted = cut(distinct.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = cut(rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.count("*").alias("members")))
    rooted = cut(join_dealt(rooted.select("fp", "root", "n"), named, ["root"], ["fp"], n="members").select("fp", "root", "component_id", "n"))
    return join_dealt(rows, rooted, ["fp"], rows.columns).drop("n")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id of each row."""
    docs = docs.select(F.col(quoted(key)[0]).alias("_key"), F.col(quoted(text)[0]).alias("_text"))
    rows = cut(fingerprints(docs, "_text", size=size))
    return group(rows, "_key", distance).select(F.col("_key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: that of its smallest key (null keys last), the first such row.

    Rows are told apart by their place, so docs must be read alike each time, as tables are.
    """
    at = [docs.columns.index(c) for c in (key, text)]
    docs, names = positional(docs)
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = cut(fingerprints(docs.select(F.col(f"_{at[0]}").alias("_key"), "_row", F.col(f"_{at[1]}").alias("_text")), "_text", size=size))
    first = F.min(F.struct(F.col("_key").isNull(), "_key", "_row")).alias("_first")
    kept = group(rows, "_key", distance).groupBy("root").agg(first).select(F.col("_first._row").alias("_row"))
    return renamed(docs.join(kept, "_row", "left_semi"), names)
