"""Near-duplicates by SimHash and the Jaccard similarity of five-word shingles, found exactly.

Documents whose shingle sets have a similarity of 4/5 or more are linked, and one of each component
of these links is kept. Equal sets are one. SimHash finds most links: sets whose fingerprints differ
in few bits meet through buckets and pivot distance tables, and those of similarity 4/5 or more, by
their whole texts, are linked. At that similarity fingerprints may differ in ten bits and more, which
buckets can't tell from chance; so sets meet in another way too, by which no link is missed: of two
sets that may link, the first fifth (and one) of
the shingles in any order common to all has one in common (prefix filter), so sets meet under those
shingles; the order puts shingles first that a sample of documents has seldom, which leaves less to
compare and changes no result. Sets that meet are compared by size and by counts of shingles in
bins, which bound the similarity from above, and survivors verified over their whole texts.

A first round verifies a forest of each meeting, a second all pairs that it left in different
components. Texts without words are one set, texts under five words have one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text, simhash_dedup
from ledgerlens.llm._graph import components
from ledgerlens.llm._spark import cut, in_chunks, join_dealt, map_texts, positional, renamed

#: Words of a shingle; sets link if their intersection is at least UP / DOWN of their sizes' sum (4/9: similarity 4/5).
SHINGLE, UP, DOWN = 5, 4, 9
#: Bins of a set's counts, sets of a chunk, sets of a meeting whose pairs are compared at once.
BINS, CHUNK, SMALL = 64, 2_048, 16
#: Documents and buckets of the table of frequent shingles.
SAMPLE, BUCKETS = 5_000, 1 << 20
#: Bins of the counts that are compared before whole texts are, and sets whose places may be broadcast.
FINE, FEW = 1_024, 1_000_000


def _words() -> np.ndarray:
    word = np.ones(256, bool)
    word[[0, 9, 10, 11, 12, 13, 32]] = False
    return word


WORDS = _text._table(_words())


def shingles(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted hashes of each row's different shingles."""
    for lo, hi, data, offsets in _text.pieces(column):
        low, starts, ends, first = _text.words(data, offsets, WORDS)
        h = _text.word_hash(low, starts, ends)
        grams = _text.gram_hash(h, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(grams[a : b - size + 1] if b - a >= size else _text.gram_hash(h[a:b], max(1, b - a)))


def frequent(docs: DataFrame) -> np.ndarray:
    """A rank of each bucket of shingles by how often a sample of docs (row, text) has it."""
    total = docs.count()
    if total > SAMPLE:
        docs = docs.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int((1 << 20) * SAMPLE / total))

    def run(batches):
        for batch in batches:
            found = list(shingles(batch.column(0)))
            bucket, n = np.unique((np.concatenate(found) if found else np.zeros(0, np.uint64)) % np.uint64(BUCKETS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    counts = map_texts(docs.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(BUCKETS, np.int64)
    seen[counts.column(0).to_numpy()] = counts.column(1).to_numpy()
    return np.log2(np.maximum(seen // 4, 1)).astype(np.uint8)


def _sets(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """row, set (a hash of the shingle set), fp (its SimHash), n, prefix and bins of docs with row and text."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        for batch in batches:
            ids, fps, sizes, prefixes, bins = [], [], [], [], []
            for h in shingles(batch.column(1)):
                n = len(h)
                order = np.lexsort((h, shared.value[(h % np.uint64(BUCKETS)).astype(np.int64)]))
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
                fps.append(simhash_dedup.majority(simhash_dedup.ones(h), n))
                sizes.append(n)
                prefixes.append(h[order[: n - -(-4 * n // 5) + 1]].view(np.int64))  # a link shares 4/5 of either set
                bins.append(np.bincount((h >> np.uint64(32)).astype(np.int64) % BINS, minlength=BINS).clip(max=65_535).astype(np.uint16).tobytes())  # counts cut off are nearer, so no pair is lost
            arrays = [batch.column(0), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "set", "fp", "n", "prefix", "bins"])

    return map_texts(docs.select("row", "text"), run, "row bigint, set bigint, fp bigint, n bigint, prefix array<bigint>, bins binary")


def _meeting(keyed: DataFrame) -> DataFrame:
    """The different rows (key, set) whose key another set has too."""
    keyed = keyed.repartition("key").sortWithinPartitions("key", "set")

    def run(batches):
        held = np.zeros((2, 0), np.int64)
        met = False  # whether the row held has a row with its key before it
        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns])), axis=1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)))]
            same = rows[0, 1:] == rows[0, :-1]
            before, after = np.concatenate(([met], same)), np.concatenate((same, [False]))
            keep = (before | after)[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in rows], names=["key", "set"])
            held, met = rows[:, -1:], bool(before[-1])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["key", "set"])

    return keyed.mapInArrow(run, "key bigint, set bigint")


def pairs_of(root: np.ndarray, n: np.ndarray, bins: np.ndarray, starts: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a meeting (rows from each start to the next; a last entry ends them) that may link and have different roots: all, or else a forest of large meetings."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def near(a, b):
        return (root[a] != root[b]) & (np.abs(bins[a] - bins[b]).sum(axis=-1) * DOWN <= (DOWN - 2 * UP) * (n[a] + n[b]))

    size = np.diff(starts)
    end = np.repeat(starts[1:], size)
    rows = np.flatnonzero(np.repeat(size <= SMALL, size))
    for step in range(1, SMALL):
        rows = rows[rows + step < end[rows]]
        if not len(rows):
            break
        ok = rows[near(rows, rows + step)]
        found.append((ok, ok + step))
    for i in np.flatnonzero(size > SMALL):
        rest = np.arange(starts[i], starts[i + 1])
        reached: list[int] = []
        while len(rest) > 1 or (len(rest) and reached):
            if not reached:
                reached, rest = [int(rest[0])], rest[1:]
            x = reached.pop()
            hit = near(np.full(len(rest), x), rest)
            found.append((np.full(int(hit.sum()), x), rest[hit]))
            if not every:
                reached += rest[hit].tolist()
                rest = rest[~hit]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _pairs(members: DataFrame, every: bool) -> DataFrame:
    """a < b: pairs of sets to verify, from members with key, set, root, n and bins."""
    members = members.select("key", "set", "root", "n", "bins").repartition("key").sortWithinPartitions("key", "set")

    def run(batches):
        held = None

        def out(table):
            key, ids, root, n = (table.column(c).to_numpy() for c in ("key", "set", "root", "n"))
            bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint16).reshape(-1, BINS).astype(np.int32)
            a, b = pairs_of(root, n, bins, np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))), every)
            a, b = ids[a], ids[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

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

    return members.mapInArrow(run, "a bigint, b bigint").where("a <> b").distinct()


def fine_bins(h: np.ndarray) -> bytes:
    """How many hashes there are, then counts of FINE bins, a byte each: every pair brings two of them through the shuffle."""
    counts = np.bincount((h >> np.uint64(32)).astype(np.int64) % FINE, minlength=FINE)
    return np.array([len(h)], np.int64).tobytes() + counts.clip(max=255).astype(np.uint8).tobytes()


def fine_near(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether sets with these fine bins (as bytes) may link; counts cut off are nearer, so no pair is lost."""
    n, a, b = int(x[:8].view(np.int64)[0]) + int(y[:8].view(np.int64)[0]), x[8:], y[8:]
    return int((np.maximum(a, b) - np.minimum(a, b)).sum()) * DOWN <= (DOWN - 2 * UP) * n


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a checkpoint) of similarity 4/5 or more, by the shingles of their whole texts; a first step looks at fine bins."""

    def hashed(pairs: DataFrame, fine: bool) -> tuple[DataFrame, DataFrame]:
        """set and h of the sets of pairs: counts in fine bins, or all hashes."""
        wanted = cut(rows.join(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set"))
        texts = docs.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, "row").select("set", "text")

        def run(batches):
            for batch in batches:
                for i, h in enumerate(shingles(batch.column(1))):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([fine_bins(h) if fine else h.tobytes()], pa.binary())], names=["set", "h"])

        found = map_texts(texts, run, "set bigint, h binary")
        return found.select(F.col("set").alias("a"), F.col("h").alias("x")), found.select(F.col("set").alias("b"), F.col("h").alias("y"))

    def compare(batches, fine):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint8 if fine else np.uint64) for v in (x, y))
                if fine:
                    keep.append(fine_near(x, y))
                else:
                    keep.append(len(np.intersect1d(x, y, assume_unique=True)) * DOWN >= UP * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for fine in (True, False):
        x, y = hashed(pairs, fine)
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
        pairs = cut(both.mapInArrow(lambda batches, fine=fine: compare(batches, fine), "a bigint, b bigint"))
    return pairs


def _by_simhash(ids: DataFrame) -> DataFrame:
    """a < b: pairs of sets (set, fp), enough for all links of their fingerprints."""
    fps = cut(ids.groupBy("fp").agg(F.min("set").alias("least"), F.count("*").alias("n")))
    links = simhash_dedup.links(fps, fps.count())
    links = links.join(fps.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    same = join_dealt(ids.select("set", "fp"), fps, ["fp"], ["set"]).select(F.col("least").alias("x"), F.col("set").alias("y"))
    return links.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest key (null keys last), the first such row.

    Rows are told apart by their place, so docs must be read alike each time, as tables are. Other
    columns may have any names.
    """
    doc, at = (f"_{docs.columns.index(c)}" for c in (key, text))
    docs, names = positional(docs)
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    texts = docs.select(F.col("_row").alias("row"), F.col(at).alias("text"))
    found = cut(_sets(texts, frequent(texts)))
    ids = cut(found.groupBy("set").agg(F.min("row").alias("row"), F.first("fp").alias("fp"), F.count("*").alias("copies")))
    rows = ids.select("set", "row")
    met = cut(in_chunks(cut(_meeting(found.select(F.explode("prefix").alias("key"), "set").select("key", "set"))), "set", CHUNK))
    sets = cut(found.select("row", "n", "bins").join(ids.join(met.select("set").distinct(), "set"), "row").select("set", "n", "bins", F.col("set").alias("root")))
    members = met.join(sets, "set")
    tried = cut(_by_simhash(ids).unionByName(_pairs(members, False)).distinct())
    links = _verified(tried, texts, rows)
    roots = components(links).select(F.col("node").alias("set"), "root")
    members = members.drop("root").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    links = links.unionByName(_verified(cut(_pairs(members, True).join(tried, ["a", "b"], "left_anti")), texts, rows))
    roots = components(links).select(F.col("node").alias("set"), "root")
    named = ids.select("set", "copies").join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "copies")
    keyed = docs.select("_row", F.col(doc).alias("_key")).join(found.select(F.col("row").alias("_row"), "set"), "_row")
    first = F.min(F.struct(F.col("_key").isNull(), "_key", "_row")).alias("_first")
    kept = join_dealt(keyed, cut(named), ["set"], ["_row"], n="copies").groupBy("root").agg(first).select(F.col("_first._row").alias("_row"))
    return renamed(docs.join(kept, "_row", "left_semi"), names)
