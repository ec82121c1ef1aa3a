"""Toxicity by a factorization machine over hashed terms.

A text is the set of its distinct terms: words (runs of letters, A-Z lower-cased) and their first
bytes, which stand for a stem before endings. Each is hashed to a feature. Besides a weight for each
feature the machine has a short vector for each; the inner product of two features' vectors is the
weight of their meeting in one text, so that an insult next to a mention of a group can weigh more
than the two alone.

Features are used if their frequency tells toxic rows from others, or if that of their meeting with
another one does, though neither does alone: thousands of chance weights would drown one insult in
a long text. Meetings of all features that don't tell anything alone are counted, in blocks of these
on the executors, and told by a likelihood ratio, which isn't misled by meetings in a few rows.

The machine is fitted on the driver to a bounded sample of labelled rows: at most `SAMPLE`, the first
by a hash of their key, and fewer if these have over `FEATURES` features, which is known before they
come to the driver. It takes the same number of steps at every size. Features are extracted, and all
rows scored, on the executors. Null and empty texts have no features and get the score of the base
rate; without labelled rows of both kinds, all texts get that score. Rows are scored one by one, so
ties and repeated rows give equal scores. Labels that are null or of rows that aren't there are
skipped; repeated labels weigh as often as they occur. Long texts are read in windows of about a
megabyte. Result columns take the place of columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import cut, map_texts, with_text, without
from ledgerlens.llm.language import LETTERS

#: Hash bits of features, length of their vectors, labelled rows and features of these that are learned from.
BITS, FACTORS, SAMPLE, FEATURES = 18, 4, 12_000, 16_000_000
#: Lengths of the beginnings of words that are terms, in bytes.
STEMS = (4, 5, 6)
STEPS, RATE, BATCH, DECAY, LEAST, CHANCE = 1_500, 0.2, 128, 1e-4, 3, 10.0
#: What a meeting must tell beyond chance (twice a log-likelihood ratio: there may be a thousand million of them), and features of a block.
PAIR_CHANCE, PAIR_BLOCK = 45.0, 512


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def features(column: pa.Array, used: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct features, first feature of each row) of runs of rows; of all features, or those used."""
    for lo, windows in groupby(_text.windows(column, LETTERS), itemgetter(0)):
        keyed = np.zeros(0, np.int64)
        for _, hi, data, offsets, _ in windows:  # several if the row is a long one, on its own
            low, starts, ends, first = _text.words(data, offsets, LETTERS)
            if not len(starts):
                continue
            sums = _text.prefix_hash(low)
            h = np.stack([_text.span_hash(sums, starts, ends), *(_text.mix(_text.span_hash(sums, starts, np.minimum(starts + k, ends)) + np.uint64(k)) for k in STEMS)])
            h = (h >> np.uint64(64 - BITS)).astype(np.int64)
            rows = np.broadcast_to(np.repeat(np.arange(hi - lo), np.diff(first)), h.shape)
            now = np.unique(h | (rows << BITS) if used is None else h[used[h]] | (rows[used[h]] << BITS))
            keyed = np.union1d(keyed, now) if len(keyed) else now
        yield lo, hi, keyed & ((1 << BITS) - 1), np.searchsorted(keyed, np.arange(hi - lo + 1) << BITS)


def _energy(m: Machine, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = m.vectors[at]
    total = _text.row_sums(v, first)
    pairs = 0.5 * ((total**2).sum(axis=1) - _text.row_sums((v * v).sum(axis=1), first))
    return m.bias + _text.row_sums(m.weights[at], first) + pairs, total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _apart(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """How far beyond chance the shares of two groups of rows are apart: squared deviates."""
    p = (toxic + other) / (n1 + n0)
    return (toxic / n1 - other / n0) ** 2 / np.maximum(p * (1 - p) * (1 / n1 + 1 / n0), 1e-12)


def _ratio(toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of two shares against a common one."""
    p = (toxic + other) / (n1 + n0)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-300)), 0)

    return 2 * (part(toxic, n1 * p) + part(other, n0 * p) + part(n1 - toxic, n1 * (1 - p)) + part(n0 - other, n0 * (1 - p)))


@dataclass
class Silent:
    """Features that tell nothing alone, in groups of those that stand in the same rows; the groups of each row, and the rows' labels."""

    ids: np.ndarray
    group: np.ndarray
    first: np.ndarray
    found: np.ndarray
    toxic: np.ndarray

    @property
    def blocks(self) -> int:
        return -(-self.groups // PAIR_BLOCK)

    @property
    def groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    def meeting(self, block: int) -> np.ndarray:
        """The features of a block whose meeting with another one tells something, and these others."""
        n1, n0 = int(self.toxic.sum()), int((~self.toxic).sum())
        n = self.groups
        lo, hi = block * PAIR_BLOCK, min((block + 1) * PAIR_BLOCK, n)
        row = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        mine = np.flatnonzero((self.found >= lo) & (self.found < hi))
        mine = mine[np.argsort(self.found[mine], kind="stable")]
        begin = np.searchsorted(self.found[mine], np.arange(lo, hi + 1))
        kept = np.zeros(n, bool)
        for f in range(hi - lo):
            rows = row[mine[begin[f] : begin[f + 1]]]
            both = []
            for of in (rows[self.toxic[rows]], rows[~self.toxic[rows]]):
                there = [self.found[self.first[r] : self.first[r + 1]] for r in of]
                both.append(np.bincount(np.concatenate(there), minlength=n) if there else np.zeros(n, np.int64))
            both[0][lo + f] = both[1][lo + f] = 0
            often = np.flatnonzero(both[0] + both[1] >= LEAST)
            telling = often[_ratio(both[0][often], both[1][often], n1, n0) >= PAIR_CHANCE]
            if len(telling):
                kept[telling] = kept[lo + f] = True
        return self.ids[kept[self.group]]


def alone(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, Silent]:
    """The features whose share among toxic rows differs from that among the others beyond chance, and the rest."""
    count = lambda of: np.bincount(np.concatenate([rows[i] for i in np.flatnonzero(of)]), minlength=1 << BITS)
    toxic, other = count(y > 0), count(y <= 0)
    often = toxic + other >= LEAST
    telling = often & (_apart(toxic, other, int((y > 0).sum()), int((y <= 0).sum())) >= CHANCE)
    n1, n0 = int((y > 0).sum()), int((y <= 0).sum())
    none = np.zeros_like(toxic)
    # the ratio is convex, so no meeting tells more than the most that its rows could: all toxic ones, all others, or all
    most = np.maximum.reduce([_ratio(toxic, none, n1, n0), _ratio(none, other, n1, n0), _ratio(toxic, other, n1, n0)])
    silent = often & ~telling & (toxic + other <= 0.9 * len(y)) & (most >= PAIR_CHANCE)
    ids = np.flatnonzero(silent)
    draw = np.random.default_rng(3).integers(0, 1 << 63, len(rows), dtype=np.uint64)
    where = np.zeros(1 << BITS, np.uint64)
    for r, x in zip(rows, draw):
        where[r] += x  # the features of a row are distinct
    _, first, group = np.unique(where[ids], return_index=True, return_inverse=True)
    compact = np.full(1 << BITS, -1, np.int32)
    compact[ids[first]] = np.arange(len(first))
    found = [compact[r][compact[r] >= 0] for r in rows]
    return np.flatnonzero(telling), Silent(ids, group, np.concatenate(([0], np.cumsum([len(r) for r in found]))), np.concatenate(found), y > 0)


def telling(rows: list[np.ndarray], y: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
    """The features whose share among toxic rows differs from that among the others beyond chance, alone or where two meet; meetings are counted on the executors, or here without a session."""
    known, silent = alone(rows, y)
    if spark is None:
        met = [silent.meeting(b) for b in range(silent.blocks)]
    else:
        shared = spark.sparkContext.broadcast((silent.ids, silent.group, silent.first, silent.found, silent.toxic))

        def run(batches):
            silent = Silent(*shared.value)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(silent.meeting(b), pa.int64())], names=["id"])

        blocks = spark.range(0, silent.blocks, numPartitions=max(1, silent.blocks)).mapInArrow(run, "id bigint")
        met = [blocks.distinct().toArrow().column(0).to_numpy()]
        shared.unpersist()
    return np.unique(np.concatenate([known, *met]).astype(np.int64))


def fit_arrays(rows: list[np.ndarray], y: np.ndarray, spark: SparkSession | None = None) -> Machine:
    """Log loss, by STEPS steps of AdaGrad over mini-batches, in an order that depends on the number of rows only."""
    m = Machine(0.0, np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32))
    rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
    m.bias = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return m
    rng = np.random.default_rng(7)
    ids = telling(rows, y, spark)
    often = np.zeros(1 << BITS, bool)
    often[ids] = True
    compact = np.full(1 << BITS, -1)
    compact[ids] = np.arange(len(ids))
    rows = [compact[r][often[r]] for r in rows]
    n = len(ids)
    small = Machine(m.bias, np.zeros(n), rng.normal(0, 0.02, (n, FACTORS)))
    seen_w, seen_v = np.full(n, 1e-2), np.full((n, FACTORS), 1e-1)
    order = np.zeros(0, np.int64)
    for _ in range(STEPS):
        if not len(order):
            order = rng.permutation(len(rows))
        part, order = order[:BATCH], order[BATCH:]
        first = np.concatenate(([0], np.cumsum([len(rows[i]) for i in part])))
        at = np.concatenate([rows[i] for i in part])
        z, total = _energy(small, at, first)
        miss = np.repeat(_sigmoid(z) - y[part], np.diff(first)) / len(part)
        used = np.bincount(at, minlength=n) > 0
        g = np.bincount(at, miss, n) + DECAY * small.weights * used
        seen_w += g * g
        small.weights -= RATE * g / np.sqrt(seen_w)
        pull = miss[:, None] * (np.repeat(total, np.diff(first), axis=0) - small.vectors[at])
        for f in range(FACTORS):
            g = np.bincount(at, pull[:, f], n) + DECAY * small.vectors[:, f] * used
            seen_v[:, f] += g * g
            small.vectors[:, f] -= RATE * 0.25 * g / np.sqrt(seen_v[:, f])
        small.bias -= 0.05 * float((_sigmoid(z) - y[part]).mean())
    m.bias, m.weights[ids], m.vectors[ids] = small.bias, small.weights, small.vectors
    return m


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, most: int = FEATURES) -> Machine:
    """Learns from labels whose rows are in docs, in the order of a hash of their key: at most `sample`, and as many as have `most` features in all."""
    draw = F.xxhash64(F.col("_key").cast("string"))
    marked = labels.select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_y")).where("_key is not null and _y is not null")
    marked = marked.withColumn("_draw", draw).orderBy("_draw", "_key", "_y").limit(sample)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(marked), "_key").select("_draw", F.col("_key").cast("string").alias("_key"), "_y", "_text")

    def run(batches):
        for batch in batches:
            for lo, hi, found, first in features(batch.column(3)):
                listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), listed], names=["draw", "key", "y", "features"])

    table = cut(map_texts(rows, run, "draw bigint, key string, y int, features array<int>"))
    size = table.groupBy("draw").agg(F.sum(F.size("features")).alias("n")).orderBy("draw")
    size = size.limit(sample).toArrow().to_pydict()
    end = int(np.searchsorted(np.cumsum(size["n"]), most, "right"))
    if end < len(size["n"]):
        table = table.where(F.col("draw") < size["draw"][end])
    known = table.toArrow().sort_by([("draw", "ascending"), ("key", "ascending"), ("y", "ascending")])
    return fit_arrays([np.asarray(x.values) for x in known.column("features")], known.column("y").to_numpy().astype(float), docs.sparkSession)


def score(docs: DataFrame, machine: Machine, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, by default), score and predicted."""
    keep = without(docs.columns if keep is None else keep, ["score", "predicted"])
    docs, kept = with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.vectors))

    def run(batches):
        machine = Machine(*shared.value)
        used = (machine.weights != 0) | machine.vectors.any(axis=1)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, found, first in features(batch.column(len(keep)), used):
                out[lo:hi] = _sigmoid(_energy(machine, found, first)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return map_texts(docs, run, f"{kept}score double, predicted int")
