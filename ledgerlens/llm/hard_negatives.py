"""Hard negatives by norm-bucketed search with Cauchy-Schwarz bounds.

Anchors are rows that a condition names. An anchor's positives are its `positives` best other rows of
the same label; its hard negatives for a positive are the best rows of other labels whose score lies
in the window from `low` hundredths of the positive's score up to that score. A score is the inner
product of the vectors with each component x as floor(scale * x), so it is a whole number and exact.
Higher scores come first, ties by the smaller id.

Candidates are sorted by norm and cut into blocks, and these into buckets of `BUCKET` rows. No row of
a bucket scores more than the anchor's norm times the bucket's largest one. A bucket is left out for
an anchor if that is less than what a row must reach: the running k-th score of its positives; or, for
negatives, the least over its windows of the window's lower limit and the window's running k-th score.
The first block, of the largest norms, is searched first for all anchors: the k-th scores that it
gives, and the lower limits, decide which further blocks an anchor is sent to. As the norms fall, these
are the first so many, found by bisection. In a block an anchor's search ends at the first bucket that
can't reach.

Each block is a task for each pack of `PACK` anchors, which are streamed past it: a task holds a block
of `BLOCK` vectors and a batch of anchors, whatever the numbers of both. Anchors are a stated query
set against all rows; no pair of rows is ever a row of a table unless it scores.

Rows with a null id, label, vector or component, or with one that isn't finite, take no part, nor do
vectors of another length than most, or so long that a square doesn't fit a long. Zero vectors take
part. A row that repeats id, label and vector counts once; an id with several of these is several
rows. An anchor without positives, or whose positive's score is negative, has no negatives. An empty
table has none. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm._order import ranked
from ledgerlens.llm._spark import cut, quoted

#: Rows of a bucket, of a block and of a pack of anchors; anchors that are multiplied at a time.
BUCKET, BLOCK, PACK, BATCH = 512, 32_768, 65_536, 1_024
#: Products of norms up to which sums of doubles are exact.
EXACT = float(1 << 53)


def usable(rows: DataFrame, anchor: Column, id_column: str, label: str, vector: str, scale: int) -> DataFrame:
    """id, label, vector: array<bigint>, square: its inner product with itself, and is_anchor, of the rows that take part."""
    of = lambda c: F.col(quoted(c)[0])
    rows = rows.select(of(id_column).cast("bigint").alias("id"), of(label).cast("bigint").alias("label"), of(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    scaled = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)).cast("double")))
    long = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale))
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < 3e9)) & (long < 9e18)
    rows = rows.where(fits).select("id", "label", scaled.alias("vector"), "is_anchor").distinct()
    return rows.withColumn("square", F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, x: a + x * x))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k best of their row; by row, best first."""
    order = np.lexsort((ids, -scores, rows))
    begin = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - begin < k]


class Block:
    """Vectors by falling norm, in buckets."""

    def __init__(self, pos: np.ndarray, ids: np.ndarray, labels: np.ndarray, squares: np.ndarray, vectors: np.ndarray):
        self.pos, self.ids, self.labels, self.vectors = pos, ids, labels, vectors
        self.norms = np.sqrt(squares.astype(np.float64)) * (1 + 1e-9)
        self.double = vectors.astype(np.float64)

    def scores(self, anchors: np.ndarray, norms: np.ndarray, lo: int, hi: int) -> np.ndarray:
        if norms.max(initial=0) * self.norms[lo] < EXACT:
            return (anchors.astype(np.float64) @ self.double[lo:hi].T).astype(np.int64)
        return anchors @ self.vectors[lo:hi].T

    def search(self, anchors: np.ndarray, norms: np.ndarray, pos: np.ndarray, labels: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, place in the block, score) of the k best of each window, given by its row of `anchors`, limits and a k-th score known so far."""
        need = np.maximum(low, kth)
        found = np.zeros((3, 0), np.int64)
        for lo in range(0, len(self.ids), BUCKET):
            hi = min(lo + BUCKET, len(self.ids))
            open_ = norms[row] * self.norms[lo] >= need
            if not open_.any():  # nor can any later bucket reach
                break
            asked = np.unique(row[open_])
            s = self.scores(anchors[asked], norms[asked], lo, hi)
            alike = labels[asked][:, None] == self.labels[lo:hi]
            fits = (alike if same else ~alike) & (pos[asked][:, None] != self.pos[lo:hi])
            least, most = np.full(len(anchors), np.iinfo(np.int64).max), np.full(len(anchors), np.iinfo(np.int64).min)
            np.minimum.at(least, row[open_], need[open_])
            np.maximum.at(most, row[open_], high[open_])
            r, c = np.nonzero(fits & (s >= least[asked][:, None]) & (s <= most[asked][:, None]))
            values = s[r, c]
            r = asked[r]
            windows = np.flatnonzero(open_)
            windows = windows[np.argsort(row[windows], kind="stable")]
            a, b = np.searchsorted(row[windows], r), np.searchsorted(row[windows], r, "right")
            entry = np.repeat(np.arange(len(r)), b - a)
            w = windows[np.arange(len(entry)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
            fits = (values[entry] >= need[w]) & (values[entry] <= high[w])
            found = np.concatenate((found, np.stack((w[fits], c[entry[fits]] + lo, values[entry[fits]]))), axis=1)
            found = found[:, best(found[0], found[2], self.ids[found[1]], k)]
            full, at = np.flatnonzero(np.bincount(found[0], minlength=len(row)) == k), np.searchsorted(found[0], np.arange(len(row)), "right") - 1
            need[full] = np.maximum(need[full], found[2][at[full]])
        return found[0], found[1], found[2]


def _searched(vectors: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, slot, id and score: the k best of each window within each block that the anchor is sent to.

    asked: anchors (pos, pack, label, square, vector) with windows: array of slot, low, high and kth, and blocks: array.
    """
    wanted = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    asked = asked.withColumn("block", F.explode("blocks"))
    needed = asked.select("block", "pack").distinct()
    no = F.lit(None).cast("array<struct<slot:int,low:bigint,high:bigint,kth:bigint>>")
    left = vectors.join(needed, "block").select("block", "pack", F.lit(0).alias("kind"), "pos", "id", "label", "square", "vector", no.alias("windows"))
    right = asked.select("block", "pack", F.lit(1).alias("kind"), "pos", "id", "label", "square", "vector", "windows")
    both = left.unionByName(right).repartition(wanted, "block", "pack").sortWithinPartitions("block", "pack", "kind", "pos")
    names = both.columns

    def answers(block: Block, table: pa.Table):
        for lo in range(0, len(table), BATCH):
            part = table.slice(lo, BATCH).combine_chunks()
            get = {c: part.column(c).combine_chunks() for c in ("pos", "label", "square", "vector", "windows")}
            windows = get["windows"]
            flat = windows.flatten()
            slot, low, high, kth = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            row = np.repeat(np.arange(len(part)), windows.value_lengths().to_numpy(zero_copy_only=False))
            pos = get["pos"].to_numpy()
            w, c, s = block.search(_matrix(get["vector"]), np.sqrt(get["square"].to_numpy().astype(float)), pos, get["label"].to_numpy(), row, low, high, kth, same, k)
            yield pa.RecordBatch.from_arrays([pa.array(pos[row[w]], pa.int64()), pa.array(slot[w], pa.int32()), pa.array(block.ids[c], pa.int64()), pa.array(s, pa.int64())], names=["anchor", "slot", "id", "score"])

    def run(batches):
        at, held, block = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch]).rename_columns(names)
            key = np.stack([table.column(c).to_numpy() for c in ("block", "pack", "kind")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(table)]):
                if lo == hi:
                    continue
                part, now = table.slice(lo, hi - lo), tuple(key[:, lo].tolist())
                if now[2] == 0:
                    if now != at:
                        held = []
                    held.append(part)
                    at, block = now, None
                    continue
                if block is None:
                    whole = pa.concat_tables(held).combine_chunks()
                    get = [whole.column(c).combine_chunks() for c in ("pos", "id", "label", "square")]
                    block, held = Block(*(c.to_numpy() for c in get), _matrix(whole.column("vector").combine_chunks())), []
                yield from answers(block, part)

    return both.mapInArrow(run, "anchor bigint, slot int, id bigint, score bigint")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """With rank (from 1): the k best of each window over all blocks."""
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score; low in hundredths."""
    spark = rows.sparkSession
    known = cut(usable(rows, anchor, id_column, label, vector, scale))
    size = known.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    known = ranked(known.where(F.size("vector") == (size[0]["d"] if size else 0)), [], [F.desc("square"), "id", "label", "vector"])
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = size[0]["count"] if size else 0
    width = -(-n // max(1, -(-n // BLOCK), min(wanted, -(-n // 1024)))) or 1
    known = cut(known.drop("n").withColumn("block", F.floor(F.col("pos") / width).cast("int")))
    tops = np.array([r[1] for r in known.groupBy("block").agg(F.max("square")).orderBy("block").collect()], np.float64)
    norms = np.sqrt(tops) * (1 + 1e-9)  # a number for each BLOCK rows
    n_packs = -(-known.where("is_anchor").count() // PACK) or 1
    anchors = known.where("is_anchor").select("pos", "id", "label", "square", "vector", F.floor(F.col("pos") * n_packs / max(n, 1)).cast("int").alias("pack"))  # by norm, as blocks are

    def sent(asked: DataFrame, first: bool) -> DataFrame:
        """With blocks: the first one, or those further ones that may reach what one of the windows needs."""
        if first:
            return asked.withColumn("blocks", F.array(F.lit(0)))
        need = F.array_min(F.transform("windows", lambda w: F.greatest(w["low"], w["kth"])))

        def run(batches):
            for batch in batches:
                norm, need = np.sqrt(batch.column(0).to_numpy().astype(float)), batch.column(1).to_numpy().astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where(need <= 0, -1.0, np.where(norm > 0, need / np.maximum(norm, 1e-300), np.inf))
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(len(norms) - np.searchsorted(norms[::-1], least), pa.int32())], names=[*batch.schema.names[2:], "reach"])

        kinds = "".join(f"_{c} {t}, " for c, t in asked.dtypes)
        reached = asked.select("square", need.alias("need"), *(F.col(c).alias(f"_{c}") for c in asked.columns)).mapInArrow(run, f"{kinds}reach int")
        reached = reached.select(*(F.col(f"_{c}").alias(c) for c in asked.columns), "reach")
        return reached.where("reach > 1").withColumn("blocks", F.sequence(F.lit(1), F.col("reach") - 1)).drop("reach")

    def search(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best of all windows: the first block for all, then the others for those anchors that they may have something for."""
        early = cut(_merged(_searched(known, sent(asked, True), same, k), k))
        kth = early.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        better = F.transform("windows", lambda w: w.withField("kth", F.coalesce(F.greatest(w["kth"], F.col("reached")[w["slot"]]), w["kth"])))
        later = asked.join(kth, F.col("pos") == F.col("anchor"), "left").withColumn("windows", better).drop("reached", "anchor")
        rest = _searched(known, sent(later, False), same, k)
        return cut(_merged(early.drop("rank").unionByName(rest), k))

    least, most = F.lit(-(1 << 63)).cast("bigint"), F.lit((1 << 63) - 1).cast("bigint")
    window = lambda slot, low, high: F.struct(slot.cast("int").alias("slot"), low.alias("low"), high.alias("high"), least.alias("kth"))
    near = search(anchors.withColumn("windows", F.array(window(F.lit(0), least, most))), True, positives)
    near = near.where("score >= 0").select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    limit = F.expr(f"cast(ceil(cast(positive_score as decimal(38,0)) * {low} / 100) as bigint)")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(window(F.col("slot"), limit, F.col("positive_score")))).alias("windows"))
    far = search(anchors.join(windows, F.col("pos") == F.col("anchor")).drop("anchor"), False, negatives)
    found = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near, ["anchor", "slot"]).join(anchors.select(F.col("pos").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
