"""Nearest neighbours by multi-index hashing: learned binary codes, pigeonhole probing, exact rerank.

Rotations learned from a bounded sample turn vectors into binary codes, of which substrings of
`SUBSTRING` bits are indexed. Codes within Hamming distance r of a query agree with it up to `r // m`
bits in at least one of m substrings, so probing the index of each substring with all values that
near retrieves every such code. What it retrieves is reranked by the inner product of the original
vectors, in double precision.

The radius is each query's own. First all are searched within a narrow radius, `FLIPS` bits to a
substring. A query is done if its k-th score is one that vectors beyond that radius don't reach, which
the sample tells; so it is for vectors that have near ones, and this round is left out if the sample
has none. The others are searched within the radius that holds nearly all of the sample's neighbours
of such queries, and those few that find fewer than k vectors there, without a radius. Where probing would visit more codes than a block has,
as at wide radii, the codes are compared directly: the same ones are found.

Equal vectors are indexed once, with the smallest of their ids. Vectors are dealt into blocks, each
of which is sent out once a round for every `QUERIES` queries; a task indexes a block and has the
queries streamed past it.

Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows with a null id. A row that repeats an id and its vector counts
once; an id with several vectors is as near as the nearest of them, and asks with each. Ties go to
the smaller id. With fewer than k candidates all are returned.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._spark import cut

#: Bits of codes, bits of a substring, vectors that the rotations are learned from and turns of learning each.
BITS, SUBSTRING, SAMPLE, TURNS = 256, 16, 8_192, 12
#: Share of the sample's true neighbours that the wide radius holds, the sample's queries, and bits of a substring that may differ at first.
HELD, SAMPLE_QUERIES, FLIPS = 0.985, 512, 1
#: Vectors and queries of a block at most, and bytes of the sample.
BLOCK, QUERIES, SAMPLE_BYTES = 32_768, 65_536, 64 << 20


@dataclass
class Code:
    """Rotations side by side, the narrow and the wide radius, the score (over the query's norm) that vectors beyond the narrow one don't reach, and whether neighbours of the sample reach it."""

    mean: np.ndarray
    rotation: np.ndarray
    narrow: int
    wide: int
    reach: float
    near: bool = True

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of substrings."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1).view(np.uint16)


def _wide(codes: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), np.uint16)
    padded[:, : codes.shape[1]] = codes
    return padded.view(np.uint64)


def hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ query).sum(axis=1)


def learn(x: np.ndarray, k: int, bits: int = BITS) -> Code:
    """Principal axes turned by iterative quantisation, from as many starts as give the bits, and radii that hold the sample's neighbours."""
    bits = max(SUBSTRING, bits // SUBSTRING * SUBSTRING)
    narrow = bits // SUBSTRING * (FLIPS + 1) - 1
    if not len(x):
        return Code(np.zeros(1), np.zeros((1, bits)), narrow, bits, np.inf)
    mean = x.mean(axis=0)
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    rng, turns, d = np.random.default_rng(5), [], x.shape[1]
    while sum(t.shape[1] for t in turns) < bits:
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(TURNS):
            left, _, right = np.linalg.svd(v.T @ np.where(v @ turn > 0, 1.0, -1.0))
            turn = left @ right
        turns.append(axes @ turn)
    code = Code(mean, np.concatenate(turns, axis=1)[:, :bits], narrow, bits, np.inf)
    packed = _wide(code.encode(x))
    beyond, away, least = [], [], []
    for i in range(min(len(x), SAMPLE_QUERIES)):
        near = x @ x[i]
        near[i] = -np.inf
        far = hamming(packed, packed[i])
        best = np.argsort(-near, kind="stable")[: min(k, len(x) - 1)]
        norm = np.linalg.norm(x[i])
        beyond.append(near[far > narrow].max(initial=-np.inf) / norm)
        away.append(far[best])
        least.append(near[best].min(initial=np.inf) / norm)
    code.reach = float(np.quantile(beyond, HELD, method="higher"))
    rest = [a for a, s in zip(away, least) if s <= code.reach and len(a)]
    code.near = len(rest) < len(least)
    if rest:
        code.wide = int(np.quantile(np.concatenate(rest), HELD, method="higher"))
    return code


def flips(most: int) -> np.ndarray:
    """What to change of a substring's value for all values up to so many bits away."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in itertools.combinations(range(SUBSTRING), n)], np.uint16)


class Index:
    """For each substring, the rows of a block ordered by its value."""

    def __init__(self, code: Code, x: np.ndarray):
        self.code, self.x = code, x
        self.codes = code.encode(x)
        self.packed = _wide(self.codes)
        self.order = np.argsort(self.codes, axis=0, kind="stable").T
        self.values = np.take_along_axis(self.codes.T, self.order, axis=1)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within the radius of the query's, by pigeonhole probing."""
        code = self.code.encode(query[None])
        if radius // code.shape[1] <= FLIPS and len(self.x):
            change = flips(radius // code.shape[1])
            parts, visits = [], 0
            for values, order, part in zip(self.values, self.order, code[0]):
                lo, hi = np.searchsorted(values, change ^ part), np.searchsorted(values, change ^ part, "right")
                visits += int((hi - lo).sum())
                parts += [order[a:b] for a, b in zip(lo[lo < hi], hi[lo < hi])]
            if visits < len(self.x):
                rows = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
                return rows[hamming(self.packed[rows], _wide(code)[0]) <= radius]
        return np.flatnonzero(hamming(self.packed, _wide(code)[0]) <= radius)


def top(index: Index, ids: list[list[int]], query: np.ndarray, own: int, radius: int, k: int) -> tuple[list[int], list[float]]:
    """The k nearest ids but the query's own among rows within the radius, nearest first."""
    rows = index.within(query, radius)
    scores = (index.x[rows] * query).sum(axis=1)
    if len(rows) > k + 1:  # the own vector may be among them
        least = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        rows, scores = rows[scores >= least], scores[scores >= least]
    best: dict[int, float] = {}
    for s, r in zip(scores.tolist(), rows.tolist()):
        for i in ids[r]:
            if i != own and best.get(i, -np.inf) < s:
                best[i] = s
    pairs = sorted((-s, i) for i, s in best.items())[:k]
    return [i for _, i in pairs], [-s for s, _ in pairs]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id: bigint, and vector: array<double>, of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.select(F.col(id_column).cast("bigint").alias("id"), v.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda c: c != 0))
    # adding 0 turns -0.0 into 0.0, which groups with it
    return rows.select("id", F.transform("vector", lambda c: c + F.lit(0.0)).alias("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector, and ids: the k + 1 smallest ids that have it (no query needs more)."""

    def few(batches):
        for batch in batches:
            by: dict[tuple, set[int]] = {}
            where: dict[tuple, int] = {}
            ids = batch.column(0).to_pylist()
            vectors = batch.column(1)
            for i in range(batch.num_rows):
                v = vectors[i].values.to_numpy().tobytes()
                by.setdefault(v, set()).add(ids[i])
                where.setdefault(v, i)
            least = [sorted(x)[: k + 1] for x in by.values()]
            yield pa.RecordBatch.from_arrays([vectors.take(pa.array(list(where.values()), pa.int32())), pa.array(least, pa.list_(pa.int64()))], names=["vector", "ids"])

    parts = rows.mapInArrow(few, "vector array<double>, ids array<bigint>")
    return parts.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def _search(vectors: DataFrame, queries: DataFrame, code: Code, radius: int, k: int, n_blocks: int, n_packs: int) -> DataFrame:
    """The k best of each query within each block, as one row for each query and block."""
    spark = vectors.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    shared = spark.sparkContext.broadcast((code.mean, code.rotation, code.narrow, code.wide, code.reach))
    none = F.lit(None)
    left = vectors.select(F.pmod(F.xxhash64("vector"), F.lit(n_blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack"), F.lit(0).alias("kind"), "vector", "ids", none.cast("bigint").alias("id"))
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(n_packs)).cast("int").alias("pack"), F.lit(1).alias("kind"), "vector", none.cast("array<bigint>").alias("ids"), "id")
    both = left.unionByName(right).repartition(wanted, "block", "pack").sortWithinPartitions("block", "pack", "kind")
    names = both.columns

    def run(batches):
        at, held, index, ids = None, [], None, []
        for batch in batches:
            table = pa.Table.from_batches([batch]).rename_columns(names)
            key = np.stack([table.column(c).to_numpy() for c in ("block", "pack", "kind")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(table)]):
                if lo == hi:
                    continue
                part, (block, pack, kind) = table.slice(lo, hi - lo), key[:, lo].tolist()
                if (block, pack) != at:  # queries whose block has no vectors find none
                    at, held, index = (block, pack), [], None
                if not kind:
                    held.append(part)
                    continue
                if index is None:
                    if not held:
                        continue
                    whole = pa.concat_tables(held).combine_chunks()
                    index, ids, held = Index(Code(*shared.value), _matrix(whole.column("vector").combine_chunks())), whole.column("ids").to_pylist(), []
                out: tuple[list, list, list] = ([], [], [])
                for own, query in zip(part.column("id").to_pylist(), _matrix(part.combine_chunks().column("vector").combine_chunks())):
                    found, scores = top(index, ids, query, own, radius, k)
                    if found:
                        for column, value in zip(out, (own, found, scores)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])

    return both.mapInArrow(run, "query_id bigint, ids array<bigint>, scores array<double>")


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id and hits: its k best over all blocks."""
    hits = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct((-x["scores"]).alias("away"), x["ids"].alias("vec_id")))
    every = F.array_sort(F.flatten(F.collect_list("hits")))
    none = F.array().cast("array<struct<away:double,vec_id:bigint>>")
    # an id with several vectors is there once, with the nearest of them
    merged = F.aggregate(every, none, lambda kept, x: F.when((F.size(kept) >= k) | F.exists(kept, lambda y: y["vec_id"] == x["vec_id"]), kept).otherwise(F.concat(kept, F.array(x))))
    return found.select("query_id", hits.alias("hits")).groupBy("query_id").agg(merged.alias("hits"))


def search(rows: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 20, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k nearest rows of each query but its own, by inner product."""
    spark = rows.sparkSession
    vectors = cut(distinct_vectors(usable(rows, id_column, vector), k))
    sizes = vectors.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).orderBy(F.desc("n"), "d").limit(1).collect()
    d, n, total = sizes[0] if sizes else (1, 0, 0)
    vectors = vectors.where(F.size("vector") == d)
    asked = cut(usable(queries, id_column, vector).where(F.size("vector") == d).dropDuplicates())
    n_asked = asked.count()
    sample = min(SAMPLE, SAMPLE_BYTES // (8 * d))
    few = vectors.select("vector", F.xxhash64("vector", F.lit(3)).alias("h")).orderBy("h", "vector").limit(sample).select("vector").toArrow()
    code = learn(_matrix(few.column(0).combine_chunks()) if len(few) else np.zeros((0, d)), k, bits)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n_blocks = max(1, -(-n // BLOCK), min(wanted, -(-n // 1024)))

    def found(queries: DataFrame, radius: int) -> DataFrame:
        """query_id and hits, and last: the k-th score over the query's norm (null with fewer hits)."""
        n_packs = max(1, -(-queries.count() // QUERIES))
        norm = queries.groupBy("id").agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"))
        best = _best(_search(vectors, queries, code, radius, k, n_blocks, n_packs), k).join(norm, F.col("query_id") == F.col("id")).drop("id")
        return cut(best.withColumn("last", F.when(F.size("hits") >= k, -F.element_at("hits", -1)["away"] / F.col("norm"))).drop("norm"))

    def but(queries: DataFrame, done: DataFrame) -> DataFrame:
        return cut(queries.join(done.select("query_id"), F.col("id") == F.col("query_id"), "left_anti"))

    if total <= 1 or not n_asked:
        best = found(asked, code.bits)
    else:
        parts = []
        if code.near:
            parts.append(found(asked, code.narrow).where(F.col("last") >= code.reach))
            asked = but(asked, parts[0])
        parts.append(found(asked, code.wide).where("last is not null"))
        asked = but(asked, parts[-1])
        best = reduce(DataFrame.unionByName, parts)
        if not asked.isEmpty():
            best = best.unionByName(found(asked, code.bits))
    hit = F.posexplode("hits").alias("rank", "hit")
    return best.select("query_id", hit).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.away")).alias("score"))
