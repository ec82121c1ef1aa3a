"""Hard negatives against all pairs, with ties, repeated rows, nulls and blocks of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives


def brute(rows, every, scale=256):
    known = {(i, label, tuple(int(np.floor(scale * float(x))) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)}
    found = []
    for a in known:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in known if b != a)
        near = [(-s, i) for s, i, label in scored if label == a[1]][:5]
        for p, i in near:
            far = [(-s, j) for s, j, label in scored if label != a[1] and 80 * p <= -100 * s <= 100 * p][:5]
            found += [(a[0], i, rank, j, p, s) for rank, (s, j) in enumerate(far, 1)]
    return sorted(found)


@pytest.mark.parametrize("bucket, block, pack, batch", [(512, 32_768, 65_536, 1_024), (3, 20, 4, 2)])
def test_hard_negatives(spark, monkeypatch, bucket, block, pack, batch):
    for name, value in zip(("BUCKET", "BLOCK", "PACK", "BATCH"), (bucket, block, pack, batch)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(10, 8))
    rows = [(i, int(i % 4), (base[i % 10] + 0.3 * rng.normal(size=8)) * rng.choice([0.2, 1, 3])) for i in range(300)]
    rows = [(i, label, np.round(v, 1).astype(np.float32).tolist()) for i, label, v in rows]
    rows += [(400 + i, i % 3, rows[10][2]) for i in range(12)]  # ties
    rows += [rows[20], rows[20], (None, 1, rows[1][2]), (600, None, rows[1][2]), (601, 1, None), (602, 1, [None] * 8), (603, 1, [float("nan")] * 8), (604, 1, [float("inf")] * 8), (605, 1, [1.0]), (620, 2, [0.0] * 8), (640, 77, rows[1][2])]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumn("pos", F.lit(1)).withColumn("Block", F.lit("x"))
    found = hard_negatives.mine(table.repartition(3), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 20) and len(found) > 100
    assert hard_negatives.mine(table.where("vec_id = -1"), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_are_exact():
    vectors = np.array([[1 << 30, 3], [1 << 30, 5]], np.int64)
    block = hard_negatives.Block(np.arange(2), np.arange(2), np.zeros(2, int), (vectors**2).sum(axis=1), vectors)
    assert block.scores(vectors, np.sqrt((vectors.astype(float) ** 2).sum(axis=1)), 0, 2).tolist() == [[(1 << 60) + 9, (1 << 60) + 15], [(1 << 60) + 15, (1 << 60) + 25]]


def test_buckets_that_cannot_reach_are_left_out(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 10)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(200, 4)) * 100).astype(np.int64)
    squares = (vectors**2).sum(axis=1)
    order = np.argsort(-squares, kind="stable")
    vectors, squares = vectors[order], squares[order]
    block = hard_negatives.Block(np.arange(200), np.arange(200), np.zeros(200, int), squares, vectors)
    seen = []
    scores = block.scores
    block.scores = lambda a, n, lo, hi: seen.append(lo) or scores(a, n, lo, hi)
    row, limit = np.zeros(1, int), np.full(1, np.iinfo(np.int64).min)
    _, at, s = block.search(vectors[:1], np.sqrt(squares[:1].astype(float)), np.array([0]), np.array([0]), row, limit, np.full(1, np.iinfo(np.int64).max), limit, True, 5)
    true = np.argsort(-(vectors @ vectors[0])[1:], kind="stable")[:5] + 1
    assert at.tolist() == true.tolist() and len(seen) < 20
