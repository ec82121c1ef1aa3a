"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._spark import HOT_ROWS, cut, join_dealt


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(edges: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            hi, lo = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    return edges.mapInArrow(run, "hi bigint, lo bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of the edges (two bigint columns) but the roots; the root is a component's smallest node.

    Alternates large-star steps (each node's larger neighbours go to its smallest neighbour) and
    small-star steps (its smaller ones do) until nothing changes; every step is a partial
    aggregation and a join, and is checkpointed.
    """
    a, b = edges.columns
    edges = cut(_local(edges.where(F.col(a) != F.col(b)).select(a, b)).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        state = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # the centre of a star has as many rows as the star
        centred = join_dealt(both.where("v > u"), least, ["u"], ["v"]) if now[0] > HOT_ROWS else both.where("v > u").join(least, "u")
        large = centred.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct())
