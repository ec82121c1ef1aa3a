"""Merkle manifest of a table: authentication paths by fractal traversal, upper proofs by joins.

A leaf is the SHA-256 of a row's fields, each `-` if null, else its length in UTF-8 bytes, `:` and
its value. The leaves of a group (null is one, and the first), ordered by a key (nulls first, ties by
the leaf), form a tree in which every 3 consecutive nodes, the last ones of a level maybe fewer,
become the hash of their digests as hex text, until one is left: the group's subroot. The subroots,
in the order of their groups, likewise give the root. A proof lists level by level what stands before
and after the own node in its run, from the leaf to the root; `fold` computes the root from it.

Leaves get their places by a range sort over all tasks and are dealt in aligned blocks of
3 ** HEIGHT. In each block a fractal traversal emits the paths one after the other: the block's levels
are cut into strata of `STRATUM` levels, and each stratum keeps the existing subtree that the current
leaf stands under and the desired one that comes next, which grows by one leaf a step and is complete
when it is needed. What is kept is two subtrees of 3 ** STRATUM leaves for each stratum, whatever the
block's height. Block roots are the leaves of the next round, until each group has one root; then the
paths of blocks are joined to those of their nodes, downwards, so that no join has more rows of a key
than a block has nodes.

Rows that are equal in all fields have equal leaves and stand next to each other; each has its own
proof. Null and empty texts are told apart by the field's form. Very long texts are hashed on the
executors and go no further than their task. An empty table has an empty manifest. Other columns may
have any names; only those asked for are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm._order import ranked
from ledgerlens.llm._spark import cut, quoted

#: Nodes of a run, levels of a block and of a subtree of the traversal.
SIDE, HEIGHT, STRATUM = 3, 5, 2
SIZE = SIDE**HEIGHT
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, digest, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from leaf to root, each run's from left to right, in one text."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run["before"], run["after"])), "")


def levels(n: int) -> int:
    """Levels above n leaves until one node is left."""
    found = 0
    while n > 1:
        n, found = -(-n // SIDE), found + 1
    return found


class Subtree:
    """The nodes of levels bottom to top - 1 under one node of level `top`, made from its leaves one by one."""

    __slots__ = ("bottom", "top", "nodes", "waiting", "root")

    def __init__(self, bottom: int, top: int):
        self.bottom, self.top = bottom, top
        self.nodes: list[dict[int, str]] = [{} for _ in range(top - bottom)]
        self.waiting: list[list[str]] = [[] for _ in range(top)]
        self.root = ""

    def feed(self, i: int, digest: str, last: bool) -> None:
        """Leaf i of the block; the last one of the block closes all runs above it."""
        for level in range(self.top):
            if level >= self.bottom:
                self.nodes[level - self.bottom][i] = digest
            run = self.waiting[level]
            run.append(digest)
            if len(run) < SIDE and not last:
                return
            digest = sha256("".join(run).encode()).hexdigest()
            run.clear()
            i //= SIDE
        self.root = digest


def traverse(leaves: list[str], height: int) -> tuple[str, Iterator[list[tuple[str, str]]]]:
    """The root of a block's leaves and, one after the other, their paths: (before, after) for each level."""
    n = len(leaves)
    strata = [(low, min(low + STRATUM, height)) for low in range(0, height, STRATUM)]
    existing = [Subtree(*s) for s in strata]
    for subtree in existing:
        for i in range(min(n, SIDE**subtree.top)):
            subtree.feed(i, leaves[i], i == n - 1)

    def paths() -> Iterator[list[tuple[str, str]]]:
        now = list(existing)
        desired = [Subtree(*s) for s in strata[:-1]]
        path = [("", "")] * height
        for i in range(n):
            for subtree in now:
                for level in range(subtree.bottom, subtree.top):
                    at, below = divmod(i, SIDE**level)
                    if below:  # the node above hasn't changed, nor have those further up
                        break
                    nodes, own = subtree.nodes[level - subtree.bottom], at % SIDE
                    run = [nodes.get(at - own + k, "") for k in range(SIDE)]
                    path[level] = "".join(run[:own]), "".join(run[own + 1 :])
            yield list(path)
            for s, subtree in enumerate(desired):
                width = SIDE**subtree.top
                if i + width < n:
                    subtree.feed(i + width, leaves[i + width], i + width == n - 1)
                if (i + 1) % width == 0:
                    now[s], desired[s] = subtree, Subtree(*strata[s])

    return (existing[-1].root if height else leaves[0]), paths()


def _traversed(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, n, digest and others) with their path in their block and, at a block's first node, the block's root as `top`."""
    wanted = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    at = {c: i for i, c in enumerate(nodes.columns)}

    def blocks(table: pa.Table) -> pa.RecordBatch:
        starts = [i for i, p in enumerate(table.column(at["pos"]).to_pylist()) if p % SIZE == 0]
        digests, sizes = table.column(at["digest"]).to_pylist(), table.column(at["n"]).to_pylist()
        before, after, first, tops = [], [], [0], [None] * table.num_rows
        for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
            tops[lo], paths = traverse(digests[lo:hi], min(HEIGHT, levels(sizes[lo])))
            for path in paths:
                for b, a in path:
                    before.append(b)
                    after.append(a)
                first.append(len(before))
        runs = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], names=["before", "after"])
        columns = [c.combine_chunks() for c in table.columns]
        columns = [c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(first, pa.int32()), runs), pa.array(tops, pa.string())], names=[*table.column_names, "path", "top"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # of a block whose end hasn't come
        for batch in batches:
            starts = [i for i, p in enumerate(batch.column(at["pos"]).to_pylist()) if p % SIZE == 0]
            if starts and (held or starts[-1]):
                whole = pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                if whole.num_rows:
                    yield blocks(whole)
                held = []
            held.append(batch.slice(starts[-1]) if starts else batch)
        if held and (whole := pa.Table.from_batches(held)).num_rows:
            yield blocks(whole)

    dealt = nodes.repartition(wanted, "g", F.floor(F.col("pos") / SIZE)).sortWithinPartitions("g", "pos")
    kinds = ", ".join(f"{quoted(f.name)[0]} {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, path {PATH}, top string")


def climb(nodes: DataFrame, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes with their proofs: each group's tree is built in rounds of blocks, and what `crown` gives for the groups' roots comes down again.

    crown gets g and digest, a row for each group, and returns g, proof (from there on) and other
    columns, which all nodes of the group get.
    """
    rounds = []
    while True:
        done = cut(_traversed(nodes))
        rounds.append(done)
        most = done.agg(F.max("n")).first()[0] or 0
        nodes = done.where("top is not null").select("g", F.floor(F.col("pos") / SIZE).alias("pos"), F.ceil(F.col("n") / SIZE).alias("n"), F.col("top").alias("digest"))
        if most <= SIZE:
            break
    above = crown(nodes.select("g", "digest")).withColumn("_block", F.lit(0).cast("bigint"))
    for done in reversed(rounds):
        extra = [c for c in above.columns if c not in ("g", "_block", "proof")]
        rows = done.withColumn("_block", F.floor(F.col("pos") / SIZE)).join(above, ["g", "_block"])
        own = [c for c in done.columns if c not in ("path", "top", "n", "digest", *extra)] if done is not rounds[0] else [c for c in done.columns if c not in ("path", "top")]
        above = rows.select(*own, *extra, F.concat("path", "proof").alias("proof"))
        if done is not rounds[0]:
            above = above.withColumnRenamed("pos", "_block")
    return above


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "source", key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns `keep` (the key and the group, by default), leaf, subroot, root, and proof: array of before and after."""
    fields = FIELDS if fields is None else fields
    of = lambda c: F.col(quoted(c)[0])
    keep = {key: of(key), group: of(group)} if keep is None else keep
    kept = [v.alias(f"_k{i}") for i, v in enumerate(keep.values())]
    named = F.coalesce(F.concat(F.lit("="), of(group).cast("string")), F.lit("-"))  # null comes first, and equals itself
    leaves = cut(docs.select(*kept, of(key).alias("_order"), named.alias("g"), leaf([of(c) for c in fields]).alias("digest"), F.monotonically_increasing_id().alias("_tie")))
    leaves = ranked(leaves, ["g"], ["_order", "digest", "_tie"]).drop("_tie", "_order")

    def crown(tops: DataFrame) -> DataFrame:
        groups = ranked(cut(tops), [], ["g"]).select(F.col("g").alias("_g"), F.lit("").alias("g"), "pos", "n", "digest")
        none = F.array().cast(PATH).alias("proof")
        found = climb(groups, lambda top: top.select("g", none, F.col("digest").alias("root")))
        return found.select(F.col("_g").alias("g"), "proof", F.col("digest").alias("subroot"), "root")

    found = climb(leaves, crown)
    return found.select(*(F.col(f"_k{i}").alias(name) for i, name in enumerate(keep)), F.col("digest").alias("leaf"), "subroot", "root", "proof")
