"""The Merkle manifest against trees built level by level, and its proofs against changed rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import merkle_manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    found = []
    for level in levels[:-1]:
        at = i - i % 3
        found.append(("".join(level[at:i]), "".join(level[i + 1 : at + 3])))
        i //= 3
    return found


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 100, 242, 243])
@pytest.mark.parametrize("stratum", [1, 2, 3])
def test_traversal_of_a_block(monkeypatch, n, stratum):
    monkeypatch.setattr(merkle_manifest, "STRATUM", stratum)
    leaves = [digest(str(i)) for i in range(n)]
    for height in {merkle_manifest.levels(n), merkle_manifest.HEIGHT}:  # a group's only block, or its last one
        levels = tree(leaves)
        while len(levels) <= height:
            levels.append([digest(*levels[-1])])
        root, paths = merkle_manifest.traverse(leaves, height)
        assert root == levels[-1][0] and list(paths) == [path(levels, i) for i in range(n)]


def test_subtrees_are_bounded():
    leaves = [digest(str(i)) for i in range(3**8)]
    _, paths = merkle_manifest.traverse(leaves, 8)
    for _ in paths:
        held = [s for x in (paths.gi_frame.f_locals["now"], paths.gi_frame.f_locals["desired"]) for s in x]
        assert sum(len(level) for s in held for level in s.nodes) + sum(map(len, (w for s in held for w in s.waiting))) < 150


@pytest.mark.parametrize("height", [1, 5])
def test_manifest(spark, monkeypatch, height):
    monkeypatch.setattr(merkle_manifest, "HEIGHT", height)
    monkeypatch.setattr(merkle_manifest, "SIZE", 3**height)
    rows = [(i, ["b", "a", "é", None, ""][i % 5] if i < 60 else "hot", "en", i, f"text {i}\nünï") for i in range(150)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), (7, "a", "x", 1, ""), (7, "a", "x", 2, None), (9, "lone", "x", 1, "x" * 100_000), rows[100], rows[100]]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    extra = docs.withColumn("g", F.lit(1)).withColumn("Leaf", F.lit("x")).withColumn("pos", F.lit(2)).repartition(3)
    found = merkle_manifest.manifest(extra).collect()
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), digest(*map(said, r))))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([h for _, h in sorted(by[g])]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    wanted = []
    for at, g in enumerate(groups):
        for i, ((_, key), h) in enumerate(sorted(by[g])):
            wanted.append((h, trees[g][-1][0], top[-1][0], path(trees[g], i) + path(top, at)))
    assert sorted((r["leaf"], r["subroot"], r["root"], [(p["before"], p["after"]) for p in r["proof"]]) for r in found) == sorted(wanted)
    folded = merkle_manifest.manifest(docs).select(merkle_manifest.fold(F.col("leaf"), F.col("proof")).alias("f"), merkle_manifest.fold(F.sha2(F.lit("other"), 256), F.col("proof")).alias("o"), "root").collect()
    assert all(r["f"] == r["root"] != r["o"] for r in folded)
    assert merkle_manifest.manifest(docs.where("doc_id = -1")).count() == 0
