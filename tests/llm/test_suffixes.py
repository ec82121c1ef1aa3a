"""Suffix-array dedup against counts of all strings, and its sort against sorted suffixes."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    found = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        first, _ = suffix_dedup.runs(gone)
        found.append((len(d), int(gone.sum()), len(first), bytes(x for x, g in zip(d, gone) if not g)))
    return found


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "a"])
def test_two_stage_sort(letters):
    deal = random.Random(3)
    length = 12
    parts = ["".join(deal.choices(letters, k=deal.randrange(12, 40))).encode() for _ in range(60)]
    text = np.frombuffer(b"\xff".join([*parts, b"\xff" * 40]), np.uint8)
    wanted = np.zeros(len(text), bool)
    at = 0
    for p in parts:
        wanted[at : at + len(p) - length + 1] = True
        at += len(p) + 1
    order = suffix_dedup.suffix_array(text, wanted, length)
    said = text.tobytes()
    assert sorted(order) == np.flatnonzero(wanted).tolist()
    keys = [said[i : i + length] for i in order]
    assert keys == sorted(keys)
    common = [next((k for k in range(length) if a[k] != b[k]), length) for a, b in zip(keys, keys[1:])]
    assert suffix_dedup.common_prefixes(text, order, length).tolist() == common


def test_only_smaller_suffixes_are_sorted_directly(monkeypatch):
    """The direct sort gets the suffixes smaller than their successors, and no others."""
    text = np.frombuffer(b"banana bandana cabana\xff" + b"\xff" * 40, np.uint8)
    wanted = np.zeros(len(text), bool)
    wanted[:14] = True
    given = []
    argsort = np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, **k: (given.append(x) if x.dtype.kind == "S" else None) or argsort(x, **k))
    order = suffix_dedup.suffix_array(text, wanted, 8)
    said = text.tobytes()
    assert [said[i : i + 8] for i in order] == sorted(said[i : i + 8] for i in range(14))
    assert len(given) == 1 and all(s < s[1:] + b"\xff" for s in given[0].tolist())


@pytest.mark.parametrize("length, crowd, batch", [(12, 4_096, 1 << 19), (12, 3, 100), (40, 4_096, 500)])
def test_removal(spark, monkeypatch, length, crowd, batch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    deal = random.Random(7)
    passage = "".join(deal.choices("abcdefghij é", k=90))
    texts = ["".join(deal.choices("abc ", k=deal.randrange(0, 150))) for _ in range(60)]
    texts += ["".join(deal.choices("xyz ü", k=deal.randrange(30))) + passage[deal.randrange(30) : deal.randrange(45, 90)] + "".join(deal.choices("xyz ü", k=30)) for _ in range(40)]
    texts += [None, "", "short", "a" * 700, "a" * 30, "ab" * 200, texts[0], texts[0], texts[-1], "日本語" * 20]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("p", F.lit(1)).withColumn("Kept", F.lit("x")).coalesce(1).repartition(3, "doc_id")
    found = suffix_dedup.remove(docs, length=length)
    assert found.columns == ["doc_id", "text", "p", "n_bytes", "n_removed", "n_spans", "kept"]
    wanted = sorted((str(t), *x) for t, x in zip(texts, brute(texts, length)))
    assert sorted((str(r["text"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect()) == wanted
    assert suffix_dedup.remove(docs.where("text = 'no'"), length=length).count() == 0


def test_long_texts_in_stripes(spark):
    deal = random.Random(1)
    parts = ["".join(deal.choices("abcdefghijklmnop ", k=1 << 20)) for _ in range(3)]
    parts[2] = parts[2][:5000] + parts[0][(1 << 20) - 300 :] + parts[1][:300] + parts[2][5000:]  # over a stripe's end
    docs = spark.createDataFrame([(1, parts[0] + parts[1]), (2, parts[2])], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in suffix_dedup.remove(docs).collect()}
    assert found[1]["n_removed"] == found[2]["n_removed"] == 600 and found[1]["n_spans"] == found[2]["n_spans"] == 1
    assert bytes(found[1]["kept"]).decode() == parts[0][:-300] + parts[1][300:]
