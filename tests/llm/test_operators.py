"""Operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import itertools
import json
import pickle
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import _spark, _text, bpe_stream, decontaminate, hash_search, html_text, language, license_scan, line_dedup, simhash_dedup, toxicity, url_filter
from ledgerlens.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"
random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "omega"]
PROSE = [" ".join(random.choice(WORDS) for _ in range(40)) for _ in range(12)]
TEXTS = [None, "", " \n ", *PROSE, PROSE[0], PROSE[1] + " end", PROSE[2].replace("alpha", "alphas", 1), "x " * 3000, "ünï çödé ß 日本語", "123 456 !!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 5 else None, t, "l1" if i % 2 else "l2", "s", 1) for i, t in enumerate(TEXTS)]
    rows.append(rows[4])  # a repeated row
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).repartition(3, "n_chars")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id = -1")


def test_language(spark, docs, empty):
    model = language.fit(docs)
    found = language.predict(docs, model, keep=["doc_id", "text"]).collect()
    assert len(found) == len(TEXTS) + 1
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
        assert not letters or abs(sum(r["shares"].values()) - 1) < 1e-6
    nothing = language.fit(empty)
    assert nothing.languages == [] and language.predict(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    clashing = language.predict(docs.withColumnRenamed("source", "Score"), model)
    assert clashing.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score", "evidence", "shares"] and clashing.count() == len(found)


def test_language_mixture(spark):
    a, b = "the cat sat on that mat with this hat ", "der hund lief über die straße und bellte laut "
    model = language.fit(spark.createDataFrame([(a * 9, "en"), (b * 9, "de")], "text string, lang string"))
    shares = language.predict(spark.createDataFrame([(a * 3 + b * 3,), (a,)], "text string"), model).collect()
    assert set(shares[0]["shares"]) == {"en", "de"} and shares[1]["lang_pred"] == "en"


def test_language_sample_keeps_rare_languages_and_no_copies(spark):
    rows = [(f"the cat number {i} sat on that mat", "en") for i in range(3000)] + [(f"der hund {i} lief über die straße", "de") for i in range(5)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), sample=20)
    assert model.languages == ["de", "en"]
    everything = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    copied = language.fit(spark.createDataFrame(rows + rows[:1] * 1500, "text string, lang string"))
    assert np.array_equal(everything.logp, copied.logp)
    sampled = language.fit(spark.createDataFrame(rows + rows[:1] * 1500, "text string, lang string"), sample=20)
    assert np.array_equal(model.logp[0], everything.logp[0]) and np.array_equal(model.logp, sampled.logp)
    assert language.quota([5, 3000], 20) == 15 and language.quota([5, 7], 20) == 7 and language.quota([9, 9, 9], 2) == 1


def test_hash_search(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 16)).astype(np.float32).tolist()
    vectors[7] = vectors[3]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (None, vectors[1]), (503, [1.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = hash_search.search(table, table.where("vec_id % 20 = 0 or vec_id = 3"), k=5).collect()
    x = np.array(vectors, dtype=np.float64)
    hits = 0
    for q in [0, 3, 20, 40, 60, 80, 100]:
        want = sorted((-float((x[i] * x[q]).sum()), i) for i in range(120) if i != q)[:5]
        got = [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert len(got) == 5
        hits += len({i for i, _ in got} & {i for _, i in want})
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-12 for i, s in got)
    assert hits >= 0.9 * 35
    assert hash_search.search(table.where("vec_id < 3"), table.where("vec_id = 1"), k=5).count() == 2
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.9, 0.1]), (3, [0.7, 0.0])], "vec_id bigint, embedding array<double>")
    assert [(r[1], r[2]) for r in hash_search.search(twice, twice.where("vec_id = 1"), k=3).orderBy("rank").collect()] == [(1, 2), (2, 3)]
    assert hash_search.search(table.where("vec_id = -1"), table.where("vec_id = -1")).count() == 0


def test_hash_search_probes_for_near_ones_and_searches_wide_for_the_rest():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 64))
    x[:300] = x[0] + 0.03 * rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = hash_search.learn(x, 20)
    index = hash_search.Index(code, x)
    for radius in (code.narrow, code.wide, 15, 0):
        for i in (0, 5, 700):
            want = np.flatnonzero(hash_search.hamming(index.packed, index.packed[i]) <= radius)
            assert np.array_equal(np.sort(index.within(x[i], radius)), want)
    assert len(index.within(x[3], code.narrow)) >= 250 and code.narrow < code.wide < code.bits
    ids, hits = [[i] for i in range(len(x))], 0
    for i in range(300, 340):
        best = x @ x[i]
        best[i] = -9
        hits += len(set(hash_search.top(index, ids, x[i], i, code.wide, 20)[0]) & set(np.argsort(-best)[:20].tolist()))
    assert hits >= 0.9 * 800
    near = hash_search.top(index, ids, x[3], 3, code.narrow, 20)
    assert near[1][-1] >= code.reach


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    found = simhash_dedup.find(docs).collect()
    want = [(d if d != 5 else None, brute_fingerprint(t)) for d, t in enumerate(TEXTS)]
    want.append(want[4])
    parent = list(range(len(want)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i in range(len(want)):
        for j in range(i):
            if (want[i][1] ^ want[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(want):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    expected = sorted((str(d), f"{fp:016x}", str(least.get(root(i)))) for i, (d, fp) in enumerate(want))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == expected
    assert simhash_dedup.keep_one(docs).count() == len({root(i) for i in range(len(want))})
    assert simhash_dedup.find(empty).count() == 0


def test_simhash_buckets():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp[:20] ^ np.uint64(5), fp[:5] ^ np.uint64(1)]))
    for starts in (np.array([0, len(fp)]), np.array([0, 9, 20, len(fp)])):
        table = np.bitwise_count(fp[None, :] ^ simhash_dedup.REFERENCES[:, None]).astype(np.int8)
        order = np.concatenate([lo + np.argsort(table[0][lo:hi], kind="stable") for lo, hi in zip(starts[:-1], starts[1:])])
        a, b = simhash_dedup.bucket_links(fp[order], table[:, order], starts, 3)
        assert all(int(x ^ y).bit_count() <= 64 for x, y in zip(a, b))
        from ledgerlens.llm._graph import forest

        want = [(x, y) for lo, hi in zip(starts[:-1], starts[1:]) for i, x in enumerate(fp[lo:hi]) for y in fp[lo:hi][:i] if (int(x) ^ int(y)).bit_count() <= 3]
        same = forest(np.array([x for x, _ in want], np.uint64), np.array([y for _, y in want], np.uint64))
        mine = forest(a, b)
        assert dict(zip(*map(np.ndarray.tolist, same))) == dict(zip(*map(np.ndarray.tolist, mine)))


def test_license_scan(spark, empty):
    rows = [(1, "Made by me. Licensed under the Apache License, Version 2.0. Bye"), (2, None), (3, ""), (4, "cc by CC-BY mit license " * 2), (5, "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met"), (1, "plain words"), (1, "plain words")]
    found = sorted(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect(), key=str)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    apache = next(r for r in by[1] if r["n_base"])
    assert (apache["n_base"], apache["first_word"], apache["labels"], apache["score"]) == (1, 6, "apache", 1.0)
    assert len(by[1]) == 3 and by[2][0]["n_words"] == 0 and by[2][0]["first_word"] is None and by[3][0]["labels"] == ""
    assert (by[4][0]["n_base"], by[4][0]["base_labels"]) == (6, "cc-by,mit")
    assert by[5][0]["labels"] == "bsd" and by[5][0]["n_base"] == 0 and 0.75 <= by[5][0]["score"] <= 1
    assert license_scan.scan(empty).count() == 0


def test_url_filter(spark):
    urls = ["http://a.net/x", "https://www.example.net/en/1?q=1", "http://EXAMPLE.com/de/", "x://b.org/fr/#t", "http://net", "nothing", None, "http://other.dev/a/b?c=d&e=f"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id bigint, url string")
    found = sorted(url_filter.judge(pages, url_filter.fit(pages), keep=["page_id"]).collect())
    assert [r["rule"] for r in found] == ["net/", "net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None]
    assert [r["verdict"] for r in found[:5]] == ["block", "block", "allow", "block", "allow"] and {r["verdict"] for r in found} == {"allow", "block"}
    assert (found[4]["host"], found[4]["path"], found[5]["host"], found[5]["path"], found[7]["host"]) == ("b.org", "/fr/", "net", "", "")
    none = pages.where("page_id = -1")
    assert url_filter.judge(none, url_filter.fit(none)).count() == 0


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame([(1, PROSE[3]), (2, "only few Words"), (3, None), (4, ""), (1, PROSE[3])], "item_id bigint, text string")
    texts = ["a b " + " ".join(PROSE[3].split()[5:20]) + " c", "only FEW words!", "only few other", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted(decontaminate.find(rows, bench, keep=["doc_id"]).collect())
    assert [(r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found] == [(18, 15, ["1"], True), (3, 3, ["2"], True), (3, 0, [], False), (0, 0, [], False), (0, 0, [], False)]
    blocks = sorted(decontaminate.find(rows, bench, keep=["doc_id"], block_words=20).collect())
    assert [(r["n_hit"], r["item_ids"]) for r in blocks] == [(r["n_hit"], r["item_ids"]) for r in found]
    assert [r["doc_id"] for r in decontaminate.decontaminate(rows, bench).orderBy("doc_id").collect()] == [2, 3, 4]
    assert decontaminate.decontaminate(rows, bench, mode="span").orderBy("doc_id").first()["text"] == "a b  c"
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("item_id = -1")).count() == docs.count()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><h1>Big</h1><p>One<p>Two<ul><li>a<li>b</ul><table><tr><td>long cell<td>1<tr><td>x<td>2</table><p hidden>no</p><div style='display:none'>no</div>&lt;end"
    assert html_text.html_to_text(page).split("\n") == ["Big", "", "One", "", "Two", "", "- a", "- b", "", "long cell | 1", "x         | 2", "", "<end"]
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<div>" * 3000 + "deep")], "page_id bigint, html string")
    found = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    assert found[2] is None and found[3] == "" and found[4] == "deep"


def test_toxicity(spark, docs, empty):
    rows = [(i, f"{random.choice(PROSE)} {'vile scum' if i % 4 == 0 else 'kind'}") for i in range(200)]
    texts = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(7, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(texts, toxicity.fit(texts, labels), keep=["doc_id"]).collect()}
    assert all(found[i]["predicted"] == int(i % 4 == 0) for i in range(150, 200)) and found[900]["predicted"] == found[901]["predicted"] == 0
    base = toxicity.fit(texts, labels.where("doc_id = -1"))
    assert len({r["score"] for r in toxicity.score(docs, base, keep=["doc_id"]).collect()}) == 1 and toxicity.score(empty, base).count() == 0


@pytest.mark.parametrize("fillers, each", [(300, 25), (1100, 770)])
def test_toxicity_of_pairs_that_no_term_tells_alone(fillers, each):
    """Also where more than a thousand other words are commoner: with 770 of 1,100 fillers in a text, each is in 70 % of them."""
    deal = random.Random(3)
    filler = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}filler" for i in range(fillers)]

    def row():
        a, b = deal.random() < 0.5, deal.random() < 0.5
        words = (deal.choices(filler, k=each) if each < 100 else deal.sample(filler, each)) + ["insult"] * a + ["group"] * b
        deal.shuffle(words)
        return " ".join(words), float(a != b)

    def known(rows):
        found = []
        for _, _, ids, first in toxicity.features(pa.array([t for t, _ in rows], pa.string())):
            found += [ids[a:b] for a, b in zip(first[:-1], first[1:])]
        return found

    learned, held = [row() for _ in range(1200)], [row() for _ in range(300)]
    ids, y = known(held), np.array([v for _, v in held])
    first = np.concatenate(([0], np.cumsum([len(r) for r in ids])))
    machine = toxicity.fit_arrays(known(learned), np.array([v for _, v in learned]))
    accuracy = lambda m: ((toxicity._energy(m, np.concatenate(ids), first)[0] > 0) == (y > 0)).mean()
    additive = toxicity.Machine(machine.bias, machine.weights, np.zeros_like(machine.vectors))
    assert accuracy(machine) > 0.95 and accuracy(additive) < 0.8


def test_windows_of_long_texts_change_nothing(monkeypatch):
    deal = random.Random(6)
    said = [f"w{i}" for i in range(400)] + ["mit", "license", "ünï", "Insult"]
    texts = [" ".join(deal.choices(said, k=n)) for n in (3000, 5, 900)] + ["", None, "x" * 5000, PROSE[3] + " " + PROSE[3]]
    column = pa.array(texts, pa.string())
    bench = decontaminate.window_set([(1, PROSE[3]), (2, "w1 w2"), (3, " ".join(texts[0].split()[700:760]))])
    model = language.Model(["a", "b"], np.log(np.random.default_rng(1).dirichlet(np.ones(language.BUCKETS), 2)).astype(np.float32))

    def results():
        toxic = [(lo, f.tolist(), first.tolist()) for lo, _, f, first in toxicity.features(column)]
        per_row = [f[a:b] for lo, f, first in toxic for a, b in zip(first[:-1], first[1:])]
        counts, spans, items = decontaminate._scan(column, bench, np.unpackbits(bench.marks).view(bool), 13)
        return per_row, counts.tolist(), spans, items, np.round(language._infer(column, model), 9).tolist()

    whole = results()
    original = _text.windows
    for size in (2000, 300):
        monkeypatch.setattr(_text, "windows", lambda c, t, again=0, s=0, size=size: original(c, t, again, size))
        assert results() == whole
    assert whole[1][:3] == [3000, 5, 900] and whole[2][0] and "3" in whole[3][0]


def test_phrases_and_grams_across_windows(spark, monkeypatch):
    deal = random.Random(7)
    said = ["filler"] * 30 + ["mit", "license", "gnu general public license"]
    text = " ".join(deal.choices(said, k=2500)) + " " + license_scan.TEMPLATES[8][1]
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    whole = license_scan.scan(rows).collect()
    words = text.lower().split()
    places = [i for i in range(len(words)) if words[i : i + 2] == ["mit", "license"] or words[i : i + 4] == ["gnu", "general", "public", "license"]]
    assert (whole[0]["n_base"], whole[0]["first_word"]) == (len(places), places[0]) and "mit" in whole[0]["labels"]
    monkeypatch.setattr(_text.windows, "__defaults__", (0, 400))
    assert license_scan.scan(rows).collect() == whole


def brute_license(text, templates):
    """Labels whose template's words stand in the text in order, by the longest common subsequence of some stretch twice as long."""
    words = [w for w in "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split()]
    found = set()
    for label, said in templates:
        wanted = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in said).split()
        for at in range(max(1, len(words) - len(wanted) + 1)):
            part, row = words[at : at + len(wanted)], [0] * (len(wanted) + 1)
            for w in part:
                new = [0]
                for j, v in enumerate(wanted):
                    new.append(max(row[j] + (v == w), row[j + 1], new[-1]))
                row = new
            if row[-1] >= 0.9 * len(wanted):
                found.add(label)
    return found


def test_license_scan_against_common_subsequences(spark):
    deal = random.Random(9)
    templates = [license_scan.TEMPLATES[i] for i in (0, 1, 3, 7, 11, 13)]
    rows, want = [], []
    for i in range(60):
        label, said = deal.choice(templates)
        words = said.split()
        if i % 3 == 1:
            words[len(words) // 2] = "changed"
        if i % 3 == 2:
            deal.shuffle(words)
        text = " ".join(deal.choices(WORDS, k=9) + words + deal.choices(WORDS, k=9))
        rows.append((i, text))
        want.append(brute_license(text, templates))
    found = {r["doc_id"]: r["labels"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=templates, base={"no such phrase": "none"}).collect()}
    for (i, text), labels in zip(rows, want):
        if i % 3 != 1:
            assert set(filter(None, found[i].split(","))) >= labels, text
        if i % 3 == 2:
            assert not found[i] or labels, text


def test_license_spans_of_a_text_that_repeats_templates(spark):
    """Copies of a template end to end, in several batches of votes: each gives its own span, and no task holds more than one."""
    label, said = license_scan.TEMPLATES[8]
    size = len(said.replace("/", " ").split())
    text = " ".join([said] * 300 + WORDS + [license_scan.TEMPLATES[4][1]] * 50)
    rows = spark.createDataFrame([(1, text), (None, said), (2, None)], "doc_id bigint, text string")
    spans = license_scan.spans(rows, ["doc_id"], templates=[license_scan.TEMPLATES[8]]).collect()
    long = sorted((r["first"], r["last"]) for r in spans if r["doc_id"] == 1)
    assert long == [(i * size, (i + 1) * size - 1) for i in range(300)] and all(r["label"] == label and r["coverage"] == 1.0 for r in spans)
    assert [(r["first"], r["last"]) for r in spans if r["doc_id"] is None] == [(0, size - 1)]
    assert [r["labels"] for r in license_scan.scan(rows).orderBy("doc_id").collect()] == ["mit", "cc-by,mit", ""]


@pytest.mark.parametrize("hot", [1_000, 3])
def test_large_benchmark_equals_the_broadcast_one(spark, monkeypatch, hot):
    """Windows of thousands of items, some shared by many items or many documents, ids null and repeated, short items."""
    monkeypatch.setattr(decontaminate, "HOT_ROWS", hot)
    deal = random.Random(21)
    prompt = " ".join(deal.choices(WORDS, k=15))
    items = [(i if i % 11 else None, f"{prompt if i % 3 == 0 else ''} " + " ".join(deal.choices(WORDS, k=deal.randrange(0, 40))) + f" item{i}") for i in range(300)]
    texts = [prompt + " and more"] * 20 + [" ".join(deal.choices(WORDS, k=5)) + " " + " ".join(deal.choice(items)[1].split()[: deal.randrange(1, 30)]).upper() for _ in range(80)]
    rows = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate([*texts, None, "", "x " * 200])], "doc_id bigint, text string").repartition(4)
    bench = spark.createDataFrame([*items, items[0], (5, None), (6, "..")], "item_id bigint, text string")
    whole = lambda **how: sorted(map(str, decontaminate.find(rows, bench, **how).collect()))
    assert whole() == whole(block_words=50)
    assert sum("contaminated=True" in r for r in whole()) > 20


def test_decontamination_of_a_large_benchmark_tells_rows_apart(spark):
    bench = spark.createDataFrame([(i, PROSE[i]) for i in range(6)], "item_id bigint, text string")
    rows = spark.createDataFrame([(7, PROSE[0]), (7, PROSE[2] + " some more"), (None, PROSE[4]), (7, PROSE[0]), (8, None)], "n_words bigint, text string")
    one = decontaminate.find(rows, bench, keep=["text"])
    several = decontaminate.find(rows, bench, keep=["text"], block_words=60)
    key = lambda r: str(r)
    assert sorted(map(key, one.select("n_words", "n_hit", "item_ids", "text").collect())) == sorted(map(key, several.select("n_words", "n_hit", "item_ids", "text").collect()))
    kept = decontaminate.decontaminate(rows, bench)
    assert kept.columns == ["n_words", "text"] and [r["n_words"] for r in kept.collect()] == [8]
    assert decontaminate.find(rows, bench.where("item_id < 0"), keep=["text"]).where("contaminated").count() == 0


CLASHING = ["_row", "_left", "_dropped", "_text", "_key", "_0", "score", "n_words", "lang_pred", "N_Tokens", "row", "text.x"]


def test_columns_of_any_name_come_through(spark, docs):
    extra = docs.toDF("doc_id", "text", "lang", "source", "n_chars")
    for i, name in enumerate(CLASHING):
        extra = extra.withColumn(name, F.lit(f"own {i}"))
    extra = spark.createDataFrame(extra.collect(), extra.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, extra, DATA)
        assert kept.columns == extra.columns, name
        assert all(r[c] == f"own {i}" for r in kept.collect() for i, c in enumerate(CLASHING)), name
        assert stage(spark, extra.where("doc_id < 0"), DATA).count() == 0
    tokens = corpus_pipeline.tokenize(spark, extra, DATA)
    assert "n_tokens" in tokens.columns and "N_Tokens" not in tokens.columns and tokens.where("`text.x` = 'own 11'").count() == extra.count()
    assert simhash_dedup.keep_one(extra).columns == extra.columns
    pages = spark.createDataFrame([(1, "http://a.net/x", None, "mine"), (2, None, "", "mine"), (2, "x", "<b>t", "mine")], "page_id bigint, url string, html string, host string")
    judged = url_filter.judge(pages, url_filter.fit(pages))
    assert judged.columns == ["page_id", "url", "html", *url_filter.RESULTS] and judged.count() == 3
    assert [r["host"] for r in judged.where("page_id = 1").collect()] == ["a.net"]
    assert html_text.extract(pages.withColumn("text", F.lit("mine"))).where("text = 't' or text is null or text = ''").count() == 3


def test_rules_as_a_table_find_the_same(spark, monkeypatch):
    rules = {f"{h}/{p}": v for h, v in (("net", "block"), ("a.net", "allow"), ("b.a.net", "block")) for p in ("", "x/", "x/y")}
    urls = [f"http://{h}/{p}" for h in ("net", "a.net", "c.b.a.net", "org", "xa.net") for p in ("", "x/", "x/yz?q", "z")] + [None, "nothing"]
    rows = spark.createDataFrame([*enumerate(urls)], "page_id bigint, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    by_conditions = url_filter.with_rule(rows, rules).orderBy("page_id").collect()
    monkeypatch.setattr(url_filter, "MOST_RULES", 2)
    by_table = url_filter.with_rule(rows, rules).select(*rows.columns, "rule", "ruled").orderBy("page_id").collect()
    assert [(r["rule"], r["ruled"]) for r in by_table] == [(r["rule"], r["ruled"]) for r in by_conditions]
    for r in by_table:
        fits = [x for x in rules if r["host"] and ("." + r["host"]).endswith("." + x.split("/", 1)[0]) and r["path"].startswith("/" + x.split("/", 1)[1])]
        assert r["rule"] == (max(fits, key=len) if fits else None)


def test_html_shows_all_visible_words():
    cases = {
        "<table><tr>STRAY<td>a</table>": "STRAY\n\na",
        "<table><tr><td>a</td><span>INROW</span><td>b</table>": "INROW\n\na | b",
        "<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>": "yes",
        "<table><td>a<td>b<tr><td>c<td>d</table>": "a | b\nc | d",
        "<table><tr><td rowspan=2>R<td>1<tr><td>2</table>": "R | 1\n  | 2",
        "<table><tr><td>o<td><table><tr><td>1<td>2<tr><td>3<td>4</table></table>": "o | 1 | 2\n  | 3 | 4",
        "<table><tr><td>l1<br>l2<td>z</table>": "l1 | z\nl2",
        "<ol><li value=5>five<li>six</ol>": "5. five\n6. six",
        "<pre>\na\n\n\nb</pre>": "a\n\n\nb",
        "<dialog>no</dialog><details><summary>s</summary>no</details>": "s",
        "<table><tr><form><td>Name</td></form></tr></table>": "Name",
        "<select><option>one<option>two</select><svg><text>t</text></svg>": "one\ntwo\nt",
        "<select><optgroup label='Few &amp; big'><option>one</optgroup><optgroup><option>two</select>": "Few & big\none\ntwo",
        "<ruby>\u6f22<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>": "\u6f22kan",
        "<p>a<plaintext>b <i>c</i> &amp;": "a\n\nb <i>c</i> &amp;",
    }
    for page, want in cases.items():
        assert html_text.html_to_text(page) == want, page
    deal = random.Random(2)
    tags = ["<p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</td>", "</tr>", "</table>", "<tbody>", "<span>", "</span>", "<form>", "</p>", "<th colspan=2>", "<td rowspan=2>", "<h2>", "<br>"]
    for _ in range(300):
        words = [f"word{i}" for i in range(12)]
        page = "".join(x for w in words for x in (*deal.choices(tags, k=deal.randrange(4)), f" {w} "))
        said = html_text.html_to_text(page).split()
        assert sorted(w for w in said if w.startswith("word")) == sorted(words), page
    assert html_text.html_to_text("<table><tr><td>x" * 900 + "end").endswith("end")


def test_bpe_streams_what_has_no_spaces():
    codec = bpe_stream.Codec(tokenizer_path())
    deal = random.Random(4)
    for text in ("ab" * 3000, "".join(deal.choice("abcdefé日") for _ in range(4000)), "1234567890" * 500):
        data = text.encode()
        want = codec.transducer._path(data[:200], [-1] + [None] * 200, 200)
        assert b"".join(codec.vocabulary.bytes[i] for i in want) == data[:200]
        for size in (7, 100, 5000):
            parts = list(codec.transducer.stream(data[i : i + size] for i in range(0, len(data), size)))
            ids = [i for part in parts for i in part]
            assert b"".join(map(codec.vocabulary.bytes.__getitem__, ids)) == data and all(codec.transducer.fits(a, b) for a, b in zip(ids, ids[1:]))
            assert len(parts) > 1  # tokens come before the end


def test_bpe_is_exact(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    reference = tokenizers.Tokenizer.from_file(path)
    texts = [*TEXTS, "a  b \n c<|endoftext|>it's", "a" * 700, "\t \x1c x", "日本" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in bpe_stream.digests(rows, path, ids_column="token_ids").collect():
        ids = reference.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_stream.decode(bpe_stream.encode(docs, path), path).where("text <> ''").count() == docs.where("text <> ''").count()
    assert bpe_stream.digests(empty, path).count() == 0


def test_bpe_words_that_never_repeat_go_abreast():
    deal = random.Random(9)
    words = [" " + "".join(deal.choices(["th", "ing", "tion", "an", "er", "ou", "st", "é", "日"], k=deal.randint(3, 6))) + str(i % 10) for i in range(40_000)]
    codec, alone = bpe_stream.Codec(tokenizer_path()), bpe_stream.Transducer(bpe_stream.Vocabulary(tokenizer_path()))
    began = time.process_time()
    together = b"".join(codec.encode("".join(words)))
    between = time.process_time()
    assert together == b"".join(alone.pretoken(x) for w in words for x in (w[:-1], w[-1]))
    assert between - began < time.process_time() - between  # 0.65 to 0.73 of it; 1.4 when words went one after another


def test_bpe_blocks_keep_texts_apart_and_odd_spaces(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(tokenizer_path())
    deal = random.Random(3)
    texts = ["", "x", " ", " \x1fab", "\x1fab ab", "ab \x1fab", "<|endoftext|>", "", "a <|endoftext|> b", "a\x85b c", "don't we'll", "a" * 64 + " " + "b" * 65, "ab  cd \n ef " * 40]
    texts += ["".join(deal.choices(["a", "b", " ", "\n", "\t", "'s", "\x1f", "\u3000", "é", "日", "7", "!"], k=deal.randint(1, 50))) for _ in range(400)]
    for name, most in (("BLOCK", 90), ("WINDOW", 30), ("REMEMBERED", 20)):
        monkeypatch.setattr(bpe_stream, name, most)
    codec, found = bpe_stream.Codec(tokenizer_path()), {}
    for place, ids in codec.encode_all(texts):
        found.setdefault(place, []).append(np.frombuffer(ids, "<u4"))
    assert list(found) == list(range(len(texts)))
    for place, parts in found.items():
        want = reference.encode(texts[place], add_special_tokens=False).ids
        assert np.concatenate(parts).tolist() == want and "".join(codec.decode(iter(parts))) == reference.decode(want, skip_special_tokens=False)


def test_bpe_abreast_in_small_vocabularies(tmp_path):
    file = tmp_path / "small.json"
    for merges in ([], ["a b", "ab ab", "b a", "c ab"]):
        vocab = {x: i for i, x in enumerate(dict.fromkeys([*"abc", *(m.replace(" ", "") for m in merges)]))}
        file.write_text(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
        transducer = bpe_stream.Transducer(bpe_stream.Vocabulary(str(file)))
        words = ["".join(x) for n in range(1, 8) for x in itertools.product("abc", repeat=n)]
        paths = [transducer._path(w.encode(), [-1] + [None] * len(w), len(w)) for w in words]
        assert transducer.pretokens(words) == [np.array(x, "<u4").tobytes() for x in paths]
        with pytest.raises(ValueError, match="lacks a byte"):
            transducer.pretokens(["ab", "ad"])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_banded_distance():
    for _ in range(3000):
        a, b = ("".join(random.choice("ab") for _ in range(random.randint(0, 9))) for _ in range(2))
        for edits in (1, 2, 3):
            assert line_dedup.within(a, b, edits) == (edit_distance(a, b) <= edits)


def test_banded_distance_of_long_lines_takes_time_in_proportion():
    deal, took = random.Random(3), []
    for n in (50_000, 200_000):
        a = "x" + "".join(deal.choices("abcdef ", k=n)) + "x"
        began = time.process_time()
        assert line_dedup.within(a, "y" + a[1:-1] + "z", 2) and not line_dedup.within(a, "y" + a[1:-3] + "zzz", 2)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def test_line_dedup(spark, empty):
    lines = ["".join(random.choice("abcdef ") for _ in range(random.randint(18, 40))) for _ in range(25)]
    near = [lines[0][:9] + "X" + lines[0][9:], lines[1][1:], lines[2][:-2] + "YZ", lines[3][:5] + lines[3][6:20] + "Q" + lines[3][20:]]
    texts = ["\n".join(random.choices(lines + near + ["", "tiny"], k=8)) for _ in range(30)]
    rows = spark.createDataFrame([*enumerate(texts), (40, None), (41, "")], "doc_id bigint, text string")
    first, dropped = {}, {}
    for d, text in enumerate(texts):
        for i, line in enumerate(text.split("\n")):
            if line.strip():
                if line in first or len(line) >= 20 and any(len(x) >= 20 and edit_distance(line, x) <= 2 for x in first):
                    dropped.setdefault(d, []).append(i)
                first.setdefault(line, (d, i))
    found = {r["doc_id"]: r["dropped"] for r in line_dedup.find(rows).collect()}
    assert {d: x for d, x in found.items() if x} == dropped and len(found) == 32
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(rows).collect()}
    for d, text in enumerate(texts):
        kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in dropped.get(d, []))
        assert left.get(d) == (kept if kept.strip() or d not in dropped else None)
    assert left[40] is None and left[41] == "" and line_dedup.find(empty).count() == 0


def test_line_dedup_of_a_key_with_more_lines_than_are_held(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HELD", 3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "4")
    try:
        deal = random.Random(8)
        lines = ["shared segment" + "".join(deal.choice("abcdefgh") for _ in range(26)) for _ in range(40)]
        lines += [lines[0], lines[7], lines[3][:-1] + "Z", lines[9][:20] + "Q" + lines[9][20:]]
        rows = spark.createDataFrame([*enumerate(lines)], "doc_id bigint, text string")
        want = [i for i, x in enumerate(lines) if any(edit_distance(x, y) <= 2 for y in lines[:i])]
        assert want == [40, 41, 42, 43]
        assert sorted(r["doc_id"] for r in line_dedup.find(rows).collect() if r["dropped"]) == want
        assert line_dedup.dedup(rows).count() == 40
    finally:
        spark.conf.set(batch, before)


def test_line_dedup_of_short_repeats(spark, tmp_path):
    texts = ["Home\n\nMenu\n x", "Home\n\nMenus\n  \nx", "Menu\n  \nnew", "a line of over twenty characters\nHome", None]
    spark.createDataFrame([(i, t, "l1", "s", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["dropped"] for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {0: [], 1: [0], 2: [0], 3: [1], 4: []}
    left = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in left} == {0: texts[0], 1: "\nMenus\n  \nx", 2: "  \nnew", 3: "a line of over twenty characters", 4: None}


def test_near_duplicates_fine_bins(monkeypatch):
    from ledgerlens.llm import near_dedup

    deal = np.random.default_rng(2)
    h = np.unique(deal.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    assert len(near_dedup.fine_bins(h)) <= near_dedup.FINE + 8  # every pair brings two through the shuffle
    for bins in (near_dedup.FINE, 16):  # in 16 bins the counts are cut off
        monkeypatch.setattr(near_dedup, "FINE", bins)
        for n, shared in ((900, 800), (1_800, 1_600), (9_000, 8_000), (300, 267), (9, 8), (1, 1), (0, 0)):  # 4/5 or a little more
            x, y = (np.frombuffer(near_dedup.fine_bins(np.sort(a)), np.uint8) for a in (h[:n], h[n - shared : 2 * n - shared]))
            assert near_dedup.fine_near(x, y)
    monkeypatch.undo()
    x, y = (np.frombuffer(near_dedup.fine_bins(a), np.uint8) for a in (h[:900], h[900:1_800]))
    assert not near_dedup.fine_near(x, y)


def test_pipeline_near_duplicates_by_jaccard(spark, monkeypatch):
    from ledgerlens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    deal = random.Random(3)
    texts = [None, "", "one two", "One  two", "one two three"]
    for size in (8, 30, 30, 90, 200, 400):
        base = [f"w{deal.randrange(5000)}" for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 1, 2, 3, 5, 8, *[1] * 14):
            words = list(base)
            for _ in range(edits):
                words[deal.randrange(size)] = f"v{deal.randrange(5000)}"
            texts.append(" ".join(words))
    common = " ".join(f"c{i}" for i in range(30))
    texts += [f"{common} " + " ".join(f"u{deal.randrange(5000)}" for _ in range(40)) for _ in range(20)]
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows.collect(), rows.schema), DATA)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})
    assert corpus_pipeline.drop_near_duplicates(spark, rows.where("doc_id < 0"), DATA).count() == 0


def test_simhash_bucket_over_several_batches(spark):
    deal = np.random.default_rng(8)
    fp = deal.integers(0, 1 << 48, 700, dtype=np.uint64) << np.uint64(16)  # all in one bucket of the last sixteen bits
    flips = [np.bitwise_or.reduce(np.uint64(1) << deal.integers(0, 64, k, dtype=np.uint64)) for k in deal.integers(1, 4, 200)]
    fp = np.unique(np.concatenate((fp, fp[:200] ^ np.array(flips, np.uint64), fp[:20] ^ np.uint64(7 << 40))))
    parent = {int(x): int(x) for x in fp.view(np.int64)}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for x in fp:
        for y in fp[np.bitwise_count(fp ^ x) <= 3]:
            a, b = sorted((root(int(x.view(np.int64))), root(int(y.view(np.int64)))))
            parent[b] = a
    rows = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp bigint")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for batch in ("100", "10000"):
            spark.conf.set(name, batch)
            found = simhash_dedup.components(simhash_dedup.links(rows, rows.count())).collect()
            assert {r["node"]: r["root"] for r in found} == {x: root(x) for x in parent if root(x) != x}
    finally:
        spark.conf.set(name, before)


def brute_lines(rows):
    """(doc_id, text) without repeated and nearly repeated lines, and without documents of which only space is left."""
    seen, kept = [], []
    for d, text in rows:
        lines, out = text.split("\n"), []
        for line in lines:
            near = line in seen or len(line) >= 20 and any(len(x) >= 20 and line_dedup.within(line, x, 2) for x in seen)
            if line.strip():
                if line not in seen:
                    seen.append(line)
                if near:
                    continue
            out.append(line)
        if out == lines or "".join(out).strip():
            kept.append((d, "\n".join(out)))
    return kept


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [r for i, r in enumerate(rows) if root(i) == i]


def brute_contaminated(text, items):
    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    said, hit = words(text), set()
    for item in items:
        w = words(item)
        k = min(13, len(w))
        known = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(said) - k + 1):
            if tuple(said[i : i + k]) in known:
                hit |= set(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(said)


def test_pipeline_stages_equal_brute_force(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1).orderBy("doc_id")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["text"] and len(r["text"]) < 3000]
    docs = spark.createDataFrame(docs.where(F.length("text") < 3000).collect(), docs.schema).coalesce(1)
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {
        "language": lambda rows: [r for r in rows if regex.search(r"\p{L}", r[1])],  # these data hold no noise
        "lines": brute_lines,
        "near_duplicates": brute_near,
        "decontamination": lambda rows: [r for r in rows if not brute_contaminated(r[1], items)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns
        rows = want[name](rows)
        found = kept.orderBy("doc_id").collect()
        assert [(r["doc_id"], r["text"]) for r in found] == rows, name
        docs = spark.createDataFrame(found, kept.schema).coalesce(1)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    found = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    for d, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        assert found[d]["token_ids"] == ids and found[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert 0 < len(rows) == len(found)


def test_pipeline_runs_over_the_table(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "token_ids", "n_tokens"} <= set(found.columns) and found.count() > 100


@pytest.mark.parametrize("copies", [12, 120, 12_000])
def test_language_rejects_noise(spark, copies):
    """Training n-grams: about 3,000, 30,000 and 3 million."""
    deal = random.Random(5)
    english, german = "the cat sat on that mat with this hat and that was that ", "der hund lief ueber die strasse und bellte laut wie nie "
    noise = " ".join("".join(deal.choice("qxzjkvwy") for _ in range(7)) for _ in range(40))
    rows = [(1, english * copies * 2, "en"), (2, german * copies * 2, "de"), (3, noise, None), (4, english, None), (5, None, "en"), (6, "12 34", None), (7, "ok", None)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r["doc_id"] for r in language.identified(rows).collect()) == [1, 2, 4, 7]


def test_functions_for_executors_stay_small():
    """What the driver has hashed isn't shipped with each function."""
    _text.word_hash(np.arange(100, dtype=np.uint8), np.array([0]), np.array([9]))
    decontaminate.window_set([(1, PROSE[3])])
    assert len(_text._powers_made.up) > 1 << 20
    for module in (language, toxicity, license_scan, decontaminate, line_dedup, simhash_dedup):
        functions = [f for f in vars(module).values() if callable(f) and getattr(f, "__module__", "") == module.__name__]
        assert len(cloudpickle.dumps(functions)) < 100_000, module


def test_batches_of_texts_have_a_bound(spark):
    """Long texts: 2,000 of them were one batch of 64 MB."""
    texts = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("a b "), 25_000).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    total, size = _spark.map_texts(texts, run, "n bigint, size bigint").agg(F.sum("n"), F.max("size")).first()
    assert total == 300 and size <= _spark.TEXT_BYTES + 200_000


def test_hashing_a_megabyte_holds_little():
    """The sums are 8 MB; the powers that a worker keeps were 35."""
    data = np.random.default_rng(3).integers(0, 256, 1 << 20, dtype=np.uint8)
    _text._powers_made.__init__()
    tracemalloc.start()
    sums = _text.prefix_hash(data)
    kept, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 20e6 and most < 30e6
    starts = np.random.default_rng(4).integers(0, (1 << 20) - 300, 200)
    for at, n in zip(starts.tolist(), range(200)):
        h = sum(int(_text._BYTE[b]) * pow(int(_text._ODD), i, 1 << 64) for i, b in enumerate(data[at : at + n]))
        want = _text.mix(np.array([(h + n * int(_text._MIX2)) % (1 << 64)], np.uint64))
        assert _text.span_hash(sums, np.array([at]), np.array([at + n])) == want


def test_vocabulary_of_a_worker_is_small():
    sent = pickle.dumps(vars(bpe_stream.Vocabulary(tokenizer_path())))
    tracemalloc.start()
    held = pickle.loads(sent)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held["across"]) == 50_000 and size < 36e6  # 47 MB with pairs and merges as tuples


def test_languages_drawn_need_no_second_python_daemon(spark, monkeypatch):
    """createDataFrame of rows makes an RDD of Python's, whose workers have a daemon of their own."""
    rows = spark.createDataFrame([(f"the cat sat on mat {i}", "en") for i in range(50)], "text string, lang string").cache()
    rows.count()
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert language.fit(rows, sample=10).languages == ["en"]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
