"""Multilingual mixture inference: each document's language proportions by expectation-maximisation.

Training counts byte n-grams of words per language; a word's likelihood under a language is the
product over its n-grams. Shares of n-grams are interpolated with the uniform distribution at a fixed
weight, so what an unknown n-gram costs doesn't depend on how much was learned from. A document is a mixture: each word comes from one language of a set, in
proportions that EM estimates. The set is grown from the best single language, one language at a
time, as long as the log-likelihood less `penalty * log(words)` per further language rises.

The predicted language has the largest proportion (ties: the first by name); the score is that
proportion times the posterior probability of the best single language. `evidence` is by how much
the mixture's log-likelihood, less its penalties, exceeds that of noise: n-grams of which each is as
likely as any other. Texts that are null or hold no letter are `und` with score 0 and no evidence,
as is everything if there are no labelled rows. Rows are judged one by one, so ties, repeated rows
and rows without an id need no care. Result columns take the place of columns of the same name.

A model has 256 KiB for each language. Texts are read in windows of about a megabyte; what is kept
of a longer text is a row of likelihoods for each of its different words.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import map_texts, positional, renamed, with_text, without

#: n-gram length, hash buckets, EM steps, penalty per language, texts learned from.
ORDER, BUCKETS, STEPS, PENALTY, SAMPLE = 3, 1 << 16, 12, 1.0, 20_000
#: Weight of the uniform distribution of n-grams.
UNKNOWN = 0.05
#: A language with a smaller share of the words of a document isn't taken into its set.
LEAST = 0.02
#: By how much noise must explain a text better for `identified` to reject it: a factor of e to this power.
DOUBT = 10.0
RESULTS = ["lang_pred", "score", "evidence", "shares"]
LETTER = regex.compile(r"\p{L}")


def _letters() -> np.ndarray:
    word = np.zeros(256, bool)
    word[65:91] = word[97:123] = word[128:] = True
    return word


LETTERS = _text._table(_letters())


@dataclass
class Model:
    """log p(n-gram | language), a row for each language in order of name and a column for each bucket."""

    languages: list[str]
    logp: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the n-gram ending at each byte of a word and at its end, first n-gram of each word, first word of each row)."""
    low, starts, ends, first = _text.words(data, offsets, LETTERS)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), first
    size = ends - starts + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(begin[-1]) + np.repeat(starts - begin[:-1], size)  # the last place of each word is one past its end
    here = np.concatenate((low, np.zeros(1, np.uint8)))[at].astype(np.uint32)
    here[begin[1:] - 1] = 0
    h = here.copy()
    for back in range(1, ORDER):  # bytes before a word count as 0
        before = np.zeros(len(here), np.uint32)
        before[back:] = here[:-back]
        for i in range(back):
            before[np.minimum(begin[:-1] + i, begin[1:] - 1)] = 0
        h = h * np.uint32(0x9E3779B1) + before + np.uint32(1)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(16), begin, first


def quota(sizes: list[int], sample: int) -> int:
    """How many texts of each language may be read, at least one, for about `sample` in all."""
    left = sample
    for i, n in enumerate(sorted(sizes)):
        most = max(1, left // (len(sizes) - i))
        if n > most:
            return most
        left -= n
    return max(sizes, default=1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns all languages of the rows with text and language, each from its different texts: all, or those chosen by a hash so that about `sample` texts are read."""
    labelled = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).where("lang is not null and text is not null")
    draw = F.pmod("h", F.lit(1 << 40))
    sizes = {r[0]: (r[1], r[2]) for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h"), F.min(draw)).collect()}
    languages = sorted(sizes)
    most = quota([n for n, _ in sizes.values()], sample)
    shares = [(x, max(int((1 << 40) * most / n), least + 1)) for x, (n, least) in sizes.items() if n > most]  # one text at least
    if shares:
        chosen = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"lang": pa.array([x for x, _ in shares], pa.string()), "_most": pa.array([n for _, n in shares], pa.int64())})))  # of rows, executors would start a second Python daemon
        labelled = labelled.join(chosen, "lang", "left").where(F.col("_most").isNull() | (draw < F.col("_most")))
    labelled = labelled.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, data, offsets in _text.pieces(batch.column(1)):
                grams, begin, first = _grams(data, offsets)
                of_row = begin[first]
                for name in sorted(set(langs[lo:hi])):
                    mine = np.repeat(langs[lo:hi] == name, np.diff(of_row))
                    sums[name] = sums.get(name, 0) + np.bincount(grams[mine], minlength=BUCKETS)
        for name, counts in sums.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())], names=["lang", "bucket", "n"])

    counts = map_texts(labelled, run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BUCKETS))
    place = {x: i for i, x in enumerate(languages)}
    table[[place[x] for x in counts.column(0).to_pylist()], counts.column(1).to_numpy()] += counts.column(2).to_numpy()
    return Model(languages, smoothed(table).astype(np.float32))


def smoothed(table: np.ndarray) -> np.ndarray:
    """log p(bucket) of rows of counts."""
    return np.log((1 - UNKNOWN) * table / table.sum(axis=1, keepdims=True).clip(1) + UNKNOWN / table.shape[1])


def _sums(values: np.ndarray, first: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Sums over each row's words, which are the last axis, each as often as its weight says."""
    out = np.zeros(values.shape[:-1] + (len(first) - 1,))
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[..., full] = np.add.reduceat(values if weight is None else values * weight, first[full], axis=-1)
    return out


def _em(likely: np.ndarray, first: np.ndarray, weight: np.ndarray | None, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (languages x rows) and each row's log-likelihood, from p(word | language) scaled by each word's largest; n words each."""
    words = np.diff(first)
    for _ in range(STEPS):
        joint = likely * np.repeat(share, words, axis=1)
        joint /= joint.sum(axis=0)
        share = _sums(joint, first, weight) / n
    return share, _sums(np.log(np.maximum((likely * np.repeat(share, words, axis=1)).sum(axis=0), 1e-300)), first, weight)


def _mixtures(logs: np.ndarray, first: np.ndarray, weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares (languages x rows), the posterior of the best single language, and the log-likelihood less its penalties, from log p(word | language)."""
    k, rows_ = len(logs), len(first) - 1
    words = np.diff(first)
    total = words.astype(float) if weight is None else _sums(np.ones(logs.shape[1]), first, weight)
    most = logs.max(axis=0)
    alone = _sums(logs.astype(np.float64), first, weight)
    likely = np.exp(logs - most, dtype=np.float64)
    np.maximum(likely, 1e-250, out=likely)
    best = alone.argmax(axis=0)
    share = np.zeros((k, rows_))
    share[best, np.arange(rows_)] = 1
    base = _sums(most.astype(np.float64), first, weight)
    reached = alone.max(axis=0) - base
    several = total > 1
    rows, kept = np.flatnonzero(several), np.repeat(several, words)
    part, heavy = likely[:, kept], None if weight is None else weight[kept]
    while len(rows) and k > 1:
        n, size = total[rows], words[rows]
        at = np.concatenate(([0], np.cumsum(size)))
        ratio = part / (part * np.repeat(share[:, rows], size, axis=1)).sum(axis=0)
        has = share[:, rows] > 0
        gain = np.where(has, -np.inf, _sums(ratio, at, heavy) - n)  # the log-likelihood is concave in the shares: nothing gains more than this
        extra = gain.argmax(axis=0)
        worth = gain.max(axis=0) > PENALTY * np.log(n)
        kept = np.repeat(worth, size)
        rows, extra, has, part, heavy = rows[worth], extra[worth], has[:, worth], part[:, kept], None if heavy is None else heavy[kept]
        if not len(rows):
            break
        n, size = total[rows], words[rows]
        sizes = has.sum(axis=0) + 1
        start = share[:, rows] * (1 - 1 / sizes)
        start[extra, np.arange(len(rows))] = 1 / sizes
        new, value = _em(part, np.concatenate(([0], np.cumsum(size))), heavy, n, start)
        value -= PENALTY * np.log(n) * (sizes - 1)
        better = (value > reached[rows]) & (new[extra, np.arange(len(rows))] >= LEAST)
        kept = np.repeat(better, size)
        rows, part, heavy = rows[better], part[:, kept], None if heavy is None else heavy[kept]
        share[:, rows], reached[rows] = new[:, better], value[better]
    return share, 1 / np.exp(np.maximum(alone - alone.max(axis=0), -600)).sum(axis=0), base + reached


def _distinct(hashes: np.ndarray, logs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes, one, at = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, logs[:, one], np.bincount(at, counts, len(hashes))


def _infer(column: pa.Array, model: Model) -> np.ndarray:
    """Share of each language in each row; last columns have the posterior of the best single one, and the evidence."""
    k = len(model.languages)
    found = np.zeros((len(column), k + 2))
    if not k:
        return found
    noise = np.log(BUCKETS)
    for lo, windows in groupby(_text.windows(column, LETTERS, 0, _text.PIECE * 4 // max(4, k)), itemgetter(0)):
        hashes, weight, logs, grams = np.zeros(0, np.uint64), None, np.zeros((k, 0), np.float32), np.zeros(1)
        for several, (_, hi, data, offsets, _) in enumerate(windows):
            some, begin, first = _grams(data, offsets)
            now = np.stack([np.add.reduceat(of[some], begin[:-1]) for of in model.logp]) if len(some) else logs[:, :0]
            if len(offsets) > 2:
                logs, grams = now, np.diff(begin[first])
            else:  # a row alone: of a long one, its different words are kept
                low, starts, ends, _ = _text.words(data, offsets, LETTERS)
                weight = np.zeros(0) if weight is None else weight
                hashes, logs, weight = _distinct(np.concatenate((hashes, _text.word_hash(low, starts, ends))), np.concatenate((logs, now), axis=1), np.concatenate((weight, np.ones(len(starts)))))
                grams, first = grams + len(some) if several else np.array([float(len(some))]), np.array([0, len(hashes)])
        if not logs.shape[1]:
            continue
        share, posterior, reached = _mixtures(logs, first, weight)
        found[lo:hi, :k], found[lo:hi, k], found[lo:hi, k + 1] = share.T, posterior, reached + grams * noise
        found[lo:hi][np.diff(first) == 0] = 0
    return found


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, by default), lang_pred, score, evidence, and shares: map of language to proportion."""
    keep = without(docs.columns if keep is None else keep, RESULTS)
    docs, kept = with_text(docs, keep, text)
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.logp))

    def run(batches):
        model = Model(*shared.value)
        names = [*model.languages, "und"]
        for batch in batches:
            column = batch.column(at)
            found = _infer(column, model)
            shares = found[:, :-2]
            for i in np.flatnonzero(_mostly_odd(column)):
                if not LETTER.search(column[i].as_py()):
                    shares[i] = 0
            known = shares.any(axis=1)
            which = np.where(known, shares.argmax(axis=1) if model.languages else 0, len(model.languages))
            score = shares.max(axis=1, initial=0) * found[:, -2]
            listed = [[(names[j], float(row[j])) for j in np.flatnonzero(row)] for row in shares]
            arrays = [pa.array([names[i] for i in which], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(found[:, -1], pa.float64(), mask=~known), pa.array(listed, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *arrays], names=[*keep, *RESULTS])

    return map_texts(docs, run, f"{kept}lang_pred string, score double, evidence double, shares map<string,double>")


def _mostly_odd(column: pa.Array) -> np.ndarray:
    """Rows without an ASCII letter but with other bytes over 127."""
    found = np.zeros(len(column), bool)
    for lo, hi, data, offsets in _text.pieces(column):
        odd = np.concatenate(([0], np.cumsum(data >= 128)))
        letter = np.concatenate(([0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))))
        found[lo:hi] = (letter[offsets[1:]] == letter[offsets[:-1]]) & (odd[offsets[1:]] > odd[offsets[:-1]])
    return found


def identified(docs: DataFrame, text: str = "text", lang: str = "lang", doubt: float = DOUBT) -> DataFrame:
    """docs without the rows whose language can't be told.

    These are null texts, texts without a letter, and texts whose words noise explains better than
    any mixture of the languages does, by over `doubt` in log-likelihood. The languages are learned
    from docs itself; without labelled rows only letters are asked for.
    """
    model = fit(docs, text, lang)
    at = docs.columns.index(text)
    docs, names = positional(docs)
    if not model.languages:
        return renamed(docs.where(F.col(f"_{at}").rlike(r"\p{L}")), names)
    return renamed(predict(docs, model, f"_{at}").where((F.col("lang_pred") != "und") & (F.col("evidence") >= -doubt)), names)
