"""License scan by diagonal voting.

All rolling word k-grams of all texts are joined to the places of the same k-grams in license
templates: by hash, and word by word, as each gram brings its words. Where a text follows a
template, its matches share the diagonal `text place - template place`; matches are gathered by
diagonal, a template's size of them at most, and neighbouring diagonals (an inserted or a missing
word shifts the diagonal) are merged into spans as they come in the order of the text, so a task
holds one span at a time, however often a text repeats a template. A span is verified if the template words that stand in it in the template's order, in
grams that match, are at least `share` of the template.

Besides, phrases of the `BASE` list are found wherever their words stand consecutively. Words are
runs of letters, digits and non-ASCII characters, A-Z lower-cased. Null texts are empty. Rows that
repeat an id and its text have the same result; the same id with another text is another document.
Texts are read in windows of about a megabyte. Only the id and the text of docs are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import _text
from ledgerlens.llm._spark import ddl, map_texts, quoted

#: Words of a gram, diagonals that may lie apart within a span, share of a template that must be covered.
K, GAP, SHARE = 3, 8, 0.75
#: Template words whose grams are broadcast; those of more are joined by a shuffle.
TEMPLATE_WORDS = 200_000

# Phrases and the labels that they give.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as licenses word them, by label.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at"),
]


def _words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    low, starts, ends, _ = _text.words(data, np.array([0, len(data)]))
    return [low[a:b].tobytes() for a, b in zip(starts, ends)], _text.word_hash(low, starts, ends)


def _phrases(docs: DataFrame, text: str, base: dict[str, str]) -> DataFrame:
    """docs without its text, with n_words, n_base, first_word, last_word and base_list."""
    kept = [c for c in docs.columns if c != text]
    at = docs.columns.index(text)
    longest = max((len(_words_of(p)[0]) for p in base), default=1)

    def run(batches):
        known = []
        for phrase, label in base.items():
            spelled, h = _words_of(phrase)
            known.append((spelled, _text.gram_hash(h, len(h))[0], label))
        for batch in batches:
            n = batch.num_rows
            counts, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
            least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            labels: dict[int, set[str]] = {}
            for lo, hi, data, offsets, again in _text.windows(batch.column(at), _text.ALNUM, longest - 1):
                low, starts, ends, first = _text.words(data, offsets)
                before = int(counts[lo]) - again  # words of the row before this window of it
                counts[lo:hi] += np.diff(first) - again
                h = _text.word_hash(low, starts, ends)
                for spelled, wanted, label in known:
                    size = len(spelled)
                    hits = np.flatnonzero(_text.gram_hash(h, size) == wanted)
                    for i in hits[_text.grams_within_rows(first, size)[hits]].tolist():
                        if [low[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size])] != spelled:
                            continue
                        row = int(np.searchsorted(first, i, "right")) - 1
                        if row == 0 and i + size <= again:
                            continue  # wholly among the words that the window before had
                        place, row = i - int(first[row]) + (before if row == 0 else 0), lo + row
                        places[row] += 1
                        least[row] = place if least[row] < 0 else min(least[row], place)
                        most[row] = max(most[row], place)
                        labels.setdefault(row, set()).add(label)
            none = places == 0
            arrays = [pa.array(counts), pa.array(places), pa.array(least, mask=none), pa.array(most, mask=none), pa.array([sorted(labels.get(i, ())) for i in range(n)], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + arrays, names=[*kept, "n_words", "n_base", "first_word", "last_word", "base_list"])

    return map_texts(docs, run, f"{ddl(docs.select(*kept))}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_list array<string>")


WORDS = [f"word{j}" for j in range(K)]


def _grams(docs: DataFrame, text: str) -> DataFrame:
    """docs without its text, with grams: at, hash and words of word k-grams in order; a row for each window of a text."""
    kept = [c for c in docs.columns if c != text]
    at = docs.columns.index(text)
    kind = pa.struct([("at", pa.int32()), ("gram", pa.int64()), *((w, pa.string()) for w in WORDS)])

    def run(batches):
        for batch in batches:
            rest = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            for _, windows in groupby(_text.windows(batch.column(at), _text.ALNUM, K - 1), itemgetter(0)):
                before = 0
                for lo, hi, data, offsets, again in windows:
                    low, starts, ends, first = _text.words(data, offsets)
                    ok = np.flatnonzero(_text.grams_within_rows(first, K))
                    h = _text.gram_hash(_text.word_hash(low, starts, ends), K).view(np.int64)[ok]
                    size = np.maximum(np.diff(first) - (K - 1), 0)
                    place = ok - np.repeat(first[:-1], size) + (before - again)
                    before += len(starts) - again
                    letters = pa.py_buffer(low[low != 0].tobytes())
                    bounds = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
                    every = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), letters)
                    parts = [every.take(pa.array(ok + j)) for j in range(K)]
                    grams = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(h), *parts], fields=list(kind))
                    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), grams)
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in rest), listed], names=[*kept, "grams"])

    words = ",".join(f"{w}:string" for w in WORDS)
    return map_texts(docs, run, f"{ddl(docs.select(*quoted(*kept)))}, grams array<struct<at:int,gram:bigint,{words}>>")


def _template_grams(spark, templates: list[tuple[str, str]]) -> DataFrame:
    rows = []
    for t, (label, text) in enumerate(templates):
        spelled, h = _words_of(text)
        rows += [(int(g), *(spelled[i + j].decode() for j in range(K)), t, i, len(spelled), label) for i, g in enumerate(_text.gram_hash(h, K).view(np.int64).tolist())]
    words = ", ".join(f"{w} string" for w in WORDS)
    found = spark.createDataFrame(rows, f"gram bigint, {words}, template int, place int, size int, label string")
    return F.broadcast(found) if len(rows) <= TEMPLATE_WORDS else found


def merged(matches: Iterable[tuple[tuple, int, int, int, int, list[tuple[int, int]]]], gap: int = GAP) -> Iterator[tuple[tuple, int, int, int, list[tuple[int, int]]]]:
    """Spans (who, size, first word, last word, matches) of rows (who, size, diagonal, first, last, matches (text place, template place)).

    Rows come by who (a text and a template), first and diagonal. No span grows beyond twice the template's size.
    """
    held = None
    for who, size, diagonal, first, last, pairs in matches:
        if held and who == held[0] and abs(diagonal - held[2]) <= gap and first <= held[4] + gap and last + K - held[3] <= 2 * size:
            held[2] = diagonal
            held[4] = max(last, held[4])
            held[5] += pairs
            continue
        if held:
            yield held[0], held[1], held[3], held[4] + K - 1, held[5]
        held = [who, size, diagonal, first, last, list(pairs)]
    if held:
        yield held[0], held[1], held[3], held[4] + K - 1, held[5]


def verified(spans: Iterable[tuple]) -> Iterator[tuple]:
    """(who, first word, last word, coverage) of the spans that cover enough of their template."""
    for who, size, first, last, pairs in spans:
        if len({p + j for _, p in pairs for j in range(K)}) < SHARE * size:
            continue
        share = covered(pairs) / size
        if share >= SHARE:
            yield who, first, last, share


def covered(pairs: list[tuple[int, int]]) -> int:
    """How many template words stand in order: those of the longest run of matches that rises in text and in template."""
    words = sorted({(at + j, place + j) for at, place in pairs for j in range(K)}, key=lambda w: (w[0], -w[1]))
    ends: list[int] = []
    for _, place in words:
        i = bisect_right(ends, place - 1)
        ends[i : i + 1] = [place]
    return len(ends)


def spans(docs: DataFrame, key: list[str], text: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """key, label, first, last and coverage of each verified span; places are words, from 0."""
    grams = _grams(docs.select(*quoted(*key, text)), text).select(*quoted(*key), F.inline("grams"))
    votes = grams.join(_template_grams(docs.sparkSession, templates or TEMPLATES), ["gram", *WORDS])
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*quoted(*key), "template", "label", "size", "diagonal")
    votes = votes.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set(F.struct("at", "place")).alias("pairs"))
    votes = votes.repartition(*quoted(*key), "template").sortWithinPartitions(*quoted(*key), "template", "first", "diagonal")

    def run(batches):
        kinds: list[pa.DataType] = []

        def rows():
            for batch in batches:
                kinds[:] = [column.type for column in batch.columns[: len(key)]]
                who = zip(*(batch.column(i).to_pylist() for i in [*range(len(key)), batch.schema.get_field_index("template"), batch.schema.get_field_index("label")]))
                size, diagonal, first, last, pairs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("size", "diagonal", "first", "last", "pairs"))
                for row in zip(who, size, diagonal, first, last, pairs):
                    yield *row[:5], [(p["at"], p["place"]) for p in row[5]]

        found = verified(merged(rows()))
        while some := list(islice(found, 1_000)):
            who, first, last, share = zip(*some)
            keys = list(zip(*who))
            arrays = [pa.array(values, kind) for values, kind in zip(keys[: len(key)], kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys[-1], pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(share, pa.float64())], names=[*key, "label", "first", "last", "coverage"])

    return votes.mapInArrow(run, f"{ddl(docs.select(*quoted(*key)))}, label string, first bigint, last bigint, coverage double")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: key, the places of base phrases, all labels, and score.

    The score is 1 with a base phrase, else the largest coverage of a span, else 0.
    """
    docs = docs.select(F.col(quoted(key)[0]).alias("_key"), F.xxhash64(quoted(text)[0]).alias("_text_hash"), F.col(quoted(text)[0]).alias("_text"))
    found = spans(docs, ["_key", "_text_hash"], "_text", templates)
    found = found.groupBy(F.col("_key").alias("_id"), F.col("_text_hash").alias("_hash")).agg(F.collect_set("label").alias("_labels"), F.max("coverage").alias("_coverage"))
    rows = _phrases(docs, "_text", BASE if base is None else base)
    rows = rows.join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    every = F.array_sort(F.array_union("base_list", F.coalesce("_labels", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.coalesce("_coverage", F.lit(0.0)), F.lit(1.0)))
    return rows.select(F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", F.array_join("base_list", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
