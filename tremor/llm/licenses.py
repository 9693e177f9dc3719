"""License scans by diagonal voting.

All rolling hashes of k words of all documents are joined by Spark to the positions of
the same hashes in a set of license texts. A hit votes for the diagonal (document
position minus template position): the words of a copied license text lie on one
diagonal, and a few inserted or deleted words move the rest to a neighbouring one.
Votes are counted per document, template and diagonal, neighbouring diagonals are merged,
and what has enough votes is verified word by word on the text itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import asciiwords
from .common import Scratch, col
from .lineruns import text_key

# Phrases that name a license by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Public license texts and the notices that refer to them.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
               "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
               "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
               "limitations under the License."),
    ("gpl", "this work is licensed under the GNU General Public License"),
    ("gpl", "licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "released under the BSD License"),
    ("bsd", "licensed under the BSD License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
            "following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
                  "or non-commercial, and by any means."),
    ("cc0", "dedicated to the public domain under CC0"),
    ("cc-by", "licensed under CC BY"),
    ("cc-by-sa", "licensed under CC BY-SA"),
    ("cc-by-nc", "licensed under CC BY-NC"),
    ("cc-by-nd", "licensed under CC BY-ND"),
    ("cc-by-nc-sa", "licensed under CC BY-NC-SA"),
    ("cc-by-nc-nd", "licensed under CC BY-NC-ND"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

GRAM = 3             # words of a gram
MIN_COVERAGE = 0.8   # share of a template's words that a span must hold in matching grams
MAX_SLACK = 12       # words that may be inserted or deleted within a long template
MAX_TEMPLATE_GRAMS = 100_000
PIECE_WORDS = 1 << 16
_FACTOR = 0x9E3779B97F4A7C15


class Template(NamedTuple):
    label: str
    words: list[bytes]
    slack: int


def templates(texts=TEMPLATES) -> list[Template]:
    out = []
    for label, text in texts:
        own = asciiwords.words(text)
        if len(own) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        if not re.fullmatch(r"[^,]+", label):
            raise ValueError("labels are joined by commas")
        out.append(Template(label, own, max(1, min(MAX_SLACK, len(own) // 8))))
    return out


@lru_cache(maxsize=200_000)
def _word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def grams(words: list[bytes], n: int = GRAM) -> np.ndarray:
    """Rolling hash of every run of ``n`` words: a polynomial over word hashes, mod 2^64."""
    if len(words) < n:
        return np.zeros(0, np.int64)
    h = np.array([_word_hash(w) for w in words], dtype=np.uint64)
    size = len(h) - n + 1
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(_FACTOR) + h[j:j + size]
    return out.view(np.int64)


def template_grams(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(gram, template, at, slack): a row for each position of each template; the
    templates are a parameter, and their size is checked."""
    rows = [(g, n, at, t.slack) for n, t in enumerate(known) for at, g in enumerate(grams(t.words).tolist())]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError(f"{len(rows)} grams of templates; they are broadcast and must be at most {MAX_TEMPLATE_GRAMS}")
    return spark.createDataFrame(rows, "gram long, template int, at int, slack int")


def _document_grams(docs: DataFrame) -> DataFrame:
    """(k1, k2, start, grams): the grams of a text in pieces of bounded length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                k1, k2, start, found = [], [], [], []
                for a, b, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(2)):
                    words = asciiwords.words(text.as_py())
                    for at in range(0, max(0, len(words) - GRAM + 1), PIECE_WORDS):
                        k1.append(a), k2.append(b), start.append(at)
                        found.append(grams(words[at:at + PIECE_WORDS + GRAM - 1]))
                sizes = np.cumsum([0, *map(len, found)])
                flat = pa.array(np.concatenate(found)) if found else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(start, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["k1", "k2", "start", "grams"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, start int, grams array<long>")


def candidates(docs: DataFrame, known: list[Template], min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(k1, k2, found array<struct<template, diagonals>>) of the texts where merged
    diagonals have enough votes: covering a share of a template takes at least that
    share of its words over the gram length, so the limit loses nothing.

    Copies of a row (equal id and text) share a key and may vote more than once; the
    verification does not depend on the number of votes."""
    hits = (_document_grams(docs).select("k1", "k2", "start", F.posexplode("grams").alias("i", "gram"))
            .join(F.broadcast(template_grams(docs.sparkSession, known)), "gram")
            .select("k1", "k2", "template", "slack", (F.col("start") + F.col("i") - F.col("at")).alias("diagonal")))
    votes = hits.groupBy("k1", "k2", "template", "slack", "diagonal").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack")
    merged = (votes.withColumn("new", F.coalesce(apart, F.lit(False)).cast("int"))
              .withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("k1", "k2", "template", "group")
              .agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_list("diagonal")).alias("diagonals")))
    need = F.create_map(*[F.lit(x) for n, t in enumerate(known) for x in (n, int(np.ceil(min_coverage * len(t.words) / GRAM - 1e-9)))])
    enough = merged.where(F.col("votes") >= need[F.col("template")])
    return enough.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("template", "diagonals"))).alias("found"))


# ---------------------------------------------------------------- verification of one text

def covered(words: np.ndarray, own: np.ndarray, diagonal: int, n: int = GRAM) -> np.ndarray:
    """Template positions whose words stand on the diagonal in runs of at least ``n``."""
    at = np.arange(len(own)) + diagonal
    inside = (at >= 0) & (at < len(words))
    same = np.zeros(len(own), bool)
    same[inside] = words[at[inside]] == own[inside]
    full = np.convolve(same, np.ones(n, int), "valid") == n if len(own) >= n else np.zeros(0, bool)
    out = np.zeros(len(own), bool)
    for j in range(n):
        out[j:j + len(full)] |= full
    return out


class Span(NamedTuple):
    label: str
    first: int
    last: int
    matched: int
    coverage: float


def verify(words: list[bytes], found: list[tuple[int, list[int]]], known: list[Template],
           min_coverage: float = MIN_COVERAGE) -> list[Span]:
    """The verified spans of a text, of overlapping ones the one with most words (then
    the greater coverage). Around the diagonal that covers most, those within the slack
    count together; what is left over is looked at again."""
    number: dict[bytes, int] = {}
    for n, _ in found:
        for w in known[n].words:
            number.setdefault(w, len(number) + 1)
    ids = np.array([number.get(w, 0) for w in words], dtype=np.int64)
    spans = []
    for n, diagonals in found:
        t = known[n]
        own = np.array([number[w] for w in t.words])
        marks = {d: m for d in sorted(diagonals) if (m := covered(ids, own, d)).any()}
        line, used = list(marks), set()
        for anchor in sorted(line, key=lambda d: (-int(marks[d].sum()), d)):
            if anchor in used:
                continue
            near = [d for d in line[bisect_left(line, anchor - t.slack):bisect_right(line, anchor + t.slack)] if d not in used]
            used.update(near)
            union = np.any([marks[d] for d in near], axis=0)
            coverage = float(union.sum()) / len(own)
            if coverage >= min_coverage:
                at = np.concatenate([np.flatnonzero(marks[d]) + d for d in near])
                spans.append(Span(t.label, int(at.min()), int(at.max()), int(union.sum()), coverage))
    spans.sort(key=lambda s: (-s.matched, -s.coverage, s.first, s.label))
    kept: list[Span] = []
    for s in spans:
        if all(s.last < o.first or o.last < s.first for o in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s.first, s.label))


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases:
        own = asciiwords.words(phrase)
        at = -1
        while True:
            try:
                at = words.index(own[0], at + 1)
            except ValueError:
                break
            if words[at:at + len(own)] == own:
                out.append((at, label))
    return out


RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "spans array<struct<label: string, first: int, last: int, matched: int, coverage: double>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts=TEMPLATES, phrases=PHRASES,
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans).

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the
    smallest and largest start. ``labels`` are those of the phrases and of the verified
    ``spans``; ``score`` is the best coverage of a span, 1 if a phrase was found, 0 if
    nothing was.

    Texts are read twice, for the votes and for phrases and verification. The second
    reading looks up the few texts with candidates; Spark broadcasts those if they are
    small and joins by key otherwise.

    Defined cases: a null or empty text has no words and no label (empty strings, null
    places); a null id is like any other; rows equal in id and text have the same
    result each; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    known = templates(texts)
    id_type = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), *text_key(id_col, text_col))
    found = scratch.keep(candidates(keyed, known, min_coverage), "candidates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                rows = []
                for text, cand in zip(few.column(1), few.column(2)):
                    words = asciiwords.words(text.as_py())
                    base = phrase_places(words, phrases)
                    cand = cand.as_py()
                    spans = verify(words, [(c["template"], c["diagonals"]) for c in cand], known, min_coverage) if cand else []
                    named = {label for _, label in base}
                    starts = [at for at, _ in base]
                    rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)),
                                 ",".join(sorted(named | {s.label for s in spans})),
                                 1.0 if base else max((s.coverage for s in spans), default=0.0), [s._asdict() for s in spans]))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                    [("label", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([few.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                                 names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return (keyed.join(found, ["k1", "k2"], "left").select("id", "text", "found")
            .mapInArrow(run, f"id {id_type}, {RESULT}"))
