"""Language identification by rank-order n-gram profiles.

A language profile is the list of the most frequent character n-grams of its training
texts, in order. A document's own most frequent n-grams are compared to each profile by
the out-of-place distance: the sum over them of how far apart the two ranks are, or of
the profile length where the profile lacks the n-gram. The nearest profile wins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
MAX_GRAM = 3
_GRAMS: dict[str, np.ndarray] = {}


def grams(word: str) -> np.ndarray:
    """The n-grams (1 to 3 code points) of a word between blanks, each packed into an
    integer of 21 bits a code point."""
    kept = _GRAMS.get(word)
    if kept is None:
        points = np.array([32, *map(ord, word), 32], dtype=np.int64)
        out, packed = [points[1:-1]], points
        for n in range(2, MAX_GRAM + 1):
            packed = (packed[:-1] << 21) | points[n - 1:]
            out.append(packed)
        kept = np.concatenate(out)
        if len(_GRAMS) >= 200_000:  # a bounded memory of frequent words
            _GRAMS.clear()
        if len(word) <= 40:
            _GRAMS[word] = kept
    return kept


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams ascending, counts) of a whole text; empty if it has no letter."""
    words = Counter(WORD.findall((text or "").lower()))
    if not any(any(map(str.isalpha, w)) for w in words):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lists = [grams(w) for w in words]
    times = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), [len(x) for x in lists])
    found, place = np.unique(np.concatenate(lists), return_inverse=True)
    return found, np.bincount(place, weights=times).astype(np.int64)


def ranked(found: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; ties by code points."""
    return found[np.lexsort((found, -counts))[:size]]


def held_out(id_column: Column, folds: int = 4, fold: int = 2) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, size: int = 300,
          per_language: int = 3000) -> dict[str, list[int]]:
    """Profiles of ``size`` n-grams per language from the rows that are not held out and
    have text and language.

    ``per_language`` bounds the sample: about so many texts per language are counted,
    chosen by a hash of the id; all if there are fewer. The driver receives ``size``
    n-grams per language."""
    train = docs.where(~held_out(col(id_col)) & col(text_col).isNotNull() & col(lang_col).isNotNull())
    train = train.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"),
                         F.pmod(F.xxhash64(col(id_col).cast("string")), F.lit(1 << 30)).alias("h"))
    share = train.groupBy("lang").agg(F.least(F.lit(1.0), per_language / F.count("*")).alias("share"))
    share = {r["lang"]: r["share"] for r in share.collect()}
    if not share:
        return {}
    limit = F.create_map(*[F.lit(x) for k, v in share.items() for x in (k, int(v * (1 << 30)))])[F.col("lang")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, counts = gram_counts(text)
                own = total.setdefault(lang, Counter())
                for g, n in zip(found.tolist(), counts.tolist()):
                    own[g] += n
        for lang, own in total.items():
            keys = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()),
                                              pa.array([own[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    sums = (train.where(F.col("h") < limit).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).orderBy("lang", "rank")
    profiles: dict[str, list[int]] = {}
    for r in top.collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Classifier:
    """Profiles as one table: a row per n-gram, its rank in each language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(profiles)
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.rank = np.full((len(self.known) + 1, len(self.langs)), -1, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.known, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one minus the distance as a share of the
        largest possible one; ties go to the first language by name."""
        found, counts = gram_counts(text)
        if not len(found) or not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(found, counts, self.size)
        at = np.searchsorted(self.known, own)
        hit = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == own)
        ranks = self.rank[np.where(hit, at, len(self.known))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(apart))
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             size: int = 300, per_language: int = 3000, carry: bool = False,
             results: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """Language of every whole text: the id column, ``held_out``, ``lang_pred``, ``score``;
    with ``carry`` all columns of ``docs`` instead of the id column alone. ``results``
    names the three columns.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so
    is everything if there is nothing to learn from; a null id is not held out; repeated
    rows are predicted each; an empty table gives an empty result; other columns are
    ignored, or with ``carry`` passed through, where one that is called like a result
    column is an error.
    """
    names = docs.columns if carry else [id_col]
    if clash := {c.lower() for c in names} & {r.lower() for r in results}:
        raise ValueError(f"the documents already have {sorted(clash)}; choose other names")
    model = Classifier(learn(docs, id_col, text_col, lang_col, size, per_language), size)
    # Columns travel under plain names; the text once, also if it is carried.
    plain = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*names, id_col, text_col]))}
    back = [plain[c] for c in names]
    rows = docs.select(*[col(c).cast("string").alias(p) if c == text_col else col(c).alias(p) for c, p in plain.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                got = [model.predict(t) for t in part.column(plain[text_col]).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in back), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], names=[*back, "lang_pred", "score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in back)
    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(plain[c]).alias(c) for c in names], held_out(F.col(plain[id_col])).alias(results[0]),
                      F.col("lang_pred").alias(results[1]), F.col("score").alias(results[2]))
