"""Repetition coverage: how much of a text lies in n-grams or lines that repeat.

Word n-grams of several lengths are hashed with a rolling polynomial over word
numbers, for all texts of a batch at once, and the characters inside later copies of
n-grams are counted once per text. A text is rejected if these characters, or those of
repeated lines, exceed a share of its word characters. A short frame, the last copy of the
lines that open the text, does not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

# Shares of the word characters, by n-gram length: the most frequent n-gram for short
# ones, later copies of any n-gram for long ones; and for later copies of lines.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.15
# One copy of the opening lines is boilerplate, up to this many words.
FRAME_WORDS = 20
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WORD = re.compile("[^\x20\x09-\x0D]+")
SYMBOL = re.compile("[#*$%&|<>]")
BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "dup_line_chars long, frame_chars long, top_chars array<long>, dup_chars array<long>, base_failed boolean, kept boolean")


def _duplicates(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group number per entry, count per entry) of equal names."""
    _, group, count = np.unique(names, return_inverse=True, return_counts=True)
    return group, count[group]


def _later(names: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    _, group = np.unique(names, return_inverse=True)
    first = np.empty(len(names), dtype=np.int64)
    at = np.arange(len(names))
    first[group[::-1]] = at[::-1]  # of equal groups the smallest position is written last
    return at != first[group]


def _frame(lines: list[str]) -> tuple[int, int]:
    """The last copy of the opening lines, all that follow alike: (words from its start
    to the end of the text, its words); none if it has over ``FRAME_WORDS`` words."""
    at = next((j for j in range(len(lines) - 1, 0, -1) if lines[j] == lines[0]), None)
    if at is None:
        return 0, 0
    words = 0
    for line, opening in zip(lines[at:], lines[:at]):
        if line != opening:
            break
        words += sum(1 for _ in islice(WORD.finditer(line), FRAME_WORDS + 1))
        if words > FRAME_WORDS:
            return 0, 0
    return sum(len(WORD.findall(line)) for line in lines[at:]), words


def _covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in the windows of ``n`` words at ``starts``."""
    steps = np.zeros(total + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Counts per text; see the column names of ``SCHEMA``."""
    number: dict[str, int] = {}
    ids, lengths, words_of, symbols, dup_lines, dup_line_chars, frames = [], [], [], [], [], [], []
    for text in texts:
        text = text or ""
        words = WORD.findall(text)
        ids.extend([number.setdefault(w, len(number)) for w in words])
        lengths.extend(map(len, words))
        words_of.append(len(words))
        symbols.append(len(SYMBOL.findall(text)))
        seen, again, chars = set(), 0, 0
        lines = [line for line in text.split("\n") if WORD.search(line)]
        for line in lines:
            if line in seen:
                again += 1
                chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
        frames.append(_frame(lines))
        dup_lines.append(again)
        dup_line_chars.append(chars)
    n_words = np.array(words_of, dtype=np.int64)
    m, total = len(texts), int(n_words.sum())
    text_of = np.repeat(np.arange(m), n_words)
    end_of = np.cumsum(n_words)[text_of] if total else np.zeros(0, dtype=np.int64)
    chars = np.array(lengths, dtype=np.int64)
    prefix = np.concatenate([[0], np.cumsum(chars)])
    word = np.array(ids, dtype=np.uint64)
    at = np.arange(total)
    back, long = np.array(frames, dtype=np.int64).reshape(m, 2).T
    since = at - (end_of - np.repeat(back, n_words))
    frame = (since >= 0) & (since < np.repeat(long, n_words))

    def windows(n: int) -> np.ndarray:
        return np.flatnonzero(at + n <= end_of)

    def per_text(mask: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[mask], weights=weights[mask], minlength=m).astype(np.int64)

    # Three-word windows by exact names: numbers of pairs, then of pair and word.
    w3 = windows(3)
    repeat = np.zeros(m, dtype=np.int64)
    if len(w3):
        size = np.int64(len(number) + 1)
        pair, _ = _duplicates(word[w3].astype(np.int64) * size + word[w3 + 1].astype(np.int64))
        triple, _ = _duplicates(pair * size + word[w3 + 2].astype(np.int64))
        _, count = _duplicates(triple * np.int64(m) + text_of[w3])
        repeat = per_text(_covered(w3[count > 1], 3, total), np.ones(total))
    # Rolling hashes: h(n) = h(n - 1) * BASE + word, of every length in turn; the text's
    # number is mixed in, so that windows of different texts never compare equal.
    mixed = (word + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    own = (text_of.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    hashed = mixed.copy()
    top, dup = {}, {}
    for n in range(2, max(DUP_LIMITS) + 1):
        starts = windows(n)
        rolled = np.zeros(total, dtype=np.uint64)
        rolled[starts] = hashed[starts] * BASE + mixed[starts + n - 1]
        hashed = rolled
        if n not in TOP_LIMITS and n not in DUP_LIMITS:
            continue
        if not len(starts):
            (top if n in TOP_LIMITS else dup)[n] = np.zeros(m, dtype=np.int64)
            continue
        names = hashed[starts] ^ own[starts]
        if n in TOP_LIMITS:
            group, count = _duplicates(names)
            # Characters of the most frequent n-gram (the longest among the most frequent).
            span = prefix[starts + n] - prefix[starts]
            twice = count > 1
            best = np.zeros(m, dtype=np.int64)
            most = np.zeros(m, dtype=np.int64)
            np.maximum.at(most, text_of[starts[twice]], count[twice])
            lead = twice & (count == most[text_of[starts]])
            np.maximum.at(best, text_of[starts[lead]], count[lead] * span[lead])
            top[n] = best
        else:
            dup[n] = per_text(_covered(starts[_later(names)], n, total) & ~frame, chars)
    return {"n_words": n_words, "word_chars": per_text(np.ones(total, dtype=bool), chars),
            "n_symbols": np.array(symbols, dtype=np.int64), "n_dup_lines": np.array(dup_lines, dtype=np.int64),
            "n_repeat_words": repeat, "dup_line_chars": np.array(dup_line_chars, dtype=np.int64),
            "frame_chars": per_text(frame, chars),
            "top_chars": np.stack([top[n] for n in TOP_LIMITS], axis=1),
            "dup_chars": np.stack([dup[n] for n in DUP_LIMITS], axis=1)}


def verdict(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) from the counts."""
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
    size = np.maximum(x["word_chars"], 1)
    bad = x["dup_line_chars"] - x["frame_chars"] > LINE_LIMIT * size
    for name, limits in (("top_chars", TOP_LIMITS), ("dup_chars", DUP_LIMITS)):
        for k, limit in enumerate(limits.values()):
            bad |= x[name][:, k] > limit * size
    return failed, ~failed & ~bad


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 22) -> DataFrame:
    """One row per document: the id column and the counts and verdict of ``SCHEMA``.

    Texts are measured in groups of about ``batch_chars`` characters; a longer text is
    a group of its own. ``top_chars`` and ``dup_chars`` follow the n-gram lengths of
    ``TOP_LIMITS`` and ``DUP_LIMITS``; ``dup_chars`` counts words inside later copies (an
    n-gram that starts earlier in the text too) outside the frame, ``frame_chars`` the
    frame itself.

    Defined cases: a null, empty or blank text has zero words and fails the base
    checks; a null id stays null; repeated rows are measured each; an empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t) + 1 if t else 1 for t in (x.as_py() for x in batch.column(1))] if batch.num_rows else []
            lo, held = 0, 0
            for hi, size in enumerate([*sizes, None]):
                if size is None or (held and held + size > batch_chars):
                    if hi > lo:
                        yield _rows(batch.slice(lo, hi - lo))
                    lo, held = hi, 0
                held += size or 0

    def _rows(part: pa.RecordBatch) -> pa.RecordBatch:
        x = measure(part.column(1).to_pylist())
        failed, kept = verdict(x)
        lists = [pa.array(list(x[n]), pa.list_(pa.int64())) for n in ("top_chars", "dup_chars")]
        flat = [pa.array(x[n], pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "frame_chars")]
        names = [id_col, *(f.split()[0] for f in SCHEMA.split(", "))]
        return pa.RecordBatch.from_arrays([part.column(0), *flat, *lists, pa.array(failed), pa.array(kept)], names=names)

    return docs.select(col(id_col), col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")
