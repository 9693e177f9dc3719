"""Importance resampling towards a target distribution.

Word runs are hashed into buckets; the counts of all documents and of all target texts
give each bucket a gain, an array of integers. A document's weight is the sum of the
gains of its features, its score the weight plus noise from its id. The documents with
the highest scores are drawn.

Scores are put in order by a distributed LSD radix sort: the composite key (score, id) is
cut into digits, least significant first, and each pass is a stable counting sort. A row
knows its position; the positions fall into blocks of equal size. A pass counts the
digits of every block, turns the counts into global offsets in the order (digit, block),
and a row's new position is the offset of its digit and block plus its place among the
rows of the block with this digit. Blocks are equal by construction, so equal scores or
ids, however many, never meet in one task. The number of passes depends on the range of
the keys, not on the number of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asciiwords
from .common import Scratch, col

RUN = 3  # words of the longest feature
DIGIT_BITS = 11
BLOCK_ROWS = 1 << 17   # the most rows of a block
LEAST_ROWS = 256


def features(text: str | None, buckets: int, size: int = asciiwords.PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) of the pieces of a text: all
    runs of 1 to 3 consecutive words, joined by a space, by the crc32 of their bytes."""
    tail: list[bytes] = []
    for new in asciiwords.pieces(text, size):
        own = tail + new
        spaced = [b" " + w for w in own[1:]]
        runs = [list(map(crc32, own))]  # the crc32 of a run goes on from that of its beginning
        for n in range(1, RUN):
            runs.append(list(map(crc32, spaced[n - 1:], runs[-1])))
        skip = len(tail)  # what lies in the words before was counted with them
        found = [np.array(r[max(0, skip - n):], dtype=np.int64) for n, r in enumerate(runs)]
        yield len(new), np.concatenate(found) % buckets
        tail = own[-(RUN - 1):]


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over the column ``text``. Tasks add up arrays; the driver
    receives at most one row per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            kept, size = [], 0
            for text in batch.column(0):
                for _, found in features(text.as_py(), buckets):
                    kept.append(found)
                    size += len(found)
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(kept), minlength=buckets)
                        kept, size = [], 0
            if kept:
                total += np.bincount(np.concatenate(kept), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Integer gain of each bucket: 1000 times the logarithm of the smoothed odds of the
    target against the source, rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(id_text: str | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{id_text or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, id_col: str, text_col: str, gain: np.ndarray, min_words: int, seed: int) -> DataFrame:
    """(id, n_features, weight, score, part, at): ``part`` and ``at`` number the rows with
    at least ``min_words`` words within their task, and are null for others."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                few = batch.slice(lo, 1024)
                rows = []
                for id_text, text in zip(few.column(1).to_pylist(), few.column(2)):
                    n_words = n = weight = 0
                    for more, found in features(text.as_py(), len(gain)):
                        n_words += more
                        n += len(found)
                        weight += int(gain[found].sum())
                    in_draw = n_words >= min_words
                    rows.append((n, weight, weight + noise(id_text, seed), part if in_draw else None, at if in_draw else None))
                    at += in_draw
                cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([few.column(0), *cols], names=["id", "n_features", "weight", "score", "part", "at"])

    own = docs.select(col(id_col).alias("id"), col(id_col).cast("string").alias("id_text"), col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, f"id {id_type}, n_features long, weight long, score long, part long, at long")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``pos``, a gapless number from 0 by (part, at), instead of these. One
    window over the counts of the parts, which are the tasks that wrote them."""
    sizes = rows.groupBy("part").agg(F.count("*").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "part").withColumn("pos", F.col("start") + F.col("at")).drop("part", "at", "start")


def _digit(key: Column, shift: int, bits: int) -> Column:
    # The sign bit is flipped: digits then follow the order of signed numbers.
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(flipped, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def counting_pass(rows: DataFrame, key: str, shift: int, bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` at their positions after a stable counting sort by one digit of ``key``.

    Rows are exchanged by (block, digit): at most ``block_rows`` of them belong together.
    The table of counts has a row for each digit that a block holds."""
    own = rows.withColumn("block", F.floor(F.col("pos") / F.lit(block_rows))).withColumn("digit", _digit(F.col(key), shift, bits))
    counts = own.groupBy("block", "digit").agg(F.count("*").alias("n"))
    # Global offsets: all smaller digits (at most 2^bits totals), then this digit in earlier blocks.
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("digit").agg(F.sum("n").alias("all")).select(
        "digit", F.coalesce(F.sum("all").over(smaller), F.lit(0)).alias("base"))
    offsets = (counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(base, "digit")
               .select("block", "digit", (F.col("base") + F.col("before")).alias("offset")))
    stable = Window.partitionBy("block", "digit").orderBy("pos")
    placed = own.withColumn("among", F.row_number().over(stable) - 1).join(offsets, ["block", "digit"])
    return placed.withColumn("pos", F.col("offset") + F.col("among")).select(*rows.columns)


def block_size(rows: int, tasks: int) -> int:
    """Several blocks for each task of a shuffle, within the limits: rows that share a
    digit then spread over all tasks."""
    return max(LEAST_ROWS, min(BLOCK_ROWS, -(-rows // (4 * tasks))))


def radix_sort(scratch: Scratch, rows: DataFrame, keys: Sequence[str], bits: int = DIGIT_BITS,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows(pos, …)`` with ``pos`` the position in ascending order of the long columns
    ``keys``, the first one most significant; ties keep their order. Each pass is written,
    so a lost executor repeats one pass at most."""
    ends = rows.agg(*[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    state, name = rows, None
    for i in range(len(keys) - 1, -1, -1):
        if ends[f"lo{i}"] is None:
            continue
        # Bits above the highest one that differs are the same in all keys.
        used = ((ends[f"lo{i}"] ^ ends[f"hi{i}"]) & ((1 << 64) - 1)).bit_length()
        for shift in range(0, used, bits):
            done = f"sort-{i}-{shift}"
            state = scratch.keep(counting_pass(state, keys[i], shift, bits, block_rows), done)
            if name:
                scratch.drop(name)
            name = done
    return state


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """Every row's (id, n_features, weight, score, rank): ``rank`` numbers the drawn rows
    from 1, by score from the highest, ties by the smaller id; null for the rest. Of the
    rows with at least ``min_words`` words, ``percent`` in a hundred are drawn.

    The counts cover all of ``docs`` and of ``target``; what the tasks receive is one
    integer per bucket.

    Defined cases: a null or empty text has no words, weight 0, and takes no part in the
    draw; a null id is hashed as the empty text and sorts behind other ids; ids must be
    integers; repeated rows are counted, scored and drawn each (equal in score and id,
    they rank in the order in which they were scored); an empty target or an empty table
    is all zeros; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    text = col(text_col).cast("string").alias("text")
    source = bucket_counts(docs.select(text), buckets)
    wanted = bucket_counts(target.select(col(target_text_col).cast("string").alias("text")), buckets)
    scored = scratch.keep(score(docs, id_col, text_col, gains(source, wanted), min_words, seed), "scored")
    in_draw = numbered(scored.where("part is not null"))
    size = scored.where("part is not null").count()
    order = in_draw.select("*", F.bitwise_not("score").alias("down"), F.col("id").isNull().cast("long").alias("no_id"),
                           F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long")).alias("id_key"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = radix_sort(scratch, scratch.keep(order, "numbered"), ["down", "no_id", "id_key"], block_rows=block_size(size, tasks))
    drawn = size * percent // 100
    result = ["id", "n_features", "weight", "score"]
    ranked = done.select(*result, F.when(F.col("pos") < drawn, F.col("pos") + 1).cast("long").alias("rank"))
    return ranked.unionByName(scored.where("part is null").select(*result, F.lit(None).cast("long").alias("rank")))
