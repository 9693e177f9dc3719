"""Best-fit packing of token sequences by linear grouping.

``pack`` tokenizes documents, cuts those longer than a sequence, and places every
piece at an offset of a numbered sequence so that few sequences are needed.

The plan works on the histogram of piece lengths, which has at most ``capacity``
entries whatever the number of documents:

1. large lengths are sorted and divided into groups of equal cardinality, and each
   length is rounded up to the largest of its group;
2. the best mix of configurations (multisets of the few rounded sizes that fit one
   sequence) is found by column generation: a small linear program whose pricing step
   is an integer knapsack; its solution is rounded down;
3. actual pieces are substituted in the slots of each configuration: the longest up to
   the size of the slot, in the last slot the longest that fits; the room that rounding
   up leaves takes the longest pieces that fit, small ones mostly;
4. what is left goes longest first to the sequences with the least room that still fits
   (best fit); new sequences open only if none does.

All steps handle runs of equal sequences at once, so the plan has a few thousand
rows. Each piece finds its place by its length and its rank among the pieces of that
length; ranks are counted per (length, salt) and need no group in one task.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"
SPECIAL = "<|endoftext|>"
_TOKENIZERS: dict = {}


def _place_of(name: str) -> str:
    """A tokenizer file by its path, or by its name among the installed public ones."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(tokenizer: str, ranks: str | None):
    """``texts -> list of id lists``, loaded once per Python worker.

    ``tokenizer`` is a file of the ``tokenizers`` library and defines the ids. With
    ``ranks`` (the same vocabulary as byte ranks) plain text takes the faster
    ``tiktoken`` encoder; texts that hold the vocabulary's special string still go
    through ``tokenizers``."""
    key = (tokenizer, ranks)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = _load(tokenizer, ranks)
    return _TOKENIZERS[key]


def _load(tokenizer: str, ranks: str | None):
    kept: list = []

    def slow(text: str) -> list[int]:
        if not kept:  # loaded when a text needs it
            from tokenizers import Tokenizer

            kept.append(Tokenizer.from_file(_place_of(tokenizer)))
        return kept[0].encode(text, add_special_tokens=False).ids

    if ranks is None:
        return lambda texts: [slow(t) for t in texts]
    import public_tokenizers
    import tiktoken

    with open(_place_of(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda texts: [slow(t) if SPECIAL in t else quick(t) for t in texts]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: one if they fit, else pieces of
    ``capacity`` with the remainder as the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    head = [(0, first)] if first else []
    return head + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, ranks: str | None,
           capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece: the id column, piece, start, length, ids_crc32 (and ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {PIECE_SCHEMA}" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):  # the ids of few texts at a time
                part = batch.slice(lo, 512)
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for k, ids in enumerate(encode([t or "" for t in part.column(1).to_pylist()])):
                    ids = np.append(np.asarray(ids, dtype="<u4"), np.uint32(end_id)).astype("<u4")
                    for j, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start:start + length]
                        for store, v in zip(out, (k, j, start, length, zlib.crc32(own.tobytes()),
                                                  own.astype("i4") if keep_ids else None)):
                            store.append(v)
                cols = [part.column(0).take(pa.array(out[0], pa.int32())), pa.array(out[1], pa.int32()),
                        *(pa.array(x, pa.int64()) for x in out[2:5])]
                if keep_ids:
                    cols.append(pa.array(out[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    return docs.select(col(id_col), col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan (bounded: one entry per length)

def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes within ``capacity`` by value (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(int(s[0]), capacity + 1):
        got = best[c - s[:fits[c]]] + v[:fits[c]]
        k = int(np.argmax(got))
        if got[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(s[pick[c]])
    return float(best[capacity]), counts


# Configurations are optimal when no other could lower their number by more than this share.
GAP = 1e-4


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """(pieces per size, number of sequences): the linear relaxation solved by column
    generation from one-size configurations, rounded down. The knapsack of the prices
    bounds what is left to gain; a basis that has not come within ``gap`` of the optimum
    after a thousand exchanges per size raises."""
    n = len(sizes)
    scale = float(demand.max())
    d = demand / scale
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(1000 * (n + 1)):
        x = np.linalg.solve(basis, d)
        dual = np.linalg.solve(basis.T, np.ones(n))
        value, counts = _knapsack(dual, sizes, capacity)
        if value <= 1 + gap:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = counts
    else:
        raise RuntimeError(f"configurations of {n} sizes not within {gap} of the optimum: {value - 1} left")
    x = np.linalg.solve(basis, d) * scale
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-6))) for j in range(n) if x[j] >= 1 - 1e-6]


def _best_fit(runs: list[list], left: dict[int, int], capacity: int) -> list[list]:
    """Best fit, longest first: each piece goes to the sequence with the least room
    that still fits, a new one if none does. ``runs`` are [number of equal sequences,
    room, lengths in a sequence, how many of them in slots]; equal sequences are filled
    together."""
    runs = [[n, room, list(lengths), slots] for n, room, lengths, slots in runs]
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}

    def offer(i: int) -> None:
        room = runs[i][1]
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(i)

    for i in range(len(runs)):
        offer(i)
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            at = bisect_left(rooms, k)
            if at == len(rooms):
                each = min(capacity // k, n)
                fit = n // each
                runs.append([fit, capacity, [], 0])
                i = len(runs) - 1
            else:
                room = rooms[at]
                i = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
                each = min(room // k, n)
                fit = min(runs[i][0], n // each)
                if fit < runs[i][0]:  # only some of these sequences are needed
                    runs.append([runs[i][0] - fit, room, list(runs[i][2]), runs[i][3]])
                    offer(len(runs) - 1)
                    runs[i][0] = fit
            runs[i][2] += [k] * each
            runs[i][1] -= k * each
            n -= fit * each
            offer(i)
    return runs


def _grouped(left: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[list[int], int]]:
    """Configurations of rounded sizes for the large pieces, by linear grouping: the
    descending order is cut into stretches of equal count, each rounded up to its longest.
    (sizes in descending order, number of sequences), those of the longest pieces first."""
    large = sorted((k for k in left if k >= max(small, 1)), reverse=True)
    total = sum(left[k] for k in large)
    if not total:
        return []
    per = max(1, -(-total // groups))
    rounded: dict[int, int] = {}  # stretches with the same largest length are one size
    size, filled = 0, per
    for k in large:
        n = left[k]
        while n:
            if filled == per:
                size, filled = k, 0
            use = min(n, per - filled)
            rounded[size] = rounded.get(size, 0) + use
            filled += use
            n -= use
    sizes = np.array(sorted(rounded, reverse=True))
    found = configurations(sizes, np.array([rounded[int(k)] for k in sizes]), capacity)
    return sorted((([int(k) for k in np.repeat(sizes, counts)], n) for counts, n in found), reverse=True)


def _substituted(left: dict[int, int], capacity: int, planned: list[tuple[list[int], int]]) -> list[list]:
    """Runs of sequences whose slots hold actual pieces; takes them out of ``left``.

    A slot takes the longest piece up to its size, the last slot the longest that fits
    behind the others. Pieces are shorter than their rounded sizes, so room is left: it
    takes the longest pieces that fit. A configuration ends early if no piece is left for
    one of its slots."""
    runs: list[list] = []
    lengths = sorted(k for k, n in left.items() if n)

    def longest(limit: int, used: Counter) -> int:
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and left[lengths[at]] == used[lengths[at]]:
            at -= 1
        return lengths[at] if at >= 0 else 0

    for sizes, n in planned:
        while n:
            held, used, room = [], Counter(), capacity
            for k in [*sizes[:-1], capacity]:
                piece = longest(min(k, room), used)
                if not piece:
                    break
                held.append(piece)
                used[piece] += 1
                room -= piece
            if len(held) < len(sizes):
                break
            while room and (piece := longest(room, used)):
                held.append(piece)
                used[piece] += 1
                room -= piece
            same = min(n, *(left[k] // c for k, c in used.items()))  # as many as these lengths allow
            for k, c in used.items():
                left[k] -= same * c
                if not left[k]:
                    lengths.remove(k)
            runs.append([same, room, held, len(sizes)])
            n -= same
    return runs


def plan(histogram: dict[int, int], capacity: int, groups: int = 96, small: int | None = None) -> pd.DataFrame:
    """Rows (length, rank_lo, count, sequence, offset, in_slot): the pieces of ``length``
    with rank ``rank_lo + i``, i < count, go to ``sequence + i`` at ``offset``, into a slot
    of a configuration or as best fit.

    ``groups``: number of equal-cardinality groups; ``small``: lengths below it have no
    slots (default: an eighth of the capacity). Small pieces fill the room that rounding up
    left; what then remains, and what the rounded-down configurations did not hold, is
    best-fitted."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    planned = _grouped(left, capacity, groups, capacity // 8 if small is None else small)
    runs = _best_fit(_substituted(left, capacity, planned), {k: n for k, n in left.items() if n}, capacity)
    rows, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for n, _, held, slots in runs:
        offset = 0
        for j, k in enumerate(held):
            rows.append((k, rank[k], n, sequence, offset, j < slots))
            rank[k] += n
            offset += k
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank_lo", "count", "sequence", "offset", "in_slot"]).sort_values(
        ["length", "rank_lo"], ignore_index=True)


# ---------------------------------------------------------------- the operator

def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
         capacity: int = 1024, end_id: int = 2, groups: int = 96, keep_ids: bool = False,
         rows_per_salt: int = 100_000) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: the id column, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids``.

    Defined cases: a null or empty text is the end id alone; a null id stays null and
    its document is packed like any other; repeated rows are documents of their own;
    ties in length are broken by id, piece and checksum; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    table = scratch.keep(pieces(docs, id_col, text_col, tokenizer, ranks, capacity, end_id, keep_ids), "pieces")
    # At most `capacity` rows reach the driver: one count per length.
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity, groups)
    salts = max(16, -(-sum(histogram.values()) // rows_per_salt))
    salted = table.withColumn("__salt", F.pmod(F.xxhash64(col(id_col), "piece", "ids_crc32"), F.lit(salts)))
    sizes = (salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
             .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n"))
             .drop("__n"))
    own = Window.partitionBy("length", "__salt").orderBy(col(id_col), "piece", "ids_crc32", "start")
    ranked = (salted.withColumn("__own", F.row_number().over(own) - 1)
              .join(sizes, ["length", "__salt"])
              .withColumn("__rank", F.col("__before") + F.col("__own")).drop("__own", "__before", "__salt"))
    names = [id_col, "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, {PIECE_SCHEMA}" + (", ids array<int>" if keep_ids else "")
              + ", sequence_id long, offset long")
    span = 1 << 44  # more than the pieces of one length
    keys = (runs["length"].to_numpy(dtype=np.int64) * span + runs["rank_lo"].to_numpy(dtype=np.int64))
    low, seq, off = (runs[c].to_numpy(dtype=np.int64) for c in ("rank_lo", "sequence", "offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch.column("length").to_numpy(zero_copy_only=False) * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(seq[at] + rank - low[at]), pa.array(off[at])],
                names=[*names, "sequence_id", "offset"])

    return ranked.select(*[col(c) for c in names], "__rank").mapInArrow(place, schema)
