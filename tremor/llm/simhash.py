"""SimHash near-duplicate groups by a self-join of a binary trie.

``fingerprints`` gives each text a 64-bit SimHash of its word shingles. ``links`` finds
the pairs of distinct fingerprints within a Hamming distance by walking pairs of trie
nodes together: both nodes of a pair have the same depth, the differing bits of their
prefixes add up, and a pair whose sum exceeds the budget is dropped with everything
below it. ``groups`` returns the connected components.

The upper trie is walked by Spark, a few bits per step, on a table of node counts; a
pair of nodes that together hold few fingerprints becomes one block, and the walk goes
on inside the block in numpy. So no task holds more than ``block`` fingerprints, and
dense regions of the trie are divided further before they are compared. A block emits
a spanning forest of its links: at most one link per fingerprint, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name

BITS = 64
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of one text: A-Z lower-cased, words between ASCII white space, shingles
    of ``words`` words joined by a space and counted with repeats (a shorter text is
    one shingle; no word: 0), XXH64 with seed 42; a bit is set if it is set in over
    half the hashes."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(ends[:-words] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())]
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):  # the bits of few hashes at a time
        part = np.array(hashes[lo:lo + (1 << 14)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3) -> DataFrame:
    """(id, text_hash, fp): the fingerprint's 64 bits as a signed long. ``text_hash``
    tells rows of one id apart."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                fp = [_signed(fingerprint(t, words)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp, pa.int64())],
                                                 names=["id", "text_hash", "fp"])

    text = col(text_col).cast("string")
    return docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        run, f"id {id_type}, text_hash long, fp long")


# ---------------------------------------------------------------- the walk inside a block

def _walk(a: np.ndarray, b: np.ndarray, depth: int, diff: int, budget: int,
          frontier: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index in a, index in b) within ``budget`` bits. ``a`` and ``b`` are sorted
    and are the tries below two nodes of the same ``depth`` whose prefixes differ in
    ``diff`` bits; a node of the trie is a range of the sorted array. The pairs of
    nodes of one depth are advanced together; a wide frontier is walked in parts."""
    same = a is b
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), diff)))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        while len(alo):
            if len(alo) > frontier:
                half = len(alo) // 2
                stack.append((d, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]))
                alo, ahi, blo, bhi, err = (x[:half] for x in (alo, ahi, blo, bhi, err))
            # Pairs of single fingerprints are checked at once.
            leaf = (ahi - alo == 1) & (bhi - blo == 1)
            if leaf.any():
                i, j = alo[leaf], blo[leaf]
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                if same:
                    near &= i < j
                if near.any():
                    yield i[near], j[near]
                alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
                if not len(alo):
                    break
            if d == BITS:  # equal fingerprints: only a node with itself
                break
            shift = np.uint64(BITS - 1 - d)
            amid, bmid = (_split(x, lo, hi, shift) for x, lo, hi in ((a, alo, ahi), (b, blo, bhi)))
            kids = []
            for x, y, add in (((alo, amid), (blo, bmid), 0), ((amid, ahi), (bmid, bhi), 0),
                              ((alo, amid), (bmid, bhi), 1), ((amid, ahi), (blo, bmid), 1)):
                ok = (x[0] < x[1]) & (y[0] < y[1]) & (err + add <= budget)
                if same:  # each unordered pair of nodes once
                    ok &= x[0] <= y[0]
                kids.append([v[ok] for v in (x[0], x[1], y[0], y[1], err + add)])
            alo, ahi, blo, bhi, err = (np.concatenate(v) for v in zip(*kids))
            d += 1


def _split(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: np.uint64) -> np.ndarray:
    """First index in [lo, hi) whose bit is set; within a node the bit rises once."""
    ones = np.concatenate([[0], np.cumsum((x >> shift) & np.uint64(1))]).astype(np.int64)
    return hi - (ones[hi] - ones[lo])


class _Forest:
    """Union-find over the positions of a block; keeps the links that join trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _block_links(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Spanning links of one block: rows (side, fp, depth, diff)."""
    fp = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    side = rows["side"].to_numpy()
    a = np.sort(fp[side == 0])
    b = a if not (side == 1).any() else np.sort(fp[side == 1])
    forest, shift = _Forest(len(a) + len(b)), 0 if b is a else len(a)
    src, dst = [], []
    for i, j in _walk(a, b, int(rows["depth"].iloc[0]), int(rows["diff"].iloc[0]), budget):
        for x, y in zip(i.tolist(), j.tolist()):
            if forest.join(x, y + shift):
                src.append(a[x])
                dst.append(b[y])
    u, v = np.array(src, dtype=np.uint64).view(np.int64), np.array(dst, dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})


# ---------------------------------------------------------------- the walk over Spark

def _prefix(fp, depth: int):
    """The first ``depth`` bits as a number."""
    return F.shiftrightunsigned(fp, BITS - depth)


def block_size(n: int, most: int = 1 << 17) -> int:
    """Fingerprints of a block for ``n`` in all: the same share of them whatever their
    number, so that the upper walk ends at about the same depth and a fingerprint goes
    to about as many blocks; at most what one task should hold."""
    return min(most, max(2048, n // 24))


def links(scratch: Scratch, fps: DataFrame, budget: int = 2, block: int = 1 << 17, step: int = 2) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints ``fps(fp)`` within ``budget``.

    ``block``: most fingerprints of a node pair that is compared in one task. A node
    of full depth holds one fingerprint, so every pair gets there at last."""
    spark = fps.sparkSession
    block = block_size(fps.count(), block)
    depth, first = step, range(1 << step)
    pairs = spark.createDataFrame([(x, y, (x ^ y).bit_count()) for x in first for y in first
                                   if x <= y and (x ^ y).bit_count() <= budget], "a long, b long, diff int")
    blocks = []
    while True:
        nodes = fps.groupBy(_prefix(F.col("fp"), depth).alias("node")).agg(F.count("*").alias("n"))
        sized = (pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("an")), "a")
                 .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("bn")), "b"))
        sized = scratch.keep(sized, f"pairs{depth}")
        small = F.col("an") + F.col("bn") <= block
        blocks.append(sized.where(small).select(F.lit(depth).alias("depth"), "a", "b", "diff"))
        rest = sized.where(~small)
        if rest.isEmpty():
            break
        # Children of both nodes, `step` bits further; the budget prunes.
        bits = F.sequence(F.lit(0), F.lit((1 << step) - 1)).cast("array<long>")
        kids = (rest.select("a", "b", "diff", F.explode(bits).alias("x")).select("*", F.explode(bits).alias("y"))
                .withColumn("diff", (F.col("diff") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")))).cast("int"))
                .where(F.col("diff") <= budget)
                .select((F.shiftleft("a", step) + F.col("x")).alias("a"),
                        (F.shiftleft("b", step) + F.col("y")).alias("b"), "diff")
                .where(F.col("a") <= F.col("b")))  # of a node with itself, each child pair once
        pairs, depth = kids, depth + step
    found = blocks[0]
    for more in blocks[1:]:
        found = found.unionByName(more)
    found = found.withColumn("block", F.monotonically_increasing_id())
    found = scratch.keep(found, "blocks")
    depths = [step * (k + 1) for k in range(len(blocks))]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("node"))
                                                 for d in depths])).alias("k")).select("fp", "k.*")
    sides = (found.select("block", "depth", F.col("a").alias("node"), "diff", F.lit(0).alias("side"))
             .unionByName(found.where(F.col("a") != F.col("b"))
                          .select("block", "depth", F.col("b").alias("node"), "diff", F.lit(1).alias("side"))))
    members = keyed.join(sides, ["depth", "node"]).select("block", "side", "fp", "depth", "diff")
    return members.groupBy("block").applyInPandas(lambda rows: _block_links(rows, budget), "u long, v long")


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges(u, v)``.

    Alternating star contraction: each node's neighbours are linked to the smallest
    node it sees, larger ones first, then smaller ones, until nothing changes. The
    minimum per node is pre-aggregated, and the join back to the edges is a plain
    equi-join, so a node with many neighbours can be split by the skew join."""
    edges = scratch.keep(edges.where("u != v").distinct(), "edges0")
    seen = None
    for k in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u != v").distinct())
        # Now u > v: link the smaller neighbours of u to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u != v").distinct())
        now = scratch.keep(small, f"edges{k}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"edges{k - 1}")
        edges = now
        if tuple(state) == seen:
            # Fixed point: stars, each leaf linked to the smallest node.
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _grouped(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, words: int, budget: int, block: int) -> DataFrame:
    """(id, text_hash, fp, component_id) per row of ``docs``."""
    own = scratch.keep(fingerprints(docs, id_col, text_col, words), "own")
    # Equal fingerprints are one node, however many documents share it.
    distinct = scratch.keep(own.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    edges = links(scratch, distinct.select("fp"), budget, block)
    roots = components(scratch, edges)
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.keep(nodes.join(least, "root").select("fp", "root", "component_id"), "named")
    # Both sides are plain tables: one fingerprint of very many documents is split.
    return own.join(named, "fp")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
           budget: int = 2, block: int = 1 << 17) -> DataFrame:
    """Near-duplicate groups: one row per document with the id column, ``fingerprint``
    (16 lower-case hex digits) and ``component_id``, the smallest id reachable over
    fingerprints that differ in at most ``budget`` bits.

    Defined cases: a null or empty text, or one of white space, has fingerprint zero
    and is linked like any other; a null id is never a component id unless its whole
    group has null ids; repeated rows are kept and share a component; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    found = _grouped(Scratch(docs.sparkSession, "simhash"), docs, id_col, text_col, words, budget, block)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                  budget: int = 2, block: int = 1 << 17) -> DataFrame:
    """``docs`` with one row of each group of ``groups``: the one with the smallest id
    (rows without an id last; of rows with that id, by a hash of the text). Cases as
    there; of repeated rows one stays."""
    scratch = Scratch(docs.sparkSession, "simhash")
    found = scratch.keep(_grouped(scratch, docs, id_col, text_col, words, budget, block).select("id", "text_hash", "root"), "found")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    first = scratch.keep(found.groupBy("root").agg(F.min(rank).alias("first")).select("root", "first"), "first")
    kept = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))
    marked = found.join(first, "root").groupBy("id", "text_hash").agg(F.max(kept).alias("kept"), F.count("*").alias("rows"))
    i, t, k = (free_name(docs, x) for x in ("id", "text_hash", "kept"))
    marked = scratch.keep(marked.where("not kept or rows > 1").select(
        F.col("id").alias(i), F.col("text_hash").alias(t), F.col("kept").alias(k)), "marked")
    same = col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(col(text_col).cast("string")) == F.col(t))
    out = docs.join(marked.drop(k), same, "left_anti")
    again = marked.where(F.col(k))
    if not again.isEmpty():  # kept rows that are repeated: one each
        repeated = docs.join(again.drop(k), same, "left_semi")
        h = free_name(docs, "hash")
        out = out.unionByName(repeated.withColumn(h, F.xxhash64(col(text_col).cast("string"))).dropDuplicates([id_col, h]).drop(h))
    return out
