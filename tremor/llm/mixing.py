"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. Exponent one
keeps the natural mix, zero weighs all sources alike. The largest exponent that meets a
target entropy is found by bisection; so is the smallest that keeps every source within
a limit of repeats, which goes first where both cannot be met. Weights become a token budget per source, and the budget becomes
epochs: each epoch is a permutation of the source's blocks of documents, and the last
epoch stops where the budget is spent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, free_name

HALVINGS_PER_PASS = 5
PASSES = 7
MAX_BROADCAST_SOURCES = 10_000


def count_words(text: Column) -> Column:
    """Words between ASCII white space; the default measure of tokens."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _bisect(sources: DataFrame, holds, lo: float = 0.0, hi: float = 1.0) -> float:
    """The largest exponent in [lo, hi] for which ``holds(stats)``, a condition that is
    true below some exponent and false above it; ``lo`` if it never holds.

    Each pass evaluates the exponents of five halvings together in one aggregation over
    the sources, so the sources stay distributed and the driver sees one row."""
    for _ in range(PASSES):
        grid = [lo + (hi - lo) * k / (1 << HALVINGS_PER_PASS) for k in range((1 << HALVINGS_PER_PASS) + 1)]
        powered = [F.exp(F.lit(a) * F.col("log_share")) for a in grid]
        row = sources.agg(*[F.sum(p).alias(f"z{k}") for k, p in enumerate(powered)],
                          *[F.sum(p * F.col("log_share")).alias(f"l{k}") for k, p in enumerate(powered)]).first()
        ok = [holds(a, row[f"z{k}"], row[f"l{k}"]) for k, a in enumerate(grid)]
        if not ok[0]:
            return lo
        last = max(k for k in range(len(ok)) if all(ok[:k + 1]))
        if last == len(grid) - 1:
            return hi
        lo, hi = grid[last], grid[last + 1]
    return lo


def exponent(sources: DataFrame, tokens: float, target_entropy: float | None, max_repeats: float | None,
             budget: float | None) -> float:
    """Exponent over ``sources(log_share)``. ``target_entropy`` is a share of the largest
    possible entropy (1: all sources alike); the weights reach it, unless that would
    repeat the smallest source more than ``max_repeats`` times."""
    s = sources.agg(F.count("*").alias("n"), F.min("log_share").alias("lo"), F.max("log_share").alias("hi")).first()
    if not s["n"] or s["hi"] - s["lo"] < 1e-12:
        return 1.0
    at = []
    if target_entropy is not None:
        goal = target_entropy * math.log(s["n"])
        # Entropy of share^a / z: log z - a * (sum of share^a log share) / z; it falls with a.
        at.append(_bisect(sources, lambda a, z, l: math.log(z) - a * l / z >= goal))
    if max_repeats is not None:
        # Readings of the smallest source; they fall with a, so this is a lower limit of it.
        at.append(_bisect(sources, lambda a, z, l: size_of_mix(tokens, a, z, s["hi"], budget) / tokens
                          * math.exp((a - 1) * s["lo"]) / z > max_repeats))
    return max(at, default=1.0)


def size_of_mix(tokens: float, a: float, z: float, hi: float, budget: float | None) -> float:
    """Tokens of the mix: the budget, or what reads the least repeated source once."""
    return budget if budget is not None else tokens * z * math.exp((1 - a) * hi)


def weigh(measured: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None,
          scratch: Scratch) -> DataFrame:
    """(source, docs, tokens, weight, budget, full, rest): ``full`` whole epochs and
    ``rest`` tokens of one more. Without ``budget``, the mix is as large as it must be
    for the least repeated source to be read once in full, so no document is left out."""
    totals = scratch.keep(measured.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "totals")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.where("tokens > 0").withColumn("log_share", F.log(F.col("tokens") / F.lit(float(max(all_tokens, 1)))))
    a = exponent(shares, float(max(all_tokens, 1)), target_entropy, max_repeats, budget)
    power = F.exp(F.lit(a) * F.col("log_share"))
    s = shares.agg(F.sum(power).alias("z"), F.max("log_share").alias("hi")).first()
    z, hi = s["z"] or 1.0, s["hi"] or 0.0
    whole = size_of_mix(float(all_tokens), a, z, hi, budget)
    exact = F.col("weight") * F.lit(whole)
    epochs = F.round(exact / F.col("tokens")) * F.col("tokens")
    weighed = (totals.join(shares.select(F.col("source").alias("__s"), "log_share"), F.col("source").eqNullSafe(F.col("__s")), "left")
               .withColumn("weight", F.coalesce(power / F.lit(z), F.lit(0.0)))
               # Whole epochs stay whole when the weights carry rounding errors.
               .withColumn("budget", F.when((F.col("tokens") > 0) & (F.abs(exact - epochs) <= 1e-6 * exact + 0.5), epochs)
                           .otherwise(F.floor(exact)).cast("long"))
               .drop("__s", "log_share"))
    # A source without tokens costs nothing and is read once.
    return weighed.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)).withColumn(
        "rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(0)).select(
        "source", "docs", "tokens", "weight", "budget", "full", "rest")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        target_entropy: float | None = 0.9, max_repeats: float | None = 4.0, budget: int | None = None,
        block_docs: int = 4096, seed: int = 7, epoch_name: str = "epoch", order_names: tuple[str, str] = ("block", "place"),
        ) -> DataFrame:
    """``docs`` with one row per reading of a document, and the columns ``epoch`` (from
    0), ``block`` and ``place``; reading a source by (epoch, block, place) is its mix.

    Within an epoch, documents belong to blocks by a hash; the blocks are permuted by a
    hash of block and epoch, and ``block`` is that hash; ``place`` orders the documents
    of a block. The last epoch of a source takes whole blocks in this order while the
    budget lasts and documents of one more block: a document is the last one if the
    budget ends within it. Whether a row is in is decided from its own hashes and two
    cut values of its source, so texts are not shuffled.

    Defined cases: a null source is a source of its own; a null or empty text has no
    tokens; a source without tokens is read once; rows with equal id and text share
    their place and are in or out together; an empty table gives an empty result; other
    columns pass through, and one that is called like a result column is an error.
    """
    results = (epoch_name, *order_names)
    clash = {r.lower() for r in results} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the documents already have {sorted(clash)}; choose other names")
    scratch = Scratch(docs.sparkSession, "mixing")
    key = F.xxhash64(F.lit(seed), col(id_col), col(text_col))
    measured = scratch.keep(docs.select(col(source_col).cast("string").alias("source"), key.alias("key"),
                                        count_words(col(text_col)).alias("tokens")), "measured")
    weights = scratch.keep(weigh(measured, target_entropy, max_repeats, budget, scratch), "weights")

    def blocks(key, docs_of_source):
        n = F.ceil(docs_of_source / F.lit(block_docs))
        return F.pmod(F.xxhash64(F.lit(seed + 1), key), F.greatest(n, F.lit(1)))

    def block_hash(source, block, epoch):
        return F.xxhash64(F.lit(seed + 2), source, block, epoch)

    def place_hash(key, epoch):
        return F.xxhash64(F.lit(seed + 3), key, epoch)

    # Where the last epoch of each source ends: first among its blocks, then within one.
    # One row per source and block, pre-aggregated; only that one block is looked into.
    few = weights.count() <= MAX_BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    w = weights.select(F.col("source").alias("__s"), F.col("docs").alias("__docs"), "full", "rest")
    parted = (measured.join(small(w.where("rest > 0")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
              .withColumn("b", blocks(F.col("key"), F.col("__docs"))))
    per_block = (parted.groupBy("source", "b", "full", "rest").agg(F.sum("tokens").alias("t"))
                 .withColumn("h", block_hash(F.col("source"), F.col("b"), F.col("full"))))
    order = Window.partitionBy("source").orderBy("h", "b")
    ends = (per_block.withColumn("sum", F.sum("t").over(order)).where("sum >= rest and sum - t < rest")
            .select(F.col("source").alias("__s"), F.col("b").alias("end_b"), F.col("h").alias("end_h"),
                    (F.col("rest") - (F.col("sum") - F.col("t"))).alias("left")))
    ends = scratch.keep(ends, "ends")
    inside = (parted.join(small(ends), F.col("source").eqNullSafe(F.col("__s")) & (F.col("b") == F.col("end_b")))
              .withColumn("p", place_hash(F.col("key"), F.col("full"))))
    within = Window.partitionBy("source").orderBy("p", "key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (inside.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).where(F.col("before") < F.col("left"))
            .groupBy("__s").agg(F.max("p").alias("end_p")))
    final = (weights.select(F.col("source").alias("__s"), F.col("docs").alias("__docs"), F.col("full").alias("__full"), "rest")
             .join(ends.select(F.col("__s").alias("__s2"), F.col("end_h").alias("__end_h"), F.col("end_b").alias("__end_b")),
                   F.col("__s").eqNullSafe(F.col("__s2")), "left").drop("__s2")
             .join(cuts.select(F.col("__s").alias("__s3"), F.col("end_p").alias("__end_p")),
                   F.col("__s").eqNullSafe(F.col("__s3")), "left").drop("__s3", "rest"))
    final = scratch.keep(final, "final")
    # The settings of a source as one struct under a name the documents do not have.
    own = free_name(docs, "mix")
    setting = final.select(F.struct("*").alias(own))
    rows = docs.join(small(setting), col(source_col).cast("string").eqNullSafe(F.col(f"{own}.__s")))
    k, s = key, lambda n: F.col(f"{own}.{n}")
    b = blocks(k, s("__docs"))
    h = block_hash(col(source_col).cast("string"), b, s("__full"))
    last = (h < s("__end_h")) | ((h == s("__end_h")) & (b < s("__end_b"))) | (
        (h == s("__end_h")) & (b == s("__end_b")) & (place_hash(k, s("__full")) <= s("__end_p")))
    times = s("__full") + F.coalesce(last, F.lit(False)).cast("long")
    epoch = F.col(epoch_name)
    read = rows.withColumn(epoch_name, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1))))
    return read.select(*[col(c) for c in docs.columns], epoch_name,
                       block_hash(col(source_col).cast("string"), blocks(k, s("__docs")), epoch).alias(order_names[0]),
                       place_hash(k, epoch).alias(order_names[1]))
