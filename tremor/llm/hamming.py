"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of m segments is indexed by each segment. A query looks up, in every segment,
the values within a radius of its own, and checks the codes it finds there in full.
After radius r in all m segments, every code at distance m * (r + 1) - 1 or less has
been seen. The radius grows until the k-th verified distance lies within this bound, so
the result is exact; queries that are done leave the search.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col

WORD_BITS = 64


def sign_code(vector: Column, dims: int) -> Column:
    """Binary code of a vector: bit i of word i / 64 is set if entry i is positive. Null
    for a null vector or one of another length."""
    def word(lo: int, size: int) -> Column:
        bit = lambda i: F.coalesce(F.element_at(vector, i + lo + 1) > 0, F.lit(False)).cast("long")
        return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"),
                           lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", bit(i), i)))

    words = [word(lo, min(WORD_BITS, dims - lo)) for lo in range(0, dims, WORD_BITS)]
    return F.when(F.size(vector) == dims, F.array(*words))


def _segment(code: Column, k: int, bits: int) -> Column:
    per_word = WORD_BITS // bits
    word = F.element_at(code, k // per_word + 1)
    return F.shiftrightunsigned(word, bits * (k % per_word)).bitwiseAND(F.lit((1 << bits) - 1))


def distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _segments(codes: DataFrame, segments: int, bits: int) -> DataFrame:
    each = F.array(*[F.struct(F.lit(k).alias("segment"), _segment(F.col("code"), k, bits).alias("value")) for k in range(segments)])
    return codes.withColumn("s", F.explode(each)).select(*codes.columns, "s.*")


def _closest(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest codes of a query code by (distance, smallest id): no other
    code can hold one of the query's nearest ids. The limit is applied before the
    shuffle as well."""
    best = Window.partitionBy("q").orderBy("d", "least")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).drop("n")


def search(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 16) -> DataFrame:
    """The ``k`` nearest rows of each query: (query_id, id, distance, rank).

    ``codes`` and ``queries``: (id, code array<long>), codes of equal length; ``bits``:
    segment length, a divisor of 64, about the binary logarithm of the number of codes.
    Neighbours are ordered by distance, then id; a query's own id is left out.

    Equal codes are searched once, whatever the number of rows that share one; of these
    rows only the k + 1 smallest ids can be among the nearest.

    Defined cases: rows with a null id or code are neither found nor asked; repeated
    ids are one; if there are fewer than k other rows, all of them are returned; an
    empty table gives an empty result.
    """
    spark = codes.sparkSession
    scratch = Scratch(spark, "hamming")
    rows = codes.select("id", "code").where("id is not null and code is not null").distinct()
    first = Window.partitionBy("code").orderBy("id")
    ids = scratch.keep(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("id", "code"), "ids")
    index = scratch.keep(ids.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")), "index")
    asked = scratch.keep(queries.select("id", "code").where("id is not null and code is not null").distinct(), "asked")
    # Active queries, with the largest distance that can still be among the nearest.
    active = asked.select(F.col("code").alias("q"), (F.size("code") * WORD_BITS).alias("limit")).distinct()
    words = index.select(F.size("code").alias("n")).limit(1).collect()
    segments = (words[0]["n"] if words else 1) * (WORD_BITS // bits)
    buckets = scratch.keep(_segments(index, segments, bits), "buckets")
    # The distinct values of a segment: at most 2^bits, and at most the number of codes.
    values = scratch.keep(buckets.groupBy("segment", "value").agg(F.count("*").alias("codes")), "values")
    per_segment = values.groupBy("segment").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    found, settled = None, []
    for radius in range(bits + 1):
        active = scratch.keep(active, f"active{radius}")
        if active.isEmpty():
            break
        mine = _segments(active.select("q", "limit", F.col("q").alias("code")), segments, bits).select(
            "q", "limit", "segment", F.col("value").alias("own"))
        if comb(bits, radius) <= per_segment:
            # All values at this radius from the own one.
            masks = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long")), lambda x: F.bit_count(x) == radius)
            probes = mine.select("q", "limit", "segment", F.explode(masks).alias("mask"), "own").select(
                "q", "limit", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        else:
            # Fewer values exist than lie at this radius: test those of the segment.
            probes = mine.join(values.hint("merge"), "segment").where(
                F.bit_count(F.col("own").bitwiseXOR(F.col("value"))) == radius).select("q", "limit", "segment", "value")
        # The full check is part of the join: what cannot be among the nearest is not
        # emitted. Probes outnumber the queries by far, so neither side is broadcast.
        seen = (probes.alias("p").join(
            buckets.hint("shuffle_hash").alias("b"),
            (F.col("p.segment") == F.col("b.segment")) & (F.col("p.value") == F.col("b.value"))
            & (distance(F.col("p.q"), F.col("b.code")) <= F.col("p.limit")))
            .select("q", "code", "least", "n", distance(F.col("q"), F.col("code")).alias("d")))
        if found is not None:
            seen = seen.unionByName(found.join(active, "q", "left_semi"))
        found = scratch.keep(_closest(seen.distinct().withColumnRenamed("n", "copies"), k + 1).withColumnRenamed("copies", "n"), f"found{radius}")
        bound = segments * (radius + 1) - 1
        state = scratch.keep(found.groupBy("q").agg(
            F.sum(F.when(F.col("d") <= bound, F.col("n")).otherwise(0)).alias("sure"),
            F.when(F.count("*") > k, F.max("d")).alias("kth")), f"state{radius}")
        done = state.where(F.col("sure") >= k + 1).select("q")
        last = radius == bits
        settled.append(found if last else found.join(done, "q", "left_semi"))
        active = (active.join(done, "q", "left_anti").join(state.select("q", "kth"), "q", "left")
                  .select("q", F.least("limit", "kth").alias("limit")))
    if not settled:
        return spark.createDataFrame([], f"query_id {_type(asked)}, id {_type(ids)}, distance int, rank int")
    near = settled[0]
    for more in settled[1:]:
        near = near.unionByName(more)
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    pairs = (asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(near.select("q", "code", "d"), "q")
             .join(ids, "code").where("id != query_id")
             .select("query_id", "id", F.col("d").cast("int").alias("distance")))
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _type(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors (of equally frequent ones the largest), 0
    if there is none."""
    sizes = vectors.where(col(vector_col).isNotNull()).groupBy(F.size(col(vector_col)).alias("dims")).agg(F.count("*").alias("n"))
    top = sizes.where("dims > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    return top["dims"] if top else 0


def nearest_by_sign(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None,
                    k: int = 10, bits: int = 16, query: Column | None = None) -> DataFrame:
    """``search`` over the sign codes of a table of vectors; ``query`` selects the rows
    to ask for (default: ids divisible by 50). ``dims`` is the length of the vectors,
    by default the one that most of them have; null vectors and vectors of another length
    have no code and are neither found nor asked."""
    dims = dims or common_length(vectors, vector_col) or WORD_BITS
    codes = vectors.select(col(id_col).alias("id"), sign_code(col(vector_col), dims).alias("code"))
    return search(codes, codes.where(F.col("id") % 50 == 0 if query is None else query), k, bits)
