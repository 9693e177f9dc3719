"""Centroid clustering with the Shallot search (exact Lloyd rounds).

Each vector remembers its centroid, its second-nearest centroid, an upper bound of the
distance to the first and a lower bound of the distance to every other one. After the
centroids moved, a vector stays where the bounds (or half the gap to the nearest other
centroid) prove it. Else its distances to the two remembered centroids are computed and
the scan starts from the closer one, over the neighbours of that centroid in order of
their gap to it. A centroid can only be first or second if its gap is at most the
distance to the start plus the distance to the runner-up; this ball shrinks whenever the
scan finds a closer runner-up, and a vector leaves the scan when the next gap is outside.
Bounds are doubles with a margin; what survives them is compared in exact integers.

The state is one Parquet table per round. A pass over it assigns the vectors of a task
and appends the task's partial sums to the same output, so a round reads the vectors
once and nothing is shuffled but ``centroids × components`` sums per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col

# Bounds must differ by this relative margin to decide anything, which is far above the
# rounding of doubles and far below the difference of two integer distances that matter.
MARGIN = 1e-9


class Clustering(NamedTuple):
    rows: DataFrame            # (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    centroids: list[list[int]]  # final centroids in order


def largest_component(dims: int) -> int:
    """Components up to this size keep squared distances within a long."""
    return 1 << min(30, (62 - (dims - 1).bit_length()) // 2 - 1)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    """(id, v array<int>): ``floor(scale * x)`` of the vectors with exactly ``dims``
    components, none null or non-finite."""
    own = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("x"))
    inf = F.lit(float("inf"))
    own = own.where((F.size("x") == dims) & ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf)))
    most = largest_component(dims)
    scaled = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x))
    fits = F.forall(scaled, lambda x: (x >= -most) & (x <= most))
    return own.select("id", F.when(fits, scaled.cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component leaves ±{most}: its squared distances do not fit a long"))).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, in that order; ties
    by the vector. Distributed top-k: the driver receives ``k`` rows."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    top = rows.select("v", key.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r["v"] for r in top], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to a centroid, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """The search structure of one round: gaps between centroids, neighbours in order,
    and how far the centroids moved since the bounds were taken."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids
        k = len(centroids)
        self.gap = np.sqrt(np.array([squared(centroids, c) for c in centroids], dtype=np.float64).reshape(k, k))
        self.order = np.argsort(self.gap, axis=1, kind="stable")
        others = self.gap + np.where(np.eye(k, dtype=bool), np.inf, 0.0)
        self.half = others.min(axis=1, initial=np.inf) / 2
        d = centroids - (centroids if before is None else before)
        self.moved = np.sqrt(np.einsum("ij,ij->i", d, d).astype(np.float64)) * (1 + MARGIN)
        # The largest move among the centroids other than the own one.
        top = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(k, self.moved[top[0]])
        self.others_moved[top[0]] = self.moved[top[1]] if k > 1 else 0.0

    def start(self, n: int) -> tuple[np.ndarray, ...]:
        """State of vectors that nothing is known of."""
        return (np.zeros(n, np.int32), np.full(n, min(1, len(self.c) - 1), np.int32), np.full(n, np.inf), np.zeros(n))

    def assign(self, x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """New (first, second, upper, lower) of the vectors ``x``; ties go to the smaller
        number."""
        first, second = first.copy(), second.copy()
        upper = upper + self.moved[first]
        lower = lower * (1 - MARGIN) - self.others_moved[first]

        def undecided(rows: np.ndarray) -> np.ndarray:
            safe = np.maximum(lower[rows], self.half[first[rows]])
            return rows[~(upper[rows] * (1 + MARGIN) < safe * (1 - MARGIN))]

        rows = undecided(np.arange(len(x)))
        own = squared(x[rows], self.c[first[rows]])
        upper[rows] = np.sqrt(own.astype(np.float64))
        if len(self.c) == 1:
            return first, second, upper, lower
        left = undecided(rows)
        own = own[np.isin(rows, left, assume_unique=True)]
        other = squared(x[left], self.c[second[left]])
        closer = (other < own) | ((other == own) & (second[left] < first[left]))
        near = np.where(closer, second[left], first[left])
        far = np.where(closer, first[left], second[left])
        near_d, far_d = np.minimum(own, other), np.maximum(own, other)
        for s in np.unique(near):
            at = np.flatnonzero(near == s)
            n1, n2, d1, d2 = self._scan(x[left[at]], int(s), far[at], near_d[at], far_d[at])
            rows = left[at]
            first[rows], second[rows] = n1, n2
            upper[rows], lower[rows] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
        return first, second, upper, lower

    def _scan(self, x, s: int, known: np.ndarray, d1: np.ndarray, d2: np.ndarray):
        """Nearest and second-nearest centroid, from start ``s`` at squared distance ``d1``
        and another centroid ``known`` at ``d2``."""
        n1, n2 = np.full(len(x), s, np.int32), known.astype(np.int32)
        d1, d2 = d1.copy(), d2.copy()
        reach = np.sqrt(d1.astype(np.float64))
        live = np.arange(len(x))
        for j in self.order[s]:
            if j == s:
                continue
            live = live[self.gap[s, j] <= (reach[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + MARGIN)]
            if not len(live):
                break
            rows = live[known[live] != j]
            d = squared(x[rows], self.c[j])
            best = (d < d1[rows]) | ((d == d1[rows]) & (j < n1[rows]))
            next_ = ~best & ((d < d2[rows]) | ((d == d2[rows]) & (j < n2[rows])))
            up = rows[best]
            n2[up], d2[up] = n1[up], d1[up]
            n1[up], d1[up] = j, d[best]
            n2[rows[next_]], d2[rows[next_]] = j, d[next_]
        return n1, n2, d1, d2


STATE = "v array<int>, cluster int, second int, upper double, lower double"


def _step(state: DataFrame, search: Search, fresh: bool, last: bool) -> DataFrame:
    """One assignment of all vectors: their new state, and per task and cluster a row
    (``sums``, ``n``) with the sums of its vectors. The last step gives distances only."""
    dims = search.c.shape[1]
    id_type = state.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(search.c), dims), np.int64), np.zeros(len(search.c), np.int64)
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            v = batch.column(1)
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            known = search.start(len(x)) if fresh else tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2, 6))
            first, second, upper, lower = search.assign(x, *known)
            if last:
                found = np.zeros(len(x), np.int64)
                for c in np.unique(first):
                    found[first == c] = squared(x[first == c], search.c[c])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first, pa.int32()), pa.array(found)],
                                                 names=["id", "cluster", "distance"])
                continue
            for c in np.unique(first):
                sums[c] += x[first == c].sum(axis=0)
            counts += np.bincount(first, minlength=len(counts))
            none = pa.nulls(len(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), v, pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower),
                 none.cast(pa.list_(pa.int64())), none.cast(pa.int64())],
                names=["id", "v", "cluster", "second", "upper", "lower", "sums", "n"])
        used = np.flatnonzero(counts)
        if len(used) and not last:
            none = pa.nulls(len(used))
            yield pa.RecordBatch.from_arrays(
                [none.cast(id_arrow), none.cast(pa.list_(pa.int32())), pa.array(used, pa.int32()), none.cast(pa.int32()),
                 none.cast(pa.float64()), none.cast(pa.float64()), pa.array(sums[used].tolist(), pa.list_(pa.int64())),
                 pa.array(counts[used])], names=["id", "v", "cluster", "second", "upper", "lower", "sums", "n"])

    if last:
        return state.mapInArrow(run, f"id {id_type}, cluster int, distance long")
    return state.mapInArrow(run, f"id {id_type}, {STATE}, sums array<long>, n long")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of their vectors' mean; empty ones stay. The driver
    receives one row per centroid and component."""
    part = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    wide = "decimal(38,0)"
    rows = part.groupBy("cluster", "i").agg(F.sum(F.col("x").cast(wide)).alias("x"), F.sum(F.col("n").cast(wide)).alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["i"]] = int(r["x"]) // int(r["n"])
    return out


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5,
            dims: int = 64, scale: float = 256.0, seed: int = 2) -> Clustering:
    """``rounds`` exact Lloyd rounds over the integer vectors ``floor(scale * x)`` and one
    more assignment. Ties go to the smaller centroid number; a centroid moves to the
    componentwise floor of its vectors' mean, an empty one stays.

    Broadcast data: ``k × dims`` integers and ``k × k`` gaps. Intermediate states are
    tables in the shared folder; the one before is deleted when the next is written.

    Defined cases: vectors that are null, of another length, or with a null or non-finite
    component are left out; a null id is clustered and comes last among the first
    centroids; repeated rows are clustered each, so equal centroids may arise (the
    smaller number wins all their vectors); fewer than ``k`` vectors give as many
    centroids, none an empty result; a component beyond :func:`largest_component` raises,
    because its squared distances would not fit a long; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "shallot")
    state = scratch.keep(integer_vectors(vectors, id_col, vector_col, dims, scale), "vectors")
    id_type = state.schema["id"].dataType.simpleString()
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame(
            [], f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), [])
    before, name = None, "vectors"
    for r in range(rounds):
        step = _step(state, Search(centroids, before), fresh=r == 0, last=False)
        whole = scratch.keep(step, f"round{r}")
        scratch.drop(name)
        name = f"round{r}"
        before, centroids = centroids, _moved(whole, centroids)
        state = whole.where("n is null").select("id", "v", "cluster", "second", "upper", "lower")
    done = scratch.keep(_step(state, Search(centroids, before), fresh=rounds == 0, last=True), "assigned")
    scratch.drop(name)
    wide = "decimal(38,0)"
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast(wide)).alias("s")).collect()}
    # One row per centroid.
    facts = spark.createDataFrame(
        [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = done.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return Clustering(rows, centroids.tolist())
