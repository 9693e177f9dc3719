import hashlib
import math

import numpy as np
import pytest

from tremor.llm import shallot


def lloyd(vectors, k, rounds, seed=2):
    """Every vector against every centroid: (rows, centroids)."""
    kept = [(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in vectors
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ("g" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((dist(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == n]
            if mine:
                centroids[n] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return found, centroids


def check(spark, vectors, schema, k, rounds, dims):
    got = shallot.cluster(spark.createDataFrame(vectors, schema), k=k, rounds=rounds, dims=dims)
    want, centroids = lloyd(vectors if dims is None else [v for v in vectors if v[1] is not None and len(v[1]) == dims], k, rounds)
    key = lambda r: tuple((x is None, x) for x in r)
    rows = got.rows.collect()
    assert sorted([(r["id"], r["cluster"], r["distance"]) for r in rows], key=key) == sorted(want, key=key)
    assert [tuple(c) for c in got.centroids] == centroids
    total = sum(d for *_, d in want)
    for r in rows:
        assert r["inertia"] == total
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("k,rounds,dims,spread", [(7, 5, 4, 1.0), (12, 3, 2, 0.02), (1, 2, 3, 1.0), (5, 0, 3, 1.0)])
def test_equals_comparing_everything(spark, k, rounds, dims, spread):
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(4, dims))
    x = centres[rng.integers(0, 4, 160)] + spread * rng.normal(size=(160, dims))
    check(spark, [(int(i), [float(v) for v in row]) for i, row in enumerate(x)], SCHEMA, k, rounds, dims)


def test_ties_copies_and_hard_rows(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(45)]  # many ties, equal first centroids
    hard = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [0.0, float("-inf")]), (None, [0.5, 0.5]), (6, [-0.0, -0.003])]
    check(spark, grid + grid[:5] + hard, SCHEMA, 11, 5, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0])], SCHEMA, 5, 2, 2)
    empty = shallot.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA), dims=2)
    assert empty.rows.collect() == [] and empty.centroids == []


def test_overflowing_component_raises(spark):
    with pytest.raises(Exception, match="do not fit a long"):
        shallot.cluster(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), dims=2)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i)], 1, "x", 2, 3.0) for i in range(9)],
                               "vec_id long, embedding array<float>, cluster int, id string, v int, distance double")
    assert shallot.cluster(df, k=3, dims=1).rows.count() == 9


def test_search_skips_most_distances():
    """On separated groups most vectors are settled by their bounds alone."""
    rng = np.random.default_rng(1)
    centres = (rng.normal(size=(30, 16)) * 4000).astype(np.int64)
    x = centres[rng.integers(0, 30, 3000)] + rng.integers(-200, 200, (3000, 16))
    first = shallot.Search(centres)
    state = first.assign(x, *first.start(len(x)))
    moved = centres + rng.integers(-3, 3, centres.shape)
    seen = []
    original = shallot.squared
    search = shallot.Search(moved, centres)
    shallot.squared = lambda a, c: (seen.append(len(a)), original(a, c))[1]
    try:
        again = search.assign(x, *state)
    finally:
        shallot.squared = original
    assert sum(seen) < len(x)  # fewer than one distance a vector, of thirty
    want = np.array([[original(x, c)] for c in moved]).reshape(30, -1).argmin(axis=0)
    assert (again[0] == want).all()
