"""Series solve, doubling inverse and the identities between them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import LABELS, X_VALUES
from tremor.operators import economy as econ
from tremor.operators import linalg, tiles


def dense(df, labels=LABELS):
    idx = {lab: i for i, lab in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    for r in df.collect():
        m[idx[(r.producer_region, r.producer_sector)], idx[(r.consumer_region, r.consumer_sector)]] = r.value
    return m


def test_gross_output_from_series(eco):
    x = {(r.region, r.sector): r.value for r in econ.gross_output(eco.A, eco.Y).collect()}
    assert [x[lab] for lab in LABELS] == pytest.approx(X_VALUES)


def test_power_series_matches_dense_inverse(eco):
    L = dense(linalg.power_series(eco.A, eco.labels, 40))
    A = dense(eco.A)
    assert L == pytest.approx(np.linalg.inv(np.eye(4) - A), abs=1e-12)


def test_power_series_odd_term_counts(eco):
    for terms in (1, 2, 3, 5):
        S = dense(linalg.power_series(eco.A, eco.labels, terms))
        A = dense(eco.A)
        expect = sum(np.linalg.matrix_power(A, k) for k in range(terms))
        assert S == pytest.approx(expect, abs=1e-12)


def test_ghosh_inverse_by_similarity(eco):
    L = linalg.power_series(eco.A, eco.labels, 40)
    G = dense(linalg.similarity_scale(L, eco.X))
    B = dense(eco.B)
    assert G == pytest.approx(np.linalg.inv(np.eye(4) - B), abs=1e-12)
    assert G[0, 1] == pytest.approx(1 / 3) and G[0, 3] == pytest.approx(1 / 9) and G[2, 3] == pytest.approx(5 / 9)


def test_residual_gives_final_demand(eco):
    y = {(r.region, r.sector): r.value for r in linalg.residual(eco.A, eco.X).collect()}
    assert [y[lab] for lab in LABELS] == pytest.approx([100, 150, 80, 200])


def test_series_with_tolerance_stops_early(spark, eco):
    systems = linalg.oriented(eco.A, "column", "A")
    seed = eco.Y.select(F.lit("A").alias("system"), F.lit("x").alias("run_id"), "region", "sector", "value")
    x = {(r.region, r.sector): r.value for r in linalg.series_solve(systems, seed, terms=200, tol=1e-15, checkpoint_every=2).collect()}
    assert [x[lab] for lab in LABELS] == pytest.approx(X_VALUES)


def test_convergence_check(eco, spark):
    assert linalg.check_convergent(eco.A, "column") == pytest.approx(0.6)
    bad = spark.createDataFrame([("a", "s", "a", "s", 1.5)], eco.A.schema)
    with pytest.raises(ValueError):
        linalg.check_convergent(bad, "column")


def test_matmul_and_transpose(eco):
    A = dense(eco.A)
    assert dense(linalg.matmul(eco.A, eco.A)) == pytest.approx(A @ A)
    assert dense(linalg.transpose(eco.A)) == pytest.approx(A.T)


def test_shuffle_path_matches_broadcast_path(spark, eco):
    """The loop without any broadcast (the path for matrices above the row limit)."""
    systems = linalg.oriented(eco.B, "row", "B")
    seed = spark.createDataFrame([("B", "r1", "C2", "Mining", -36.0), ("B", "r2", "C1", "Farming", 1.0)],
                                 "system string, run_id string, region string, sector string, value double")
    mask = spark.createDataFrame([("B", "r1", "C1", "Food Processing")], "system string, run_id string, region string, sector string")
    a = {(r.run_id, r.region, r.sector): r.value for r in linalg.series_solve(systems, seed, 40, mask).collect()}
    b = {(r.run_id, r.region, r.sector): r.value for r in linalg.series_solve(systems, seed, 40, mask, broadcast_rows=0).collect()}
    assert a == pytest.approx(b)
    assert a[("r1", "C2", "Manufacturing")] == pytest.approx(-20)
    assert ("r1", "C1", "Food Processing") not in a          # masked label never receives
    assert a[("r2", "C1", "Food Processing")] == pytest.approx(1 / 3)


def long_matrix(spark, M):
    """A dense or sparse numpy matrix as a long table; label i is (r<i % 7>, s<i>)."""
    import pandas as pd

    i, j = np.nonzero(M)
    cells = spark.createDataFrame(pd.DataFrame({"i": i, "j": j, "value": M[i, j]}))
    name = lambda c: (F.concat(F.lit("r"), F.col(c) % 7), F.concat(F.lit("s"), F.lpad(F.col(c).cast("string"), 5, "0")))
    (pr, ps), (cr, cs) = name("i"), name("j")
    return cells.select(pr.alias("producer_region"), ps.alias("producer_sector"), cr.alias("consumer_region"), cs.alias("consumer_sector"), "value")


def matrix_of(df, n):
    rows = df.select(F.substring("producer_sector", 2, 9).cast("int").alias("i"), F.substring("consumer_sector", 2, 9).cast("int").alias("j"), "value").toPandas()
    out = np.zeros((n, n))
    out[rows["i"], rows["j"]] = rows["value"]
    return out


@pytest.mark.parametrize("n,tile,chunk", [(23, 5, 2), (23, 5, 8), (6, 1, 3), (9, 64, 8)])
def test_tiled_product_over_any_grid(spark, n, tile, chunk):
    rng = np.random.default_rng(n)
    a, b, c = (rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3) for _ in range(3))
    frames = [long_matrix(spark, x) for x in (a, b, c)]
    grid = tiles.grid_of(tiles.labels_of(*frames).cache(), tile)
    ta, tb, tc = (tiles.to_tiles(x, grid) for x in frames)
    assert matrix_of(tiles.to_cells(tiles.multiply(ta, tb, grid, chunk=chunk), grid), n) == pytest.approx(a @ b)
    assert matrix_of(tiles.to_cells(tiles.multiply(ta, tb, grid, plus=tc, chunk=chunk), grid), n) == pytest.approx(c + a @ b)
    assert tiles.column_norm(ta, grid) == pytest.approx(np.abs(a).sum(axis=0).max())


def test_inverse_of_two_thousand_labels_by_tiles(spark, monkeypatch):
    """A join of cells would form 8·10⁹ rows a product; 2 · 4³ tiles are moved instead."""
    n = 2000
    rng = np.random.default_rng(2)
    M = np.zeros((n, n))
    M[rng.integers(0, n, 12 * n), rng.integers(0, n, 12 * n)] = rng.random(12 * n)
    M *= 0.45 / M.sum(axis=0).max()
    m = long_matrix(spark, M)
    labels = spark.range(n).select(F.concat(F.lit("r"), F.col("id") % 7).alias("region"),
                                   F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("sector"))
    moved, original = [], tiles.pairs
    monkeypatch.setattr(tiles, "pairs", lambda *a: moved.append(original(*a)) or moved[-1])
    got = linalg.power_series(m, labels)
    got = got.cache()
    want = np.linalg.inv(np.eye(n) - M)
    some = got.where(F.substring("producer_sector", 2, 9).cast("int") % 100 == 7)  # whole rows of L
    assert matrix_of(some, n)[7::100] == pytest.approx(want[7::100], rel=1e-10, abs=1e-13)
    sums = {r["s"]: r["v"] for r in got.groupBy(F.col("consumer_sector").alias("s")).agg(F.sum("value").alias("v")).collect()}
    assert [sums[f"s{k:05d}"] for k in range(n)] == pytest.approx(want.sum(axis=0).tolist())
    got.unpersist()
    assert max(p.count() for p in moved) <= 2 * 4 ** 3


def test_product_of_empty_matrices(spark, eco):
    assert linalg.matmul(eco.A.limit(0), eco.A.limit(0)).collect() == []
    assert linalg.power_series(eco.A.limit(0), eco.labels).count() == 4


def solve(spark, monkeypatch, M, seeds, mask=None, **options):
    """Result and number of rounds of the solver on a numpy matrix (row orientation)."""
    rounds, krylov = [0], linalg._krylov
    counted = lambda step: lambda *a: rounds.__setitem__(0, rounds[0] + 1) or step(*a)
    monkeypatch.setattr(linalg, "_krylov", lambda state, step, *a: krylov(state, counted(step), *a))
    label = lambda k: (f"r{k % 7}", f"s{k:05d}")
    seed = spark.createDataFrame([("M", run, *label(k), float(v)) for run, b in seeds.items() for k, v in b.items()],
                                 "system string, run_id string, region string, sector string, value double")
    mk = None if mask is None else spark.createDataFrame([("M", run, *label(k)) for run, ks in mask.items() for k in ks],
                                                         "system string, run_id string, region string, sector string")
    out = linalg.series_solve(linalg.oriented(long_matrix(spark, M), "row", "M"), seed, mask=mk, **options)
    got = {run: np.zeros(len(M)) for run in seeds}
    for r in out.collect():
        got[r["run_id"]][int(r["sector"][1:])] = r["value"]
    monkeypatch.undo()
    return got, rounds[0]


def slow_system(n=30, radius=0.91, seed=3):
    rng = np.random.default_rng(seed)
    M = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    M[:n // 2, n // 2:] *= 0.02  # two groups of labels that hardly trade: two slow directions
    M[n // 2:, :n // 2] *= 0.02
    return M * (radius / M.sum(axis=0))  # every column sum is the radius


def test_krylov_takes_a_quarter_of_the_rounds(spark, monkeypatch):
    M = slow_system()
    n = len(M)
    seeds = {"up": {k: 1.0 + k for k in range(n)}, "one": {4: -36.0}, "mixed": {0: 5.0, 20: -5.0, 7: 1e-6}, "masked": {3: 2.0}}
    mask = {"masked": [1, 2, 25], "one": [0]}
    terms, many = np.array([seeds["up"][k] for k in range(n)]), 0  # the plain series, to the same share
    total = terms.copy()
    while np.abs(terms).max() > 1e-16 * np.abs(total).max():
        terms, many = terms @ M, many + 1
        total += terms
    fast, few = solve(spark, monkeypatch, M, seeds, mask)
    assert 0 < few <= many / 4, (few, many)
    for run, b in seeds.items():
        free = [k for k in range(n) if k not in mask.get(run, [])]
        v = np.array([b.get(k, 0.0) for k in free])
        want = np.linalg.solve(np.eye(len(free)) - M[np.ix_(free, free)].T, v)
        assert fast[run][free] == pytest.approx(want, rel=1e-11, abs=1e-13 * np.abs(want).max())
        assert not fast[run][mask.get(run, [])].any()


def test_krylov_on_a_placed_matrix_and_acyclic_flows(spark, monkeypatch):
    M = np.zeros((6, 6))
    M[0, 1], M[1, 2], M[0, 2], M[2, 5] = 0.4, 0.5, 0.1, 0.3  # no cycles: the series ends by itself
    seeds = {"a": {0: 1.0}, "b": {5: 2.0}}
    for rows in (1000, 0):
        got, _ = solve(spark, monkeypatch, M, seeds, broadcast_rows=rows)
        for run, b in seeds.items():
            assert got[run] == pytest.approx(np.linalg.solve(np.eye(6) - M.T, [b.get(k, 0.0) for k in range(6)]))


def test_expanding_systems_take_the_plain_series(spark):
    """Krylov directions would solve a system whose series diverges; the certificate (a
    norm below one) keeps them off it."""
    grow = linalg.oriented(long_matrix(spark, np.array([[0.0, 2.0], [0.9, 0.0]])), "row", "M")
    keyed = grow.selectExpr("concat(src_region, src_sector) as src", "concat(dst_region, dst_sector) as dst", "value", "1L as sys_id")
    assert not linalg.contracts(keyed)
    assert linalg.contracts(keyed.withColumn("value", F.col("value") / 3))
