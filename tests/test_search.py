"""The largest-impact search: closed form against the propagated scenarios."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import CELL, LABELS, VEC, shocks
from tremor.operators import linalg, propagate, search
from tremor.operators.economy import Economy, allocation, coefficients

HOMES = "scenario_id string, home_region string, home_sector string"


@pytest.fixture(scope="module")
def dense(spark, eco):
    """Five regions of three sectors that all deliver to each other, some cells missing."""
    rng = random.Random(4)
    labels = [(f"R{r}", f"S{s}") for r in range(5) for s in range(3)]
    Z = spark.createDataFrame([(*a, *b, rng.uniform(0.5, 9)) for a in labels for b in labels if rng.random() < 0.8], CELL)
    X = spark.createDataFrame([(*a, rng.uniform(150, 300)) for a in labels], VEC)
    return Economy(labels=spark.createDataFrame(labels, "region string, sector string"), Z=Z, X=X, Y=X.withColumn("value", F.lit(0.0)),
                   A=coefficients(Z, X), B=allocation(Z, X), regions=eco.regions, groups=eco.groups)


def propagated(eco, sh, variant="parity"):
    dy = propagate.required_demand(eco.A, propagate.leontief_impact(eco, sh, variant))
    return {(r.scenario_id, r.region, r.sector): r.delta_y for r in dy.collect()}


@pytest.mark.parametrize("variant", ["parity", "textbook"])
def test_free_homes_equal_the_propagated_model(spark, dense, variant):
    sh = shocks(spark, [("a", "R0", "S0", 0.1), ("b", "R1", "S0", 0.3), ("b", "R1", "S2", 1.0), ("b", "R4", "S1", 0.0)])
    homes = dense.labels.select(F.col("region").alias("home_region"), F.col("sector").alias("home_sector"))
    asked = homes.withColumn("scenario_id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("unknown"))))
    got = {(r.scenario_id, r.home_region, r.home_sector): r.delta_y
           for r in propagate.free_demand_change(dense, sh, asked.unionByName(asked), variant).collect()}
    shocked = {(r.scenario_id, r.region, r.sector) for r in sh.collect()}
    want = {k: v for k, v in propagated(dense, sh, variant).items() if k not in shocked}
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9) and len(got) == 14 + 12


def test_every_pair_and_the_winner(spark, dense):
    pairs = dense.Z.where("producer_sector in ('S0', 'S1')")  # some producers are their own home
    got = {(r.shock_region, r.shock_sector, r.home_region, r.home_sector): r.impact for r in search.pair_impacts(dense, pairs).collect()}
    dy = propagated(dense, search.search_runs(pairs, 0.1))
    want = {(p.producer_region, p.producer_sector, p.consumer_region, p.consumer_sector):
            abs(dy[f"{p.producer_region}|{p.producer_sector}", p.consumer_region, p.consumer_sector]) for p in pairs.collect()}
    assert any(k[:2] == k[2:] for k in want)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-9)
    best = search.max_impact_scenario(dense, pairs).collect()
    assert [tuple(r)[:4] for r in best] == [min(want, key=lambda k: (-want[k], k))]


def test_no_loop_where_no_home_is_its_own_shock(spark, eco, monkeypatch):
    def loop(*a, **k):
        raise AssertionError("the search ran a loop")
    monkeypatch.setattr(linalg, "series_solve", loop)
    pairs = eco.Z.where("producer_region <> consumer_region")
    best = search.max_impact_scenario(eco, pairs).first()
    # Farming makes 18 less, 10 % of it for Manufacturing, which delivers nothing back.
    assert (best.shock_sector, best.home_sector) == ("Farming", "Manufacturing") and best.impact == pytest.approx(1.8)
    assert search.max_impact_scenario(eco, pairs.limit(0)).collect() == []


def test_unknown_producers_raise(spark, eco):
    pairs = spark.createDataFrame([("XX", "Farming", *LABELS[1], 1.0)], CELL)
    with pytest.raises(ValueError):
        search.pair_impacts(eco, pairs)
