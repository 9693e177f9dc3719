"""Economies of several years, stored-inverse models and adjoint portfolios."""

import pytest
from pyspark.sql import functions as F

from conftest import shocks
from tremor.operators import attribution as att
from tremor.operators import linalg, propagate
from tremor.operators.years import YearEconomies, coefficients_by_year, home_impact_by_year, impacts_by_year


@pytest.fixture(scope="module")
def two_years(spark, eco):
    """The fixture's year, and one with half the flows of it."""
    both = lambda df: df.withColumn("year", F.lit(2000)).unionByName(df.withColumn("year", F.lit(2001)).withColumn("value", F.col("value")))
    Z = both(eco.Z).withColumn("value", F.when(F.col("year") == 2001, F.col("value") / 2).otherwise(F.col("value")))
    X = both(eco.X)
    A, B = coefficients_by_year(Z, X)
    return YearEconomies(eco.labels, A, B, X)


CASES = [("a", "C1", "Farming", 0.1), ("a", "C2", "Mining", 0.2), ("b", "C1", "Farming", 0.5)]


def test_a_year_equals_its_own_economy(spark, eco, two_years):
    sh = shocks(spark, CASES)
    methods = ["ghosh", "leontief", "textbook", "direct"]
    got = impacts_by_year(two_years, sh, methods).cache()
    alone = {(r.method, r.scenario_id, r.region, r.sector): r.delta_x for r in propagate.impacts(eco, sh, methods).collect()}
    rows = got.collect()
    assert len(rows) == 2 * len(alone)
    assert {(r.method, r.scenario_id, r.region, r.sector): r.delta_x for r in rows if r.year == 2000} == pytest.approx(alone)
    at = {(r.year, r.method, r.scenario_id, r.sector): r.delta_x for r in rows}
    assert at[2000, "ghosh", "a", "Manufacturing"] == pytest.approx(-22.0)
    assert at[2001, "ghosh", "a", "Manufacturing"] == pytest.approx(-11.0)  # half the deliveries
    one = impacts_by_year(two_years.only([2001]), sh, ["ghosh"]).collect()
    assert {r.year for r in one} == {2001} and len(one) == 8
    homes = spark.createDataFrame([("a", "C2", "Manufacturing")], "scenario_id string, home_region string, home_sector string")
    impact = {r.year: r.pct_change for r in home_impact_by_year(two_years.X, got.where("method = 'ghosh'"), homes).collect()}
    assert impact == pytest.approx({2000: -11.0, 2001: -5.5})


def test_years_in_folders_are_pruned(spark, two_years, tmp_path):
    from tremor.sources import io
    io.write_by_year(two_years.A, str(tmp_path), "A")
    A = spark.read.parquet(f"{tmp_path}/A")
    plan = YearEconomies(two_years.labels, A, two_years.B, two_years.X).only([2001]).A._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2001" in plan.split("PartitionFilters")[1]


@pytest.mark.parametrize("limit", [1000, 1])
def test_stored_inverse_equals_the_series(spark, eco, limit):
    """With a limit of one label, scenario ``a`` is too large for a block and loops."""
    sh = shocks(spark, CASES + [("z", "C1", "Food Processing", 0.0)])
    methods = ["ghosh", "leontief", "textbook", "direct"]
    L = linalg.power_series(eco.A, eco.labels)
    G = linalg.similarity_scale(L, eco.X)
    key = lambda r: (r.method, r.scenario_id, r.region, r.sector)
    want = {key(r): r.delta_x for r in propagate.impacts(eco, sh, methods).collect()}
    got = {key(r): r.delta_x for r in propagate.stored_impacts(eco, sh, methods, L, G, max_block=limit).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_stored_inverse_is_asked_for(spark, eco):
    with pytest.raises(ValueError, match="stored inverse"):
        propagate.stored_impacts(eco, shocks(spark, CASES), ["ghosh"])


def test_a_portfolio_is_one_run(spark, eco):
    """Goldens of the fixture: contributions 3.6 and 12, shares 23.0769 and 76.9231 %."""
    sh = shocks(spark, CASES[:2])
    dx = propagate.ghosh_impact(eco, sh)
    held = spark.createDataFrame([("p", "C2", "Manufacturing", 60.0), ("p", "C1", "Food Processing", 40.0)],
                                 "portfolio_id string, region string, sector string, weight double")
    seeds = att.portfolio_seeds(held, "ghosh")
    assert seeds.select("run_id").distinct().count() == 1
    positions = held.withColumn("scenario_id", F.lit("a"))
    homes = held.select(F.col("region").alias("home_region"), F.col("sector").alias("home_sector"))
    for infl in (att.portfolio_influence(eco, held, "ghosh"), att.influence(eco, homes, "ghosh")):
        rows = {r.cause_sector: r for r in att.attribute_portfolio(dx, sh, positions, infl).collect()}
        assert rows["Farming"].contribution == pytest.approx(3.6) and rows["Mining"].contribution == pytest.approx(12.0)
        assert rows["Mining"].share_pct == pytest.approx(76.9231, abs=1e-4) and rows["Mining"].total_impact == pytest.approx(15.6)
