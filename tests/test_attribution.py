"""Attribution, portfolio and report values on the four-label economy."""

import pytest
from pyspark.sql import functions as F

from conftest import shocks
from tremor.operators import attribution as att
from tremor.operators import linalg, propagate, reports

F1, F2, M1, M2 = ("C1", "Farming"), ("C1", "Food Processing"), ("C2", "Mining"), ("C2", "Manufacturing")


@pytest.fixture(scope="module")
def case(spark, eco):
    sh = shocks(spark, [("g2", *F1, 0.1), ("g2", *M1, 0.2)])
    dx = propagate.ghosh_impact(eco, sh)
    L = linalg.power_series(eco.A, eco.labels, 40)
    G = linalg.similarity_scale(L, eco.X)
    infl_g = G.select(F.col("consumer_region").alias("home_region"), F.col("consumer_sector").alias("home_sector"),
                      F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"), "value")
    return sh, dx, infl_g


def test_home_attribution(spark, case):
    sh, dx, infl = case
    homes = spark.createDataFrame([("g2", *M2)], "scenario_id string, home_region string, home_sector string")
    rows = {(r.cause_region, r.cause_sector): r for r in att.attribute(dx, sh, homes, infl).collect()}
    assert rows[F1].contribution == pytest.approx(2) and rows[M1].contribution == pytest.approx(20)
    assert rows[F1].share_pct == pytest.approx(9.0909, abs=1e-4) and rows[M1].share_pct == pytest.approx(90.9091, abs=1e-4)
    assert rows[F1].total_impact == pytest.approx(22)
    assert sum(r.share_pct for r in rows.values()) == pytest.approx(100)


def test_home_is_dropped_and_small_impact_gives_no_cause(spark, eco, case):
    sh, dx, infl = case
    homes = spark.createDataFrame([("g2", *M1)], "scenario_id string, home_region string, home_sector string")
    rows = att.attribute(dx, sh, homes, infl).collect()
    assert {(r.cause_region, r.cause_sector) for r in rows} == {F1}
    zero = propagate.ghosh_impact(eco, shocks(spark, [("z", *F2, 0.5)]))  # Food sells to nobody
    homes_z = spark.createDataFrame([("z", *M2)], "scenario_id string, home_region string, home_sector string")
    rows = att.attribute(zero, shocks(spark, [("z", *F2, 0.5)]), homes_z, infl).collect()
    # No impact: the home stays, without a cause and with total 0.
    assert [(r.cause_region, r.contribution, r.share_pct, r.total_impact) for r in rows] == [(None, 0.0, 0.0, 0.0)]


def test_portfolio_attribution_and_impact(spark, eco, case):
    sh, dx, infl = case
    pos = spark.createDataFrame([("g2", "pf", *M2, 60.0), ("g2", "pf", *F2, 40.0)],
                                "scenario_id string, portfolio_id string, region string, sector string, weight double")
    rows = {(r.cause_region, r.cause_sector): r for r in att.attribute_portfolio(dx, sh, pos, infl).collect()}
    assert rows[F1].contribution == pytest.approx(3.6) and rows[M1].contribution == pytest.approx(12)
    assert rows[F1].share_pct == pytest.approx(23.0769, abs=1e-4) and rows[M1].total_impact == pytest.approx(15.6)
    imp = reports.portfolio_impact(eco.X, dx, pos).first()
    assert imp.pct_change == pytest.approx(-8.666667, abs=1e-6)
    assert imp.before == pytest.approx(180) and imp.total_abs_change == pytest.approx(-15.6)


def test_rollups_and_top_contributors(spark, eco, case):
    sh, dx, infl = case
    homes = spark.createDataFrame([("g2", *M2)], "scenario_id string, home_region string, home_sector string")
    causes = att.attribute(dx, sh, homes, infl)
    by_c = {r.item: r.value for r in att.rollup_causes(causes, "country", eco.regions, ["scenario_id"]).collect()}
    assert by_c == pytest.approx({"Country 1": 100 * 2 / 22, "Country 2": 100 * 20 / 22})
    top = {r.item: r for r in att.top_contributors(att.rollup_causes(causes, "none", eco.regions, ["scenario_id"]), ["scenario_id"]).collect()}
    assert top["Total"].value == pytest.approx(100) and "Others" not in top
    assert top["Country 2 - Mining"].position == 1
    iso = att.country_contributions(causes, eco.regions, ["scenario_id"]).collect()
    assert [r.iso3 for r in iso] == ["CO1"]  # C2 has no ISO3
    signed = {(r.cause_region, r.is_total): r.value for r in att.signed_contributions(causes, ["scenario_id"], ["cause_region", "cause_sector"]).collect()}
    assert signed[("Total Impact", True)] == pytest.approx(-22)


def test_lost_input_flows_and_paths(spark, eco):
    sh = shocks(spark, [("l", *F1, 0.1)])
    dx = propagate.leontief_impact(eco, sh)
    flows = {(r.producer_sector, r.consumer_sector): r.flow for r in reports.lost_input_flows(eco.A, dx).collect()}
    assert flows == pytest.approx({("Farming", "Food Processing"): 2.88, ("Farming", "Manufacturing"): 0.18,
                                   ("Mining", "Manufacturing"): 0.9})
    homes = spark.createDataFrame([("l", *M2)], "scenario_id string, home_region string, home_sector string")
    edges = {(r.source_sector, r.target_sector, r.edge) for r in reports.impact_paths(eco.A, dx, sh, homes, eco.labels).collect()}
    assert ("Farming", "Manufacturing", "shock_to_home") in edges
    assert ("Mining", "Manufacturing", "intermediate_to_home") in edges
    nodes = {(r.sector, r.role) for r in reports.path_nodes(sh, reports.key_intermediaries(eco.A, dx, sh, homes, eco.labels), homes, eco.regions).collect()}
    assert ("Farming", "shock") in nodes and ("Manufacturing", "home") in nodes and ("Mining", "intermediate") in nodes


def test_top_impacts_excludes_shocks_and_breaks_ties(spark, eco):
    sh = shocks(spark, [("t", *M1, 0.5)])
    dx = propagate.ghosh_impact(eco, sh)
    top = reports.top_impacts(dx, eco.X, sh, eco.regions, n=3).orderBy("rank").collect()
    assert [(r.region, r.sector) for r in top] == [M2, F1, F2]  # M2 moves; the rest tie at 0 in label order
    assert top[0].country == "Country 2"


def test_home_impact_and_history(spark, eco):
    sh = shocks(spark, [("h", *F1, 0.5), ("h", *M1, 0.5)])
    dx = propagate.ghosh_impact(eco, sh)
    homes = spark.createDataFrame([("h", *M2)], "scenario_id string, home_region string, home_sector string")
    h = reports.home_impact(eco.X, dx, homes).first()
    assert h.before == 200 and h.after == pytest.approx(200 + h.delta_x)
    hist = spark.createDataFrame([(*F1, 2020, 10.0), (*F1, 2021, 12.0), (*F2, 2021, 99.0)],
                                 "region string, sector string, year int, value double")
    rows = {r.year: r for r in reports.shock_history(hist, eco.X, sh).collect()}
    assert rows[2020].history_output == 10 and rows[2021].history_output == 12
    assert rows[2020].base_output == 360 and rows[2020].post_shock_output == pytest.approx(180)
    assert reports.shock_history(hist, eco.X, sh, strict=True).count() == 0  # Mining has no history


def test_home_seeded_influence_equals_inverse_columns(spark, eco):
    """Without a full inverse, the rows of L / columns of G for the homes come from
    a home-seeded series."""
    homes = spark.createDataFrame([("s", *M2), ("s", *F2)], "scenario_id string, home_region string, home_sector string")
    g = {(r.home_sector, r.sector): r.value for r in att.influence(eco, homes, "ghosh").collect()}
    assert g[("Manufacturing", "Mining")] == pytest.approx(5 / 9) and g[("Food Processing", "Farming")] == pytest.approx(1 / 3)
    l_rows = {(r.home_sector, r.sector): r.value for r in att.influence(eco, homes, "leontief").collect()}
    assert l_rows[("Manufacturing", "Manufacturing")] == pytest.approx(1.0)
    assert ("Manufacturing", "Mining") not in l_rows  # row of L for Manufacturing: it sells to nobody
    a = {(r.home_sector, r.sector): r.value for r in att.influence(eco, homes, "direct").collect()}
    assert a == pytest.approx({("Manufacturing", "Mining"): 0.5, ("Manufacturing", "Farming"): 0.1,
                               ("Food Processing", "Farming"): 0.4})
