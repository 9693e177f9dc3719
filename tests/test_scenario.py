"""Scenario and portfolio building."""

import pytest

from tremor.operators import scenario as scn

SPEC = "scenario_id string, region_spec string, sector string, percent double"


def test_expand_region_all_group_single(spark, eco):
    specs = spark.createDataFrame([("all", "All", "Mining", 10.0), ("grp", "G12", "Mining", 20.0),
                                   ("one", "C2", "Mining", 30.0), ("gone", "GONE", "Mining", 5.0)], SPEC)
    got = {(r.scenario_id, r.region, r.magnitude) for r in scn.single_shock(specs, eco.labels, eco.groups).collect()}
    assert ("all", "C1", 0.1) in got and ("all", "C2", 0.1) in got
    assert ("grp", "C1", 0.2) in got and ("grp", "C2", 0.2) in got
    assert ("one", "C2", 0.3) in got
    # an emptied group disappears, so its name is treated as a plain region code
    assert ("gone", "GONE", 0.05) in got


def test_valid_groups_drop_absent_members(eco):
    assert {r.group_name for r in scn.valid_groups(eco.groups, eco.labels).collect()} == {"G12"}


def test_service_shock_and_resolution(spark, eco):
    mat = spark.createDataFrame([("Pollination", "Farming"), ("Pollination", "Nope"), ("Water", "Mining")],
                                "service string, sector string")
    specs = spark.createDataFrame([("s", "ecosystem", "All", None, "Pollination", 50.0),
                                   ("p", "sector", "C2", "Mining", None, 10.0),
                                   ("c", "sector", "C1", "Farming", None, 10.0)],
                                  "scenario_id string, shock_type string, region_spec string, sector string, service string, percent double")
    custom = spark.createDataFrame([("c", "C2", "Manufacturing", 40.0)], "scenario_id string, region string, sector string, percent double")
    got = {(r.scenario_id, r.region, r.sector, r.magnitude) for r in scn.resolve_scenario(specs, custom, mat, eco.labels, eco.groups).collect()}
    assert got == {("s", "C1", "Farming", 0.5), ("p", "C2", "Mining", 0.1), ("c", "C2", "Manufacturing", 0.4)}


def test_apply_edits_last_write_wins(spark):
    edits = spark.createDataFrame([
        ("e", 1, "add", "C1", "Farming", 0.3), ("e", 2, "add", "C1", "Farming", 0.2),
        ("e", 3, "add", "C2", "Mining", 0.5), ("e", 4, "delete", "C2", "Mining", None),
        ("e", 5, "add", "C2", "Mining", 0.1), ("e", 6, "add", "C1", "Food Processing", 0.9),
        ("e", 7, "delete", "C1", "Food Processing", None),
        ("f", 1, "add", "C1", "Farming", 0.3), ("f", 2, "clear", None, None, None), ("f", 3, "add", "C2", "Mining", 0.7)],
        "scenario_id string, seq int, op string, region string, sector string, magnitude double")
    got = {(r.scenario_id, r.region, r.sector, r.magnitude) for r in scn.apply_edits(edits).collect()}
    assert got == {("e", "C1", "Farming", 0.2), ("e", "C2", "Mining", 0.1), ("f", "C2", "Mining", 0.7)}


def test_portfolio_tolerance(spark):
    pf = spark.createDataFrame([("a", "C1", "Farming", 60.0), ("a", "C2", "Mining", 40.0009),
                                ("b", "C1", "Farming", 60.0), ("b", "C2", "Mining", 40.0011),
                                ("c", "C1", "Farming", 100.0), ("c", "C2", "Mining", 0.0)], scn.PORTFOLIO)
    ok = {r.portfolio_id: r.is_valid for r in scn.validate_portfolio(pf).collect()}
    assert ok == {"a": True, "b": False, "c": False}
    cand = spark.createDataFrame([("a", "C2", "Mining", 40.0), ("a", "C1", "Food Processing", 1.0), ("a", "C1", "Food Processing", -1.0)], scn.PORTFOLIO)
    allowed = [(r.sector, r.weight, r.allowed) for r in scn.can_add(pf.where("portfolio_id = 'a'"), cand).collect()]
    assert ("Mining", 40.0, True) in allowed and ("Food Processing", 1.0, False) in allowed and ("Food Processing", -1.0, False) in allowed


def test_levels_split_blocks_and_validation(spark, eco):
    sh = spark.createDataFrame([("s", "C1", "Farming", 0.25), ("s", "C1", "Farming", 0.25), ("s", "ZZ", "Mining", 1.5)], scn.SHOCKS)
    lv = scn.shock_levels(eco.X, sh.limit(1)).first()
    assert lv.x == 180 and lv.x_new == pytest.approx(135) and lv.delta_x == pytest.approx(-45)
    assert scn.duplicate_shocks(sh).count() == 1
    assert scn.bad_magnitudes(sh).count() == 1
    assert [r.region for r in scn.missing_labels(sh, eco.labels).collect()] == ["ZZ"]
    good = sh.limit(1)
    split = {(r.sector, r.shocked) for r in scn.partition_labels(eco.labels, good).collect()}
    assert ("Farming", True) in split and ("Mining", False) in split and len(split) == 4
    blocks = {r.block: (r.cells, r.total) for r in scn.block_summary(eco.A, good).collect()}
    assert blocks["MN"] == (2, pytest.approx(0.5)) and blocks["NN"] == (1, pytest.approx(0.5))
    nn = scn.block(eco.A, good.select("region", "sector"), good.select("region", "sector"), rows_in=False, cols_in=False)
    assert nn.count() == 1
