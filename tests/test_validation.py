"""Convergence, shock validation, paths of several homes, record files on any path."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import CELL, VEC, shocks
from tremor.operators import attribution as att
from tremor.operators import economy as econ
from tremor.operators import linalg, propagate, reports, scenario, search
from tremor.sources import io

M1, M2, F1 = ("C2", "Mining"), ("C2", "Manufacturing"), ("C1", "Farming")


def two_labels(spark, c):
    A = spark.createDataFrame([("a", "s", "b", "s", c), ("b", "s", "a", "s", c)], CELL)
    return A, spark.createDataFrame([("a", "s", 10.0), ("b", "s", 10.0)], VEC)


def test_tight_series_is_summed_to_the_end(spark):
    A, y = two_labels(spark, 0.9)
    assert [r.value for r in econ.gross_output(A, y, tol=1e-12).collect()] == pytest.approx([100.0, 100.0], rel=1e-10)
    A, y = two_labels(spark, 0.98)
    labels = y.select("region", "sector")
    assert [r.value for r in linalg.matvec(linalg.power_series(A, labels), y).collect()] == pytest.approx([500.0, 500.0])


def test_series_that_does_not_settle_raises(spark, monkeypatch):
    A, y = two_labels(spark, 1.0)
    with pytest.raises(linalg.NotConvergent):
        econ.gross_output(A, y)
    A, y = two_labels(spark, 0.98)
    systems = linalg.oriented(A, "column", "A")
    seed = y.select(F.lit("A").alias("system"), F.lit("x").alias("run_id"), "region", "sector", "value")
    # A norm below one: solved in a few rounds; the plain series takes over a thousand.
    assert [r.value for r in linalg.series_solve(systems, seed, max_rounds=30).collect()] == pytest.approx([500.0, 500.0])
    monkeypatch.setattr(linalg, "contracts", lambda m: False)
    with pytest.raises(linalg.NotConvergent):
        linalg.series_solve(systems, seed, max_rounds=30)
    with pytest.raises(linalg.NotConvergent):
        linalg.power_series(two_labels(spark, 1.1)[0], y.select("region", "sector"))


def test_loop_leaves_the_session_settings(spark, eco):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    econ.gross_output(eco.A, eco.Y).collect()
    assert {k: spark.conf.get(k) for k in before} == before


@pytest.mark.parametrize("rows,rule", [([("s", "XX", "Farming", 0.1)], "unknown_label"),
                                       ([("s", *F1, 0.1), ("s", *F1, 0.2)], "2 duplicate"), ([("s", *F1, 1.7)], "bad_magnitude"),
                                       ([("s", *F1, -0.1)], "bad_magnitude"), ([("s", *F1, None)], "bad_magnitude")])
def test_invalid_shocks_raise(spark, eco, rows, rule):
    with pytest.raises(ValueError, match=rule):
        propagate.ghosh_impact(eco, shocks(spark, rows))


def test_unknown_home_is_found(spark, eco):
    with pytest.raises(ValueError, match="1 homes"):
        scenario.require_labels(spark.createDataFrame([("XX", "YY")], "region string, sector string"), eco.labels, "homes")


def test_two_homes_of_a_scenario_are_ranked_apart(spark, eco):
    sh = shocks(spark, [("g", *F1, 0.1), ("g", *M1, 0.2)])
    dx = propagate.ghosh_impact(eco, sh)
    schema = "scenario_id string, home_region string, home_sector string"
    one = lambda *h: {tuple(r) for r in reports.impact_paths(
        eco.A, dx, sh, spark.createDataFrame([("g", *x) for x in h], schema), eco.labels).collect()}
    a, b = one(M2), one(("C1", "Food Processing"))
    assert a and b and one(M2, ("C1", "Food Processing")) == a | b


def test_block_summary_of_a_scenario_without_cells(spark, eco):
    extra = eco.labels.unionByName(spark.createDataFrame([("C3", "Alone")], "region string, sector string"))
    assert extra.count() == 5
    got = {r.block: (r.cells, r.total) for r in scenario.block_summary(eco.A, shocks(spark, [("z", "C3", "Alone", 0.1)])).collect()}
    assert got == {"MM": (0, 0.0), "MN": (0, 0.0), "NM": (0, 0.0), "NN": (3, pytest.approx(1.0))}


def test_unknown_service_keeps_the_single_pick(spark, eco):
    specs = spark.createDataFrame([("s", "ecosystem", "C1", "Farming", "none", 10.0)],
                                  "scenario_id string, shock_type string, region_spec string, sector string, service string, percent double")
    custom = spark.createDataFrame([], "scenario_id string, region string, sector string, percent double")
    sectors = spark.createDataFrame([("Pollination", "Mining")], "service string, sector string")
    rows = scenario.resolve_scenario(specs, custom, sectors, eco.labels, eco.groups).collect()
    assert [tuple(r) for r in rows] == [("s", "C1", "Farming", 0.1)]


def test_home_without_own_row_of_causes(spark, eco):
    sh = shocks(spark, [("z", *M2, 0.5)])
    dx = propagate.ghosh_impact(eco, sh)
    home = spark.createDataFrame([("z", *M2)], "scenario_id string, home_region string, home_sector string")
    rows = att.attribute(dx, sh, home, att.influence(eco, home, "ghosh")).collect()
    assert [(r.cause_region, r.share_pct, r.total_impact) for r in rows] == [(None, 0.0, pytest.approx(100.0))]


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.95, 1.0])
def test_quantile_by_bins_is_exact(spark, q):
    import numpy as np

    rng = np.random.default_rng(4)
    v = np.concatenate([rng.exponential(size=900) ** 4, np.zeros(300), np.full(50, 7.5), [1e12]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    for sketch, most in ((search.SKETCH, search.MOST_BETWEEN), (40, 20)):
        got = search.quantiles(df, "v", [q], sketch=sketch, most=most).first()["value"]
        assert got == pytest.approx(float(np.quantile(v, q)), rel=1e-12)
    assert search.quantile_threshold(df.limit(0), "v", q) is None


def test_json_arrays_and_lines_on_plain_paths_and_uris(spark, tmp_path):
    rows = [{"scenario_id": "s", "region": "C1", "sector": "Farming", "magnitude": 10.0}, {"scenario_id": "s", "region": "C2", "sector": "Mining", "magnitude": 20.0}]
    (tmp_path / "array.json").write_text("\n " + json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    got = [sorted(map(tuple, io.read_scenarios(spark, p).collect())) for name in ("array", "lines")
           for p in (f"{tmp_path}/{name}.json", f"file://{tmp_path}/{name}.json")]
    assert got == [[("s", "C1", "Farming", 0.1), ("s", "C2", "Mining", 0.2)]] * 4
    (tmp_path / "m.json").write_text(json.dumps([{"service": "a", "sectors": ["x", "y"]}]))
    assert io.read_materiality(spark, f"file://{tmp_path}/m.json").count() == 2


def test_wide_history_and_headers(spark, tmp_path):
    spark.createDataFrame([("C1", "Farming", 1.0, None)], "region string, sector string, `1995` double, `1996` double").write.parquet(f"{tmp_path}/h")
    assert [tuple(r) for r in io.read_history(spark, f"{tmp_path}/h").collect()] == [("C1", "Farming", 1995, 1.0)]
    (tmp_path / "r.csv").write_text("ISIC Section,ISIC Division,ISIC Group,ISIC Class,EXIOBASE\nA,01,011,0111,Farming\n")
    assert io.read_crosswalk(spark, f"{tmp_path}/r.csv").columns == ["isic_section", "isic_division", "isic_group", "isic_class", "sector"]


def test_year_files_with_a_prefix(spark, eco, tmp_path):
    io.long_to_wide(eco.A, eco.labels).write.parquet(f"{tmp_path}/2020/T_A.parquet")
    eco.X.withColumnRenamed("value", "GrossOutput").write.parquet(f"{tmp_path}/2020/T_X.parquet")
    eco.X.write.parquet(f"{tmp_path}/notayear/T_X.parquet")
    eco.X.write.parquet(f"{tmp_path}/2021/T_Y.parquet")
    x, A = io.load_year_files(spark, str(tmp_path), 2020, ["X", "A"], "T_")
    assert x.count() == 4 and sorted(map(tuple, A.collect())) == sorted(map(tuple, eco.A.collect()))
    assert {r.year for r in io.read_year_files(spark, str(tmp_path), "X", "T_").collect()} == {2020}
