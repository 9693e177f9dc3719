"""The driver contract at sf0.001: entry runs, and a spread of queries matches the
DuckDB oracle exactly (rows, column names, values)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tremor.plans import catalog, fixtures, oracle, store

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
SAMPLE = ["flow_table", "ghosh_impact", "leontief_impact", "leontief_textbook", "top_impacts_pct",
          "home_attribution_leontief", "portfolio_attribution", "top_contributors", "impact_paths",
          "portfolio_paths", "shock_history", "shock_history_strict", "year_files_round_trip", "materiality", "materiality_intent", "high_flow_pairs",
          "max_impact_scenario", "default_scenario", "ghosh_inverse_top", "scenario_batch", "catalog_listing"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: repr(v + 0.0) if isinstance(v, float) else repr(v)
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["scenario_id", "rank", "region", "country", "sector", "change", "pct_change"]


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(oracle.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon([d[0] for d in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["shock_history", "shock_history_strict"])
def test_history_of_every_region_counts(spark, con, name, monkeypatch):
    """The reports sum the shocked labels over all lines, whatever the region; a label
    without a line is a real gap, which drops its scenario from the strict report."""
    shocks = [tuple(r) for r in store.scenarios(spark, SF).select("scenario_id", "region", "sector").collect()]
    history = con.execute(oracle.with_(oracle.ECONOMY) + """
        SELECT producer_region, producer_sector, year, CAST(SUM(v) AS DOUBLE) FROM lines GROUP BY ALL""").fetchall()
    has = {h[:2] for h in history}
    gaps = {s for s, *label in shocks if tuple(label) not in has}
    assert ("two", "NATION_3", "FURNITURE") in shocks and "NATION_3" in {r for r, _ in has} and gaps
    want = {(s, y): 0.0 for s in {s for s, *_ in shocks} - (gaps if name == "shock_history_strict" else set()) for y in {h[2] for h in history}}
    for region, sector, year, value in history:
        for s, *label in shocks:
            if label == [region, sector] and (s, year) in want:
                want[s, year] += value
    read, report = [], catalog.reports.shock_history
    monkeypatch.setattr(catalog.reports, "shock_history", lambda hist, *a: read.append(hist) or report(hist, *a))
    got = {(r["scenario_id"], r["year"]): r["history_output"] for r in entry.queries()[name](spark, SF).collect()}
    assert got == pytest.approx(want)
    assert {tuple(r) for r in read[0].select("region", "sector", "year").collect()} == {h[:3] for h in history}


def test_every_oracle_binds(con):
    """Every oracle statement parses and binds against the driver's views."""
    bad = {}
    for name, sql in oracle.SQL.items():
        try:
            con.execute("EXPLAIN " + sql)
        except Exception as e:  # noqa: BLE001
            bad[name] = str(e)[:200]
    assert not bad, bad


def test_year_files_hold_every_year(spark, con):
    want = con.execute(oracle.with_(oracle.ECONOMY) + """
        SELECT producer_region, producer_sector, year, CAST(SUM(v) AS DOUBLE) FROM lines GROUP BY ALL""").fetchall()
    got = entry.queries()["year_files_round_trip"](spark, SF).select("region", "sector", "year", "gross_output").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert 2050 not in {r["year"] for r in got}


def test_every_valid_portfolio_is_valued(spark, monkeypatch):
    more = [("p5", "NATION_2", "BUILDING", 70.0), ("p5", "NATION_3", "FURNITURE", 30.0), ("p6", "NATION_2", "BUILDING", 90.0)]
    listed = [(s, *p) for s in fixtures.SCENARIO_IDS for p in fixtures.PORTFOLIOS if p[0] in fixtures.VALUED_PORTFOLIOS]
    assert sorted(tuple(r) for r in store.positions(spark).collect()) == sorted(listed)
    monkeypatch.setattr(fixtures, "PORTFOLIOS", fixtures.PORTFOLIOS + more)
    got = sorted(tuple(r) for r in store.positions(spark).collect())
    assert got == sorted(listed + [(s, *p) for s in fixtures.SCENARIO_IDS for p in more[:2]])
