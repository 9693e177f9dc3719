"""Sources and sinks: wide ↔ long matrices, year folders, records, materiality map."""

import json
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tremor.sources import io, yaml_records


def test_wide_long_round_trip(spark, eco, tmp_path):
    wide = io.long_to_wide(eco.A, eco.labels)
    path = str(tmp_path / "A_wide")
    wide.write.parquet(path)
    back = io.read_matrix(spark, path, wide=True)
    a = {tuple(r[:4]): r.value for r in eco.A.collect()}
    b = {tuple(r[:4]): r.value for r in back.collect()}
    assert a == pytest.approx(b)


def test_wide_posexplode_path(spark, eco, monkeypatch):
    monkeypatch.setattr(io, "UNPIVOT_MAX_COLUMNS", 1)
    back = io.wide_to_long(io.long_to_wide(eco.A, eco.labels))
    assert back.count() == 3


def test_sliced_columns_of_a_labelled_file(spark, tmp_path, monkeypatch):
    """Tuple-literal names with quotes and dots, nulls, zeros, several slices."""
    monkeypatch.setattr(io, "UNPIVOT_MAX_COLUMNS", 2)
    monkeypatch.setattr(io, "SLICE_COLUMNS", 2)
    names = ["('AT', 'Wheat, n.e.c.')", "BE|Rail.way `x`", "('CZ', \"Food 'a'\")"]
    table = pa.table({"region": ["AT", "BE"], "sector": ["s", "t"], names[0]: [1.5, 0.0], names[1]: [None, 2.0], names[2]: [float("nan"), -3.0]})
    pq.write_table(table, tmp_path / "w.parquet")
    wide = spark.read.parquet(str(tmp_path / "w.parquet"))
    got = {(*r[:4], str(r.value)) for r in io.wide_to_long(wide).collect()}
    assert got == {("AT", "s", "AT", "Wheat, n.e.c.", "1.5"), ("BE", "t", "BE", "Rail.way `x`", "2.0"),
                   ("AT", "s", "CZ", "Food 'a'", "nan"), ("BE", "t", "CZ", "Food 'a'", "-3.0")}
    everything = io.wide_to_long(wide, drop_zeros=False)
    assert everything.count() == 6 and everything.where("value is null").count() == 1


def test_round_trip_at_real_width(spark, tmp_path):
    """5,000 columns: read in slices, none of which scans the others' columns."""
    n, rng = 5000, np.random.default_rng(3)
    names = [("R%02d" % (i // 100), "sector %02d" % (i % 100)) for i in range(n)]
    producer, consumer = rng.integers(0, n // 20, 4000) * 20, rng.integers(0, n, 4000)
    cells = {(*names[p], *names[c]): float(p + c + 1) for p, c in zip(producer, consumer)}
    A = spark.createDataFrame([(*k, v) for k, v in cells.items()], "producer_region string, producer_sector string, "
                              "consumer_region string, consumer_sector string, value double")
    labels = spark.createDataFrame(names, "region string, sector string")
    producers = spark.createDataFrame(names[::20], "region string, sector string")
    path = str(tmp_path / "wide")
    io.long_to_wide(A, labels, producers).write.parquet(path)
    stored = spark.read.parquet(path)
    assert len(stored.columns) == n + 2 and stored.count() == n // 20
    assert {tuple(r[:4]): r.value for r in io.read_matrix(spark, path, wide=True).collect()} == cells


def test_parse_label_forms():
    assert io.parse_label("('AT', 'Cultivation of wheat')") == ("AT", "Cultivation of wheat")
    assert io.parse_label("AT|Cultivation of wheat") == ("AT", "Cultivation of wheat")


def test_tables_by_year_and_history(spark, eco, tmp_path):
    base = str(tmp_path / "eco")
    io.write_tables({"A": eco.A, "X": eco.X}, base, 2020)
    io.write_tables({"X": eco.X.selectExpr("region", "sector", "value * 2 as value")}, base, 2021)
    A, X = io.load_tables(spark, base, 2020, ["A", "X"])
    assert A.count() == 3 and X.count() == 4
    years = io.read_years(spark, base, "X")
    assert sorted(r.year for r in years.select("year").distinct().collect()) == [2020, 2021]
    assert io.read_years(spark, base, "missing").count() == 0
    assert io.read_history(spark, str(tmp_path / "nope")) is None
    assert io.labels_of(eco.A).count() == 4


def test_records_rejected_when_incomplete(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text(json.dumps([{"scenario_id": "s", "region": "C1", "sector": "Farming", "magnitude": 20}]))
    df = io.read_scenarios(spark, str(good))
    assert df.first().magnitude == pytest.approx(0.2)
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps([{"scenario_id": "s", "region": "C1", "sector": "Farming", "magnitude": 20},
                               {"scenario_id": "s", "region": "C1", "magnitude": 5}]))
    assert io.read_scenarios(spark, str(bad)) is None
    out = str(tmp_path / "out")
    io.write_scenarios(df, out)
    assert io.read_scenarios(spark, out).first().magnitude == pytest.approx(0.2)
    pf = spark.createDataFrame([("p", "C1", "Farming", 100.0)], "portfolio_id string, region string, sector string, weight double")
    io.write_portfolios(pf, str(tmp_path / "pf.csv"))
    assert io.read_portfolios(spark, str(tmp_path / "pf.csv")).first().weight == 100.0


def test_materiality_map_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("Pollination", ["b", "a"]), ("Empty", [])], "service string, sectors array<string>")
    path = str(tmp_path / "mat")
    io.write_materiality(m, path)
    got = {(r.service, r.sector) for r in io.read_materiality(spark, path).collect()}
    assert got == {("Pollination", "a"), ("Pollination", "b")}
    assert io.read_materiality(spark, str(tmp_path / "none")) is None
    arr = tmp_path / "arr.json"
    arr.write_text(json.dumps([{"service": "W", "sectors": ["x"]}], indent=4))
    assert io.read_materiality(spark, str(arr)).count() == 1


def test_yaml_records(spark, tmp_path):
    """Uploads as users write them: one list per file, the file's name is the scenario's."""
    up = tmp_path / "uploads.yaml"
    up.mkdir()
    (up / "drought.yaml").write_text("- {region: C1, sector: Farming, magnitude: 20}\n- region: 'NO'\n  sector: Öl & Gas\n  magnitude: 5.5\n")
    (up / "none.yml").write_text("[]")
    (up / "notes.txt").write_text("not read")
    got = {tuple(r) for r in io.read_scenarios(spark, str(up)).collect()}
    assert got == {("drought", "C1", "Farming", 0.2), ("drought", "NO", "Öl & Gas", 0.055)}
    out = str(tmp_path / "back.yaml")
    io.write_scenarios(io.read_scenarios(spark, str(up)), out)
    assert {(r[0], r[1], r[2], round(r[3], 12)) for r in io.read_scenarios(spark, out).collect()} == got
    pf = spark.createDataFrame([("p", "C1", "Farming", 60.0), ("p", "C2", "x: y # z", 40.0)],
                               "portfolio_id string, region string, sector string, weight double")
    io.write_portfolios(pf, str(tmp_path / "pf.yaml"))
    assert sorted(io.read_portfolios(spark, str(tmp_path / "pf.yaml")).collect()) == sorted(pf.collect())
    single = tmp_path / "one.yaml"
    single.write_text("- {portfolio_id: q, region: C1, sector: Farming, weight: 100}")
    assert io.read_portfolios(spark, str(single)).first().portfolio_id == "q"


@pytest.mark.parametrize("text, reason", [
    ("- {region: C1, sector: Farming}", "record 0 lacks magnitude"),
    ("- {region: C1, sector: Farming, magnitude: 1}\n- {region: C1, magnitude: 2}", "record 1 lacks sector"),
    ("region: C1", "not a list of records"), ("", "not a list of records"), ("- [1, 2]", "not a list of records"),
    ("- {region: [", "not YAML"), ("- {region: C1, sector: s, magnitude: much}", "not a number"),
    ("- !!python/object/apply:os.getcwd []", "not YAML")])
def test_yaml_files_are_rejected_whole(spark, tmp_path, text, reason):
    up = tmp_path / "uploads.yaml"
    up.mkdir()
    (up / "bad.yaml").write_text(text)
    (up / "good.yaml").write_text("- {region: C1, sector: Farming, magnitude: 20}")
    assert io.read_scenarios(spark, str(up)) is None
    records, rejected = yaml_records.read(spark, str(up), "scenario_id string, region string, sector string, magnitude double", io.SHOCK_FIELDS)
    assert [r.region for r in records.collect()] == ["C1"]
    row = rejected.first()
    assert row.source_file.endswith("bad.yaml") and row.rejected.startswith(reason)
