"""Plan shape: the lineitem scan reads only the columns it needs, and the loop's
join is a broadcast only when the matrix passes the size check."""

import os

import pytest

from tremor.operators import linalg
from tremor.plans import driver_economy

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_cube_scan_is_pruned(spark):
    p = plan(driver_economy.line_cube(spark, SF))
    scans = [line for line in p.splitlines() if "FileScan parquet" in line and "lineitem" in line]
    assert scans, p
    li = scans[0]
    for unused in ("l_tax", "l_shipdate", "l_linenumber"):
        assert unused not in li
    for used in ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount"):
        assert used in li


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_z_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F
    li = spark.read.parquet(f"{SF}/lineitem.parquet").where(F.col("l_returnflag") != "N").select("l_orderkey")
    assert "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,N))]" in plan(li)


def rounds(spark, eco, monkeypatch, **options):
    """The plan of one more round after a short run of the loop, and its result."""
    from pyspark.sql import functions as F
    systems = linalg.oriented(eco.A, "column", "A")
    seed = eco.Y.select(F.lit("A").alias("system"), F.lit("x").alias("run_id"), "region", "sector", "value")
    original, plans = linalg._iterate, []

    def spy(state, step, *a, **k):
        plans.append(plan(step(state)))
        return original(state, step, *a, **k)

    monkeypatch.setattr(linalg, "_iterate", spy)
    out = {(r.region, r.sector): r.value for r in linalg.series_solve(systems, seed, terms=6, **options).collect()}
    monkeypatch.setattr(linalg, "_iterate", original)
    return plans[0], out


def test_small_matrix_is_broadcast(spark, eco, monkeypatch):
    shape, _ = rounds(spark, eco, monkeypatch)
    assert "BroadcastHashJoin" in shape


def test_large_matrix_stays_in_place(spark, eco, monkeypatch):
    """Beyond the row limit a round neither exchanges nor sorts the matrix, whichever
    side the hash table is built on, and hubs split into parts give the same sums."""
    _, expect = rounds(spark, eco, monkeypatch)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for per_task in (linalg.ROWS_PER_TASK, 2):
            monkeypatch.setattr(linalg, "ROWS_PER_TASK", per_task)
            shape, out = rounds(spark, eco, monkeypatch, broadcast_rows=0)
            assert "ShuffledHashJoin" in shape and "Bucketed: true" in shape
            assert "Sort " not in shape and "SortMergeJoin" not in shape
            assert shape.count("Exchange hashpartitioning") == 2, shape
            assert out == pytest.approx(expect)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


def test_hash_table_on_the_matrix(spark, eco, monkeypatch):
    _, expect = rounds(spark, eco, monkeypatch)
    original = linalg._round_placed
    monkeypatch.setattr(linalg, "_round_placed", lambda state, m, build: original(state, m, "matrix"))
    _, out = rounds(spark, eco, monkeypatch, broadcast_rows=0)
    assert out == pytest.approx(expect)
