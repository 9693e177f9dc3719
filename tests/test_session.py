"""Lineage cuts and the joins of the line cube keep small tables small and large
dimensions away from the driver."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tremor.plans import driver_economy
from tremor.session import cut_lineage


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield 64
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_cut_table_does_not_keep_the_shuffle_partitions(spark, many_partitions):
    sums = cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.sum("id").alias("s")))
    assert sums.rdd.getNumPartitions() < 8  # 64 of a persisted plan
    again = cut_lineage(sums.unionByName(sums).crossJoin(sums.select(F.col("k").alias("j"))))
    assert again.rdd.getNumPartitions() < 16 and again.count() == 200
    assert {r.k: r.s for r in sums.collect()} == {k: sum(range(k, 1000, 10)) for k in range(10)}


def test_cut_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out = cut_lineage(spark.range(50).mapInArrow(counted, "id long"))
    assert out.count() == 50 and out.agg(F.sum("id")).first()[0] == 1225 and seen.value == 50


def test_cut_of_no_rows_and_of_nulls(spark):
    empty = cut_lineage(spark.createDataFrame([], "a string, v double"))
    assert empty.columns == ["a", "v"] and empty.count() == 0
    odd = [("x", None, None), (None, 1.5, [1, None]), ("x", None, None)]
    kept = cut_lineage(spark.createDataFrame(odd, "a string, v double, l array<int>"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, odd))


@pytest.fixture
def lines(spark, tmp_path):
    day = dt.datetime(1996, 5, 1)
    tables = {
        "part": ([(k, 1 + 7 * (k % 7)) for k in range(40)] + [(None, 3), (5, 50)], "p_partkey long, p_size int"),
        "supplier": ([(k, k % 3) for k in range(12)] + [(None, 1)], "s_suppkey long, s_nationkey int"),
        "customer": ([(k, k % 3, "ABC"[k % 3]) for k in range(30)] + [(None, 0, "A"), (4, 2, None)],
                     "c_custkey long, c_nationkey int, c_mktsegment string"),
        "orders": ([(k, k % 31, day + dt.timedelta(days=200 * (k % 4))) for k in range(60)] + [(None, 1, day), (9, None, day)],
                   "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(k % 61, k % 41, k % 13, float(k % 9), 100.0 + k, 0.05, "ANR"[k % 3], "FO"[k % 2]) for k in range(400)]
                     + [(None, 1, 1, 1.0, 1.0, 0.0, "A", "F"), (1, None, 1, 1.0, 1.0, 0.0, "A", "F")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_large_dimensions_of_the_lines_do_not_pass_through_the_driver(spark, lines):
    small = driver_economy.line_cube(spark, lines)
    large = driver_economy.line_cube(spark, lines, max_dimension_rows=5)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 4
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(small) == rows(large) and small.count() > 0
