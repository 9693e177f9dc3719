"""Exact quantiles by splitters: all of several groups and fractions at once."""

import numpy as np
import pytest

from tremor.operators import search

QS = [0.0, 0.05, 0.5, 0.9, 0.95, 1.0]


def groups(rng):
    return {"even": rng.permutation(5000).astype(float), "ties": rng.integers(0, 4, 3001).astype(float),
            "skew": np.exp(rng.normal(0, 8, 4000)), "flat": np.full(777, 3.5), "one": np.array([-2.0]),
            "hot": np.concatenate([np.full(9000, 1.0), rng.random(500)]), "two": np.array([5.0, -5.0])}


@pytest.mark.parametrize("sketch, most", [(search.SKETCH, search.MOST_BETWEEN), (50, 40)])
def test_all_groups_and_fractions(spark, sketch, most):
    """Also with a coarse sketch and little room, where groups are narrowed first."""
    data = groups(np.random.default_rng(5))
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("even", None), ("nothing", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {(r.g, r.q): r.value for r in search.quantiles(df, "x", QS, ["g"], sketch, most).collect()}
    want = {(g, q): float(np.quantile(v, q)) for g, v in data.items() for q in QS}
    assert got == pytest.approx(want, rel=1e-12)


def test_single_threshold_and_no_values(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "x double")
    assert search.quantile_threshold(df, "x", 0.9) == 90.0
    assert search.quantile_threshold(df.where("x < 0"), "x", 0.9) is None
    assert search.above_quantile(df, "x", 0.95).count() == 5


def test_splitters_that_miss_are_moved_out(spark):
    df = spark.createDataFrame([(float(v),) for v in range(100)], "v double")
    targets = spark.createDataFrame([(0.5, 100, 0.0, 99.0, 70.0, 80.0, 49, 50, 0.5)],
                                    "q double, n long, least double, largest double, lo double, hi double, low long, high long, part double")
    done, missed = search._read_off(df, targets, [])
    # The counted values below the lower splitter hold the rank: it has no value of its own.
    assert done.count() == 0 and missed.count() == 1
