"""Shared fixtures: a local session and the reference's four-label economy."""

from __future__ import annotations

import os
import sys
from pathlib import Path

os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # before numpy: its threads can hang beside a forked JVM

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tremor.operators.economy import Economy, allocation, coefficients  # noqa: E402
from tremor.session import build_session  # noqa: E402

LABELS = [("C1", "Farming"), ("C1", "Food Processing"), ("C2", "Mining"), ("C2", "Manufacturing")]
A_CELLS = [("C1", "Farming", "C1", "Food Processing", 0.4),
           ("C2", "Mining", "C2", "Manufacturing", 0.5),
           ("C1", "Farming", "C2", "Manufacturing", 0.1)]
Y_VALUES = [100.0, 150.0, 80.0, 200.0]
X_VALUES = [180.0, 150.0, 180.0, 200.0]  # = L·y
CELL = "producer_region string, producer_sector string, consumer_region string, consumer_sector string, value double"
VEC = "region string, sector string, value double"


@pytest.fixture(scope="session")
def spark():
    s = build_session("*", shuffle_partitions=8, app="tremor-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def eco(spark):
    labels = spark.createDataFrame(LABELS, "region string, sector string")
    X = spark.createDataFrame([(*lab, v) for lab, v in zip(LABELS, X_VALUES)], VEC)
    Y = spark.createDataFrame([(*lab, v) for lab, v in zip(LABELS, Y_VALUES)], VEC)
    A = spark.createDataFrame(A_CELLS, CELL)
    Z = spark.createDataFrame([(p, ps, c, cs, a * dict(zip(LABELS, X_VALUES))[(c, cs)]) for p, ps, c, cs, a in A_CELLS], CELL)
    regions = spark.createDataFrame([("C1", "Country 1", "CO1"), ("C2", "Country 2", None)],
                                    "region string, name string, iso3 string")
    groups = spark.createDataFrame([("G12", "C1"), ("G12", "C2"), ("GONE", "XX")], "group_name string, region string")
    return Economy(labels=labels, Z=Z, X=X, Y=Y, A=coefficients(Z, X), B=allocation(Z, X),
                   regions=regions, groups=groups)


def shocks(spark, rows):
    """rows: (scenario_id, region, sector, magnitude as share)."""
    return spark.createDataFrame(rows, "scenario_id string, region string, sector string, magnitude double")


def as_dict(df, key=("scenario_id", "region", "sector"), value="delta_x"):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}
