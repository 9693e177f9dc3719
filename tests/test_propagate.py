"""Golden values on the four-label economy (Leontief parity/textbook, Ghosh, Δy),
and the checks the reference's own tests make."""

import pytest
from pyspark.sql import functions as F

from conftest import as_dict, shocks
from tremor.operators import propagate

F1, F2, M1, M2 = ("C1", "Farming"), ("C1", "Food Processing"), ("C2", "Mining"), ("C2", "Manufacturing")
ORDER = [F1, F2, M1, M2]

CASES = [
    # (scenario_id, method, shocks, Δx in label order, Δy or None)
    ("lp50", "leontief", [(F1, 0.5)], [-90, -36, -4.5, -9], [-74.7, -36, 0, -9]),
    ("lt50", "textbook", [(F1, 0.5)], [-90, 0, 0, 0], [-90, 0, 0, 0]),
    ("lp10", "leontief", [(F1, 0.1)], [-18, -7.2, -0.9, -1.8], [-14.94, -7.2, 0, -1.8]),
    ("lpf20", "leontief", [(F2, 0.2)], [-60, -30, 0, 0], [-48, -30, 0, 0]),
    ("lpf0", "leontief", [(F2, 0.0)], [-60, 0, 0, 0], [-60, 0, 0, 0]),
    ("ltf0", "textbook", [(F2, 0.0)], [0, 0, 0, 0], [0, 0, 0, 0]),
    ("gm100", "ghosh", [(M1, 1.0)], [0, 0, -180, -100], None),
    ("g2", "ghosh", [(F1, 0.1), (M1, 0.2)], [-18, -6, -36, -22], None),
]


@pytest.fixture(scope="module")
def all_impacts(spark, eco):
    """Every case in one batched loop per method (as the driver does)."""
    out = {}
    for method in ("leontief", "textbook", "ghosh"):
        rows = [(sid, *lab, mag) for sid, m, sh, _, _ in CASES if m == method for lab, mag in sh]
        dx = propagate.impacts(eco, shocks(spark, rows), [method]).drop("method")
        dy = propagate.required_demand(eco.A, dx)
        out[method] = (as_dict(dx), as_dict(dy, value="delta_y"))
    return out


@pytest.mark.parametrize("sid,method,sh,expected,expected_dy", CASES, ids=[c[0] for c in CASES])
def test_golden_delta_x(all_impacts, sid, method, sh, expected, expected_dy):
    dx, dy = all_impacts[method]
    got = [dx[(sid, *lab)] for lab in ORDER]
    assert got == pytest.approx(expected, abs=1e-9)
    if expected_dy is not None:
        assert [dy.get((sid, *lab), 0.0) for lab in ORDER] == pytest.approx(expected_dy, abs=1e-9)


def test_shocked_label_falls_by_magnitude_and_dependant_falls(all_impacts):
    dx, _ = all_impacts["leontief"]
    assert dx[("lp50", *F1)] == pytest.approx(-180 * 0.5)
    assert dx[("lp50", *F2)] < 0
    g, _ = all_impacts["ghosh"]
    assert g[("gm100", *M1)] == pytest.approx(-180.0)
    assert g[("gm100", *M2)] < 0


def test_direct_impact(spark, eco):
    dx = propagate.direct_impact(eco, shocks(spark, [("d", *F1, 0.1)]))
    d = as_dict(dx)
    assert [d[("d", *lab)] for lab in ORDER] == pytest.approx([-18, 0, 0, 0])
    dy = as_dict(propagate.required_demand(eco.A, dx), value="delta_y")
    assert dy[("d", *F1)] == pytest.approx(-18)


def test_ghosh_is_linear_in_magnitude(spark, eco):
    dx = propagate.ghosh_impact(eco, shocks(spark, [("a", *F1, 0.1), ("b", *F1, 0.3)]))
    d = as_dict(dx)
    for lab in ORDER:
        assert d[("b", *lab)] == pytest.approx(3 * d[("a", *lab)], abs=1e-9)


def test_parity_and_textbook_on_the_buyer_side(spark, eco):
    """Manufacturing buys from Farming and Mining and sells nothing: the textbook
    variant cuts its suppliers by its lost demand (A_nm·Δx_m); parity removes its
    whole original demand (−A_nm·x_m), so suppliers fall even more."""
    dx = propagate.impacts(eco, shocks(spark, [("m", *M2, 0.25)]), ["leontief", "textbook"])
    rows = {(r["method"], r["region"], r["sector"]): r["delta_x"] for r in dx.collect()}
    assert rows[("textbook", *M2)] == pytest.approx(-50) and rows[("leontief", *M2)] == pytest.approx(-50)
    assert rows[("textbook", *F1)] == pytest.approx(-5) and rows[("textbook", *M1)] == pytest.approx(-25)
    assert rows[("leontief", *F1)] == pytest.approx(-20) and rows[("leontief", *M1)] == pytest.approx(-100)
    assert rows[("leontief", *F2)] == pytest.approx(0)


def test_input_order_does_not_matter(spark, eco):
    rows = [("p", *F1, 0.1), ("p", *M1, 0.2)]
    a = as_dict(propagate.ghosh_impact(eco, shocks(spark, rows)))
    b = as_dict(propagate.ghosh_impact(eco, shocks(spark, rows[::-1]).repartition(3)))
    assert a == pytest.approx(b)
