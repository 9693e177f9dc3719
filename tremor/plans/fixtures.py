"""Fixed parameters of the driver queries: scenarios, home, portfolios, edit logs.

These are user inputs (what a user would pick in the reference's UI or upload); the
data they run against is always the economy derived from the driver tables.
"""

from __future__ import annotations

HOME = ("NATION_5", "AUTOMOBILE")
# A second home, for reports that take several homes of a scenario.
SECOND_HOME = ("NATION_7", "BUILDING")
SCENARIO_IDS = ["one", "two", "group", "service", "full", "zero", "fallback"]

# K8 scenario specs: (scenario_id, shock_type, region_spec, sector, service, percent).
SPECS = [
    ("one", "sector", "NATION_1", "BUILDING", None, 20.0),
    ("two", "sector", "NATION_1", "BUILDING", None, 20.0),  # overridden by its custom list
    ("group", "sector", "ASIA", "MACHINERY", None, 15.0),
    ("service", "ecosystem", "EUROPE", None, "service_6", 10.0),
    ("full", "sector", "NATION_6", "HOUSEHOLD", None, 100.0),
    ("zero", "sector", "NATION_2", "BUILDING", None, 0.0),
    ("fallback", "ecosystem", "NATION_4", "MACHINERY", "service_without_data", 25.0),  # keeps its single pick
]
# K4 custom list, percent: (scenario_id, region, sector, percent).
CUSTOM = [
    ("two", "NATION_1", "BUILDING", 20.0),
    ("two", "NATION_3", "FURNITURE", 10.0),
]

# Portfolios, weight in percent.
PORTFOLIOS = [
    ("p1", "NATION_5", "AUTOMOBILE", 40.0), ("p1", "NATION_7", "BUILDING", 35.0), ("p1", "NATION_9", "MACHINERY", 25.0),
    ("p2", "NATION_5", "AUTOMOBILE", 40.0), ("p2", "NATION_7", "BUILDING", 35.0), ("p2", "NATION_9", "MACHINERY", 24.9991),
    ("p3", "NATION_5", "AUTOMOBILE", 40.0), ("p3", "NATION_7", "BUILDING", 35.0), ("p3", "NATION_9", "MACHINERY", 20.0),
    ("p4", "NATION_1", "BUILDING", 50.0), ("p4", "NATION_5", "AUTOMOBILE", 50.0),
]
# Portfolios valued against every scenario: those that pass the weight check (K7).
VALUED_PORTFOLIOS = ["p1", "p2", "p4"]

# Edit logs (K5/K6): (key, seq, op, region, sector, value).
SCENARIO_EDITS = [
    ("e1", 1, "add", "NATION_1", "BUILDING", 0.30),
    ("e1", 2, "add", "NATION_3", "FURNITURE", 0.10),
    ("e1", 3, "add", "NATION_1", "BUILDING", 0.20),   # update
    ("e1", 4, "add", "NATION_4", "MACHINERY", 0.50),
    ("e1", 5, "delete", "NATION_4", "MACHINERY", None),
    ("e1", 6, "add", "NATION_4", "MACHINERY", 0.05),  # re-add
    ("e2", 1, "add", "NATION_8", "HOUSEHOLD", 0.40),
    ("e2", 2, "clear", None, None, None),
    ("e2", 3, "add", "NATION_2", "AUTOMOBILE", 0.25),
]
PORTFOLIO_EDITS = [
    ("q1", 1, "add", "NATION_5", "AUTOMOBILE", 60.0),
    ("q1", 2, "add", "NATION_7", "BUILDING", 40.0),
    ("q1", 3, "add", "NATION_5", "AUTOMOBILE", 30.0),  # update
    ("q1", 4, "add", "NATION_11", "FURNITURE", 30.0),
    ("q1", 5, "delete", "NATION_7", "BUILDING", None),
    ("q1", 6, "add", "NATION_7", "BUILDING", 40.0),    # re-add
]

# Candidate portfolio edits for the weight check (K7): (portfolio_id, region, sector, weight).
EDIT_CANDIDATES = [
    ("p1", "NATION_9", "MACHINERY", 25.0),   # same weight: total stays 100
    ("p1", "NATION_9", "MACHINERY", 30.0),   # update pushes the total over 100
    ("p3", "NATION_12", "HOUSEHOLD", 5.0),   # new label filling p3 up to 100
    ("p3", "NATION_12", "HOUSEHOLD", 6.0),   # one too many
    ("p4", "NATION_1", "BUILDING", 0.0),     # weight must be positive
]

# Shocks that break a rule (V1-V3), and one that breaks none.
REJECT_CASES = [
    ("r1", "NATION_1", "BUILDING", 0.2), ("r1", "NATION_99", "BUILDING", 0.2), ("r2", "NATION_3", "FURNITURE", 0.1),
    ("r2", "NATION_3", "FURNITURE", 0.2), ("r3", "NATION_4", "MACHINERY", 1.7), ("r3", "NATION_5", "MACHINERY", -0.1),
    ("r3", "NATION_6", "MACHINERY", None), ("r4", "XX", "YY", 2.0), ("r5", "NATION_3", "FURNITURE", 1.0),
]

# Search (B3/B4): listed producer sectors, quantile, shock.
SEARCH_SECTORS = ["BUILDING", "FURNITURE"]
SEARCH_QUANTILE = 0.95
SEARCH_MAGNITUDE = 0.1
# Default scenario (B5): quantile of large outputs.
DEFAULT_QUANTILE = 0.9

# Terms the SQL oracle sums (the engine sums until it has converged).
ORACLE_TERMS = 120
TIGHT_ORACLE_TERMS = 700
# The tight economy: gross output is this multiple of the larger of row and column sum.
TIGHT_FACTOR = 1.1
TOP_N = 100
PATH_K = 5
# Fractions of the flow quantiles.
FLOW_QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
