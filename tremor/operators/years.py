"""Economies of several years side by side.

Every table of a :class:`YearEconomies` has a ``year``; matrices and vectors are joined
on it, and each year is a system of its own in the series loop. So all years, scenarios
and methods are runs of one loop, and reading a selection of years from year folders
prunes the others at the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import linalg
from .propagate import METHOD_SYSTEM, RUN_KEYS, SYSTEM_SPECS
from .reports import pct
from .scenario import validate_shocks

LABEL = ["region", "sector"]
CELL = ["producer_region", "producer_sector", "consumer_region", "consumer_sector"]
KEYS = ["year", "scenario_id"]


@dataclass
class YearEconomies:
    """``labels`` (region, sector); matrices ``A``, ``B`` (year, cell, value); output
    ``X`` (year, region, sector, value)."""

    labels: DataFrame
    A: DataFrame
    B: DataFrame
    X: DataFrame

    def only(self, years: Iterable[int]) -> YearEconomies:
        """The economies of some years; of tables in year folders only these are read."""
        some = F.col("year").isin(list(years))
        return YearEconomies(self.labels, self.A.where(some), self.B.where(some), self.X.where(some))


def coefficients_by_year(Z: DataFrame, X: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2 and M3 of every year: ``Z_ij / x_j`` and ``Z_ij / x_i``."""
    x = lambda side: X.where("value <> 0").select(
        "year", F.col("region").alias(f"{side}_region"), F.col("sector").alias(f"{side}_sector"), F.col("value").alias("x"))
    out = [Z.join(x(side), ["year", f"{side}_region", f"{side}_sector"]).select("year", *CELL, (F.col("value") / F.col("x")).alias("value"))
           for side in ("consumer", "producer")]
    return out[0], out[1]


def levels_by_year(X: DataFrame, shocks: DataFrame) -> DataFrame:
    """K9 for every year: (year, scenario_id, region, sector, x, delta_x)."""
    lv = shocks.join(X.select("year", *LABEL, F.col("value").alias("x")), LABEL)
    return lv.select(*KEYS, *LABEL, "x", (F.col("x") * (1 - F.col("magnitude")) - F.col("x")).alias("delta_x"))


def _system(name: str) -> Column:
    return F.concat(F.lit(f"{name}@"), F.col("year").cast("string"))


def impacts_by_year(eco: YearEconomies, shocks: DataFrame, methods: Iterable[str] = ("ghosh",), tol: float = 1e-16) -> DataFrame:
    """P1, P1b, P2 and P4 for every year and scenario in one loop:
    (year, method, scenario_id, region, sector, delta_x) over the labels of each year's
    scenarios. A shocked label without output in a year does not move in it."""
    validate_shocks(shocks, eco.labels)
    methods = list(methods)
    lv = levels_by_year(eco.X, shocks)
    dx = lv.select(*KEYS, *LABEL, F.col("delta_x").alias("value"))
    xm = lv.select(*KEYS, *LABEL, F.col("x").alias("value"))
    run = lambda df, method: df.select(_system(METHOD_SYSTEM[method]).alias("system"), F.lit(method).alias("kind"),
                                       F.col("scenario_id").alias("run_id"), F.lit("").alias("home_region"), F.lit("").alias("home_sector"), *LABEL, "value")
    product = lambda matrix, v, orientation: linalg.product(matrix, v, orientation, KEYS, by=["year"])
    seeds = masks = systems = None
    join = lambda a, b: b if a is None else a.unionByName(b)
    for method in methods:
        if method == "direct":
            continue
        if method == "ghosh":
            seed = product(eco.B, dx, "row")
        elif method == "leontief":
            lost = product(eco.A, xm, "column")
            seed = product(eco.A, dx, "row").unionByName(lost.withColumn("value", -F.col("value")))
        else:
            seed = product(eco.A, dx, "column")
        seeds, masks = join(seeds, run(seed, method)), join(masks, run(xm, method))
    for name in sorted({METHOD_SYSTEM[m] for m in methods if m != "direct"}):
        matrix, orientation = SYSTEM_SPECS[name]
        systems = join(systems, linalg.oriented(getattr(eco, matrix), orientation, _system(name)))
    solved = None if seeds is None else linalg.series_solve(systems, seeds, mask=masks, tol=tol, keys=RUN_KEYS)
    domain = lv.select(*KEYS).distinct().crossJoin(broadcast_if_small(eco.labels.select(*LABEL)))
    fixed = lv.select(*KEYS, *LABEL, F.col("delta_x").alias("fixed"))
    out = None
    for method in methods:
        rows = domain.join(fixed, [*KEYS, *LABEL], "left")
        if method == "direct":
            rows = rows.withColumn("free", F.lit(0.0))
        else:
            free = solved.where(F.col("kind") == method).select(
                F.split("system", "@")[1].cast("int").alias("year"), F.col("run_id").alias("scenario_id"), *LABEL, F.col("value").alias("free"))
            rows = rows.join(free, [*KEYS, *LABEL], "left")
        out = join(out, rows.select("year", F.lit(method).alias("method"), "scenario_id", *LABEL, F.coalesce("fixed", "free", F.lit(0.0)).alias("delta_x")))
    return out


def home_impact_by_year(X: DataFrame, dx: DataFrame, homes: DataFrame) -> DataFrame:
    """R1 for every year: before, change, after and % change of each home."""
    home = [F.col("region").alias("home_region"), F.col("sector").alias("home_sector")]
    on = ["home_region", "home_sector"]
    d = dx.select(*KEYS, *home, "delta_x")
    x = X.select("year", *home, F.col("value").alias("before"))
    return (homes.join(d, ["scenario_id", *on]).join(x, ["year", *on])
            .select(*KEYS, *on, "before", "delta_x", (F.col("before") + F.col("delta_x")).alias("after"),
                    pct(F.col("delta_x"), F.col("before")).alias("pct_change")))
