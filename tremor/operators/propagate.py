"""Propagation of shocks through the economy (P0-P5), many scenarios at once.

Every model is a seed plus the masked geometric series of :func:`linalg.series_solve`:

* Leontief mixed model (P1, parity with the reference): with M the shocked set,
  ``Δx_n = (I − A_nn)⁻¹ (A_mnᵀ Δx_m − A_nm x_m)``; the textbook variant (P1b) uses
  ``A_nm Δx_m``. Series on A in column orientation (join on consumer).
* Ghosh mixed model (P2): ``Δx_nᵀ = Δx_mᵀ G_mm⁻¹ G_mn = Δx_mᵀ B_mn (I − B_nn)⁻¹``,
  so no inverse is needed: seed ``Δx_mᵀ B_mn`` and run the series on B in row
  orientation (join on producer).
* Direct (P4): only shocked labels move.

Runs are keyed by ``(system, kind, run_id, home_region, home_sector)`` so that
impacts of many scenarios and methods, rows of L and columns of G can share one
loop (B6). Shocked labels of a run are masked out of its system.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import linalg
from .economy import Economy
from .scenario import scenario_domain, shock_levels, validate_shocks

LABEL = ["region", "sector"]
RUN_KEYS = ["system", "kind", "run_id", "home_region", "home_sector"]
METHODS = ("ghosh", "leontief", "textbook", "direct")

# Which matrix and product direction each system uses.
SYSTEM_SPECS = {
    "A_col": ("A", "column"),  # Leontief mixed model; columns of L (L·v)
    "A_row": ("A", "row"),     # rows of L (vᵀ·L)
    "B_row": ("B", "row"),     # Ghosh mixed model; rows of G
    "B_col": ("B", "column"),  # columns of G (G·v)
}
METHOD_SYSTEM = {"ghosh": "B_row", "leontief": "A_col", "textbook": "A_col"}


def systems_table(eco: Economy, names: Iterable[str] = SYSTEM_SPECS) -> DataFrame:
    out = None
    for name in names:
        mat, orientation = SYSTEM_SPECS[name]
        part = linalg.oriented(getattr(eco, mat), orientation, name)
        out = part if out is None else out.unionByName(part)
    return out


def _keyed(df: DataFrame, system, kind, run_id, home_region="", home_sector="") -> DataFrame:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(as_col(system).alias("system"), as_col(kind).alias("kind"), as_col(run_id).alias("run_id"),
                     as_col(home_region).alias("home_region"), as_col(home_sector).alias("home_sector"),
                     *LABEL, "value")


def impact_seeds(eco: Economy, shocks: DataFrame, methods: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Seeds and masks of the mixed models for every (method, scenario).

    Returns ``(seeds, masks)`` keyed by :data:`RUN_KEYS` with ``kind = method`` and
    ``run_id = scenario_id``."""
    lv = shock_levels(eco.X, shocks)
    dx = lv.select("scenario_id", *LABEL, F.col("delta_x").alias("value"))
    xm = lv.select("scenario_id", *LABEL, F.col("x").alias("value"))
    seeds, masks = [], []
    for method in methods:
        if method == "ghosh":
            s = linalg.vecmat(dx, eco.B, ["scenario_id"])
        elif method == "leontief":
            s = (linalg.vecmat(dx, eco.A, ["scenario_id"])
                 .unionByName(linalg.matvec(eco.A, xm, ["scenario_id"]).select("scenario_id", *LABEL, (-F.col("value")).alias("value"))))
        elif method == "textbook":
            s = linalg.matvec(eco.A, dx, ["scenario_id"])
        else:
            continue
        system = METHOD_SYSTEM[method]
        seeds.append(_keyed(s, system, method, F.col("scenario_id")))
        masks.append(_keyed(shocks.select("scenario_id", *LABEL, F.lit(0.0).alias("value")), system, method, F.col("scenario_id")))
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(seeds), union(masks)


def inverse_seeds(labels: DataFrame, system: str, kind: str) -> DataFrame:
    """Unit seeds ``e_h`` for every label ``h`` of ``labels``: with ``A_row`` the run
    of h is row h of L, with ``B_col`` column h of G, with ``B_row`` row h of G,
    with ``A_col`` column h of L."""
    unit = labels.select(*LABEL, F.lit(1.0).alias("value"))
    return _keyed(unit, system, kind, F.lit(""), F.col("region"), F.col("sector"))


def solve_runs(eco: Economy, seeds: DataFrame, masks: DataFrame | None,
               systems: Iterable[str] = SYSTEM_SPECS, tol: float = 1e-16) -> DataFrame:
    """One shared loop for all runs; result keyed by :data:`RUN_KEYS` + label."""
    used = list(systems)
    return linalg.series_solve(systems_table(eco, used), seeds, mask=masks, tol=tol, keys=RUN_KEYS)


def assemble_impacts(eco: Economy, shocks: DataFrame, solved: DataFrame,
                     methods: Iterable[str]) -> DataFrame:
    """Δx over every label of every scenario: the series result on free labels,
    ``x·(1−mag) − x`` on shocked ones, 0 where nothing arrives.
    ``(method, scenario_id, region, sector, delta_x)``."""
    lv = shock_levels(eco.X, shocks)
    dom = scenario_domain(shocks, eco.labels)
    out = None
    for method in methods:
        fixed = lv.select("scenario_id", *LABEL, F.col("delta_x").alias("fixed"))
        if method == "direct":
            free = None
        else:
            free = solved.where(F.col("kind") == method).select(F.col("run_id").alias("scenario_id"), *LABEL, F.col("value").alias("free"))
        d = dom.join(fixed, ["scenario_id", *LABEL], "left")
        if free is not None:
            d = d.join(free, ["scenario_id", *LABEL], "left")
            val = F.coalesce("fixed", "free", F.lit(0.0))
        else:
            val = F.coalesce("fixed", F.lit(0.0))
        part = d.select(F.lit(method).alias("method"), "scenario_id", *LABEL, val.alias("delta_x"))
        out = part if out is None else out.unionByName(part)
    return out


def impact(eco: Economy, shocks: DataFrame, method: str = "ghosh", tol: float = 1e-16) -> DataFrame:
    """P5: Δx of every scenario in ``shocks`` by ``method`` (``ghosh`` default,
    ``leontief`` parity, ``textbook``, ``direct``): ``(scenario_id, region, sector, delta_x)``."""
    return impacts(eco, shocks, [method], tol).drop("method")


def impacts(eco: Economy, shocks: DataFrame, methods: Iterable[str], tol: float = 1e-16) -> DataFrame:
    """Several methods for several scenarios in one loop (B6). Invalid shocks raise
    (:func:`scenario.validate_shocks`)."""
    validate_shocks(shocks, eco.labels)
    methods = list(methods)
    iterative = [m for m in methods if m != "direct"]
    solved = None
    if iterative:
        seeds, masks = impact_seeds(eco, shocks, iterative)
        solved = solve_runs(eco, seeds, masks, {METHOD_SYSTEM[m] for m in iterative}, tol)
    return assemble_impacts(eco, shocks, solved, methods)


# The largest shocked set whose system is solved as one dense block.
MAX_BLOCK = 1000


def stored_impacts(eco: Economy, shocks: DataFrame, methods: Iterable[str], L: DataFrame | None = None,
                   G: DataFrame | None = None, max_block: int = MAX_BLOCK, tol: float = 1e-16) -> DataFrame:
    """The mixed models from a stored inverse, without a loop: ``(method, scenario_id,
    region, sector, delta_x)``, as :func:`impacts` gives it.

    With M the shocked set and N the rest, ``(I − A_nn)⁻¹ = L_nn − L_nm L_mm⁻¹ L_mn``, so a
    scenario takes one dense solve of its |M|×|M| block and a product with rows or
    columns of the inverse: ``Δx_nᵀ = Δx_mᵀ G_mm⁻¹ G_mn`` (Ghosh), ``Δx_n = L_nm L_mm⁻¹
    Δx_m`` (textbook), and, with ``u = L·(A_mnᵀ Δx_m)`` for the parity model,
    ``Δx_n = u_n − L_nm L_mm⁻¹ (u_m + x_m)``. ``L`` serves the Leontief models, ``G`` Ghosh.

    Scenarios whose shocked set is larger than ``max_block`` (a block is one group of at
    most ``max_block²`` cells) go through the series."""
    validate_shocks(shocks, eco.labels)
    methods = list(methods)
    shocks = cut_lineage(shocks.select("scenario_id", *LABEL, "magnitude"))
    sizes = cut_lineage(shocks.groupBy("scenario_id").agg((F.count("*") <= max_block).alias("small")))
    few, many = (shocks.join(sizes.where(F.col("small") == small).select("scenario_id"), "scenario_id", "left_semi") for small in (True, False))
    out = None
    if not few.isEmpty():
        few = cut_lineage(few)
        solved = None
        for method in methods:
            if method != "direct":
                part = _from_inverse(eco, few, method, G if method == "ghosh" else L).withColumn("kind", F.lit(method))
                solved = part if solved is None else solved.unionByName(part)
        out = assemble_impacts(eco, few, solved, methods)
    if not many.isEmpty():
        rest = impacts(eco, cut_lineage(many), methods, tol)
        out = rest if out is None else out.unionByName(rest)
    return assemble_impacts(eco, shocks, None, ["direct"]).where(F.lit(False)) if out is None else out


def _from_inverse(eco: Economy, shocks: DataFrame, method: str, inverse: DataFrame | None) -> DataFrame:
    """Δx of the free labels, ``(run_id, region, sector, value)``."""
    if inverse is None:
        raise ValueError(f"the {method} model needs its stored inverse")
    key = ["scenario_id"]
    lv = shock_levels(eco.X, shocks)
    order = Window.partitionBy("scenario_id").orderBy(*LABEL)  # at most a block of labels
    members = cut_lineage(lv.select("scenario_id", *LABEL, "x", "delta_x", (F.row_number().over(order) - 1).alias("i")))
    dx = members.select(*key, *LABEL, F.col("delta_x").alias("value"))
    free = lambda v: v.join(members.select(*key, *LABEL), [*key, *LABEL], "left_anti")
    right, u = members.select(*key, "i", F.col("delta_x").alias("value")), None
    if method == "leontief":
        u = cut_lineage(linalg.matvec(inverse, free(linalg.vecmat(dx, eco.A, key)), key))
        right = (members.join(u.withColumnRenamed("value", "u"), [*key, *LABEL], "left")
                 .select(*key, "i", (F.coalesce("u", F.lit(0.0)) + F.col("x")).alias("value")))
    side = lambda prefix, name: members.select(*key, F.col("region").alias(f"{prefix}_region"), F.col("sector").alias(f"{prefix}_sector"),
                                               F.col("i").alias(name))
    block = (inverse.join(side("producer", "i"), ["producer_region", "producer_sector"])
             .join(side("consumer", "j"), [*key, "consumer_region", "consumer_sector"]).select(*key, "i", "j", "value"))
    rows = block.unionByName(right.select(*key, "i", F.lit(-1).alias("j"), "value"))
    transposed = method == "ghosh"

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell = rows["j"] >= 0
        n = int((~cell).sum())
        m, b = np.zeros((n, n)), np.zeros(n)
        m[rows["i"][cell], rows["j"][cell]] = rows["value"][cell]
        b[rows["i"][~cell]] = rows["value"][~cell]
        return pd.DataFrame({"scenario_id": key[0], "i": np.arange(n), "value": np.linalg.solve(m.T if transposed else m, b)})

    y = (rows.groupBy(*key).applyInPandas(solve, "scenario_id string, i int, value double")
         .join(members.select(*key, *LABEL, "i"), [*key, "i"]).select(*key, *LABEL, "value"))
    y = cut_lineage(y)
    moved = linalg.vecmat(y, inverse, key) if transposed else linalg.matvec(inverse, y, key)
    if u is not None:
        moved = (u.unionByName(moved.withColumn("value", -F.col("value"))).groupBy(*key, *LABEL).agg(F.sum("value").alias("value")))
    return free(moved).select(F.col("scenario_id").alias("run_id"), *LABEL, "value")


def leontief_impact(eco: Economy, shocks: DataFrame, variant: str = "parity", tol: float = 1e-16) -> DataFrame:
    """P1 / P1b."""
    return impact(eco, shocks, "leontief" if variant == "parity" else "textbook", tol)


def ghosh_impact(eco: Economy, shocks: DataFrame, tol: float = 1e-16) -> DataFrame:
    """P2."""
    return impact(eco, shocks, "ghosh", tol)


def direct_impact(eco: Economy, shocks: DataFrame) -> DataFrame:
    """Δx; pair with :func:`required_demand` for Δy."""
    return impact(eco, shocks, "direct")


def required_demand(A: DataFrame, dx: DataFrame, keys: Iterable[str] = ("scenario_id",)) -> DataFrame:
    """``Δy = (I − A)·Δx`` per scenario, without an identity matrix."""
    keys = list(keys)
    v = dx.select(*keys, *LABEL, F.col("delta_x").alias("value"))
    return linalg.residual(A, v, keys).withColumnRenamed("value", "delta_y")


def free_demand_change(eco: Economy, shocks: DataFrame, homes: DataFrame, variant: str = "parity") -> DataFrame:
    """P1 then P3 at homes that are not shocked, in closed form: ``(scenario_id,
    home_region, home_sector, delta_y)``, 0 where no cell joins a home to a shock.

    The mixed model solves ``(I − A_nn) Δx_n = b``, and at free labels ``Δy_n = Δx_n −
    A_nn Δx_n − A_nm Δx_m``; so ``Δy_n = b − A_nm Δx_m = A_mnᵀ Δx_m − A_nm (x_m + Δx_m)``
    (parity), or zero (textbook): rows and columns of A at the shocked labels, no loop.
    ``homes``: ``(scenario_id, home_region, home_sector)``; shocked ones have no row here,
    since their Δy does depend on the free labels (:func:`required_demand`)."""
    validate_shocks(shocks, eco.labels)
    key, home = ["scenario_id"], ["home_region", "home_sector"]
    lv = shock_levels(eco.X, shocks)
    shocked = lv.select(*key, F.col("region").alias("home_region"), F.col("sector").alias("home_sector"))
    asked = homes.select(*key, *home).distinct().join(shocked, [*key, *home], "left_anti").join(lv.select(*key).distinct(), key, "left_semi")
    if variant == "textbook":
        return asked.withColumn("delta_y", F.lit(0.0))
    lost = linalg.vecmat(lv.select(*key, *LABEL, F.col("delta_x").alias("value")), eco.A, key)
    unmet = linalg.matvec(eco.A, lv.select(*key, *LABEL, F.col("x_new").alias("value")), key)
    moved = (lost.unionByName(unmet.withColumn("value", -F.col("value")))
             .groupBy(*key, F.col("region").alias("home_region"), F.col("sector").alias("home_sector")).agg(F.sum("value").alias("delta_y")))
    return (asked.join(moved, [*key, *home], "left")
            .select(*key, *home, F.coalesce("delta_y", F.lit(0.0)).alias("delta_y")))
