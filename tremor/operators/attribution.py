"""Attribution of a change to its causes.

``influence`` tables say how much a unit change at a cause label moves a home
label: ``(home_region, home_sector, region, sector, value)``. Leontief uses
``L[home, cause]`` (row of L), Ghosh ``G[cause, home]`` (column of G), the
first-order fallback ``A[cause, home]``. Only the rows or columns of the homes are
needed, so a home-seeded series gives them without a full inverse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .economy import Economy
from . import propagate

LABEL = ["region", "sector"]
HOME = ["home_region", "home_sector"]
CAUSE = ["cause_region", "cause_sector"]
# The system whose home-seeded series gives the influences of a method.
INFLUENCE_SYSTEM = {"leontief": ("A_row", "L"), "ghosh": ("B_col", "G")}
# Home changes below this are "no significant change" (no causes reported).
MIN_IMPACT = 1e-10
# Remainder below this gets no "Others" bar.
MIN_OTHERS = 1e-6


def first_order_influence(A: DataFrame, homes: DataFrame) -> DataFrame:
    """``A[cause, home]`` for the given homes (columns of A)."""
    h = homes.select(*HOME).distinct()
    return (A.join(h, (A.consumer_region == h.home_region) & (A.consumer_sector == h.home_sector))
            .select(*HOME, F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"), "value"))


def influence(eco: Economy, homes: DataFrame, method: str, tol: float = 1e-16) -> DataFrame:
    """Influence of every label on each home: row of L (``leontief``), column of G
    (``ghosh``) by a home-seeded series, or column of A otherwise."""
    h = homes.select(F.col("home_region").alias("region"), F.col("home_sector").alias("sector")).distinct()
    if method not in INFLUENCE_SYSTEM:
        return first_order_influence(eco.A, homes)
    system, kind = INFLUENCE_SYSTEM[method]
    solved = propagate.solve_runs(eco, propagate.inverse_seeds(h, system, kind), None, [system], tol)
    return solved.select(*HOME, *LABEL, "value")


def portfolio_seeds(portfolios: DataFrame, method: str) -> DataFrame:
    """One seed per portfolio, ``Σ_assets w/100 · e_asset``, as runs of the loop."""
    system, kind = INFLUENCE_SYSTEM[method]
    weights = portfolios.groupBy("portfolio_id", *LABEL).agg((F.sum("weight") / 100.0).alias("value"))
    return propagate._keyed(weights, system, f"portfolio {kind}", F.col("portfolio_id"))


def portfolio_influence(eco: Economy, portfolios: DataFrame, method: str, tol: float = 1e-16) -> DataFrame:
    """Influence of every label on each portfolio, ``(portfolio_id, region, sector,
    value)``: the weighted sum of its assets' rows of L or columns of G. Both are
    linear in the home, so the weighted assets are one seed and a portfolio is one run,
    whatever the number of its assets (adjoint seeding)."""
    solved = propagate.solve_runs(eco, portfolio_seeds(portfolios, method), None, [INFLUENCE_SYSTEM[method][0]], tol)
    return solved.select(F.col("run_id").alias("portfolio_id"), *LABEL, "value")


def _share(contribution: Column, keys: list[str]) -> Column:
    total = F.sum(contribution).over(Window.partitionBy(*keys))
    return F.when(total > 0, contribution / total * 100.0).otherwise(F.lit(0.0))


def attribute(dx: DataFrame, shocks: DataFrame, homes: DataFrame, infl: DataFrame,
              drop_home: bool = True) -> DataFrame:
    """Contribution of each shock to each home.

    ``dx``: ``(scenario_id, region, sector, delta_x)``; ``homes``:
    ``(scenario_id, home_region, home_sector)``. Contribution = influence ×
    |Δx_shock|. A home whose |Δx| is below 1e-10 has no causes and total 0; one whose only
    shock is itself has no causes but keeps its total: both get one row with a null cause.
    The home itself is dropped from its causes; shares are normalised to 100 (0 when the total is not
    positive). ``(scenario_id, home…, cause…, contribution, share_pct, total_impact)``."""
    s_val = (shocks.select("scenario_id", *LABEL).distinct()
             .join(dx, ["scenario_id", *LABEL])
             .select("scenario_id", F.col("region").alias("cause_region"), F.col("sector").alias("cause_sector"),
                     F.abs("delta_x").alias("shock_value")))
    h_val = (homes.join(dx.select("scenario_id", F.col("region").alias("home_region"), F.col("sector").alias("home_sector"), "delta_x"),
                        ["scenario_id", *HOME])
             .select("scenario_id", *HOME, F.abs("delta_x").alias("total_impact")))
    inf = infl.select(*HOME, F.col("region").alias("cause_region"), F.col("sector").alias("cause_sector"), F.col("value").alias("infl"))
    pairs = h_val.where(F.col("total_impact") >= MIN_IMPACT).join(s_val, "scenario_id")  # with the shocks of its scenario
    if drop_home:
        pairs = pairs.where((F.col("cause_region") != F.col("home_region")) | (F.col("cause_sector") != F.col("home_sector")))
    c = (pairs.join(inf, [*HOME, *CAUSE], "left")
         .withColumn("contribution", F.coalesce("infl", F.lit(0.0)) * F.col("shock_value")))
    found = c.select("scenario_id", *HOME, *CAUSE, "contribution",
                     _share(F.col("contribution"), ["scenario_id", *HOME]).alias("share_pct"), "total_impact")
    none = (h_val.join(found.select("scenario_id", *HOME).distinct(), ["scenario_id", *HOME], "left_anti")
            .select("scenario_id", *HOME, F.lit(None).cast("string").alias("cause_region"), F.lit(None).cast("string").alias("cause_sector"),
                    F.lit(0.0).alias("contribution"), F.lit(0.0).alias("share_pct"),
                    F.when(F.col("total_impact") >= MIN_IMPACT, F.col("total_impact")).otherwise(0.0).alias("total_impact")))
    return found.unionByName(none)


def attribute_portfolio(dx: DataFrame, shocks: DataFrame, positions: DataFrame, infl: DataFrame | None) -> DataFrame:
    """T4: portfolio attribution. ``positions``: ``(scenario_id, portfolio_id, region,
    sector, weight)``. Total = Σ w/100·|Δx_asset|; cause contribution =
    Σ_assets w/100 · influence(asset, cause) · |Δx_cause|; the asset's own label is
    kept; ``infl = None`` (no Leontief/Ghosh method) gives no causes. ``infl`` is per
    portfolio (:func:`portfolio_influence`), or per home label (:func:`influence`)."""
    pos = positions.select("scenario_id", "portfolio_id", F.col("region").alias("home_region"),
                           F.col("sector").alias("home_sector"), (F.col("weight") / 100.0).alias("w"))
    totals = (pos.join(dx.select("scenario_id", F.col("region").alias("home_region"), F.col("sector").alias("home_sector"), "delta_x"),
                       ["scenario_id", *HOME])
              .groupBy("scenario_id", "portfolio_id").agg(F.sum(F.abs("delta_x") * F.col("w")).alias("total_impact"))
              .where(F.col("total_impact") >= MIN_IMPACT))
    if infl is None:
        return totals.select("scenario_id", "portfolio_id", F.lit(None).cast("string").alias("cause_region"),
                             F.lit(None).cast("string").alias("cause_sector"), F.lit(0.0).alias("contribution"),
                             F.lit(0.0).alias("share_pct"), "total_impact").where(F.lit(False))
    s_val = (shocks.select("scenario_id", *LABEL).distinct().join(dx, ["scenario_id", *LABEL])
             .select("scenario_id", F.col("region").alias("cause_region"), F.col("sector").alias("cause_sector"),
                     F.abs("delta_x").alias("shock_value")))
    cause = [F.col("region").alias("cause_region"), F.col("sector").alias("cause_sector"), F.col("value").alias("infl")]
    if "portfolio_id" in infl.columns:
        contrib = (totals.select("scenario_id", "portfolio_id").join(s_val, "scenario_id")
                   .join(infl.select("portfolio_id", *cause), ["portfolio_id", *CAUSE], "left")
                   .select("scenario_id", "portfolio_id", *CAUSE, (F.coalesce("infl", F.lit(0.0)) * F.col("shock_value")).alias("contribution")))
    else:
        inf = infl.select(*HOME, *cause)
        contrib = (pos.join(s_val, "scenario_id")  # each asset with the shocks of its scenario
                   .join(inf, [*HOME, *CAUSE], "left")
                   .groupBy("scenario_id", "portfolio_id", *CAUSE)
                   .agg(F.sum(F.col("w") * F.coalesce("infl", F.lit(0.0)) * F.col("shock_value")).alias("contribution")))
    return (contrib.join(totals, ["scenario_id", "portfolio_id"])
            .select("scenario_id", "portfolio_id", *CAUSE, "contribution",
                    _share(F.col("contribution"), ["scenario_id", "portfolio_id"]).alias("share_pct"), "total_impact"))


def rollup_causes(causes: DataFrame, level: str, regions: DataFrame, keys: list[str]) -> DataFrame:
    """T5: shares regrouped by ``country`` (display name, falling back to the code),
    by ``sector``, or not at all (``none``: "name - sector"). ``(keys…, item, value)``."""
    named = causes.join(broadcast_if_small(regions.select(F.col("region").alias("cause_region"), "name")), "cause_region", "left")
    nm = F.coalesce(F.col("name"), F.col("cause_region"))
    if level == "country":
        item = nm
    elif level == "sector":
        item = F.col("cause_sector")
    else:
        item = F.concat_ws(" - ", nm, F.col("cause_sector"))
    return named.where(F.col("cause_region").isNotNull()).groupBy(*keys, item.alias("item")).agg(F.sum("share_pct").alias("value"))


def top_contributors(rolled: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k largest items, an ``Others`` row when the remainder exceeds 1e-6,
    and a ``Total`` row summing what is shown; ``top_share`` is the share of the top
    k. Ties go to the smaller item name. ``(keys…, position, item, value, top_share)``."""
    w = Window.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("item"))
    ranked = rolled.withColumn("rn", F.row_number().over(w))
    top = ranked.where(F.col("rn") <= k).select(*keys, F.col("rn").alias("position"), "item", "value")
    rest = (ranked.where(F.col("rn") > k).groupBy(*keys).agg(F.sum("value").alias("value"))
            .where(F.col("value") > MIN_OTHERS)
            .select(*keys, F.lit(k + 1).alias("position"), F.lit("Others").alias("item"), "value"))
    shown = top.unionByName(rest)
    top_share = top.groupBy(*keys).agg(F.sum("value").alias("top_share"))
    total = shown.groupBy(*keys).agg(F.sum("value").alias("value")).select(
        *keys, F.lit(k + 2).alias("position"), F.lit("Total").alias("item"), "value")
    return shown.unionByName(total).join(top_share, keys, "left")


def country_contributions(causes: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Share per cause region, with ISO3 and name; regions without ISO3 drop out."""
    sums = causes.groupBy(*keys, "cause_region").agg(F.sum("share_pct").alias("share_pct"))
    reg = regions.where(F.col("iso3").isNotNull()).select(F.col("region").alias("cause_region"), "iso3",
                                                            F.coalesce("name", "region").alias("name"))
    return sums.join(broadcast_if_small(reg), "cause_region")


def signed_contributions(contrib: DataFrame, keys: list[str], item_cols: list[str],
                         value_col: str = "contribution") -> DataFrame:
    """Non-zero contributions negated (losses shown as positive bars), plus a
    ``Total`` row. ``(keys…, item…, value, is_total)``."""
    rows = contrib.where(F.col(value_col) != 0).select(*keys, *item_cols, (-F.col(value_col)).alias("value"))
    total = rows.groupBy(*keys).agg(F.sum("value").alias("value"))
    for c in item_cols:
        total = total.withColumn(c, F.lit("Total Impact") if c == item_cols[0] else F.lit(None).cast("string"))
    return (rows.withColumn("is_total", F.lit(False))
            .unionByName(total.select(*keys, *item_cols, "value").withColumn("is_total", F.lit(True))))
