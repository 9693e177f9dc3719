"""Impact reports (R1-R13): the data behind every chart and table of the reference.

Inputs are keyed by ``scenario_id`` (and ``portfolio_id``); ``dx`` is
``(scenario_id, region, sector, delta_x)`` over all labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small

LABEL = ["region", "sector"]
HOME = ["home_region", "home_sector"]
# Outputs at or below this are treated as zero in percentage changes.
MIN_BASE = 1e-9
# Edges of an impact path carry more than this.
MIN_FLOW = 1e-6
PORTFOLIO_NODE = "Total Portfolio"


def pct(delta: Column, base: Column) -> Column:
    return F.when(base > MIN_BASE, delta / base * 100.0).otherwise(F.lit(0.0))


def _x(X: DataFrame, side: list[str] = LABEL, name: str = "x") -> DataFrame:
    return X.select(F.col("region").alias(side[0]), F.col("sector").alias(side[1]), F.col("value").alias(name))


def home_impact(X: DataFrame, dx: DataFrame, homes: DataFrame) -> DataFrame:
    """Before, change, after and % change of each home."""
    d = dx.select("scenario_id", F.col("region").alias("home_region"), F.col("sector").alias("home_sector"), "delta_x")
    return (homes.join(_x(X, HOME, "before"), HOME).join(d, ["scenario_id", *HOME])
            .select("scenario_id", *HOME, "before", "delta_x", (F.col("before") + F.col("delta_x")).alias("after"),
                    pct(F.col("delta_x"), F.col("before")).alias("pct_change")))


def portfolio_breakdown(X: DataFrame, dx: DataFrame, positions: DataFrame, regions: DataFrame) -> DataFrame:
    """Per asset: display region (D1), sector, weight, absolute and relative change."""
    names = regions.select("region", "name")
    return (positions.join(_x(X), LABEL).join(dx, ["scenario_id", *LABEL])
            .join(broadcast_if_small(names), "region", "left")
            .select("scenario_id", "portfolio_id", "region", F.coalesce("name", "region").alias("region_name"), "sector",
                    "weight", F.col("delta_x").alias("abs_change"), pct(F.col("delta_x"), F.col("x")).alias("rel_change")))


def portfolio_impact(X: DataFrame, dx: DataFrame, positions: DataFrame) -> DataFrame:
    """Weighted before, change, after, % change of each portfolio."""
    w = F.col("weight") / 100.0
    agg = (positions.join(_x(X), LABEL).join(dx, ["scenario_id", *LABEL])
           .groupBy("scenario_id", "portfolio_id")
           .agg(F.sum(F.col("x") * w).alias("before"), F.sum(F.col("delta_x") * w).alias("delta"),
                F.sum((F.col("x") + F.col("delta_x")) * w).alias("after")))
    return agg.select("scenario_id", "portfolio_id", "before", "delta", "after",
                      pct(F.col("delta"), F.col("before")).alias("pct_change"),
                      (F.col("after") - F.col("before")).alias("total_abs_change"),
                      pct(F.col("after") - F.col("before"), F.col("before")).alias("total_rel_change"))


def top_impacts(dx: DataFrame, X: DataFrame, shocks: DataFrame, regions: DataFrame,
                n: int = 100, rank_by: str = "percentage") -> DataFrame:
    """The n labels with the largest absolute % change (or absolute money
    change), shocked labels excluded; x = 0 gives 0 %. Country is the display name
    and null for unknown codes (D2). Ties go to the smaller (region, sector)."""
    base = (dx.join(shocks.select("scenario_id", *LABEL), ["scenario_id", *LABEL], "left_anti")
            .join(_x(X), LABEL)
            .withColumn("pct_change", F.when(F.col("x") != 0, F.col("delta_x") / F.col("x") * 100.0).otherwise(F.lit(0.0))))
    key = F.abs("pct_change") if rank_by == "percentage" else F.abs("delta_x")
    w = Window.partitionBy("scenario_id").orderBy(key.desc(), "region", "sector")
    top = base.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    names = regions.select("region", F.col("name").alias("country"))
    return (top.join(broadcast_if_small(names), "region", "left")
            .select("scenario_id", "rank", "region", "country", "sector", F.col("delta_x").alias("change"), "pct_change"))


def shock_history(history: DataFrame, X: DataFrame, shocks: DataFrame, strict: bool = False) -> DataFrame:
    """Yearly output summed over the shocked labels that have history (a year
    with none sums to 0), with the pre- and post-shock totals. ``strict``: a
    scenario with any shocked label lacking history yields no rows."""
    s = shocks.select("scenario_id", *LABEL, "magnitude")
    years = history.select("year").distinct()
    levels = (s.join(_x(X), LABEL).groupBy("scenario_id")
              .agg(F.sum("x").alias("base_output"), F.sum(F.col("x") * (1 - F.col("magnitude"))).alias("post_shock_output")))
    hist = (s.join(history.select(*LABEL, "year", F.col("value").alias("h")), LABEL)
            .groupBy("scenario_id", "year").agg(F.sum("h").alias("h")))
    grid = levels.crossJoin(broadcast_if_small(years))  # every scenario over the history's years
    out = (grid.join(hist, ["scenario_id", "year"], "left")
           .select("scenario_id", "year", F.coalesce("h", F.lit(0.0)).alias("history_output"), "base_output", "post_shock_output"))
    if strict:
        has = history.select(*LABEL).distinct()
        bad = s.join(has, LABEL, "left_anti").select("scenario_id").distinct()
        out = out.join(bad, "scenario_id", "left_anti")
    return out


def lost_input_flows(A: DataFrame, dx: DataFrame) -> DataFrame:
    """``|A_ij · Δx_j|`` per scenario (zero cells left out)."""
    d = dx.select("scenario_id", F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), "delta_x")
    return (A.join(d, ["consumer_region", "consumer_sector"])
            .select("scenario_id", "producer_region", "producer_sector", "consumer_region", "consumer_sector",
                    F.abs(F.col("value") * F.col("delta_x")).alias("flow"))
            .where(F.col("flow") > 0))


def _ranked(df: DataFrame, keys: list[str], value: str, n: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc(), "region", "sector")
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def _padded(groups: DataFrame, labels: DataFrame, sparse: DataFrame, keys: list[str], value: str, n: int, rank: str) -> DataFrame:
    """The ``n`` largest labels of every group by ``value``, labels without one counting
    as zero, ties to the smaller label. A zero can only rank if it is among the first
    ``n`` labels, so no group is crossed with all labels."""
    first = labels.select(*LABEL).orderBy(*LABEL).limit(n)
    pad = groups.select(*keys).distinct().join(F.broadcast(first)).withColumn(value, F.lit(0.0))  # n rows a group
    both = sparse.select(*keys, *LABEL, value).unionByName(pad.select(*keys, *LABEL, value))
    return _ranked(both.groupBy(*keys, *LABEL).agg(F.max(value).alias(value)), keys, value, n, rank)


def _as(df: DataFrame, side: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col("region").alias(f"{side}_region"), F.col("sector").alias(f"{side}_sector"))


def _lost(A: DataFrame, dx: DataFrame, keys: list[str], src: DataFrame | None = None, dst: DataFrame | None = None) -> DataFrame:
    """``|A_ij · Δx_j|`` from the labels of ``src`` to those of ``dst`` (both keyed by
    ``keys``, which hold ``scenario_id``; None: all labels). A is filtered to the labels
    asked for before any scenario is joined to it."""
    P, C = ["producer_region", "producer_sector"], ["consumer_region", "consumer_sector"]
    cells = A
    if src is not None:
        cells = cells.join(_as(src, "producer", []).distinct(), P, "left_semi")
    if dst is not None:
        cells = cells.join(_as(dst, "consumer", []).distinct(), C, "left_semi")
    if src is not None and dst is not None:
        pairs = _as(src, "producer", keys).join(_as(dst, "consumer", keys), keys)
        flows = cells.join(pairs, [*P, *C])
    elif src is not None:
        flows = cells.join(_as(src, "producer", keys), P)
    else:
        flows = cells.join(_as(dst, "consumer", keys), C)
    d = dx.select("scenario_id", F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), "delta_x")
    return (flows.join(d, ["scenario_id", *C])
            .select(*keys, *P, *C, F.abs(F.col("value") * F.col("delta_x")).alias("flow")).where(F.col("flow") > 0))


def _customers_of_shocks(A: DataFrame, dx: DataFrame, shocks: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    sums = (_lost(A, dx, ["scenario_id"], src=shocks)
            .groupBy("scenario_id", F.col("consumer_region").alias("region"), F.col("consumer_sector").alias("sector"))
            .agg(F.sum("flow").alias("c_flow")))
    return _padded(shocks, labels, sums, ["scenario_id"], "c_flow", n, "c_rank")


def key_intermediaries(A: DataFrame, dx: DataFrame, shocks: DataFrame, homes: DataFrame,
                       labels: DataFrame, k: int = 5) -> DataFrame:
    """R10 (nodes), for any number of homes per scenario: labels among both the 3k
    largest suppliers to the home and the 3k largest customers of the shocks, in
    supplier order, shocks and home removed, first k. Ties and zeros go to the smaller
    label. ``(scenario_id, home…, position, region, sector)``."""
    keys = ["scenario_id", *HOME]
    homes = homes.select(*keys).distinct()
    at_home = homes.select(*keys, F.col("home_region").alias("region"), F.col("home_sector").alias("sector"))
    to_home = _lost(A, dx, keys, dst=at_home).select(
        *keys, F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"), F.col("flow").alias("s_flow"))
    sup = _padded(homes, labels, to_home, keys, "s_flow", 3 * k, "s_rank")
    cus = _customers_of_shocks(A, dx, shocks, labels, 3 * k)
    both = (sup.join(cus.select("scenario_id", *LABEL), ["scenario_id", *LABEL])
            .join(shocks.select("scenario_id", *LABEL), ["scenario_id", *LABEL], "left_anti")
            .where((F.col("region") != F.col("home_region")) | (F.col("sector") != F.col("home_sector"))))
    w = Window.partitionBy(*keys).orderBy("s_rank")
    return (both.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
            .select(*keys, "position", *LABEL))


def impact_paths(A: DataFrame, dx: DataFrame, shocks: DataFrame, homes: DataFrame,
                 labels: DataFrame, k: int = 5, mids: DataFrame | None = None) -> DataFrame:
    """R10 (edges): per scenario and home, shock → intermediary, intermediary → home and
    shock → home, with lost flow above 1e-6. ``(scenario_id, home…, source…, target…,
    flow, edge)``. ``mids`` may pass precomputed :func:`key_intermediaries`."""
    keys = ["scenario_id", *HOME]
    if mids is None:
        mids = key_intermediaries(A, dx, shocks, homes, labels, k)
    homes = homes.select(*keys).distinct()
    mids = mids.select(*keys, *LABEL)
    at_home = homes.select(*keys, F.col("home_region").alias("region"), F.col("home_sector").alias("sector"))
    hit = shocks.select("scenario_id", *LABEL).join(homes, "scenario_id")  # the shocks of each home's scenario
    cols = [*keys, F.col("producer_region").alias("source_region"), F.col("producer_sector").alias("source_sector"),
            F.col("consumer_region").alias("target_region"), F.col("consumer_sector").alias("target_sector"), "flow"]
    edges = [("shock_to_intermediate", hit, mids), ("intermediate_to_home", mids, at_home), ("shock_to_home", hit, at_home)]
    out = [_lost(A, dx, keys, src, dst).select(*cols, F.lit(name).alias("edge")) for name, src, dst in edges]
    return out[0].unionByName(out[1]).unionByName(out[2]).where(F.col("flow") > MIN_FLOW)


def portfolio_paths(A: DataFrame, dx: DataFrame, shocks: DataFrame, positions: DataFrame,
                    labels: DataFrame, k: int = 5) -> DataFrame:
    """As R10 for a portfolio: suppliers weighted by weight/100, intermediaries
    kept in the order of the customers-of-shocks ranking, assets and shocks removed,
    one target node ``Total Portfolio``. ``(scenario_id, portfolio_id, source…,
    target_region, target_sector, flow, edge)``; the portfolio node has target
    region ``Total Portfolio`` and a null sector."""
    keys = ["scenario_id", "portfolio_id"]
    assets = positions.select(*keys, *LABEL)
    pos = positions.select(*keys, F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"),
                           (F.col("weight") / 100.0).alias("w"))
    weigh = lambda flows: (flows.join(pos, [*keys, "consumer_region", "consumer_sector"])
                           .groupBy(*keys, F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"))
                           .agg(F.sum(F.col("flow") * F.col("w")).alias("p_flow")))
    weighted = weigh(_lost(A, dx, keys, dst=assets))
    sup = _padded(positions, labels, weighted, keys, "p_flow", 3 * k, "p_rank")
    cus = _customers_of_shocks(A, dx, shocks, labels, 3 * k)
    mids = (cus.join(sup.select(*keys, *LABEL), ["scenario_id", *LABEL])
            .join(shocks.select("scenario_id", *LABEL), ["scenario_id", *LABEL], "left_anti")
            .join(assets, [*keys, *LABEL], "left_anti"))
    w = Window.partitionBy(*keys).orderBy("c_rank")
    mids = mids.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    hit = shocks.select("scenario_id", *LABEL).join(positions.select(*keys).distinct(), "scenario_id")
    source = [F.col("region").alias("source_region"), F.col("sector").alias("source_sector")]
    node = [F.lit(PORTFOLIO_NODE).alias("target_region"), F.lit(None).cast("string").alias("target_sector")]
    s_m = _lost(A, dx, keys, hit, mids).select(
        *keys, F.col("producer_region").alias("source_region"), F.col("producer_sector").alias("source_sector"),
        F.col("consumer_region").alias("target_region"), F.col("consumer_sector").alias("target_sector"),
        "flow", F.lit("shock_to_intermediate").alias("edge"))
    m_p = (mids.select(*keys, *LABEL).join(weighted, [*keys, *LABEL])
           .select(*keys, *source, *node, F.col("p_flow").alias("flow"), F.lit("intermediate_to_portfolio").alias("edge")))
    s_p = weigh(_lost(A, dx, keys, hit, assets)).select(
        *keys, *source, *node, F.col("p_flow").alias("flow"), F.lit("shock_to_portfolio").alias("edge"))
    return s_m.unionByName(m_p).unionByName(s_p).where(F.col("flow") > MIN_FLOW)


def path_nodes(shocks: DataFrame, intermediaries: DataFrame, homes: DataFrame, regions: DataFrame) -> DataFrame:
    """The nodes of a single-home path diagram with their role (``shock``,
    ``home``, ``intermediate`` — a shock that is also the home stays ``shock``) and
    display name "name - sector" (D1)."""
    s = shocks.select("scenario_id", *LABEL, F.lit(0).alias("prio"))
    h = homes.select("scenario_id", F.col("home_region").alias("region"), F.col("home_sector").alias("sector"), F.lit(1).alias("prio"))
    m = intermediaries.select("scenario_id", *LABEL, F.lit(2).alias("prio"))
    nodes = (s.unionByName(h).unionByName(m).groupBy("scenario_id", *LABEL).agg(F.min("prio").alias("prio")))
    names = regions.select("region", "name")
    return (nodes.join(broadcast_if_small(names), "region", "left")
            .select("scenario_id", *LABEL,
                    F.when(F.col("prio") == 0, "shock").when(F.col("prio") == 1, "home").otherwise("intermediate").alias("role"),
                    F.concat_ws(" - ", F.coalesce("name", "region"), "sector").alias("display_name")))


def headline(specs: DataFrame, shocks: DataFrame, change: DataFrame, regions: DataFrame,
             groups: DataFrame) -> DataFrame:
    """Number of shocks, the region label of the title (``All Regions``, the
    group name, or the country's display name) and the % change shown.
    ``specs``: ``(scenario_id, region_spec)``; ``change``: ``(scenario_id, pct_change)``."""
    n = shocks.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n_shocks"))
    gnames = groups.select(F.col("group_name").alias("g")).distinct()
    names = regions.select(F.col("region").alias("r"), "name")
    lab = (specs.join(broadcast_if_small(gnames), F.col("region_spec") == F.col("g"), "left")
           .join(broadcast_if_small(names), F.col("region_spec") == F.col("r"), "left")
           .select("scenario_id",
                   F.when(F.col("region_spec") == "All", "All Regions")
                   .when(F.col("g").isNotNull(), F.col("g"))
                   .otherwise(F.coalesce("name", "region_spec")).alias("region_label")))
    return lab.join(n, "scenario_id").join(change, "scenario_id")
