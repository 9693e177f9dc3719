"""Batch analyses (B2-B6): quantile thresholds, high-flow pairs, the largest-impact
search over many scenarios, and the default scenario of an economy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from . import attribution, propagate
from .economy import Economy, cross_border_only, exclude_regions, flows_from_coefficients, producers_in

LABEL = ["region", "sector"]
# Flows at or below this count as zero in the search.
MIN_FLOW = 1e-9


# Entries of the quantile sketch: splitters err by at most the 10,000th part of the rows.
SKETCH = 10_000
# Distinct values between two splitters that one group may sort.
MOST_BETWEEN = 1_000_000


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (), sketch: int = SKETCH,
              most: int = MOST_BETWEEN) -> DataFrame:
    """B2: exact linearly interpolated quantiles, all of ``qs`` in all groups of ``by`` at
    once: ``(*by, q, value)``. Nulls do not count; a group without values has no row.

    Two scans: a sketch per group names two splitters around each wanted rank; then the
    values below the lower one are counted and those between them counted by value, and
    the wanted ranks are read off the running counts. Groups too large for that (more than
    ``most`` values between splitters) are narrowed by further sketches between the
    splitters first, one scan each. A sketch only saves work: should a rank lie outside its
    splitters, they are moved out to the ends of its group."""
    values = df.select(*by, F.col(col).cast("double").alias("v")).where("v is not null")
    keys = [*by, "q"]
    # Splitters for the ranks of q: the sketch's error on both sides, twice over.
    margin, wanted = 2.0 / sketch, sorted(set(map(float, qs)))
    probes = [min(max(q + d, 0.0), 1.0) for q in wanted for d in (-margin, margin)]
    ends = cut_lineage(values.groupBy(*by).agg(
        F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("largest"),
        F.percentile_approx("v", probes, sketch).alias("s")).where("n > 0"))
    at = F.col("q") * (F.col("n") - 1)
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col("s")[2 * i].alias("lo"), F.col("s")[2 * i + 1].alias("hi"))
                               for i, q in enumerate(wanted)]))
    targets = (ends.withColumn("t", each).select(*by, "n", "least", "largest", "t.*")
               .withColumn("low", F.floor(at)).withColumn("high", F.least(F.floor(at) + 1, F.col("n") - 1)).withColumn("part", at - F.floor(at)))
    # At the ends of the scale, and where two ranks could straddle a splitter, the group's own.
    targets = targets.withColumn("lo", F.when(F.col("q") <= margin, F.col("least")).otherwise(F.col("lo"))).withColumn(
        "hi", F.when(F.col("q") >= 1 - margin, F.col("largest")).otherwise(F.col("hi")))
    targets = _narrowed(values, cut_lineage(targets), by, sketch, most)
    done, missed = _read_off(values, targets, by)
    out = done
    if not missed.isEmpty():
        again, _ = _read_off(values, missed.withColumn("lo", F.col("least")).withColumn("hi", F.col("largest")), by)
        out = out.unionByName(again)
    return out.select(*keys, "value")


def _within(values: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each value next to the targets of its group."""
    small = broadcast_if_small(targets)
    return values.join(small, [*by]) if by else values.crossJoin(small)  # without groups: one row per quantile


def _narrowed(values: DataFrame, targets: DataFrame, by: Sequence[str], sketch: int, most: int) -> DataFrame:
    """Targets whose splitters have at most ``most`` values between them, by the sketches'
    error bound; a stretch of equal values is never too large."""
    keys, size = [*by, "q"], F.col("n") * (6.0 / sketch)
    targets = targets.withColumn("size", size)
    while not targets.where((F.col("size") > most) & (F.col("lo") < F.col("hi"))).isEmpty():
        large = targets.where((F.col("size") > most) & (F.col("lo") < F.col("hi")))
        inside = _within(values, large.select(*keys, "lo", "hi"), by).where(F.col("v") <= F.col("hi"))
        inner = F.when(F.col("v") >= F.col("lo"), F.col("v"))
        found = inside.groupBy(*keys).agg(F.count(F.when(inner.isNull(), 1)).alias("below"), F.count(inner).alias("m"),
                                          F.percentile_approx(inner, [i / 1000 for i in range(1001)], sketch).alias("s"))
        share = lambda rank: (rank - F.col("below")) / F.greatest(F.col("m"), F.lit(1)) * 1000
        step = 2000 / sketch + 1  # in thousandths: the error and the width of a step
        pick = lambda i: F.element_at("s", F.least(F.greatest(i, F.lit(0)), F.lit(1000)).cast("int") + 1)
        closer = (large.join(found, keys).where("m > 0")
                  .withColumn("lo2", pick(F.floor(share(F.col("low")) - step))).withColumn("hi2", pick(F.ceil(share(F.col("high")) + step)))
                  .select(*keys, F.greatest("lo", "lo2").alias("lo2"), F.least("hi", "hi2").alias("hi2"),
                          (F.col("m") * (2 * step + 2) / 1000).alias("size2")))
        targets = cut_lineage(targets.join(closer, keys, "left").select(
            *[c for c in targets.columns if c not in ("lo", "hi", "size")], F.coalesce("lo2", "lo").alias("lo"),
            F.coalesce("hi2", "hi").alias("hi"), F.when(F.col("size2") < F.col("size"), F.col("size2")).when(F.col("size") > most, F.lit(0.0))
            .otherwise(F.col("size")).alias("size")))
    return targets.drop("size")


def _read_off(values: DataFrame, targets: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(targets with their ``value``, targets whose ranks lie outside their splitters)."""
    keys = [*by, "q"]
    counted = (_within(values, targets.select(*keys, "lo", "hi"), by).where(F.col("v") <= F.col("hi"))
               .groupBy(*keys, F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("m")))
    upto = Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("m").over(upto)).join(broadcast_if_small(targets.select(*keys, "low", "high", "part")), keys)
    a = F.min(F.struct(F.col("upto"), F.col("v").alias("at"))).alias("hit")
    ends = []
    for name in ("low", "high"):
        ends.append(ranked.where(F.col("upto") > F.col(name)).groupBy(*keys).agg(a).select(*keys, F.col("hit.at").alias(name + "_v")))
    both = cut_lineage(targets.join(ends[0], keys, "left").join(ends[1], keys, "left").withColumn(
        "value", F.when(F.col("part") > 0, F.col("low_v") + (F.col("high_v") - F.col("low_v")) * F.col("part")).otherwise(F.col("low_v"))))
    hit = F.col("low_v").isNotNull() & F.col("high_v").isNotNull()
    return both.where(hit).select(*keys, "value"), both.where(~hit).select(*targets.columns)


def quantile_threshold(df: DataFrame, col: str, q: float) -> float | None:
    """B2: the exact linearly interpolated quantile as one scalar; None without values."""
    row = quantiles(df, col, [q]).first()
    return None if row is None else row["value"]


def above_quantile(df: DataFrame, col: str, q: float) -> DataFrame:
    """B2: rows strictly above the q-quantile of ``col``."""
    t = quantile_threshold(df, col, q)
    return df.where(F.lit(False)) if t is None else df.where(F.col(col) > F.lit(t))


def high_flow_pairs(eco: Economy, sectors: Sequence[str], q: float = 0.95) -> DataFrame:
    """Flows ``A_ij·x_j`` above 1e-9 from producers of the listed sectors, above
    their q-quantile, between different regions and different sectors."""
    z = producers_in(flows_from_coefficients(eco.A, eco.X), sectors).where(F.col("value") > MIN_FLOW)
    return (above_quantile(z, "value", q)
            .where((F.col("producer_region") != F.col("consumer_region"))
                   & (F.col("producer_sector") != F.col("consumer_sector"))))


def search_runs(pairs: DataFrame, magnitude: float) -> DataFrame:
    """B4 scenarios: one per distinct producer of the pairs, shocked by ``magnitude``."""
    prods = pairs.select(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector")).distinct()
    return prods.select(F.concat_ws("|", "region", "sector").alias("scenario_id"), *LABEL, F.lit(magnitude).alias("magnitude"))


def pair_impacts(eco: Economy, pairs: DataFrame, magnitude: float = 0.1, tol: float = 1e-16) -> DataFrame:
    """|Δy| at the consumer of every pair when its producer is shocked by
    ``magnitude`` (Leontief parity): ``(shock_region, shock_sector, home_region,
    home_sector, impact)``.

    A home that is not its own shock needs no loop, its Δy follows from two cells of A
    (:func:`propagate.free_demand_change`): the cost is a join of the pairs with A,
    whatever their number. Only producers that are their own home are propagated."""
    home = ["home_region", "home_sector"]
    asked = pairs.select(F.concat_ws("|", "producer_region", "producer_sector").alias("scenario_id"),
                         F.col("producer_region").alias("shock_region"), F.col("producer_sector").alias("shock_sector"),
                         F.col("consumer_region").alias("home_region"), F.col("consumer_sector").alias("home_sector")).distinct()
    dy = propagate.free_demand_change(eco, search_runs(pairs, magnitude), asked)
    own = pairs.where((F.col("producer_region") == F.col("consumer_region")) & (F.col("producer_sector") == F.col("consumer_sector")))
    if not own.isEmpty():
        dx = propagate.leontief_impact(eco, search_runs(own, magnitude), "parity", tol)
        at_home = propagate.required_demand(eco.A, dx).select("scenario_id", F.col("region").alias("home_region"), F.col("sector").alias("home_sector"), "delta_y")
        dy = dy.unionByName(at_home.where(F.concat_ws("|", *home) == F.col("scenario_id")))
    return asked.join(dy, ["scenario_id", *home]).select("shock_region", "shock_sector", *home, F.abs("delta_y").alias("impact"))


def max_impact_scenario(eco: Economy, pairs: DataFrame, magnitude: float = 0.1, tol: float = 1e-16) -> DataFrame:
    """The pair with the largest positive impact (:func:`pair_impacts`), ties to the
    smaller labels. No row if no pair has one."""
    scored = pair_impacts(eco, pairs, magnitude, tol).where(F.col("impact") > 0)
    # Distributed top-1 (per-partition best, then a merge).
    return scored.orderBy(F.col("impact").desc(), "shock_region", "shock_sector", "home_region", "home_sector").limit(1)


def large_producers(eco: Economy, sectors: Sequence[str], q: float = 0.9) -> DataFrame:
    """Producers of the listed sectors with output above their q-quantile."""
    return above_quantile(eco.X.where(F.col("sector").isin(list(sectors))), "value", q).select(*LABEL)


def default_scenario(eco: Economy, sectors: Sequence[str], excluded: DataFrame | Sequence[str],
                     q: float = 0.9, tries: int | None = None, L: DataFrame | None = None) -> DataFrame:
    """Among producers of the listed sectors with output above their q-quantile
    and labels with output above the overall q-quantile, regions excluded and
    same-region cells dropped, the largest positive ``L`` cell whose sectors differ.
    ``tries`` inspects only so many of the largest cells, as the reference does. Falls
    back to the first/second region and sector. The rows of L are those of the large
    producers, by a series seeded with them, unless ``L`` is at hand.
    ``(home_region, home_sector, shock_region, shock_sector, dependency)``."""
    big_prod = large_producers(eco, sectors, q).select(
        F.col("region").alias("producer_region"), F.col("sector").alias("producer_sector"))
    big_all = above_quantile(eco.X, "value", q).select(
        F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"))
    if L is None:
        homes = big_prod.select(F.col("producer_region").alias("home_region"), F.col("producer_sector").alias("home_sector"))
        L = attribution.influence(eco, homes, "leontief").select(
            F.col("home_region").alias("producer_region"), F.col("home_sector").alias("producer_sector"),
            F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), "value")
    cells = (L.join(big_prod, ["producer_region", "producer_sector"]).join(big_all, ["consumer_region", "consumer_sector"]))
    cells = cross_border_only(exclude_regions(cells, excluded)).where(F.col("value") > 0)
    order = [F.col("value").desc(), "producer_region", "producer_sector", "consumer_region", "consumer_sector"]
    if tries is not None:
        cells = cells.orderBy(*order).limit(tries)  # distributed top-k
    pick = (cells.where(F.col("producer_sector") != F.col("consumer_sector")).orderBy(*order).limit(1)
            .select(F.col("consumer_region").alias("home_region"), F.col("consumer_sector").alias("home_sector"),
                    F.col("producer_region").alias("shock_region"), F.col("producer_sector").alias("shock_sector"),
                    F.col("value").alias("dependency")))
    if pick.count() > 0:
        return pick
    # Fallback: home = first region and sector, shock = second ones (two scalars each).
    regs = [r[0] for r in eco.labels.select("region").distinct().orderBy("region").limit(2).collect()]
    secs = [r[0] for r in eco.labels.select("sector").distinct().orderBy("sector").limit(2).collect()]
    row = (regs[0], secs[0], regs[-1], secs[-1], 0.0)
    return pick.sparkSession.createDataFrame([row], pick.schema)


def scenario_summary(dx: DataFrame, keys: Sequence[str] = ("method", "scenario_id")) -> DataFrame:
    """Many scenarios side by side: total change, largest loss, labels moved."""
    return (dx.groupBy(*keys)
            .agg(F.sum("delta_x").alias("total_change"), F.min("delta_x").alias("largest_loss"),
                 F.count(F.when(F.abs("delta_x") > 0, 1)).alias("labels_moved")))
