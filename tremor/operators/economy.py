"""Building the economy: flows, coefficients, final demand, extensions, gross output,
production history, and the label filters used on them (M1-M6, M11, D6-D9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import linalg

LABEL = ["region", "sector"]
PRODUCER = ["producer_region", "producer_sector"]
CONSUMER = ["consumer_region", "consumer_sector"]


@dataclass
class Economy:
    """One year of a multi-regional economy in long form.

    ``labels`` (region, sector); ``Z``, ``A``, ``B`` matrices
    (producer_region, producer_sector, consumer_region, consumer_sector, value);
    ``X``, ``Y`` vectors (region, sector, value). Optional: ``history``
    (region, sector, year, value), extension flows ``F`` (indicator, region, sector,
    value) with ``units`` (indicator, unit), ``regions`` (region, name, iso3),
    ``groups`` (group_name, region) and final demand by category ``demand``
    (region, sector, category, value), and the flows of single years ``yearly``
    (year, cell, value as exact decimals).
    """

    labels: DataFrame
    Z: DataFrame
    X: DataFrame
    Y: DataFrame
    A: DataFrame
    B: DataFrame
    history: DataFrame | None = None
    F: DataFrame | None = None
    units: DataFrame | None = None
    regions: DataFrame | None = None
    groups: DataFrame | None = None
    demand: DataFrame | None = None
    yearly: DataFrame | None = None


def _vec_on(df: DataFrame, side: Sequence[str], name: str) -> DataFrame:
    return df.select(F.col("region").alias(side[0]), F.col("sector").alias(side[1]),
                     F.col("value").alias(name))


def flows_from_coefficients(A: DataFrame, X: DataFrame) -> DataFrame:
    """M1: ``Z_ij = A_ij · x_j`` (scale columns by output)."""
    return (A.join(_vec_on(X, CONSUMER, "x"), CONSUMER)
            .select(*PRODUCER, *CONSUMER, (F.col("value") * F.col("x")).alias("value")))


def coefficients(Z: DataFrame, X: DataFrame) -> DataFrame:
    """M2: ``A_ij = Z_ij / x_j``; cells with ``x_j = 0`` are dropped."""
    return (Z.join(_vec_on(X, CONSUMER, "x"), CONSUMER).where(F.col("x") != 0)
            .select(*PRODUCER, *CONSUMER, (F.col("value").cast("double") / F.col("x").cast("double")).alias("value")))


def allocation(Z: DataFrame, X: DataFrame) -> DataFrame:
    """M3: ``B_ij = Z_ij / x_i``; cells with ``x_i = 0`` are dropped."""
    return (Z.join(_vec_on(X, PRODUCER, "x"), PRODUCER).where(F.col("x") != 0)
            .select(*PRODUCER, *CONSUMER, (F.col("value").cast("double") / F.col("x").cast("double")).alias("value")))


def scale_columns(M: DataFrame, v: DataFrame) -> DataFrame:
    """``M_ij · v_j``."""
    return (M.join(_vec_on(v, CONSUMER, "s"), CONSUMER)
            .select(*PRODUCER, *CONSUMER, (F.col("value") * F.col("s")).alias("value")))


def scale_rows(M: DataFrame, v: DataFrame) -> DataFrame:
    """``v_i · M_ij``."""
    return (M.join(_vec_on(v, PRODUCER, "s"), PRODUCER)
            .select(*PRODUCER, *CONSUMER, (F.col("value") * F.col("s")).alias("value")))


def final_demand(Y_by_category: DataFrame) -> DataFrame:
    """M4: total final demand over categories ``(region, sector, category, value)``."""
    return Y_by_category.groupBy(*LABEL).agg(F.sum("value").alias("value"))


def unit_matches(unit_col: str = "unit", patterns: Sequence[str] = ("ha", "km2")):
    """Unit contains any of the patterns (substring), null counts as no match."""
    cond = F.lit(False)
    for p in patterns:
        cond = cond | F.coalesce(F.col(unit_col).contains(p), F.lit(False))
    return cond


def extension_total(F_flows: DataFrame, units: DataFrame, labels: DataFrame,
                    patterns: Sequence[str] = ("ha", "km2")) -> DataFrame:
    """M5: per label, the sum over indicators whose unit matches; 0 where none."""
    keep = units.where(unit_matches("unit", patterns)).select("indicator")
    sums = (F_flows.join(broadcast_if_small(keep), "indicator", "left_semi")
            .groupBy(*LABEL).agg(F.sum("value").alias("value")))
    return (labels.select(*LABEL).join(sums, LABEL, "left")
            .select(*LABEL, F.coalesce(F.col("value"), F.lit(0.0)).alias("value")))


def gross_output(A: DataFrame, Y: DataFrame, tol: float = 1e-16) -> DataFrame:
    """M6: ``x = L·y`` by the geometric series on A (column orientation)."""
    systems = linalg.oriented(A, "column", "A")
    seed = Y.select(F.lit("A").alias("system"), F.lit("x").alias("run_id"), *LABEL, "value")
    return linalg.series_solve(systems, seed, tol=tol).select(*LABEL, "value")


def production_history(x_by_year: DataFrame, wide: bool = False) -> DataFrame:
    """Mean output per (region, sector, year). Long by default; ``wide`` pivots
    years into columns (only for display; the pivot needs the year list)."""
    long = x_by_year.groupBy(*LABEL, "year").agg(F.avg("value").alias("value"))
    if not wide:
        return long
    return x_by_year.groupBy(*LABEL).pivot("year").agg(F.avg("value"))


def producers_in(flows: DataFrame, sectors: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose producer sector is listed."""
    if isinstance(sectors, DataFrame):
        return flows.join(broadcast_if_small(sectors.select(F.col("sector").alias("producer_sector")).distinct()),
                          "producer_sector", "left_semi")
    return flows.where(F.col("producer_sector").isin(list(sectors)))


def exclude_regions(flows: DataFrame, regions: DataFrame | Sequence[str]) -> DataFrame:
    """Drop rows and columns of the excluded regions, a list or a table ``(region)``."""
    if isinstance(regions, DataFrame):
        out = flows
        for side in ("producer_region", "consumer_region"):
            out = out.join(regions.select(F.col("region").alias(side)), side, "left_anti")
        return out.select(*flows.columns)
    regs = list(regions)
    return flows.where(~F.col("producer_region").isin(regs) & ~F.col("consumer_region").isin(regs))


def cross_border_only(flows: DataFrame) -> DataFrame:
    """Drop same-region cells."""
    return flows.where(F.col("producer_region") != F.col("consumer_region"))


def label_catalog(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct regions and sectors of an economy."""
    return (labels.select("region").distinct(), labels.select("sector").distinct())
