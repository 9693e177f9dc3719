"""Which sectors materially depend on which ecosystem service.

Ratings are wide (one column per service, values such as ``VH``/``H``), keyed by
four classification levels; the crosswalk maps a class to a model sector.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS4 = ["isic_section", "isic_division", "isic_group", "isic_class"]
KEYS3 = KEYS4[:3]
# Materiality rule (fixed values of the reference): a sector is material for a
# service when at least one rating is VH, or VH+H are more than half of its rows,
# or there are at least three VH+H ratings.
MIN_VH = 1
MIN_SHARE = 0.5
MIN_VH_H = 3


def service_columns(ratings: DataFrame, sector_col: str = "sector") -> list[str]:
    """Service columns are those whose name does not contain ``ISIC`` (any
    case) and that are not the sector column."""
    return [c for c in ratings.columns if "isic" not in c.lower() and c != sector_col]


def match_ratings(ratings: DataFrame, crosswalk: DataFrame, fallback: str = "all") -> tuple[DataFrame, DataFrame]:
    """Ratings ⟕ crosswalk on the four keys (null keys match null keys);
    if any row is left without a sector, join again on three keys (class ignored,
    many-to-many) — for ``fallback="all"`` (reference behaviour) every rating row,
    for ``"unmatched"`` only the unmatched ones — and append to the matched rows.
    Returns ``(joined, unjoined)``."""
    xw = crosswalk.select(*[F.col(k).alias(f"x_{k}") for k in KEYS4], "sector")
    r = ratings
    cond4 = reduce(lambda a, b: a & b, [r[k].eqNullSafe(xw[f"x_{k}"]) for k in KEYS4])
    first = r.join(xw, cond4, "left").drop(*[f"x_{k}" for k in KEYS4])
    matched = first.where(F.col("sector").isNotNull())
    unmatched = first.where(F.col("sector").isNull()).drop("sector")
    if unmatched.limit(1).count() == 0:
        merged = first
    else:
        base = r if fallback == "all" else unmatched
        xw3 = crosswalk.select(*[F.col(k).alias(f"x_{k}") for k in KEYS3], "sector")
        cond3 = reduce(lambda a, b: a & b, [base[k].eqNullSafe(xw3[f"x_{k}"]) for k in KEYS3])
        second = base.join(xw3, cond3, "left").drop(*[f"x_{k}" for k in KEYS3])
        merged = matched.unionByName(second)
    return merged.where(F.col("sector").isNotNull()), merged.where(F.col("sector").isNull())


def long_ratings(joined: DataFrame) -> DataFrame:
    """Wide service columns → ``(sector, service, rating)`` (one row per joined row
    and service, null ratings kept)."""
    services = service_columns(joined)
    return joined.unpivot(["sector"], services, "service", "rating")


def materiality_counts(joined: DataFrame) -> DataFrame:
    """B1: per (service, sector): VH count, H count, rows (null ratings included in
    the denominator) and the materiality flag."""
    counts = (long_ratings(joined).groupBy("service", "sector")
              .agg(F.count(F.when(F.col("rating") == "VH", 1)).alias("vh"),
                   F.count(F.when(F.col("rating") == "H", 1)).alias("h"),
                   F.count(F.lit(1)).alias("n")))
    vhh = F.col("vh") + F.col("h")
    return counts.withColumn(
        "material",
        (F.col("vh") >= MIN_VH) | ((F.col("n") > 0) & (vhh / F.col("n") > MIN_SHARE)) | (vhh >= MIN_VH_H))


def materiality(joined: DataFrame) -> DataFrame:
    """B1/S7 shape: ``(service, sectors array<string>)`` sorted; services without
    any material sector are omitted."""
    return (materiality_counts(joined).where("material")
            .groupBy("service").agg(F.sort_array(F.collect_set("sector")).alias("sectors")))


def material_sectors(joined: DataFrame) -> DataFrame:
    """Exploded form ``(service, sector)`` used for joins (K3)."""
    return materiality_counts(joined).where("material").select("service", "sector")
