"""Ratings and crosswalk derived from the driver's ``part`` table.

A class is (part type, brand number mod 5, brand, brand + size group); each of eight
services gets a rating from a fixed integer hash of the class, some ratings are
missing, and the crosswalk leaves some classes out so that the three-key fallback
and unmatched rows both occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture.
TYPE_ORDER = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
N_SERVICES = 8
HASH_TYPE, HASH_BRAND, HASH_GROUP, HASH_SERVICE, HASH_MOD = 311, 127, 53, 389, 1999
NULL_MOD, NULL_REST = 11, 10
H_PER_SERVICE = 10
M_BELOW, L_BELOW = 900, 1500
NEVER_MATCHED_BRAND = 24
FALLBACK_GROUP = 3


def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_type", "p_brand", "p_size")
    bn = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    grp = F.expr("cast((p_size - 1) div 10 as int)")
    tn = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("p_type")).cast("int") - 1
    return part.select(
        F.col("p_type").alias("isic_section"),
        F.concat(F.lit("D"), (bn % 5).cast("string")).alias("isic_division"),
        F.col("p_brand").alias("isic_group"),
        F.concat(F.col("p_brand"), F.lit("."), grp.cast("string")).alias("isic_class"),
        bn.alias("bn"), grp.alias("grp"), tn.alias("tn"),
    ).distinct()


def _rating(k: int):
    h = (F.col("tn") * HASH_TYPE + F.col("bn") * HASH_BRAND + F.col("grp") * HASH_GROUP + k * k * HASH_SERVICE) % HASH_MOD
    return (F.when(h % NULL_MOD == NULL_REST, F.lit(None).cast("string"))
            .when(h < k, "VH").when(h < H_PER_SERVICE * k, "H").when(h < M_BELOW, "M").when(h < L_BELOW, "L")
            .otherwise("VL"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide ratings: four keys and ``service_1 … service_8``."""
    c = class_rows(spark, sf_dir)
    return c.select("isic_section", "isic_division", "isic_group", "isic_class",
                    *[_rating(k).alias(f"service_{k}") for k in range(1, N_SERVICES + 1)])


def crosswalk(spark: SparkSession, sf_dir: str, sectors: DataFrame) -> DataFrame:
    """Class → sector with ``sid = bn mod 5``; leaves out group 3 of even brands and
    the never-matched brand. ``sectors``: ``(sector, sid)``."""
    c = class_rows(spark, sf_dir).where(
        ~((F.col("grp") == FALLBACK_GROUP) & (F.col("bn") % 2 == 0)) & (F.col("bn") != NEVER_MATCHED_BRAND))
    return (c.withColumn("sid", F.col("bn") % 5).join(F.broadcast(sectors), "sid")
            .select("isic_section", "isic_division", "isic_group", "isic_class", "sector"))
