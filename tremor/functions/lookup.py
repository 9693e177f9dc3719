"""Region lookups and label formatting.

Region dimensions are small tables ``(region, name, iso3)`` and
``(group_name, region)``; they join by broadcast after a check of their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small

# Region codes, display names and ISO3 codes of the reference's real
# economy (44 countries and 5 rest-of-world regions; the latter have no ISO3).
REGION_NAMES = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "CY": "Cyprus", "CZ": "Czechia",
    "DE": "Germany", "DK": "Denmark", "EE": "Estonia", "ES": "Spain", "FI": "Finland",
    "FR": "France", "GR": "Greece", "HR": "Croatia", "HU": "Hungary", "IE": "Ireland",
    "IT": "Italy", "LT": "Lithuania", "LU": "Luxembourg", "LV": "Latvia", "MT": "Malta",
    "NL": "Netherlands", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SE": "Sweden",
    "SI": "Slovenia", "SK": "Slovakia", "GB": "United Kingdom", "US": "United States",
    "JP": "Japan", "CN": "China", "CA": "Canada", "KR": "South Korea", "BR": "Brazil",
    "IN": "India", "MX": "Mexico", "RU": "Russia", "AU": "Australia", "CH": "Switzerland",
    "TR": "Turkey", "TW": "Taiwan", "NO": "Norway", "ID": "Indonesia", "ZA": "South Africa",
    "WA": "Rest of Asia and Pacific", "WL": "Rest of America", "WE": "Rest of Europe",
    "WF": "Rest of Africa", "WM": "Rest of Middle East",
}
ISO3 = {
    "AT": "AUT", "BE": "BEL", "BG": "BGR", "CY": "CYP", "CZ": "CZE", "DE": "DEU",
    "DK": "DNK", "EE": "EST", "ES": "ESP", "FI": "FIN", "FR": "FRA", "GR": "GRC",
    "HR": "HRV", "HU": "HUN", "IE": "IRL", "IT": "ITA", "LT": "LTU", "LU": "LUX",
    "LV": "LVA", "MT": "MLT", "NL": "NLD", "PL": "POL", "PT": "PRT", "RO": "ROU",
    "SE": "SWE", "SI": "SVN", "SK": "SVK", "GB": "GBR", "US": "USA", "JP": "JPN",
    "CN": "CHN", "CA": "CAN", "KR": "KOR", "BR": "BRA", "IN": "IND", "MX": "MEX",
    "RU": "RUS", "AU": "AUS", "CH": "CHE", "TR": "TUR", "TW": "TWN", "NO": "NOR",
    "ID": "IDN", "ZA": "ZAF",
}
REGION_GROUPS = {
    "EU27": ["AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU",
             "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK"],
    "OECD": ["AU", "AT", "BE", "CA", "CH", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HU",
             "IE", "IT", "JP", "KR", "LT", "LU", "LV", "MX", "NL", "NO", "PL", "PT", "SE", "SI",
             "SK", "TR", "GB", "US"],
    "Africa": ["ZA", "WF"],
    "Americas": ["US", "CA", "BR", "MX", "WL"],
    "Asia-Pacific": ["JP", "CN", "KR", "IN", "AU", "TW", "ID", "WA"],
    "Europe (Non-EU27)": ["GB", "CH", "NO", "RU", "WE"],
    "Middle East": ["WM"],
}
LABEL_MAX = 60
ELLIPSIS = "..."


def reference_regions(spark: SparkSession) -> DataFrame:
    """The real economy's region table ``(region, name, iso3)``."""
    rows = [(code, name, ISO3.get(code)) for code, name in REGION_NAMES.items()]
    return spark.createDataFrame(rows, "region string, name string, iso3 string")


def reference_groups(spark: SparkSession) -> DataFrame:
    rows = [(g, code) for g, members in REGION_GROUPS.items() for code in members]
    return spark.createDataFrame(rows, "group_name string, region string")


def with_region_name(df: DataFrame, col: str, regions: DataFrame, strict: bool = False,
                     out: str = "region_name") -> DataFrame:
    """Display name of ``col``, falling back to the code; D2 (``strict``): null
    when the code is unknown."""
    names = regions.select(F.col("region").alias("__code"), F.col("name").alias("__name"))
    joined = df.join(broadcast_if_small(names), df[col] == F.col("__code"), "left")
    value = F.col("__name") if strict else F.coalesce(F.col("__name"), df[col])
    return joined.withColumn(out, value).drop("__code", "__name")


def with_iso3(df: DataFrame, col: str, regions: DataFrame, out: str = "iso3") -> DataFrame:
    """D3: ISO3 of ``col``; rows of regions without one are dropped (inner join)."""
    codes = regions.where(F.col("iso3").isNotNull()).select(F.col("region").alias("__code"), F.col("iso3").alias(out))
    return df.join(broadcast_if_small(codes), df[col] == F.col("__code")).drop("__code")


def truncate_label(c: Column | str, n: int = LABEL_MAX) -> Column:
    """Labels longer than n become their first n−3 characters and ``...``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(ELLIPSIS)), F.lit(ELLIPSIS))).otherwise(c)
