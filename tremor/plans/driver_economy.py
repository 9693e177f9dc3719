"""An economy derived from the driver's order tables.

Labels are (nation, market segment): 25 × 5. A line item is a flow from the
supplier's nation and a sector picked by part size to the customer's nation and
segment. All line-level work is one scan of ``lineitem`` joined to its dimensions
and aggregated into a compact cube keyed by the two labels, the order year and the
line flags (≤ 25·5·25·5·years·6 rows whatever the size of ``lineitem``); every
economy table is then derived from that cube, which is cut from the lineage once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.economy import Economy, allocation, coefficients
from ..session import cut_lineage

LABEL = ["region", "sector"]
CELL = ["producer_region", "producer_sector", "consumer_region", "consumer_sector"]

# Fixed values of the derived economy (stand-ins for the real data's dimensions).
# Unit of each extension indicator, by return flag.
INDICATOR_UNITS = {"A": "ha", "R": "km2", "N": "kg"}
# Nation keys ending in 9 have no ISO3 code (stand-ins for rest-of-world regions).
NO_ISO3_LAST_DIGIT = 9
# Extra region groups on top of the driver's `region` table.
CORE_GROUP_MAX_KEY = 8          # CORE = nations with key below this
EMPTY_GROUP_MEMBERS = ["XX"]    # a group whose only member is absent; must vanish
# Largest number of rows of a dimension of the lines that is broadcast: some 30 MB in the
# driver. Spark's own choice goes by the size of the compressed file, which lets a
# dimension of millions of rows pass through the driver.
MAX_DIMENSION_ROWS = 500_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sector, sid): the market segments in alphabetical order, numbered from 0.
    Distinct first, so the numbering window sees five rows."""
    seg = _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sector")).distinct()
    return seg.select("sector", (F.row_number().over(Window.orderBy("sector")) - 1).alias("sid"))


def _dimension(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` broadcast up to so many rows (counted from the file footers), and beyond that
    joined by shuffles, never through the driver."""
    return F.broadcast(df) if df.count() <= max_rows else df.hint("merge")


def line_cube(spark: SparkSession, sf_dir: str, max_dimension_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """Line value and quantity summed by (producer label keys, consumer label keys,
    year, return flag, line status). Keys are integers until the very end."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus",
        F.expr("cast(l_extendedprice * (1 - l_discount) as decimal(18,4))").alias("v"),
    )
    part = _read(spark, sf_dir, "part").select(
        "p_partkey", F.expr("cast((p_size - 1) div 10 as int)").alias("psid"))
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")

    # Star join on three keys (supplier, part, order → customer); lines go into the
    # order join once, and the aggregation into the cube sums map-side, so the only
    # shuffles of line-sized data are those the joins need (none for a dimension that is
    # small enough to be broadcast; the suppliers, fewest, come first).
    dim = lambda df: _dimension(df, max_dimension_rows)
    prod = (li.join(dim(supplier), li.l_suppkey == supplier.s_suppkey)
              .join(dim(part), li.l_partkey == part.p_partkey)
              .select("l_orderkey", "s_nationkey", "psid", "l_returnflag", "l_linestatus", "v", "l_quantity"))
    cons = orders.join(dim(customer), orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "year", "c_nationkey", "c_mktsegment")
    if orders.count() > max_dimension_rows:
        cons = cons.hint("merge")
    return (prod.join(cons, prod.l_orderkey == cons.o_orderkey)
            .groupBy("s_nationkey", "psid", "c_nationkey", "c_mktsegment", "year", "l_returnflag", "l_linestatus")
            .agg(F.sum("v").alias("v"), F.sum("l_quantity").alias("q")))


def build(spark: SparkSession, sf_dir: str) -> Economy:
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    seg = F.broadcast(cut_lineage(segments(spark, sf_dir)))  # five rows, from one scan of the customers
    nat = F.broadcast(nation.select("n_nationkey", "n_name"))  # one row per nation

    cube = cut_lineage(line_cube(spark, sf_dir))

    named = (cube
             .join(nat.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("producer_region")), "s_nationkey")
             .join(seg.select(F.col("sid").alias("psid"), F.col("sector").alias("producer_sector")), "psid")
             .join(nat.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("consumer_region")), "c_nationkey")
             .select("producer_region", "producer_sector", "consumer_region",
                     F.col("c_mktsegment").alias("consumer_sector"), "year", "l_returnflag", "l_linestatus", "v", "q"))

    # Regions × sectors. Cut once: nearly every report uses the label domain.
    labels = cut_lineage(nat.select(F.col("n_name").alias("region")).crossJoin(seg.select("sector")))

    yearly = cut_lineage(named.where(F.col("l_returnflag") != "N").groupBy("year", *CELL).agg(F.sum("v").alias("value")))
    z_dec = cut_lineage(yearly.groupBy(*CELL).agg(F.sum("value").alias("zdec")))
    rows = z_dec.groupBy(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector")).agg(F.sum("zdec").alias("rs"))
    cols = z_dec.groupBy(F.col("consumer_region").alias("region"), F.col("consumer_sector").alias("sector")).agg(F.sum("zdec").alias("cs"))
    zero = F.lit(0).cast("decimal(38,4)")
    xy = (labels.join(rows, LABEL, "left").join(cols, LABEL, "left")
          .select(*LABEL, F.coalesce("rs", zero).alias("rs"), F.coalesce("cs", zero).alias("cs"))
          .select(*LABEL, "rs", (F.greatest("rs", "cs") * 2 + 1).alias("xdec")))
    xy = cut_lineage(xy)
    X = xy.select(*LABEL, F.col("xdec").cast("double").alias("value"))
    Y = xy.select(*LABEL, (F.col("xdec") - F.col("rs")).cast("double").alias("value"))
    Z = z_dec.select("producer_region", "producer_sector", "consumer_region", "consumer_sector",
                     F.col("zdec").cast("double").alias("value"))
    A = cut_lineage(coefficients(Z, X))
    B = cut_lineage(allocation(Z, X))

    history = (named.groupBy(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"), "year")
               .agg(F.sum("v").cast("double").alias("value")))
    # Final demand by category: the lines left out of the flows, by line status, and
    # what balances them to Y.
    lines_n = (named.where(F.col("l_returnflag") == "N")
               .groupBy(F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"), F.col("l_linestatus").alias("category"))
               .agg(F.sum("v").cast("double").alias("value")))
    sums = lines_n.groupBy(*LABEL).agg(F.sum("value").alias("s"))
    balance = (Y.join(sums, LABEL, "left")
               .select(*LABEL, F.lit("balance").alias("category"), (F.col("value") - F.coalesce("s", F.lit(0.0))).alias("value")))
    F_flows = cut_lineage(named.groupBy(F.concat("l_returnflag", "l_linestatus").alias("indicator"),
                             F.col("producer_region").alias("region"), F.col("producer_sector").alias("sector"))
               .agg(F.sum("q").alias("value")))
    flag_units = spark.createDataFrame(list(INDICATOR_UNITS.items()), "flag string, unit string")
    units = (F_flows.select("indicator").distinct()
             .join(F.broadcast(flag_units), F.substring("indicator", 1, 1) == F.col("flag"), "left")
             .select("indicator", "unit"))

    regions = nation.select(
        F.col("n_name").alias("region"),
        F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"),
        F.when(F.col("n_nationkey") % 10 != NO_ISO3_LAST_DIGIT,
               F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))).alias("iso3"),
    )
    groups = (nation.join(region, nation.n_regionkey == region.r_regionkey)
              .select(F.col("r_name").alias("group_name"), F.col("n_name").alias("region"))
              .unionByName(nation.where(F.col("n_nationkey") < CORE_GROUP_MAX_KEY)
                           .select(F.lit("CORE").alias("group_name"), F.col("n_name").alias("region")))
              .unionByName(spark.createDataFrame([("EMPTY", r) for r in EMPTY_GROUP_MEMBERS], "group_name string, region string")))

    # Cut: the cube (holds the scan) and what is reused by many plans; regions and
    # groups are small plans over tiny files and stay uncut.
    return Economy(labels=labels, Z=Z, X=X, Y=Y, A=A, B=B,
                   history=cut_lineage(history), F=F_flows, units=units,
                   regions=regions, groups=groups, demand=cut_lineage(lines_n.unionByName(balance)), yearly=yearly)


def yearly_output(yearly: DataFrame, labels: DataFrame) -> DataFrame:
    """X of every year, by the rule of the whole economy: twice the larger of row and
    column sum, plus one. ``(year, region, sector, value)``, summed in decimals."""
    side = lambda p, name: yearly.groupBy("year", F.col(f"{p}_region").alias("region"), F.col(f"{p}_sector").alias("sector")).agg(
        F.sum("value").alias(name))
    years = yearly.select("year").distinct()  # order years: a handful
    zero = F.lit(0).cast("decimal(38,4)")
    return (years.crossJoin(F.broadcast(labels.select(*LABEL)))
            .join(side("producer", "rs"), ["year", *LABEL], "left").join(side("consumer", "cs"), ["year", *LABEL], "left")
            .select("year", *LABEL, (F.greatest(F.coalesce("rs", zero), F.coalesce("cs", zero)) * 2 + 1).cast("double").alias("value")))
