"""Session-level materialised tables shared by the driver queries.

The economy, the scenario table and one batched propagation (every scenario ×
method, the rows of L and columns of G asked for, and x = L·y) are
computed once per (Spark application, data folder) and cut from the lineage in the
shared checkpoint folder; every report reads them. This is the "many scenarios in
one plan, several reports off one Δx" design: the loop runs once for all of them.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as att
from ..operators import economy as econ
from ..operators import materiality as mat
from ..operators import linalg, propagate, search
from ..operators import years as years_op
from ..operators.scenario import resolve_scenario, validate_portfolio
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import io
from . import driver_economy, fixtures, ratings_fixture

_MEMO: dict = {}
LABEL = ["region", "sector"]


def _memo(spark: SparkSession, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _MEMO:
        ensure_checkpoint_dir(spark)
        _MEMO[key] = build()
    return _MEMO[key]


def economy(spark: SparkSession, sf_dir: str):
    return _memo(spark, sf_dir, "economy", lambda: driver_economy.build(spark, sf_dir))


def tight_economy(spark: SparkSession, sf_dir: str):
    """The same flows with little final demand, so that the series falls slowly."""
    def build():
        eco = economy(spark, sf_dir)
        x = eco.X.withColumn("value", (F.col("value") - 1) / 2 * fixtures.TIGHT_FACTOR + 1)
        both = x.join(eco.X.withColumnRenamed("value", "x0"), LABEL).join(eco.Y.withColumnRenamed("value", "y0"), LABEL)
        y = both.select(*LABEL, (F.col("value") - (F.col("x0") - F.col("y0"))).alias("value"))
        x, y = cut_lineage(x), cut_lineage(y)
        return replace(eco, X=x, Y=y, A=cut_lineage(econ.coefficients(eco.Z, x)), B=cut_lineage(econ.allocation(eco.Z, x)))
    return _memo(spark, sf_dir, "tight", build)


def tight_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "tight-impacts", lambda: cut_lineage(propagate.impacts(
        tight_economy(spark, sf_dir), scenarios(spark, sf_dir), ["ghosh", "leontief"])))


def ratings_tables(spark: SparkSession, sf_dir: str):
    def build():
        seg = driver_economy.segments(spark, sf_dir)
        r = cut_lineage(ratings_fixture.ratings(spark, sf_dir))
        x = cut_lineage(ratings_fixture.crosswalk(spark, sf_dir, seg))
        return r, x
    return _memo(spark, sf_dir, "ratings", build)


def material(spark: SparkSession, sf_dir: str, fallback: str = "all") -> DataFrame:
    def build():
        r, x = ratings_tables(spark, sf_dir)
        joined, _ = mat.match_ratings(r, x, fallback)
        return cut_lineage(mat.material_sectors(joined))
    return _memo(spark, sf_dir, f"material-{fallback}", build)


def scenario_inputs(spark: SparkSession):
    specs = spark.createDataFrame(fixtures.SPECS, "scenario_id string, shock_type string, region_spec string, sector string, service string, percent double")
    custom = spark.createDataFrame(fixtures.CUSTOM, "scenario_id string, region string, sector string, percent double")
    return specs, custom


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build():
        eco = economy(spark, sf_dir)
        specs, custom = scenario_inputs(spark)
        return cut_lineage(resolve_scenario(specs, custom, material(spark, sf_dir), eco.labels, eco.groups))
    return _memo(spark, sf_dir, "scenarios", build)


def homes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *fixtures.HOME) for s in fixtures.SCENARIO_IDS],
                                 "scenario_id string, home_region string, home_sector string")


def portfolios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.PORTFOLIOS, "portfolio_id string, region string, sector string, weight double")


def positions(spark: SparkSession) -> DataFrame:
    """Portfolios that pass the weight check (K7) against every scenario: (scenario_id,
    portfolio_id, region, sector, weight)."""
    held = portfolios(spark)
    valid = validate_portfolio(held).where("is_valid")
    ids = spark.createDataFrame([(s,) for s in fixtures.SCENARIO_IDS], "scenario_id string")
    return (held.join(valid, "portfolio_id", "left_semi").crossJoin(F.broadcast(ids))
            .select("scenario_id", "portfolio_id", *LABEL, "weight"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "pairs", lambda: cut_lineage(search.high_flow_pairs(
        economy(spark, sf_dir), fixtures.SEARCH_SECTORS, fixtures.SEARCH_QUANTILE)))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series runs in one loop, keyed by ``propagate.RUN_KEYS``."""
    def build():
        eco = economy(spark, sf_dir)
        sc = scenarios(spark, sf_dir)
        seeds, masks = propagate.impact_seeds(eco, sc, ["ghosh", "leontief", "textbook"])
        x_seed = propagate._keyed(eco.Y, "A_col", "x", "y")
        all_seeds = seeds.unionByName(x_seed)
        # Influences on the home, the portfolios and the large producers: runs like others.
        home = homes(spark).select(F.col("home_region").alias("region"), F.col("home_sector").alias("sector")).distinct()
        rows_of_L = home.unionByName(search.large_producers(eco, fixtures.SEARCH_SECTORS, fixtures.DEFAULT_QUANTILE)).distinct()
        for more in (propagate.inverse_seeds(rows_of_L, "A_row", "L"), propagate.inverse_seeds(home, "B_col", "G"),
                     att.portfolio_seeds(portfolios(spark), "ghosh")):
            all_seeds = all_seeds.unionByName(more)
        return cut_lineage(propagate.solve_runs(eco, all_seeds, masks))
    return _memo(spark, sf_dir, "batch", build)


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(method, scenario_id, region, sector, delta_x) for every scenario × method."""
    def build():
        eco = economy(spark, sf_dir)
        return cut_lineage(propagate.assemble_impacts(eco, scenarios(spark, sf_dir), batch(spark, sf_dir), propagate.METHODS))
    return _memo(spark, sf_dir, "impacts", build)


def dx(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return impacts(spark, sf_dir).where(F.col("method") == method).drop("method")


def leontief_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full L = Σ Aᵏ as a long matrix."""
    eco = economy(spark, sf_dir)
    return _memo(spark, sf_dir, "L", lambda: cut_lineage(linalg.power_series(eco.A, eco.labels)))


def ghosh_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full G = Σ Bᵏ as a long matrix. Since B = x̂⁻¹·A·x̂ term by term,
    Σ Bᵏ = x̂⁻¹ (Σ Aᵏ) x̂: G_ij = L_ij · x_j / x_i — one join with the output vector
    instead of another series."""
    eco = economy(spark, sf_dir)
    return _memo(spark, sf_dir, "G", lambda: cut_lineage(
        linalg.similarity_scale(leontief_inverse(spark, sf_dir), eco.X)))


def influence(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """(home_region, home_sector, region, sector, value): the home's row of L or column
    of G out of the batch, or column of A."""
    home = homes(spark).select("home_region", "home_sector").distinct()
    if method not in att.INFLUENCE_SYSTEM:
        return att.first_order_influence(economy(spark, sf_dir).A, home)
    found = batch(spark, sf_dir).where(F.col("kind") == att.INFLUENCE_SYSTEM[method][1])
    return found.join(F.broadcast(home), ["home_region", "home_sector"], "left_semi").select("home_region", "home_sector", *LABEL, "value")


def portfolio_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio_id, region, sector, value), Ghosh, out of the batch."""
    return batch(spark, sf_dir).where("kind = 'portfolio G'").select(F.col("run_id").alias("portfolio_id"), *LABEL, "value")


def large_producer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of L of the large producers, long, out of the batch."""
    return batch(spark, sf_dir).where("kind = 'L'").select(
        F.col("home_region").alias("producer_region"), F.col("home_sector").alias("producer_sector"),
        F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), "value")


def years(spark: SparkSession, sf_dir: str) -> years_op.YearEconomies:
    """The economies of all order years, in year folders."""
    def build():
        eco = economy(spark, sf_dir)
        X = cut_lineage(driver_economy.yearly_output(eco.yearly, eco.labels))
        A, B = years_op.coefficients_by_year(eco.yearly.withColumn("value", F.col("value").cast("double")), X)
        base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/years-{uuid.uuid4().hex}"
        for name, df in (("A", A), ("B", B), ("X", X)):
            io.write_by_year(df, base, name)
        return years_op.YearEconomies(eco.labels, *(spark.read.parquet(f"{base}/{name}").withColumn("year", F.col("year").cast("int")) for name in "ABX"))
    return _memo(spark, sf_dir, "years", build)


def year_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "year-impacts", lambda: cut_lineage(years_op.impacts_by_year(
        years(spark, sf_dir), scenarios(spark, sf_dir), ["ghosh", "leontief"])))


def gross_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).where(F.col("kind") == "x").select(*LABEL, "value")


def causes(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """T1-T3 causes of the home for every scenario (shared by the roll-up reports)."""
    def build():
        # The first-order shares explain the Ghosh Δx: the direct model moves shocked
        # labels only.
        change = dx(spark, sf_dir, "ghosh" if method == "direct" else method)
        return cut_lineage(att.attribute(change, scenarios(spark, sf_dir), homes(spark), influence(spark, sf_dir, method)))
    return _memo(spark, sf_dir, f"causes-{method}", build)


def intermediaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10 nodes for the Ghosh Δx and the home (shared by paths and nodes)."""
    from ..operators import reports

    def build():
        eco = economy(spark, sf_dir)
        return cut_lineage(reports.key_intermediaries(eco.A, dx(spark, sf_dir, "ghosh"), scenarios(spark, sf_dir),
                                                      homes(spark), eco.labels, fixtures.PATH_K))
    return _memo(spark, sf_dir, "intermediaries", build)
