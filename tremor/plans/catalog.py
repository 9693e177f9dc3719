"""The named driver queries: one function ``(spark, sf_dir) -> DataFrame`` each.

Every query reads the driver tables (through the economy derived from them).
Computed doubles are rounded in the last projection (money 2 places, shares and
percentages 6, coefficients 10) so that results compare exactly with the SQL
oracle; values that are exact decimal sums are left unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookup
from ..operators import attribution as att
from ..operators import economy as econ
from ..operators import linalg, reports, search
from ..operators import materiality as mat
from ..operators import scenario as scn
from ..operators import propagate as prop
from ..operators import years as years_op
from . import fixtures, store

LABEL = ["region", "sector"]
CELL = ["producer_region", "producer_sector", "consumer_region", "consumer_sector"]
HOME = ["home_region", "home_sector"]
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Values that are exact decimals in exact arithmetic (sums of 4-decimal money) sit
# on rounding boundaries; both engines nudge by this relative amount before
# rounding so that last-bit differences in summation order cannot split a tie.
TIE_NUDGE = 1.0000000000001


def r(c: Column | str, d: int) -> Column:
    """Round half away from zero on ``c·(1+1e-13)·10^d`` — the same operations as the
    oracle's ``round(x * 1.0000000000001, d)`` — and turn -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** d)
    return F.round(c * F.lit(TIE_NUDGE) * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def money(c, name=None):
    return r(c, 2).alias(name or (c if isinstance(c, str) else "value"))


def share(c, name=None):
    return r(c, 6).alias(name or (c if isinstance(c, str) else "value"))


def coef(c, name=None):
    return r(c, 10).alias(name or (c if isinstance(c, str) else "value"))


# ---------------------------------------------------------------- economy (M, J4/J5, D6-D9)

@query
def flow_table(spark: SparkSession, d: str) -> DataFrame:
    """M1: Z = A·x_j."""
    eco = store.economy(spark, d)
    return econ.flows_from_coefficients(eco.A, eco.X).select(*CELL, F.col("value").alias("flow"))


@query
def gross_output(spark, d):
    """M6: x = L·y by the series (equals X)."""
    return store.gross_output(spark, d).select(*LABEL, r("value", 0).alias("gross_output"))


@query
def final_demand(spark, d):
    """M4: final demand summed over its categories."""
    return econ.final_demand(store.economy(spark, d).demand).select(*LABEL, money("value", "final_demand"))


@query
def final_demand_categories(spark, d):
    """M4 before the sum: lines left out of the flows by status, and the balancing item."""
    return store.economy(spark, d).demand.select(*LABEL, "category", money("value"))


@query
def technical_coefficients(spark, d):
    """M2."""
    eco = store.economy(spark, d)
    return econ.coefficients(eco.Z, eco.X).select(*CELL, coef("value"))


@query
def allocation_coefficients(spark, d):
    """M3."""
    eco = store.economy(spark, d)
    return econ.allocation(eco.Z, eco.X).select(*CELL, coef("value"))


@query
def residual_demand(spark, d):
    """(I − A)·x, which gives back y."""
    eco = store.economy(spark, d)
    return linalg.residual(eco.A, eco.X).select(*LABEL, money("value"))


def _inverse_top(m: DataFrame, n: int = 50) -> DataFrame:
    from pyspark.sql import Window
    off = m.where((F.col("producer_region") != F.col("consumer_region")) | (F.col("producer_sector") != F.col("consumer_sector")))
    order = [F.col("value").desc(), *CELL]
    top = off.orderBy(*order).limit(n)  # distributed top-k: per-partition top n, then a merge
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(  # window over n rows
        F.col("rank").cast("bigint").alias("rank"), *CELL, coef("value"))


@query
def leontief_inverse(spark, d):
    """M8: every cell of L = (I − A)⁻¹."""
    return store.leontief_inverse(spark, d).where("value <> 0").select(*CELL, coef("value"))


@query
def ghosh_inverse(spark, d):
    """M9: every cell of G = (I − B)⁻¹."""
    return store.ghosh_inverse(spark, d).where("value <> 0").select(*CELL, coef("value"))


@query
def tight_gross_output(spark, d):
    """M6 on the tight economy: x = L·y, which takes some hundred terms."""
    eco = store.tight_economy(spark, d)
    return econ.gross_output(eco.A, eco.Y).select(*LABEL, money("value", "gross_output"))


def _tight(spark, d, method):
    return store.tight_impacts(spark, d).where(F.col("method") == method).select("scenario_id", *LABEL, money("delta_x"))


@query
def tight_ghosh_impact(spark, d):
    """P2 on the tight economy."""
    return _tight(spark, d, "ghosh")


@query
def tight_leontief_impact(spark, d):
    """P1 on the tight economy."""
    return _tight(spark, d, "leontief")


@query
def label_catalog(spark, d):
    """Labels seen on either side of the flows, with the regions and sectors they
    make up."""
    from ..sources import io
    labels = io.labels_of(store.economy(spark, d).Z)
    regions, sectors = econ.label_catalog(labels)
    kinds = [regions.select(F.lit("region").alias("kind"), F.col("region").alias("name"), F.lit(None).cast("string").alias("sector")),
             sectors.select(F.lit("sector").alias("kind"), F.lit(None).cast("string").alias("name"), "sector"),
             labels.select(F.lit("label").alias("kind"), F.col("region").alias("name"), "sector")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query
def scenario_rejects(spark, d):
    """V1-V3: shock rows that break a rule, against the labels of the economy."""
    rows = spark.createDataFrame(fixtures.REJECT_CASES, scn.SHOCKS)
    return scn.rejects(rows, store.economy(spark, d).labels)


@query
def leontief_inverse_top(spark, d):
    """M8: the 50 largest off-diagonal cells of L = (I − A)⁻¹."""
    return _inverse_top(store.leontief_inverse(spark, d))


@query
def ghosh_inverse_top(spark, d):
    """M9: the 50 largest off-diagonal cells of G = (I − B)⁻¹."""
    return _inverse_top(store.ghosh_inverse(spark, d))


@query
def scaled_flows(spark, d):
    """A scaled by output on columns and B scaled on rows (both give Z)."""
    eco = store.economy(spark, d)
    cs = econ.scale_columns(eco.A, eco.X).withColumnRenamed("value", "by_column")
    rs = econ.scale_rows(eco.B, eco.X).withColumnRenamed("value", "by_row")
    return cs.join(rs, CELL, "full_outer").select(*CELL, "by_column", "by_row")


@query
def two_step_flows(spark, d):
    """M7: A·A (second-round input requirements)."""
    eco = store.economy(spark, d)
    return linalg.matmul(eco.A, eco.A).select(*CELL, coef("value"))


@query
def cross_border_flows(spark, d):
    """Flows from listed producer sectors, regions without ISO3 excluded,
    same-region cells dropped."""
    eco = store.economy(spark, d)
    excluded = eco.regions.where(F.col("iso3").isNull()).select("region")
    z = econ.producers_in(eco.Z, fixtures.SEARCH_SECTORS)
    return econ.cross_border_only(econ.exclude_regions(z, excluded)).select(*CELL, F.col("value").alias("flow"))


@query
def extension_total(spark, d):
    """Land use per label over indicators in ha or km2; 0 where none."""
    eco = store.economy(spark, d)
    return econ.extension_total(eco.F, eco.units, eco.labels).select(*LABEL, F.col("value").alias("land_use"))


# ---------------------------------------------------------------- propagation

def _impact(spark, d, method):
    return store.dx(spark, d, method).select("scenario_id", *LABEL, money("delta_x"))


@query
def ghosh_impact(spark, d):
    return _impact(spark, d, "ghosh")


@query
def leontief_impact(spark, d):
    return _impact(spark, d, "leontief")


@query
def leontief_textbook(spark, d):
    return _impact(spark, d, "textbook")


def _stored(spark, d, method):
    eco = store.economy(spark, d)
    inverse = {"G": store.ghosh_inverse(spark, d)} if method == "ghosh" else {"L": store.leontief_inverse(spark, d)}
    dx = prop.stored_impacts(eco, store.scenarios(spark, d), [method], **inverse)
    return dx.select("scenario_id", *LABEL, money("delta_x"))


@query
def ghosh_impact_stored(spark, d):
    """P2 from the stored inverse: the shocked block solved, one product, no loop."""
    return _stored(spark, d, "ghosh")


@query
def leontief_impact_stored(spark, d):
    """P1 from the stored inverse."""
    return _stored(spark, d, "leontief")


@query
def leontief_textbook_stored(spark, d):
    """P1b from the stored inverse."""
    return _stored(spark, d, "textbook")


@query
def required_demand(spark, d):
    """Δy = (I − A)·Δx of the Leontief parity model."""
    eco = store.economy(spark, d)
    return prop.required_demand(eco.A, store.dx(spark, d, "leontief")).select("scenario_id", *LABEL, money("delta_y"))


@query
def direct_impact(spark, d):
    """Only shocked labels move; Δy = (I − A)·Δx."""
    eco = store.economy(spark, d)
    dx = store.dx(spark, d, "direct")
    dy = prop.required_demand(eco.A, dx)
    return dx.join(dy, ["scenario_id", *LABEL]).select("scenario_id", *LABEL, money("delta_x"), money("delta_y"))


@query
def top_impacts_pct(spark, d):
    """Top 100 by absolute % change, Ghosh."""
    eco = store.economy(spark, d)
    t = reports.top_impacts(store.dx(spark, d, "ghosh"), eco.X, store.scenarios(spark, d), eco.regions, fixtures.TOP_N, "percentage")
    return t.select("scenario_id", F.col("rank").cast("bigint").alias("rank"), "region", "country", "sector",
                    money("change"), share("pct_change"))


def flagship(spark, d):
    """The minimum end-to-end slice (economy → scenarios → Ghosh propagation → top
    impacts) without the shared batch: one loop over the fixed scenarios only.
    Same rows and schema as :func:`top_impacts_pct`."""
    from ..operators import propagate
    eco = store.economy(spark, d)
    sc = store.scenarios(spark, d)
    dx = propagate.ghosh_impact(eco, sc)
    t = reports.top_impacts(dx, eco.X, sc, eco.regions, fixtures.TOP_N, "percentage")
    return t.select("scenario_id", F.col("rank").cast("bigint").alias("rank"), "region", "country", "sector",
                    money("change"), share("pct_change"))


@query
def top_impacts_abs(spark, d):
    """Top 100 by absolute money change, Ghosh."""
    eco = store.economy(spark, d)
    t = reports.top_impacts(store.dx(spark, d, "ghosh"), eco.X, store.scenarios(spark, d), eco.regions, fixtures.TOP_N, "absolute")
    return t.select("scenario_id", F.col("rank").cast("bigint").alias("rank"), "region", "country", "sector",
                    money("change"), share("pct_change"))


# ---------------------------------------------------------------- attribution

def _causes(spark, d, method):
    return store.causes(spark, d, method)


def _cause_cols(df):
    return df.select("scenario_id", *HOME, "cause_region", "cause_sector", money("contribution"),
                     share("share_pct"), money("total_impact"))


@query
def home_attribution_ghosh(spark, d):
    """T1-T3, Ghosh: G[shock, home]·|Δx_shock|."""
    return _cause_cols(_causes(spark, d, "ghosh"))


@query
def home_attribution_leontief(spark, d):
    """T1-T3, Leontief: L[home, shock]·|Δx_shock|."""
    return _cause_cols(_causes(spark, d, "leontief"))


@query
def home_attribution_direct(spark, d):
    """T1-T3, first order: A[shock, home]·|Δx_shock| of the Ghosh Δx."""
    return _cause_cols(_causes(spark, d, "direct"))


@query
def portfolio_attribution(spark, d):
    """T4, Ghosh, the valid portfolios against every scenario."""
    out = att.attribute_portfolio(store.dx(spark, d, "ghosh"), store.scenarios(spark, d), store.positions(spark),
                                  store.portfolio_influence(spark, d))
    return out.select("scenario_id", "portfolio_id", "cause_region", "cause_sector", money("contribution"),
                      share("share_pct"), money("total_impact"))


def _rolled(spark, d, level):
    eco = store.economy(spark, d)
    return att.rollup_causes(_causes(spark, d, "ghosh"), level, eco.regions, ["scenario_id"])


@query
def causes_by_country(spark, d):
    """T5: shares by country display name."""
    return _rolled(spark, d, "country").select("scenario_id", "item", share("value"))


@query
def causes_by_sector(spark, d):
    """T5: shares by sector."""
    return _rolled(spark, d, "sector").select("scenario_id", "item", share("value"))


@query
def top_contributors(spark, d):
    """Top 3 causes ("name - sector"), Others, Total."""
    t = att.top_contributors(_rolled(spark, d, "none"), ["scenario_id"], 3)
    return t.select("scenario_id", F.col("position").cast("bigint").alias("position"), "item", share("value"), share("top_share"))


@query
def country_contributions(spark, d):
    """Shares per cause country with ISO3; regions without one drop out."""
    eco = store.economy(spark, d)
    c = att.country_contributions(_causes(spark, d, "ghosh"), eco.regions, ["scenario_id"])
    return c.select("scenario_id", "cause_region", "iso3", "name", share("share_pct"))


@query
def signed_contributions(spark, d):
    """Non-zero contributions negated plus a total row."""
    s = att.signed_contributions(_causes(spark, d, "ghosh"), ["scenario_id"], ["cause_region", "cause_sector"])
    return s.select("scenario_id", "cause_region", "cause_sector", money("value"), "is_total")


# ---------------------------------------------------------------- reports

@query
def home_impact(spark, d):
    """R1, Ghosh."""
    eco = store.economy(spark, d)
    h = reports.home_impact(eco.X, store.dx(spark, d, "ghosh"), store.homes(spark))
    return h.select("scenario_id", *HOME, "before", money("delta_x"), money("after"), share("pct_change"))


@query
def portfolio_impact(spark, d):
    """R2/R4, Ghosh."""
    eco = store.economy(spark, d)
    p = reports.portfolio_impact(eco.X, store.dx(spark, d, "ghosh"), store.positions(spark))
    return p.select("scenario_id", "portfolio_id", money("before"), money("delta"), money("after"), share("pct_change"),
                    money("total_abs_change"), share("total_rel_change"))


@query
def portfolio_breakdown(spark, d):
    """R3, Ghosh."""
    eco = store.economy(spark, d)
    b = reports.portfolio_breakdown(eco.X, store.dx(spark, d, "ghosh"), store.positions(spark), eco.regions)
    return b.select("scenario_id", "portfolio_id", "region", "region_name", "sector", "weight",
                    money("abs_change"), share("rel_change"))


@query
def headline(spark, d):
    """Count of shocks, region label and % change at the home (Ghosh)."""
    eco = store.economy(spark, d)
    specs, _ = store.scenario_inputs(spark)
    h = reports.home_impact(eco.X, store.dx(spark, d, "ghosh"), store.homes(spark)).select("scenario_id", "pct_change")
    out = reports.headline(specs.select("scenario_id", "region_spec"), store.scenarios(spark, d), h, eco.regions,
                           scn.valid_groups(eco.groups, eco.labels))
    return out.select("scenario_id", "region_label", "n_shocks", share("pct_change"))


def _history(spark, d, strict):
    eco = store.economy(spark, d)
    dec = "decimal(38,4)"
    hist = eco.history.withColumn("value", F.col("value").cast(dec))
    x = eco.X.withColumn("value", F.col("value").cast(dec))
    h = reports.shock_history(hist, x, store.scenarios(spark, d), strict)
    return h.select("scenario_id", "year", F.col("history_output").cast("double").alias("history_output"),
                    F.col("base_output").cast("double").alias("base_output"), money(F.col("post_shock_output").cast("double"), "post_shock_output"))


@query
def shock_history(spark, d):
    """Yearly output over the shocked labels, pre/post shock levels."""
    return _history(spark, d, False)


@query
def shock_history_strict(spark, d):
    """As R7, but a scenario with any shocked label lacking history is empty."""
    return _history(spark, d, True)


@query
def lost_input_flows(spark, d):
    """R9, Leontief parity."""
    eco = store.economy(spark, d)
    f = reports.lost_input_flows(eco.A, store.dx(spark, d, "leontief"))
    return f.select("scenario_id", *CELL, money("flow"))


@query
def impact_paths(spark, d):
    """R10, Ghosh, home NATION_5 AUTOMOBILE."""
    eco = store.economy(spark, d)
    e = reports.impact_paths(eco.A, store.dx(spark, d, "ghosh"), store.scenarios(spark, d), store.homes(spark),
                             eco.labels, fixtures.PATH_K, mids=store.intermediaries(spark, d))
    return e.select("scenario_id", "source_region", "source_sector", "target_region", "target_sector", money("flow"), "edge")


@query
def impact_paths_homes(spark, d):
    """R10 with two homes in every scenario."""
    eco = store.economy(spark, d)
    first = store.homes(spark)
    homes = first.unionByName(first.select("scenario_id", F.lit(fixtures.SECOND_HOME[0]).alias("home_region"),
                                           F.lit(fixtures.SECOND_HOME[1]).alias("home_sector")))
    e = reports.impact_paths(eco.A, store.dx(spark, d, "ghosh"), store.scenarios(spark, d), homes, eco.labels, fixtures.PATH_K)
    return e.select("scenario_id", *HOME, "source_region", "source_sector", "target_region", "target_sector", money("flow"), "edge")


@query
def portfolio_paths(spark, d):
    """R11, Ghosh, the valid portfolios."""
    eco = store.economy(spark, d)
    e = reports.portfolio_paths(eco.A, store.dx(spark, d, "ghosh"), store.scenarios(spark, d), store.positions(spark),
                                eco.labels, fixtures.PATH_K)
    return e.select("scenario_id", "portfolio_id", "source_region", "source_sector", "target_region", "target_sector",
                    money("flow"), "edge")


@query
def path_nodes(spark, d):
    """Nodes of the single-home path diagram with role and display name."""
    eco = store.economy(spark, d)
    sc = store.scenarios(spark, d)
    return reports.path_nodes(sc, store.intermediaries(spark, d), store.homes(spark), eco.regions)


# ---------------------------------------------------------------- scenarios

@query
def service_scenario(spark, d):
    """Material sectors of service_6 × nations of EUROPE at 10 %."""
    return store.scenarios(spark, d).where(F.col("scenario_id") == "service")


@query
def group_scenario(spark, d):
    """K1/K2/K4/K8: every fixed scenario resolved to its shocks."""
    return store.scenarios(spark, d)


def _levels(shocks, X):
    lv = scn.shock_levels(X, shocks)
    return lv.select("scenario_id", *LABEL, "magnitude", "x", money("x_new"), money("delta_x"))


@query
def scenario_edits(spark, d):
    """K5: an edit log replayed (update, delete, re-add, clear), tied to the data."""
    eco = store.economy(spark, d)
    edits = spark.createDataFrame(fixtures.SCENARIO_EDITS, "scenario_id string, seq int, op string, region string, sector string, magnitude double")
    return _levels(scn.apply_edits(edits, "scenario_id", "magnitude"), eco.X)


@query
def shock_levels(spark, d):
    """K9: x, x·(1−mag), Δx of every shock of every scenario."""
    eco = store.economy(spark, d)
    return _levels(store.scenarios(spark, d), eco.X)


@query
def portfolio_check(spark, d):
    """K7: weight totals within the reference tolerance; assets known to the economy."""
    eco = store.economy(spark, d)
    pf = store.portfolios(spark)
    known = (pf.join(eco.labels, LABEL, "left_semi").groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n_known")))
    return scn.validate_portfolio(pf).join(known, "portfolio_id", "left").select(
        "portfolio_id", "total_weight", "n_assets", "is_valid", F.coalesce("n_known", F.lit(0)).cast("bigint").alias("n_known"))


@query
def portfolio_edits(spark, d):
    """K6: portfolio edit log replayed, valued at the economy's output."""
    eco = store.economy(spark, d)
    edits = spark.createDataFrame(fixtures.PORTFOLIO_EDITS, "portfolio_id string, seq int, op string, region string, sector string, weight double")
    pf = scn.apply_edits(edits, "portfolio_id", "weight")
    return pf.join(eco.X, LABEL).select("portfolio_id", *LABEL, "weight", F.col("value").alias("x"))


@query
def portfolio_edit_check(spark, d):
    """K7 (edit check): would adding or updating each candidate keep the total at
    most 100 with a positive weight? Candidates are the portfolio rows themselves
    at new weights, plus one new label; tied to the economy's labels."""
    eco = store.economy(spark, d)
    pf = store.portfolios(spark)
    cand = spark.createDataFrame(fixtures.EDIT_CANDIDATES, scn.PORTFOLIO).join(eco.labels, LABEL, "left_semi")
    return scn.can_add(pf, cand).select("portfolio_id", *LABEL, "weight", share("potential_total"), "allowed")


@query
def label_split(spark, d):
    """Every label of every scenario flagged shocked or free."""
    eco = store.economy(spark, d)
    return scn.partition_labels(eco.labels, store.scenarios(spark, d))


@query
def matrix_blocks(spark, d):
    """Cells and sum of A in the NN/NM/MN/MM blocks of every scenario."""
    eco = store.economy(spark, d)
    return scn.block_summary(eco.A, store.scenarios(spark, d)).select("scenario_id", "block", "cells", coef("total"))


@query
def vector_lookup(spark, d):
    """X and Y at the portfolio labels."""
    eco = store.economy(spark, d)
    pf = store.portfolios(spark).select("portfolio_id", *LABEL)
    x = scn.at_labels(eco.X.withColumnRenamed("value", "x"), pf)
    return scn.at_labels(eco.Y.withColumnRenamed("value", "y"), x).select("portfolio_id", *LABEL, "x", "y")


# ---------------------------------------------------------------- lookups

def _codes(eco):
    return eco.labels.select("region").union(eco.groups.select("region")).distinct()


@query
def region_lookup(spark, d):
    """Display name, falling back to the code."""
    eco = store.economy(spark, d)
    return lookup.with_region_name(_codes(eco), "region", eco.regions).select("region", "region_name")


@query
def region_lookup_strict(spark, d):
    """Display name, null for unknown codes."""
    eco = store.economy(spark, d)
    return lookup.with_region_name(_codes(eco), "region", eco.regions, strict=True, out="country").select("region", "country")


@query
def region_iso3(spark, d):
    """D3: ISO3 codes; regions without one are dropped."""
    eco = store.economy(spark, d)
    return lookup.with_iso3(_codes(eco), "region", eco.regions).select("region", "iso3")


@query
def region_groups(spark, d):
    """Groups limited to present regions; an emptied group disappears."""
    eco = store.economy(spark, d)
    return scn.valid_groups(eco.groups, eco.labels)


@query
def catalog_listing(spark, d):
    """Regions with names, groups, sectors, services; default service
    ``Pollination`` if present, else the first."""
    eco = store.economy(spark, d)
    return scn.catalog_options(eco.labels, eco.regions, eco.groups, store.material(spark, d))


@query
def short_labels(spark, d):
    """D11: "name - sector" display labels shortened to 16 and to 60 characters."""
    eco = store.economy(spark, d)
    named = lookup.with_region_name(eco.labels, "region", eco.regions)
    full = F.concat_ws(" - ", "region_name", "sector")
    return named.select(*LABEL, lookup.truncate_label(full, 16).alias("short_16"), lookup.truncate_label(full, 60).alias("short_60"))


# ---------------------------------------------------------------- materiality

def _matched(spark, d, fallback):
    r, x = store.ratings_tables(spark, d)
    return mat.match_ratings(r, x, fallback)


@query
def ratings_match(spark, d):
    """Joined rating rows (four keys, then the three-key fallback over all rows)."""
    joined, _ = _matched(spark, d, "all")
    return joined.select(*mat.KEYS4, "sector")


@query
def ratings_unmatched(spark, d):
    """Rating rows left without a sector."""
    _, un = _matched(spark, d, "all")
    return un.select(*mat.KEYS4)


def _materiality(spark, d, fallback):
    joined, _ = _matched(spark, d, fallback)
    return mat.materiality_counts(joined).where("material").select("service", "sector", "vh", "h", "n")


@query
def materiality(spark, d):
    """B1 (reference behaviour: fallback over all rows)."""
    return _materiality(spark, d, "all")


@query
def materiality_intent(spark, d):
    """B1 with the fallback over unmatched rows only."""
    return _materiality(spark, d, "unmatched")


# ---------------------------------------------------------------- search

@query
def high_flow_pairs(spark, d):
    """Flows from BUILDING and FURNITURE producers above their 95th
    percentile, different region and sector."""
    return store.pairs(spark, d).select(*CELL, F.col("value").alias("flow"))


@query
def max_impact_scenario(spark, d):
    """The pair whose 10 % producer shock moves the consumer's Δy most."""
    eco = store.economy(spark, d)
    best = search.max_impact_scenario(eco, store.pairs(spark, d), fixtures.SEARCH_MAGNITUDE)
    return best.select("shock_region", "shock_sector", "home_region", "home_sector", money("impact"))


@query
def default_scenario(spark, d):
    """Strongest cross-border dependency of a large producer of the listed
    sectors by L, regions without ISO3 excluded."""
    eco = store.economy(spark, d)
    excluded = eco.regions.where(F.col("iso3").isNull()).select("region")
    out = search.default_scenario(eco, fixtures.SEARCH_SECTORS, excluded, fixtures.DEFAULT_QUANTILE,
                                  L=store.large_producer_rows(spark, d))
    return out.select("home_region", "home_sector", "shock_region", "shock_sector", coef("dependency"))


@query
def scenario_batch(spark, d):
    """Every scenario × method side by side."""
    s = search.scenario_summary(store.impacts(spark, d))
    return s.select("method", "scenario_id", money("total_change"), money("largest_loss"), "labels_moved")


@query
def year_batch(spark, d):
    """Every year × scenario × method side by side, from one loop."""
    s = search.scenario_summary(store.year_impacts(spark, d), ["year", "method", "scenario_id"])
    return s.select("year", "method", "scenario_id", money("total_change"), money("largest_loss"), "labels_moved")


@query
def year_home_impact(spark, d):
    """R1 of every year, Ghosh."""
    dx = store.year_impacts(spark, d).where("method = 'ghosh'")
    h = years_op.home_impact_by_year(store.years(spark, d).X, dx, store.homes(spark))
    return h.select("year", "scenario_id", *HOME, "before", money("delta_x"), money("after"), share("pct_change"))


# ---------------------------------------------------------------- sources and sinks

def _fresh_folder(spark, name: str) -> str:
    import uuid

    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exchange/{name}-{uuid.uuid4().hex}"


@query
def production_history(spark, d):
    """Output by year written as year folders, read back by partition
    discovery, averaged per (label, year)."""
    from ..sources import io
    eco = store.economy(spark, d)
    base = _fresh_folder(spark, "history")
    io.write_by_year(eco.history, base, "X")
    hist = econ.production_history(io.read_years(spark, base, "X"))
    return hist.select(*LABEL, "year", F.col("value").alias("gross_output"))


@query
def year_files_round_trip(spark, d):
    """S2/S5 in the layout ``{base}/{year}/<prefix>X.parquet``: a folder for every year of
    the history and one without the file, stacked again."""
    from ..sources import io
    eco = store.economy(spark, d)
    base = _fresh_folder(spark, "years")
    for y in sorted(r["year"] for r in eco.history.select("year").distinct().collect()):  # order years: a handful
        one = eco.history.where(F.col("year") == y).select(*LABEL, F.col("value").alias("GrossOutput"))
        one.write.parquet(f"{base}/{y}/T_X.parquet")
    eco.X.write.parquet(f"{base}/2050/T_other.parquet")
    return io.read_year_files(spark, base, "X", "T_").select(*LABEL, "year", F.col("value").alias("gross_output"))


@query
def economy_round_trip(spark, d):
    """A written long (by year) and wide (square), X as a one-column
    vector; everything read back. Cells from the wide file next to the long file."""
    from ..sources import io
    eco = store.economy(spark, d)
    base = _fresh_folder(spark, "economy")
    io.write_tables({"A": eco.A}, base, 2024)
    io.long_to_wide(eco.A, eco.labels).write.parquet(f"{base}/A_wide")
    eco.X.withColumnRenamed("value", "GrossOutput").write.parquet(f"{base}/X_vec")
    wide = io.read_matrix(spark, f"{base}/A_wide", wide=True).withColumnRenamed("value", "from_wide")
    long = io.load_tables(spark, base, 2024, ["A"]).withColumnRenamed("value", "from_long")
    x = io.read_vector(spark, f"{base}/X_vec", "GrossOutput")
    xj = x.select(F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"), F.col("value").alias("x_consumer"))
    assert io.read_history(spark, f"{base}/none") is None
    return (wide.join(long, CELL, "full_outer").join(xj, ["consumer_region", "consumer_sector"], "left")
            .select(*CELL, coef("from_wide"), coef("from_long"), "x_consumer"))


@query
def ratings_round_trip(spark, d):
    """Ratings and crosswalk through CSV, joined rows to CSV, the
    materiality map through JSON, read back exploded."""
    from ..sources import io
    r, x = store.ratings_tables(spark, d)
    base = _fresh_folder(spark, "ratings")
    r.write.option("header", True).csv(f"{base}/ratings")
    x.write.option("header", True).csv(f"{base}/crosswalk")
    joined, _ = mat.match_ratings(io.read_ratings(spark, f"{base}/ratings"), io.read_crosswalk(spark, f"{base}/crosswalk"), "all")
    io.write_joined(joined, f"{base}/joined")
    io.write_materiality(mat.materiality(joined), f"{base}/materiality")
    return io.read_materiality(spark, f"{base}/materiality")


@query
def scenario_round_trip(spark, d):
    """The scenario table written as records (percent) and read back with the
    required-field check, valued at the economy's output."""
    from ..sources import io
    eco = store.economy(spark, d)
    path = _fresh_folder(spark, "scenarios")
    io.write_scenarios(store.scenarios(spark, d), path)
    back = io.read_scenarios(spark, path)
    return back.join(eco.X, LABEL).select("scenario_id", *LABEL, coef("magnitude"), F.col("value").alias("x"))


@query
def portfolio_round_trip(spark, d):
    """Portfolios through CSV records, valued at the economy's output."""
    from ..sources import io
    eco = store.economy(spark, d)
    path = _fresh_folder(spark, "portfolios") + ".csv"
    io.write_portfolios(store.portfolios(spark), path)
    back = io.read_portfolios(spark, path)
    return back.join(eco.X, LABEL).select("portfolio_id", *LABEL, "weight", F.col("value").alias("x"))


@query
def history_round_trip(spark, d):
    """The production history written with years as rows and with years as
    columns; both files read back next to each other."""
    from ..sources import io
    eco = store.economy(spark, d)
    base = _fresh_folder(spark, "history")
    econ.production_history(eco.history).write.parquet(f"{base}/long")
    econ.production_history(eco.history, wide=True).write.parquet(f"{base}/wide")
    key = [*LABEL, "year"]
    rows = io.read_history(spark, f"{base}/long").select(*key, F.col("value").alias("from_rows"))
    cols = io.read_history(spark, f"{base}/wide").select(*key, F.col("value").alias("from_columns"))
    return rows.join(cols, key, "full_outer")


@query
def ratings_joined_round_trip(spark, d):
    """The joined ratings detail through CSV; every matched row read back."""
    from ..sources import io
    r, x = store.ratings_tables(spark, d)
    joined, _ = mat.match_ratings(r, x, "all")
    path = _fresh_folder(spark, "joined")
    io.write_joined(joined, path)
    back = io.read_ratings(spark, path)
    return back.where("sector is not null").select("isic_section", "isic_division", "isic_group", "isic_class", "sector")


@query
def scenario_yaml_round_trip(spark, d):
    """The scenario table as YAML records, valued at the economy's output."""
    from ..sources import io
    eco = store.economy(spark, d)
    path = _fresh_folder(spark, "scenarios") + ".yaml"
    io.write_scenarios(store.scenarios(spark, d), path)
    back = io.read_scenarios(spark, path)
    return back.join(eco.X, LABEL).select("scenario_id", *LABEL, coef("magnitude"), F.col("value").alias("x"))


@query
def portfolio_yaml_round_trip(spark, d):
    """Portfolios as YAML records, valued at the economy's output."""
    from ..sources import io
    eco = store.economy(spark, d)
    path = _fresh_folder(spark, "portfolios") + ".yaml"
    io.write_portfolios(store.portfolios(spark), path)
    back = io.read_portfolios(spark, path)
    return back.join(eco.X, LABEL).select("portfolio_id", *LABEL, "weight", F.col("value").alias("x"))


@query
def flow_quantiles(spark, d):
    """B2: quantiles of the flows of every producer region, all at once."""
    eco = store.economy(spark, d)
    out = search.quantiles(eco.Z, "value", fixtures.FLOW_QUANTILES, ["producer_region"])
    return out.select("producer_region", "q", money("value"))
