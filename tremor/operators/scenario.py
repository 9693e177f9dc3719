"""Scenarios and portfolios as tables.

A scenario is a set of rows ``(scenario_id, region, sector, magnitude)`` with the
magnitude as a share (0..1). User input comes in percent; every builder divides
by 100 once. Portfolios are ``(portfolio_id, region, sector, weight)`` with weights
in percent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import with_region_name
from ..session import broadcast_if_small

LABEL = ["region", "sector"]
SHOCKS = "scenario_id string, region string, sector string, magnitude double"
PORTFOLIO = "portfolio_id string, region string, sector string, weight double"

# np.isclose(total, 100) as the reference applies it: |total − 100| ≤ atol + rtol·100.
WEIGHT_ATOL = 1e-8
WEIGHT_RTOL = 1e-5
FULL_WEIGHT = 100.0


def valid_groups(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Group members limited to regions present; an emptied group disappears."""
    present = labels.select("region").distinct()
    return groups.join(present, "region", "left_semi").select("group_name", "region")


def expand_region(specs: DataFrame, labels: DataFrame, groups: DataFrame,
                  spec_col: str = "region_spec") -> DataFrame:
    """K2: each spec row's ``region_spec`` — ``All``, a group name, or one region —
    becomes one row per region. Group names win over region codes, as in the
    reference (the group lookup is tried first)."""
    regions = labels.select("region").distinct()
    vg = valid_groups(groups, labels)
    names = vg.select("group_name").distinct()
    all_rows = specs.where(F.col(spec_col) == "All").drop("region").crossJoin(broadcast_if_small(regions))
    grp_rows = (specs.where(F.col(spec_col) != "All").drop("region")
                .join(vg, F.col(spec_col) == F.col("group_name")).drop("group_name"))
    one_rows = (specs.where(F.col(spec_col) != "All")
                .join(names, F.col(spec_col) == F.col("group_name"), "left_anti")
                .withColumn("region", F.col(spec_col)))
    return all_rows.unionByName(grp_rows).unionByName(one_rows)


def single_shock(specs: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """K1/K2: ``(scenario_id, region_spec, sector, percent)`` → shocks, percent / 100."""
    return (expand_region(specs, labels, groups)
            .select("scenario_id", "region", "sector", (F.col("percent") / 100.0).alias("magnitude")))


def service_shock(specs: DataFrame, materiality: DataFrame, labels: DataFrame,
                  groups: DataFrame) -> DataFrame:
    """K3: ``(scenario_id, service, region_spec, percent)`` → every material sector
    of the service in every region of the spec; labels absent from the economy are
    dropped (inner join to the labels)."""
    sectors = materiality.select("service", "sector")
    with_sectors = specs.join(sectors, "service")
    expanded = expand_region(with_sectors, labels, groups)
    return (expanded.join(labels.select(*LABEL), LABEL)
            .select("scenario_id", "region", "sector", (F.col("percent") / 100.0).alias("magnitude")))


def catalog_options(labels: DataFrame, regions: DataFrame, groups: DataFrame, services: DataFrame,
                    preferred: str = "Pollination") -> DataFrame:
    """Everything a user may choose from, ``(kind, value, label, is_default)``: regions by
    name (the code where there is none), groups with a region of the economy, sectors, and
    services, of which the preferred one is the default, else the first by name.

    ``regions``: (region, name); ``services``: (service, ...), repeats allowed."""
    def plain(kind: str, df: DataFrame, value: str, label: str | None = None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(value).alias("value"), F.col(label or value).alias("label"),
                         F.lit(False).alias("is_default"))

    named = with_region_name(labels.select("region").distinct(), "region", regions)
    svc = services.select("service").distinct()
    # One row, joined without a key: the default is found where the services are.
    first = svc.agg(F.coalesce(F.max(F.when(F.col("service") == preferred, F.col("service"))), F.min("service")).alias("chosen"))
    listed = svc.crossJoin(F.broadcast(first)).select(
        F.lit("service").alias("kind"), F.col("service").alias("value"), F.col("service").alias("label"),
        (F.col("service") == F.col("chosen")).alias("is_default"))
    return (plain("region", named, "region", "region_name")
            .unionByName(plain("group", valid_groups(groups, labels).select("group_name").distinct(), "group_name"))
            .unionByName(plain("sector", labels.select("sector").distinct(), "sector")).unionByName(listed))


def custom_scenario(rows: DataFrame) -> DataFrame:
    """K4: ``(scenario_id, region, sector, percent)`` each with its own magnitude."""
    return rows.select("scenario_id", "region", "sector", (F.col("percent") / 100.0).alias("magnitude"))


def resolve_scenario(specs: DataFrame, custom: DataFrame, materiality: DataFrame,
                     labels: DataFrame, groups: DataFrame) -> DataFrame:
    """K8: per scenario, a non-empty custom list wins; otherwise ``shock_type``
    ``ecosystem`` expands the service's material sectors, else the single pick
    (region spec × sector). Both pick kinds go through one region expansion; only
    ecosystem rows are limited to labels of the economy (K3).

    ``specs``: ``(scenario_id, shock_type, region_spec, sector, service, percent)``;
    ``custom``: ``(scenario_id, region, sector, percent)``."""
    has_custom = custom.select("scenario_id").distinct()
    rest = specs.join(has_custom, "scenario_id", "left_anti")
    sectors = materiality.select("service", F.col("sector").alias("msector"))
    service = rest.where(F.col("shock_type") == "ecosystem")
    eco = (service.join(sectors, "service")
           .select("scenario_id", "region_spec", F.col("msector").alias("sector"), "percent", F.lit(True).alias("eco")))
    # A service without data leaves the single pick as it is.
    unknown = service.join(sectors.select("service").distinct(), "service", "left_anti").where(F.col("sector").isNotNull())
    single = (rest.where(F.col("shock_type") != "ecosystem").unionByName(unknown.select(*rest.columns))
              .select("scenario_id", "region_spec", "sector", "percent", F.lit(False).alias("eco")))
    expanded = expand_region(eco.unionByName(single), labels, groups)
    known = labels.select(*LABEL, F.lit(True).alias("known"))
    picked = (expanded.join(known, LABEL, "left")
              .where(~F.col("eco") | F.col("known").isNotNull())
              .select("scenario_id", "region", "sector", (F.col("percent") / 100.0).alias("magnitude")))
    return custom_scenario(custom).unionByName(picked)


def apply_edits(edits: DataFrame, key: str = "scenario_id", value: str = "magnitude") -> DataFrame:
    """K5/K6: replay an edit log ``(key, seq, op, region, sector, value)``.

    ``op``: ``add`` (add or update the label), ``delete`` (remove the label),
    ``clear`` (drop everything so far; a file upload is a ``clear`` followed by its
    rows). The last write per label wins; a delete leaves a tombstone that is
    filtered out."""
    last_clear = (edits.where(F.col("op") == "clear").groupBy(key).agg(F.max("seq").alias("clear_seq")))
    live = (edits.where(F.col("op") != "clear").join(last_clear, key, "left")
            .where(F.col("clear_seq").isNull() | (F.col("seq") > F.col("clear_seq"))))
    w = Window.partitionBy(key, *LABEL).orderBy(F.col("seq").desc())
    return (live.withColumn("rn", F.row_number().over(w)).where((F.col("rn") == 1) & (F.col("op") == "add"))
            .select(key, *LABEL, value))


def validate_portfolio(portfolio: DataFrame) -> DataFrame:
    """K7: per portfolio, total weight, count, and whether it is usable: total
    close to 100 (reference tolerance) and every weight positive."""
    tol = WEIGHT_ATOL + WEIGHT_RTOL * FULL_WEIGHT
    return (portfolio.groupBy("portfolio_id")
            .agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("n_assets"),
                 F.min("weight").alias("min_weight"))
            .select("portfolio_id", "total_weight", "n_assets",
                    ((F.abs(F.col("total_weight") - FULL_WEIGHT) <= tol) & (F.col("min_weight") > 0)).alias("is_valid")))


def can_add(portfolio: DataFrame, candidates: DataFrame) -> DataFrame:
    """K7 (edit check): a candidate ``(portfolio_id, region, sector, weight)`` is
    allowed if its weight is positive and the total after replacing the label's
    current weight stays at most 100."""
    totals = portfolio.groupBy("portfolio_id").agg(F.sum("weight").alias("current_total"))
    existing = portfolio.select("portfolio_id", *LABEL, F.col("weight").alias("existing"))
    return (candidates.join(totals, "portfolio_id", "left").join(existing, ["portfolio_id", *LABEL], "left")
            .select("portfolio_id", *LABEL, "weight",
                    (F.coalesce("current_total", F.lit(0.0)) - F.coalesce("existing", F.lit(0.0)) + F.col("weight")).alias("potential_total"))
            .withColumn("allowed", (F.col("weight") > 0) & (F.col("potential_total") <= FULL_WEIGHT)))


def shock_levels(X: DataFrame, shocks: DataFrame) -> DataFrame:
    """K9: pre-shock output ``x``, shocked output ``x·(1−mag)`` and change ``Δx``."""
    return (shocks.join(X.select(*LABEL, F.col("value").alias("x")), LABEL)
            .select("scenario_id", *LABEL, "magnitude", "x",
                    (F.col("x") * (1 - F.col("magnitude"))).alias("x_new"))
            .withColumn("delta_x", F.col("x_new") - F.col("x")))


def scenario_domain(shocks: DataFrame, labels: DataFrame, key: str | list[str] = "scenario_id") -> DataFrame:
    """Every label for every scenario: the dense output domain of a scenario's
    vectors (size = scenarios × labels = the size of the result itself)."""
    keys = [key] if isinstance(key, str) else list(key)
    return shocks.select(*keys).distinct().crossJoin(broadcast_if_small(labels.select(*LABEL)))


def partition_labels(labels: DataFrame, shocks: DataFrame) -> DataFrame:
    """Every label of every scenario, flagged shocked or not (semi/anti split)."""
    dom = scenario_domain(shocks, labels)
    flagged = shocks.select("scenario_id", *LABEL, F.lit(True).alias("shocked"))
    return (dom.join(flagged, ["scenario_id", *LABEL], "left")
            .select("scenario_id", *LABEL, F.coalesce("shocked", F.lit(False)).alias("shocked")))


def block(flows: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None,
          rows_in: bool = True, cols_in: bool = True) -> DataFrame:
    """Sub-matrix whose producers are (``rows_in``) or are not in ``rows`` and
    whose consumers are (``cols_in``) or are not in ``cols`` — semi/anti joins."""
    out = flows
    if rows is not None:
        r = rows.select(F.col("region").alias("producer_region"), F.col("sector").alias("producer_sector"))
        out = out.join(r, ["producer_region", "producer_sector"], "left_semi" if rows_in else "left_anti")
    if cols is not None:
        c = cols.select(F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"))
        out = out.join(c, ["consumer_region", "consumer_sector"], "left_semi" if cols_in else "left_anti")
    return out


def block_summary(flows: DataFrame, shocks: DataFrame) -> DataFrame:
    """J7 per scenario: cells and sum of the MM, MN, NM blocks (M = shocked labels,
    first letter = producer side) from the cells touching M only; NN is the rest
    of the matrix, so no scenario × matrix product is ever formed."""
    s = shocks.select("scenario_id", *LABEL).distinct()
    pm = s.select("scenario_id", F.col("region").alias("producer_region"), F.col("sector").alias("producer_sector"))
    cm = s.select("scenario_id", F.col("region").alias("consumer_region"), F.col("sector").alias("consumer_sector"))
    cell = ["producer_region", "producer_sector", "consumer_region", "consumer_sector"]
    by_p = flows.join(pm, ["producer_region", "producer_sector"]).select("scenario_id", *cell, "value", F.lit(1).alias("pm"), F.lit(0).alias("cm"))
    by_c = flows.join(cm, ["consumer_region", "consumer_sector"]).select("scenario_id", *cell, "value", F.lit(0).alias("pm"), F.lit(1).alias("cm"))
    touching = (by_p.unionByName(by_c).groupBy("scenario_id", *cell)
                .agg(F.first("value").alias("value"), F.max("pm").alias("pm"), F.max("cm").alias("cm"))
                .withColumn("block", F.concat(F.when(F.col("pm") == 1, "M").otherwise("N"),
                                              F.when(F.col("cm") == 1, "M").otherwise("N"))))
    parts = touching.groupBy("scenario_id", "block").agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
    whole = flows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t"))
    sums = (shocks.select("scenario_id").distinct().join(parts, "scenario_id", "left").groupBy("scenario_id")
            .pivot("block", ["MM", "MN", "NM"]).agg(F.first("cells").alias("cells"), F.first("total").alias("total")))
    sums = sums.join(F.broadcast(whole))  # one row
    n = lambda b: F.coalesce(F.col(f"{b}_cells"), F.lit(0).cast("long"))
    t = lambda b: F.coalesce(F.col(f"{b}_total"), F.lit(0.0))
    named = [F.struct(F.lit(b).alias("block"), n(b).alias("cells"), t(b).alias("total")) for b in ("MM", "MN", "NM")]
    rest = F.struct(F.lit("NN").alias("block"), (F.col("n") - n("MM") - n("MN") - n("NM")).alias("cells"),
                    (F.coalesce("t", F.lit(0.0)) - t("MM") - t("MN") - t("NM")).alias("total"))
    return sums.select("scenario_id", F.explode(F.array(*named, rest)).alias("b")).select("scenario_id", "b.*")


def at_labels(vector: DataFrame, targets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The vector's value at each target label (left join; use
    :func:`missing_labels` to enforce V1)."""
    on = [*(keys or []), *LABEL]
    return targets.join(vector, on, "left")


def rejects(shocks: DataFrame, labels: DataFrame) -> DataFrame:
    """V1-V3: shock rows that break a rule, once per rule: ``unknown_label`` (not in the
    economy), ``duplicate`` (label listed more than once in the scenario) or
    ``bad_magnitude`` (null or outside [0, 1]). ``(scenario_id, region, sector,
    magnitude, rule)``."""
    known = labels.select(*LABEL, F.lit(True).alias("known")).distinct()
    many = F.count(F.lit(1)).over(Window.partitionBy("scenario_id", *LABEL)) > 1
    m = F.col("magnitude")
    found = (shocks.select("scenario_id", *LABEL, "magnitude").join(known, LABEL, "left")
             .withColumn("rules", F.filter(F.array(
                 F.when(F.col("known").isNull(), "unknown_label"), F.when(many, "duplicate"),
                 F.when(m.isNull() | F.isnan(m) | (m < 0) | (m > 1), "bad_magnitude")), lambda r: r.isNotNull())))
    return found.select("scenario_id", *LABEL, "magnitude", F.explode("rules").alias("rule"))


def validate_shocks(shocks: DataFrame, labels: DataFrame) -> None:
    """Raises if any shock breaks V1-V3, with the number of rows per rule (one
    aggregation; at most three rows reach the driver)."""
    broken = {r["rule"]: r["n"] for r in rejects(shocks, labels).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    if broken:
        raise ValueError("invalid shocks: " + ", ".join(f"{n} {rule}" for rule, n in sorted(broken.items())))


def require_labels(targets: DataFrame, labels: DataFrame, what: str) -> None:
    """V1 for homes and assets: raises if a label is not in the economy."""
    n = missing_labels(targets, labels).count()
    if n:
        raise ValueError(f"{n} {what} not among the labels of the economy")


def missing_labels(targets: DataFrame, labels: DataFrame) -> DataFrame:
    """V1: target rows whose label is not in the economy (should be empty)."""
    return targets.join(labels.select(*LABEL), LABEL, "left_anti")


def duplicate_shocks(shocks: DataFrame) -> DataFrame:
    """V2: labels listed more than once in a scenario (should be empty)."""
    return shocks.groupBy("scenario_id", *LABEL).count().where(F.col("count") > 1)


def bad_magnitudes(shocks: DataFrame) -> DataFrame:
    """V3: magnitudes outside [0, 1] (should be empty)."""
    return shocks.where((F.col("magnitude") < 0) | (F.col("magnitude") > 1) | F.col("magnitude").isNull())
