"""Plain SQL (DuckDB dialect) for every driver query, run by the driver on the same
parquet tables to check the Spark results. Built from shared CTE fragments; series
use ``WITH RECURSIVE`` with an aggregate in the recursive term and sum many more terms
than double precision can tell apart."""

from __future__ import annotations

from . import fixtures

SQL: dict[str, str] = {}
TERMS = fixtures.ORACLE_TERMS


def _q(s):
    return "'" + str(s).replace("'", "''") + "'"


def values(rows, cols) -> str:
    """A VALUES list as a derived table body."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return _q(v)
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"


ECONOMY = """
seg AS (SELECT sector, CAST(row_number() OVER (ORDER BY sector) - 1 AS INTEGER) AS sid
        FROM (SELECT DISTINCT c_mktsegment AS sector FROM customer) s0),
lines AS (
  SELECT sn.n_name AS producer_region, ps.sector AS producer_sector,
         cn.n_name AS consumer_region, c.c_mktsegment AS consumer_sector,
         CAST(year(o.o_orderdate) AS INTEGER) AS year, l.l_returnflag AS rf, l.l_linestatus AS ls,
         CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS v, l.l_quantity AS q
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  JOIN nation cn ON c.c_nationkey = cn.n_nationkey
  JOIN seg ps ON ps.sid = CAST((p.p_size - 1) // 10 AS INTEGER)),
labels AS (SELECT n.n_name AS region, seg.sector FROM nation n CROSS JOIN seg),
zdec AS (SELECT producer_region, producer_sector, consumer_region, consumer_sector, SUM(v) AS z
         FROM lines WHERE rf <> 'N' GROUP BY ALL),
rsum AS (SELECT producer_region AS region, producer_sector AS sector, SUM(z) AS rs FROM zdec GROUP BY ALL),
csum AS (SELECT consumer_region AS region, consumer_sector AS sector, SUM(z) AS cs FROM zdec GROUP BY ALL),
xy AS (SELECT lb.region, lb.sector, COALESCE(rsum.rs, 0) AS rs,
              2 * GREATEST(COALESCE(rsum.rs, 0), COALESCE(csum.cs, 0)) + 1 AS xdec
       FROM labels lb LEFT JOIN rsum USING (region, sector) LEFT JOIN csum USING (region, sector)),
X AS (SELECT region, sector, CAST(xdec AS DOUBLE) AS value FROM xy),
Y AS (SELECT region, sector, CAST(xdec - rs AS DOUBLE) AS value FROM xy),
Z AS (SELECT producer_region, producer_sector, consumer_region, consumer_sector, CAST(z AS DOUBLE) AS value FROM zdec),
A AS (SELECT z.producer_region, z.producer_sector, z.consumer_region, z.consumer_sector, z.value / x.value AS value
      FROM Z z JOIN X x ON z.consumer_region = x.region AND z.consumer_sector = x.sector WHERE x.value <> 0),
B AS (SELECT z.producer_region, z.producer_sector, z.consumer_region, z.consumer_sector, z.value / x.value AS value
      FROM Z z JOIN X x ON z.producer_region = x.region AND z.producer_sector = x.sector WHERE x.value <> 0),
regions AS (SELECT n_name AS region, 'Nation ' || CAST(n_nationkey AS VARCHAR) AS name,
                   CASE WHEN n_nationkey % 10 <> 9 THEN 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS iso3
            FROM nation),
groups AS (SELECT r.r_name AS group_name, n.n_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
           UNION ALL SELECT 'CORE', n_name FROM nation WHERE n_nationkey < 8
           UNION ALL SELECT 'EMPTY', 'XX'),
A_col AS (SELECT consumer_region AS src_region, consumer_sector AS src_sector, producer_region AS dst_region, producer_sector AS dst_sector, value FROM A),
A_row AS (SELECT producer_region AS src_region, producer_sector AS src_sector, consumer_region AS dst_region, consumer_sector AS dst_sector, value FROM A),
B_row AS (SELECT producer_region AS src_region, producer_sector AS src_sector, consumer_region AS dst_region, consumer_sector AS dst_sector, value FROM B),
B_col AS (SELECT consumer_region AS src_region, consumer_sector AS src_sector, producer_region AS dst_region, producer_sector AS dst_sector, value FROM B)
"""

RATINGS = """
cls AS (SELECT DISTINCT p_type AS isic_section,
               'D' || CAST(CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) % 5 AS VARCHAR) AS isic_division,
               p_brand AS isic_group,
               p_brand || '.' || CAST(CAST((p_size - 1) // 10 AS INTEGER) AS VARCHAR) AS isic_class,
               CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS bn,
               CAST((p_size - 1) // 10 AS INTEGER) AS grp,
               CAST(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) AS INTEGER) - 1 AS tn
        FROM part),
hashed AS (SELECT c.*, k.k, (tn * 311 + bn * 127 + grp * 53 + k.k * k.k * 389) % 1999 AS h
           FROM cls c CROSS JOIN (SELECT unnest(range(1, 9)) AS k) k),
rlong AS (SELECT isic_section, isic_division, isic_group, isic_class, 'service_' || CAST(k AS VARCHAR) AS service,
                 CASE WHEN h % 11 = 10 THEN NULL WHEN h < k THEN 'VH' WHEN h < 10 * k THEN 'H'
                      WHEN h < 900 THEN 'M' WHEN h < 1500 THEN 'L' ELSE 'VL' END AS rating
          FROM hashed),
ratings AS (SELECT isic_section, isic_division, isic_group, isic_class FROM cls),
xwalk AS (SELECT c.isic_section, c.isic_division, c.isic_group, c.isic_class, seg.sector
          FROM cls c JOIN seg ON seg.sid = c.bn % 5
          WHERE NOT (c.grp = 3 AND c.bn % 2 = 0) AND c.bn <> 24),
j1 AS (SELECT r.*, x.sector FROM ratings r LEFT JOIN xwalk x
       ON r.isic_section IS NOT DISTINCT FROM x.isic_section AND r.isic_division IS NOT DISTINCT FROM x.isic_division
      AND r.isic_group IS NOT DISTINCT FROM x.isic_group AND r.isic_class IS NOT DISTINCT FROM x.isic_class),
x3 AS (SELECT isic_section, isic_division, isic_group, sector FROM xwalk),
j2_all AS (SELECT r.*, x.sector FROM ratings r LEFT JOIN x3 x
           ON r.isic_section IS NOT DISTINCT FROM x.isic_section AND r.isic_division IS NOT DISTINCT FROM x.isic_division
          AND r.isic_group IS NOT DISTINCT FROM x.isic_group),
j2_unm AS (SELECT r.*, x.sector FROM (SELECT isic_section, isic_division, isic_group, isic_class FROM j1 WHERE sector IS NULL) r
           LEFT JOIN x3 x ON r.isic_section IS NOT DISTINCT FROM x.isic_section
          AND r.isic_division IS NOT DISTINCT FROM x.isic_division AND r.isic_group IS NOT DISTINCT FROM x.isic_group),
merged_all AS (SELECT * FROM j1 WHERE NOT EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)
               UNION ALL SELECT * FROM j1 WHERE sector IS NOT NULL AND EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)
               UNION ALL SELECT * FROM j2_all WHERE EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)),
merged_unm AS (SELECT * FROM j1 WHERE NOT EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)
               UNION ALL SELECT * FROM j1 WHERE sector IS NOT NULL AND EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)
               UNION ALL SELECT * FROM j2_unm WHERE EXISTS (SELECT 1 FROM j1 WHERE sector IS NULL)),
mcount_all AS (SELECT rl.service, m.sector, COUNT(*) FILTER (WHERE rl.rating = 'VH') AS vh,
                      COUNT(*) FILTER (WHERE rl.rating = 'H') AS h, COUNT(*) AS n
               FROM merged_all m JOIN rlong rl USING (isic_section, isic_division, isic_group, isic_class)
               WHERE m.sector IS NOT NULL GROUP BY ALL),
mcount_unm AS (SELECT rl.service, m.sector, COUNT(*) FILTER (WHERE rl.rating = 'VH') AS vh,
                      COUNT(*) FILTER (WHERE rl.rating = 'H') AS h, COUNT(*) AS n
               FROM merged_unm m JOIN rlong rl USING (isic_section, isic_division, isic_group, isic_class)
               WHERE m.sector IS NOT NULL GROUP BY ALL),
material_all AS (SELECT service, sector FROM mcount_all WHERE vh >= 1 OR (n > 0 AND (vh + h) / n > 0.5) OR vh + h >= 3),
material_unm AS (SELECT service, sector FROM mcount_unm WHERE vh >= 1 OR (n > 0 AND (vh + h) / n > 0.5) OR vh + h >= 3)
"""


def _region_expand(specs_cte: str) -> str:
    """K2 over a CTE with columns (…, region_spec): All / valid group / single region."""
    return f"""
    SELECT s.*, rg.region FROM {specs_cte} s JOIN (SELECT DISTINCT region FROM labels) rg ON s.region_spec = 'All'
    UNION ALL
    SELECT s.*, vg.region FROM {specs_cte} s JOIN vgroups vg ON s.region_spec <> 'All' AND s.region_spec = vg.group_name
    UNION ALL
    SELECT s.*, s.region_spec AS region FROM {specs_cte} s
    WHERE s.region_spec <> 'All' AND s.region_spec NOT IN (SELECT group_name FROM vgroups)"""


def scenarios_cte() -> str:
    specs = values(fixtures.SPECS, ["scenario_id", "shock_type", "region_spec", "sector", "service", "percent"])
    custom = values(fixtures.CUSTOM, ["scenario_id", "region", "sector", "percent"])
    return f"""
specs AS {specs},
custom AS {custom},
vgroups AS (SELECT group_name, region FROM groups WHERE region IN (SELECT region FROM labels)),
rest AS (SELECT * FROM specs WHERE scenario_id NOT IN (SELECT scenario_id FROM custom)),
eco_specs AS (SELECT r.scenario_id, r.region_spec, r.percent, m.sector AS msector
              FROM rest r JOIN material_all m ON r.service = m.service WHERE r.shock_type = 'ecosystem'),
eco_exp AS ({_region_expand('eco_specs')}),
one_specs AS (SELECT scenario_id, region_spec, sector, percent FROM rest WHERE shock_type <> 'ecosystem'
              OR (sector IS NOT NULL AND service NOT IN (SELECT service FROM material_all))),
one_exp AS ({_region_expand('one_specs')}),
shocks AS (
  SELECT scenario_id, region, sector, percent / 100.0 AS magnitude FROM custom
  UNION ALL SELECT e.scenario_id, e.region, e.msector, e.percent / 100.0 FROM eco_exp e
       JOIN labels lb ON lb.region = e.region AND lb.sector = e.msector
  UNION ALL SELECT scenario_id, region, sector, percent / 100.0 FROM one_exp),
levels AS (SELECT s.scenario_id, s.region, s.sector, s.magnitude, x.value AS x,
                  x.value * (1 - s.magnitude) - x.value AS delta_x
           FROM shocks s JOIN X x USING (region, sector)),
dom AS (SELECT sc.scenario_id, lb.region, lb.sector FROM (SELECT DISTINCT scenario_id FROM shocks) sc CROSS JOIN labels lb)
"""


def series(name: str, seed: str, matrix: str, mask: str | None) -> str:
    """Recursive CTE ``name(k, run, region, sector, d)`` of many terms; ``seed`` has
    (run, region, sector, d) with masked labels already removed; ``mask`` has
    (run, region, sector)."""
    masked = (f"AND NOT EXISTS (SELECT 1 FROM {mask} mk WHERE mk.run = s.run AND mk.region = m.dst_region "
              f"AND mk.sector = m.dst_sector)") if mask else ""
    return f"""
{name}(k, run, region, sector, d) AS (
  SELECT 0, run, region, sector, d FROM {seed}
  UNION ALL
  SELECT any_value(s.k) + 1, s.run, m.dst_region, m.dst_sector, SUM(s.d * m.value)
  FROM {name} s JOIN {matrix} m ON s.region = m.src_region AND s.sector = m.src_sector
  WHERE s.k < {TERMS - 1} {masked}
  GROUP BY s.run, m.dst_region, m.dst_sector),
{name}_sum AS (SELECT run, region, sector, SUM(d) AS value FROM {name} GROUP BY ALL)"""


def impact_ctes(method: str, shocks: str = "shocks", levels: str = "levels", dom: str = "dom", out: str | None = None) -> str:
    """Δx over the domain for ``method`` as CTE ``{out}(scenario_id, region, sector, delta_x)``."""
    out = out or f"dx_{method}"
    mask = f"{out}_mask"
    mask_cte = f"{mask} AS (SELECT scenario_id AS run, region, sector FROM {shocks})"
    if method == "ghosh":
        seed = f"""SELECT l.scenario_id AS run, b.consumer_region AS region, b.consumer_sector AS sector, SUM(l.delta_x * b.value) AS d
                   FROM {levels} l JOIN B b ON b.producer_region = l.region AND b.producer_sector = l.sector GROUP BY ALL"""
        matrix = "B_row"
    elif method == "leontief":
        seed = f"""SELECT run, region, sector, SUM(d) AS d FROM (
                     SELECT l.scenario_id AS run, a.consumer_region AS region, a.consumer_sector AS sector, l.delta_x * a.value AS d
                     FROM {levels} l JOIN A a ON a.producer_region = l.region AND a.producer_sector = l.sector
                     UNION ALL
                     SELECT l.scenario_id, a.producer_region, a.producer_sector, -(a.value * l.x)
                     FROM {levels} l JOIN A a ON a.consumer_region = l.region AND a.consumer_sector = l.sector) t GROUP BY ALL"""
        matrix = "A_col"
    elif method == "textbook":
        seed = f"""SELECT l.scenario_id AS run, a.producer_region AS region, a.producer_sector AS sector, SUM(a.value * l.delta_x) AS d
                   FROM {levels} l JOIN A a ON a.consumer_region = l.region AND a.consumer_sector = l.sector GROUP BY ALL"""
        matrix = "A_col"
    else:
        return f"""
{out} AS (SELECT dm.scenario_id, dm.region, dm.sector, COALESCE(l.delta_x, 0.0) AS delta_x
          FROM {dom} dm LEFT JOIN {levels} l USING (scenario_id, region, sector))"""
    seed_cte = f"""{out}_seed AS (SELECT * FROM ({seed}) sd
        WHERE NOT EXISTS (SELECT 1 FROM {mask} mk WHERE mk.run = sd.run AND mk.region = sd.region AND mk.sector = sd.sector))"""
    return f""",
{mask_cte},
{seed_cte},
{series(out + '_it', out + '_seed', matrix, mask)},
{out} AS (SELECT dm.scenario_id, dm.region, dm.sector, COALESCE(l.delta_x, f.value, 0.0) AS delta_x
          FROM {dom} dm LEFT JOIN {levels} l USING (scenario_id, region, sector)
          LEFT JOIN {out}_it_sum f ON f.run = dm.scenario_id AND f.region = dm.region AND f.sector = dm.sector)"""


def with_(*parts: str) -> str:
    body = ",\n".join(p.strip().strip(",") for p in parts if p.strip())
    return "WITH RECURSIVE " + body + "\n"


def R(expr: str, d: int) -> str:
    """Same rounding as the Spark side: nudge ties by 1e-13 relative, round half
    away from zero, -0.0 → 0.0."""
    return f"(round(({expr}) * CAST(1.0000000000001 AS DOUBLE), {d}) + 0.0)"


def sql(name: str):
    def deco(fn):
        SQL[name] = fn()
        return fn
    return deco


CELL = "producer_region, producer_sector, consumer_region, consumer_sector"

# ---------------------------------------------------------------- economy

SQL["flow_table"] = with_(ECONOMY) + f"""
SELECT a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, a.value * x.value AS flow
FROM A a JOIN X x ON a.consumer_region = x.region AND a.consumer_sector = x.sector"""

SQL["gross_output"] = with_(ECONOMY, "yseed AS (SELECT 'y' AS run, region, sector, value AS d FROM Y)",
                            series("xit", "yseed", "A_col", None)) + f"""
SELECT region, sector, {R('value', 0)} AS gross_output FROM xit_sum"""

SQL["final_demand"] = with_(ECONOMY) + f"SELECT region, sector, {R('value', 2)} AS final_demand FROM Y"
SQL["final_demand_categories"] = with_(ECONOMY, """n AS (SELECT producer_region AS region, producer_sector AS sector, ls AS category,
      CAST(SUM(v) AS DOUBLE) AS value FROM lines WHERE rf = 'N' GROUP BY ALL)""") + f"""
SELECT region, sector, category, {R('value', 2)} AS value FROM n
UNION ALL
SELECT y.region, y.sector, 'balance', {R('y.value - COALESCE(s.t, 0.0)', 2)} FROM Y y
LEFT JOIN (SELECT region, sector, SUM(value) AS t FROM n GROUP BY ALL) s ON s.region = y.region AND s.sector = y.sector"""

SQL["technical_coefficients"] = with_(ECONOMY) + f"SELECT {CELL}, {R('value', 10)} AS value FROM A"
SQL["allocation_coefficients"] = with_(ECONOMY) + f"SELECT {CELL}, {R('value', 10)} AS value FROM B"

SQL["residual_demand"] = with_(ECONOMY, """ax AS (SELECT a.producer_region AS region, a.producer_sector AS sector, SUM(a.value * x.value) AS mv
      FROM A a JOIN X x ON a.consumer_region = x.region AND a.consumer_sector = x.sector GROUP BY ALL)""") + f"""
SELECT COALESCE(x.region, ax.region) AS region, COALESCE(x.sector, ax.sector) AS sector,
       {R('COALESCE(x.value, 0.0) - COALESCE(ax.mv, 0.0)', 2)} AS value
FROM X x FULL OUTER JOIN ax ON x.region = ax.region AND x.sector = ax.sector"""


def _inverse_top_sql(kind: str) -> str:
    if kind == "L":
        seed = "useed AS (SELECT region || '|' || sector AS run, region, sector, CAST(1.0 AS DOUBLE) AS d FROM labels)"
        it = series("inv", "useed", "A_row", None)
        cells = """cells AS (SELECT split_part(run, '|', 1) AS producer_region, split_part(run, '|', 2) AS producer_sector,
                                  region AS consumer_region, sector AS consumer_sector, value FROM inv_sum)"""
    else:
        seed = "useed AS (SELECT region || '|' || sector AS run, region, sector, CAST(1.0 AS DOUBLE) AS d FROM labels)"
        it = series("inv", "useed", "B_col", None)
        cells = """cells AS (SELECT region AS producer_region, sector AS producer_sector,
                                  split_part(run, '|', 1) AS consumer_region, split_part(run, '|', 2) AS consumer_sector, value FROM inv_sum)"""
    return with_(ECONOMY, seed, it, cells) + f"""
SELECT CAST(rank AS BIGINT) AS rank, {CELL}, {R('value', 10)} AS value FROM (
  SELECT *, row_number() OVER (ORDER BY value DESC, {CELL}) AS rank FROM cells
  WHERE producer_region <> consumer_region OR producer_sector <> consumer_sector) t
WHERE rank <= 50"""


SQL["leontief_inverse_top"] = _inverse_top_sql("L")
SQL["ghosh_inverse_top"] = _inverse_top_sql("G")

SQL["scaled_flows"] = with_(ECONOMY, f"""cs AS (SELECT a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, a.value * x.value AS by_column
          FROM A a JOIN X x ON a.consumer_region = x.region AND a.consumer_sector = x.sector)""",
                            f"""rs AS (SELECT b.producer_region, b.producer_sector, b.consumer_region, b.consumer_sector, x.value * b.value AS by_row
          FROM B b JOIN X x ON b.producer_region = x.region AND b.producer_sector = x.sector)""") + f"""
SELECT COALESCE(cs.producer_region, rs.producer_region) AS producer_region, COALESCE(cs.producer_sector, rs.producer_sector) AS producer_sector,
       COALESCE(cs.consumer_region, rs.consumer_region) AS consumer_region, COALESCE(cs.consumer_sector, rs.consumer_sector) AS consumer_sector,
       cs.by_column, rs.by_row
FROM cs FULL OUTER JOIN rs USING ({CELL})"""

SQL["two_step_flows"] = with_(ECONOMY) + f"""
SELECT l.producer_region, l.producer_sector, r.consumer_region, r.consumer_sector, {R('SUM(l.value * r.value)', 10)} AS value
FROM A l JOIN A r ON l.consumer_region = r.producer_region AND l.consumer_sector = r.producer_sector
GROUP BY l.producer_region, l.producer_sector, r.consumer_region, r.consumer_sector"""

_SECTORS = ", ".join(_q(s) for s in fixtures.SEARCH_SECTORS)
SQL["cross_border_flows"] = with_(ECONOMY) + f"""
SELECT {CELL}, value AS flow FROM Z
WHERE producer_sector IN ({_SECTORS})
  AND producer_region NOT IN (SELECT region FROM regions WHERE iso3 IS NULL)
  AND consumer_region NOT IN (SELECT region FROM regions WHERE iso3 IS NULL)
  AND producer_region <> consumer_region"""

SQL["extension_total"] = with_(ECONOMY, """ext AS (SELECT producer_region AS region, producer_sector AS sector, SUM(q) AS value
      FROM lines WHERE rf IN ('A', 'R') GROUP BY ALL)""") + """
SELECT lb.region, lb.sector, COALESCE(ext.value, 0.0) AS land_use FROM labels lb LEFT JOIN ext USING (region, sector)"""

# ---------------------------------------------------------------- propagation


def _impact_sql(method: str, select: str) -> str:
    return with_(ECONOMY, RATINGS, scenarios_cte(), impact_ctes(method)) + select


for _m, _n in [("ghosh", "ghosh_impact"), ("leontief", "leontief_impact"), ("textbook", "leontief_textbook")]:
    SQL[_n] = _impact_sql(_m, f"SELECT scenario_id, region, sector, {R('delta_x', 2)} AS delta_x FROM dx_{_m}")


def _dy(dx: str) -> str:
    return f"""dy AS (SELECT d.scenario_id, d.region, d.sector, d.delta_x - COALESCE(ad.v, 0.0) AS delta_y
      FROM {dx} d LEFT JOIN (SELECT x.scenario_id, a.producer_region AS region, a.producer_sector AS sector, SUM(a.value * x.delta_x) AS v
                             FROM {dx} x JOIN A a ON a.consumer_region = x.region AND a.consumer_sector = x.sector GROUP BY ALL) ad
      USING (scenario_id, region, sector))"""


SQL["required_demand"] = with_(ECONOMY, RATINGS, scenarios_cte(), impact_ctes("leontief"), _dy("dx_leontief")) + f"""
SELECT scenario_id, region, sector, {R('delta_y', 2)} AS delta_y FROM dy"""

SQL["direct_impact"] = with_(ECONOMY, RATINGS, scenarios_cte(), impact_ctes("direct"), _dy("dx_direct")) + f"""
SELECT d.scenario_id, d.region, d.sector, {R('d.delta_x', 2)} AS delta_x, {R('dy.delta_y', 2)} AS delta_y
FROM dx_direct d JOIN dy USING (scenario_id, region, sector)"""


def _top_impacts_sql(key: str) -> str:
    return with_(ECONOMY, RATINGS, scenarios_cte(), impact_ctes("ghosh"), f"""base AS (
  SELECT d.scenario_id, d.region, d.sector, d.delta_x, CASE WHEN x.value <> 0 THEN d.delta_x / x.value * 100.0 ELSE 0.0 END AS pct_change
  FROM dx_ghosh d JOIN X x USING (region, sector)
  WHERE NOT EXISTS (SELECT 1 FROM shocks s WHERE s.scenario_id = d.scenario_id AND s.region = d.region AND s.sector = d.sector))""",
                 f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY abs({key}) DESC, region, sector) AS rank FROM base)""") + f"""
SELECT r.scenario_id, CAST(r.rank AS BIGINT) AS rank, r.region, g.name AS country, r.sector, {R('r.delta_x', 2)} AS change, {R('r.pct_change', 6)} AS pct_change
FROM ranked r LEFT JOIN regions g ON g.region = r.region WHERE r.rank <= {fixtures.TOP_N}"""


SQL["top_impacts_pct"] = _top_impacts_sql("pct_change")
SQL["top_impacts_abs"] = _top_impacts_sql("delta_x")


# ---------------------------------------------------------------- shared inputs

HOMES = "homes AS " + values([(s, *fixtures.HOME) for s in fixtures.SCENARIO_IDS], ["scenario_id", "home_region", "home_sector"])
POSITIONS = "pos AS (SELECT *, weight / 100.0 AS w FROM " + values(
    [(s, *p) for s in fixtures.SCENARIO_IDS for p in fixtures.PORTFOLIOS if p[0] in fixtures.VALUED_PORTFOLIOS],
    ["scenario_id", "portfolio_id", "region", "sector", "weight"]) + " p0)"
PORTFOLIOS = "pf AS " + values(fixtures.PORTFOLIOS, ["portfolio_id", "region", "sector", "weight"])


def _base(*methods: str) -> list[str]:
    return [ECONOMY, RATINGS, scenarios_cte(), *[impact_ctes(m) for m in methods], HOMES, POSITIONS]


def _influence(method: str, targets: str) -> list[str]:
    """``infl(home_region, home_sector, region, sector, value)`` for the labels of
    CTE ``targets(region, sector)``: row of L, column of G, or column of A."""
    if method == "direct":
        return [f"""infl AS (SELECT a.consumer_region AS home_region, a.consumer_sector AS home_sector,
                    a.producer_region AS region, a.producer_sector AS sector, a.value FROM A a
                    JOIN (SELECT DISTINCT region, sector FROM {targets}) t ON a.consumer_region = t.region AND a.consumer_sector = t.sector)"""]
    matrix = "A_row" if method == "leontief" else "B_col"
    return [f"""iseed AS (SELECT DISTINCT region || '|' || sector AS run, region, sector, CAST(1.0 AS DOUBLE) AS d FROM {targets})""",
            series("iit", "iseed", matrix, None),
            """infl AS (SELECT split_part(run, '|', 1) AS home_region, split_part(run, '|', 2) AS home_sector, region, sector, value FROM iit_sum)"""]


def _causes(method: str) -> list[str]:
    model = "ghosh" if method == "direct" else method
    dx = f"dx_{model}"
    return [*_base(model), "htargets AS (SELECT home_region AS region, home_sector AS sector FROM homes)",
            *_influence(method, "htargets"), f"""
hv AS (SELECT h.scenario_id, h.home_region, h.home_sector, abs(d.delta_x) AS total_impact
       FROM homes h JOIN {dx} d ON d.scenario_id = h.scenario_id AND d.region = h.home_region AND d.sector = h.home_sector),
sv AS (SELECT s.scenario_id, s.region AS cause_region, s.sector AS cause_sector, abs(d.delta_x) AS shock_value
       FROM (SELECT DISTINCT scenario_id, region, sector FROM shocks) s JOIN {dx} d USING (scenario_id, region, sector)),
contrib AS (SELECT hv.scenario_id, hv.home_region, hv.home_sector, sv.cause_region, sv.cause_sector,
                   COALESCE(i.value, 0.0) * sv.shock_value AS contribution, hv.total_impact
            FROM hv JOIN sv USING (scenario_id)
            LEFT JOIN infl i ON i.home_region = hv.home_region AND i.home_sector = hv.home_sector
                            AND i.region = sv.cause_region AND i.sector = sv.cause_sector
            WHERE hv.total_impact >= 1e-10 AND (sv.cause_region <> hv.home_region OR sv.cause_sector <> hv.home_sector)),
causes AS (SELECT scenario_id, home_region, home_sector, CAST(NULL AS VARCHAR) AS cause_region, CAST(NULL AS VARCHAR) AS cause_sector, CAST(0.0 AS DOUBLE) AS contribution,
                  CASE WHEN total_impact >= 1e-10 THEN total_impact ELSE CAST(0.0 AS DOUBLE) END AS total_impact, CAST(0.0 AS DOUBLE) AS share_pct
           FROM hv WHERE (scenario_id, home_region, home_sector) NOT IN (SELECT scenario_id, home_region, home_sector FROM contrib)
           UNION ALL
           SELECT *, CASE WHEN SUM(contribution) OVER w > 0 THEN contribution / SUM(contribution) OVER w * 100.0 ELSE 0.0 END AS share_pct
           FROM contrib WINDOW w AS (PARTITION BY scenario_id, home_region, home_sector))"""]


CAUSE_COLS = f"""SELECT scenario_id, home_region, home_sector, cause_region, cause_sector, {R('contribution', 2)} AS contribution,
       {R('share_pct', 6)} AS share_pct, {R('total_impact', 2)} AS total_impact FROM causes"""

for _m in ("ghosh", "leontief", "direct"):
    SQL[f"home_attribution_{_m}"] = with_(*_causes(_m)) + CAUSE_COLS

SQL["portfolio_attribution"] = with_(*_base("ghosh"), "ptargets AS (SELECT region, sector FROM pos)", *_influence("ghosh", "ptargets"), """
tot AS (SELECT p.scenario_id, p.portfolio_id, SUM(abs(d.delta_x) * p.w) AS total_impact
        FROM pos p JOIN dx_ghosh d USING (scenario_id, region, sector) GROUP BY ALL HAVING SUM(abs(d.delta_x) * p.w) >= 1e-10),
sv AS (SELECT s.scenario_id, s.region AS cause_region, s.sector AS cause_sector, abs(d.delta_x) AS shock_value
       FROM (SELECT DISTINCT scenario_id, region, sector FROM shocks) s JOIN dx_ghosh d USING (scenario_id, region, sector)),
con AS (SELECT p.scenario_id, p.portfolio_id, sv.cause_region, sv.cause_sector,
               SUM(p.w * COALESCE(i.value, 0.0) * sv.shock_value) AS contribution
        FROM pos p JOIN sv USING (scenario_id)
        LEFT JOIN infl i ON i.home_region = p.region AND i.home_sector = p.sector AND i.region = sv.cause_region AND i.sector = sv.cause_sector
        GROUP BY ALL),
pc AS (SELECT c.*, t.total_impact,
              CASE WHEN SUM(c.contribution) OVER w > 0 THEN c.contribution / SUM(c.contribution) OVER w * 100.0 ELSE 0.0 END AS share_pct
       FROM con c JOIN tot t USING (scenario_id, portfolio_id) WINDOW w AS (PARTITION BY c.scenario_id, c.portfolio_id))""") + f"""
SELECT scenario_id, portfolio_id, cause_region, cause_sector, {R('contribution', 2)} AS contribution,
       {R('share_pct', 6)} AS share_pct, {R('total_impact', 2)} AS total_impact FROM pc"""


def _rolled(level: str) -> str:
    item = {"country": "COALESCE(g.name, c.cause_region)", "sector": "c.cause_sector",
            "none": "COALESCE(g.name, c.cause_region) || ' - ' || c.cause_sector"}[level]
    return f"""rolled AS (SELECT c.scenario_id, {item} AS item, SUM(c.share_pct) AS value
       FROM causes c LEFT JOIN regions g ON g.region = c.cause_region WHERE c.cause_region IS NOT NULL GROUP BY ALL)"""


SQL["causes_by_country"] = with_(*_causes("ghosh"), _rolled("country")) + f"SELECT scenario_id, item, {R('value', 6)} AS value FROM rolled"
SQL["causes_by_sector"] = with_(*_causes("ghosh"), _rolled("sector")) + f"SELECT scenario_id, item, {R('value', 6)} AS value FROM rolled"
SQL["top_contributors"] = with_(*_causes("ghosh"), _rolled("none"), """
ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY value DESC, item) AS rn FROM rolled),
top3 AS (SELECT scenario_id, CAST(rn AS BIGINT) AS position, item, value FROM ranked WHERE rn <= 3),
others AS (SELECT scenario_id, CAST(4 AS BIGINT) AS position, 'Others' AS item, SUM(value) AS value FROM ranked WHERE rn > 3
         GROUP BY scenario_id HAVING SUM(value) > 1e-6),
shown AS (SELECT * FROM top3 UNION ALL SELECT * FROM others),
ts AS (SELECT scenario_id, SUM(value) AS top_share FROM top3 GROUP BY scenario_id),
allrows AS (SELECT * FROM shown UNION ALL SELECT scenario_id, CAST(5 AS BIGINT), 'Total', SUM(value) FROM shown GROUP BY scenario_id)""") + f"""
SELECT a.scenario_id, a.position, a.item, {R('a.value', 6)} AS value, {R('ts.top_share', 6)} AS top_share
FROM allrows a LEFT JOIN ts USING (scenario_id)"""

SQL["country_contributions"] = with_(*_causes("ghosh")) + f"""
SELECT c.scenario_id, c.cause_region, g.iso3, COALESCE(g.name, g.region) AS name, {R('SUM(c.share_pct)', 6)} AS share_pct
FROM causes c JOIN regions g ON g.region = c.cause_region WHERE g.iso3 IS NOT NULL
GROUP BY c.scenario_id, c.cause_region, g.iso3, COALESCE(g.name, g.region)"""

SQL["signed_contributions"] = with_(*_causes("ghosh"), """sg AS (SELECT scenario_id, cause_region, cause_sector, -contribution AS value FROM causes WHERE contribution <> 0)""") + f"""
SELECT scenario_id, cause_region, cause_sector, {R('value', 2)} AS value, false AS is_total FROM sg
UNION ALL SELECT scenario_id, 'Total Impact', NULL, {R('SUM(value)', 2)}, true FROM sg GROUP BY scenario_id"""

# ---------------------------------------------------------------- reports


def _pct(delta: str, base: str) -> str:
    return f"CASE WHEN {base} > 1e-9 THEN {delta} / {base} * 100.0 ELSE 0.0 END"


SQL["home_impact"] = with_(*_base("ghosh")) + f"""
SELECT h.scenario_id, h.home_region, h.home_sector, x.value AS before, {R('d.delta_x', 2)} AS delta_x,
       {R('x.value + d.delta_x', 2)} AS after, {R(_pct('d.delta_x', 'x.value'), 6)} AS pct_change
FROM homes h JOIN X x ON x.region = h.home_region AND x.sector = h.home_sector
JOIN dx_ghosh d ON d.scenario_id = h.scenario_id AND d.region = h.home_region AND d.sector = h.home_sector"""

SQL["portfolio_impact"] = with_(*_base("ghosh"), """pa AS (SELECT p.scenario_id, p.portfolio_id, SUM(x.value * p.w) AS before, SUM(d.delta_x * p.w) AS delta,
       SUM((x.value + d.delta_x) * p.w) AS after
       FROM pos p JOIN X x USING (region, sector) JOIN dx_ghosh d USING (scenario_id, region, sector) GROUP BY ALL)""") + f"""
SELECT scenario_id, portfolio_id, {R('before', 2)} AS before, {R('delta', 2)} AS delta, {R('after', 2)} AS after,
       {R(_pct('delta', 'before'), 6)} AS pct_change, {R('after - before', 2)} AS total_abs_change,
       {R(_pct('(after - before)', 'before'), 6)} AS total_rel_change FROM pa"""

SQL["portfolio_breakdown"] = with_(*_base("ghosh")) + f"""
SELECT p.scenario_id, p.portfolio_id, p.region, COALESCE(g.name, p.region) AS region_name, p.sector, p.weight,
       {R('d.delta_x', 2)} AS abs_change, {R(_pct('d.delta_x', 'x.value'), 6)} AS rel_change
FROM pos p JOIN X x USING (region, sector) JOIN dx_ghosh d USING (scenario_id, region, sector)
LEFT JOIN regions g ON g.region = p.region"""

SQL["headline"] = with_(*_base("ghosh"), f"""hp AS (SELECT h.scenario_id, {_pct('d.delta_x', 'x.value')} AS pct_change
      FROM homes h JOIN X x ON x.region = h.home_region AND x.sector = h.home_sector
      JOIN dx_ghosh d ON d.scenario_id = h.scenario_id AND d.region = h.home_region AND d.sector = h.home_sector)""",
                        "ns AS (SELECT scenario_id, COUNT(*) AS n_shocks FROM shocks GROUP BY scenario_id)") + f"""
SELECT s.scenario_id,
       CASE WHEN s.region_spec = 'All' THEN 'All Regions'
            WHEN s.region_spec IN (SELECT group_name FROM vgroups) THEN s.region_spec
            ELSE COALESCE(g.name, s.region_spec) END AS region_label,
       ns.n_shocks, {R('hp.pct_change', 6)} AS pct_change
FROM specs s LEFT JOIN regions g ON g.region = s.region_spec JOIN ns USING (scenario_id) JOIN hp USING (scenario_id)"""


def _history_sql(strict: bool) -> str:
    bad = """AND l.scenario_id NOT IN (SELECT s.scenario_id FROM shocks s
             WHERE NOT EXISTS (SELECT 1 FROM hist h WHERE h.region = s.region AND h.sector = s.sector))""" if strict else ""
    return with_(*_base(), """hist AS (SELECT producer_region AS region, producer_sector AS sector, year, CAST(SUM(v) AS DOUBLE) AS value FROM lines GROUP BY ALL)""",
                 "years AS (SELECT DISTINCT year FROM hist)",
                 """lev AS (SELECT s.scenario_id, SUM(CAST(x.value AS DECIMAL(38,4))) AS base_output,
           SUM(CAST(x.value AS DECIMAL(38,4)) * (1 - s.magnitude)) AS post_shock_output
           FROM shocks s JOIN X x USING (region, sector) GROUP BY s.scenario_id)""",
                 """hs AS (SELECT s.scenario_id, h.year, SUM(CAST(h.value AS DECIMAL(38,4))) AS h
          FROM shocks s JOIN hist h USING (region, sector) GROUP BY ALL)""") + f"""
SELECT l.scenario_id, y.year, CAST(COALESCE(hs.h, 0) AS DOUBLE) AS history_output, CAST(l.base_output AS DOUBLE) AS base_output,
       {R('l.post_shock_output', 2)} AS post_shock_output
FROM lev l CROSS JOIN years y LEFT JOIN hs ON hs.scenario_id = l.scenario_id AND hs.year = y.year
WHERE true {bad}"""


SQL["shock_history"] = _history_sql(False)
SQL["shock_history_strict"] = _history_sql(True)

SQL["lost_input_flows"] = with_(*_base("leontief")) + f"""
SELECT d.scenario_id, a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, {R('abs(a.value * d.delta_x)', 2)} AS flow
FROM A a JOIN dx_leontief d ON a.consumer_region = d.region AND a.consumer_sector = d.sector
WHERE abs(a.value * d.delta_x) > 0"""


def _paths_common() -> list[str]:
    return [*_base("ghosh"), """
flows AS (SELECT d.scenario_id, a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, abs(a.value * d.delta_x) AS flow
          FROM A a JOIN dx_ghosh d ON a.consumer_region = d.region AND a.consumer_sector = d.sector WHERE abs(a.value * d.delta_x) > 0),
to_home AS (SELECT f.scenario_id, f.producer_region AS region, f.producer_sector AS sector, f.flow AS s_flow
            FROM flows f JOIN homes h ON f.scenario_id = h.scenario_id AND f.consumer_region = h.home_region AND f.consumer_sector = h.home_sector),
hdom AS (SELECT h.scenario_id, lb.region, lb.sector FROM (SELECT DISTINCT scenario_id FROM homes) h CROSS JOIN labels lb),
sup AS (SELECT * FROM (SELECT d.scenario_id, d.region, d.sector,
               row_number() OVER (PARTITION BY d.scenario_id ORDER BY COALESCE(t.s_flow, 0.0) DESC, d.region, d.sector) AS s_rank
        FROM hdom d LEFT JOIN to_home t USING (scenario_id, region, sector)) x WHERE s_rank <= 15),
shock_cust AS (SELECT f.scenario_id, f.consumer_region AS region, f.consumer_sector AS sector, SUM(f.flow) AS c_flow
               FROM flows f JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector
               GROUP BY ALL),
cus AS (SELECT * FROM (SELECT d.scenario_id, d.region, d.sector,
               row_number() OVER (PARTITION BY d.scenario_id ORDER BY COALESCE(c.c_flow, 0.0) DESC, d.region, d.sector) AS c_rank
        FROM dom d LEFT JOIN shock_cust c USING (scenario_id, region, sector)) x WHERE c_rank <= 15),
mids AS (SELECT * FROM (SELECT s.scenario_id, s.region, s.sector, h.home_region, h.home_sector,
                row_number() OVER (PARTITION BY s.scenario_id ORDER BY s.s_rank) AS position
         FROM sup s JOIN cus c USING (scenario_id, region, sector) JOIN homes h USING (scenario_id)
         WHERE NOT EXISTS (SELECT 1 FROM shocks k WHERE k.scenario_id = s.scenario_id AND k.region = s.region AND k.sector = s.sector)
           AND (s.region <> h.home_region OR s.sector <> h.home_sector)) x WHERE position <= 5)"""]


EDGE = "f.scenario_id, f.producer_region AS source_region, f.producer_sector AS source_sector, f.consumer_region AS target_region, f.consumer_sector AS target_sector, f.flow"
SQL["impact_paths"] = with_(*_paths_common(), f"""
edges AS (
  SELECT {EDGE}, 'shock_to_intermediate' AS edge FROM flows f
  JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector
  JOIN mids m ON f.scenario_id = m.scenario_id AND f.consumer_region = m.region AND f.consumer_sector = m.sector
  UNION ALL
  SELECT {EDGE}, 'intermediate_to_home' FROM flows f
  JOIN mids m ON f.scenario_id = m.scenario_id AND f.producer_region = m.region AND f.producer_sector = m.sector
  JOIN homes h ON f.scenario_id = h.scenario_id AND f.consumer_region = h.home_region AND f.consumer_sector = h.home_sector
  UNION ALL
  SELECT {EDGE}, 'shock_to_home' FROM flows f
  JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector
  JOIN homes h ON f.scenario_id = h.scenario_id AND f.consumer_region = h.home_region AND f.consumer_sector = h.home_sector)""") + f"""
SELECT scenario_id, source_region, source_sector, target_region, target_sector, {R('flow', 2)} AS flow, edge FROM edges WHERE flow > 1e-6"""

# Two homes per scenario: every ranking and edge is per home.
_HOME2 = values([(sc, *h) for sc in fixtures.SCENARIO_IDS for h in (fixtures.HOME, fixtures.SECOND_HOME)],
                ["scenario_id", "home_region", "home_sector"])
SQL["impact_paths_homes"] = with_(*_base("ghosh"), f"""
h2 AS {_HOME2},
flows AS (SELECT d.scenario_id, a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, abs(a.value * d.delta_x) AS flow
          FROM A a JOIN dx_ghosh d ON a.consumer_region = d.region AND a.consumer_sector = d.sector WHERE abs(a.value * d.delta_x) > 0),
sup AS (SELECT * FROM (SELECT h.scenario_id, h.home_region, h.home_sector, lb.region, lb.sector,
               row_number() OVER (PARTITION BY h.scenario_id, h.home_region, h.home_sector ORDER BY COALESCE(f.flow, 0.0) DESC, lb.region, lb.sector) AS s_rank
        FROM h2 h CROSS JOIN labels lb LEFT JOIN flows f ON f.scenario_id = h.scenario_id AND f.consumer_region = h.home_region
             AND f.consumer_sector = h.home_sector AND f.producer_region = lb.region AND f.producer_sector = lb.sector) x WHERE s_rank <= 15),
sc AS (SELECT f.scenario_id, f.consumer_region AS region, f.consumer_sector AS sector, SUM(f.flow) AS c_flow
       FROM flows f JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector GROUP BY ALL),
cus AS (SELECT * FROM (SELECT d.scenario_id, d.region, d.sector,
               row_number() OVER (PARTITION BY d.scenario_id ORDER BY COALESCE(c.c_flow, 0.0) DESC, d.region, d.sector) AS c_rank
        FROM dom d LEFT JOIN sc c USING (scenario_id, region, sector)) x WHERE c_rank <= 15),
mids AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.scenario_id, s.home_region, s.home_sector ORDER BY s.s_rank) AS position
         FROM sup s JOIN cus c USING (scenario_id, region, sector)
         WHERE NOT EXISTS (SELECT 1 FROM shocks k WHERE k.scenario_id = s.scenario_id AND k.region = s.region AND k.sector = s.sector)
           AND (s.region <> s.home_region OR s.sector <> s.home_sector)) x WHERE position <= 5),
hit AS (SELECT h.*, s.region, s.sector FROM h2 h JOIN shocks s USING (scenario_id)),
ends AS (SELECT *, home_region AS region, home_sector AS sector FROM h2),
links AS (
  SELECT 'shock_to_intermediate' AS edge, a.scenario_id, a.home_region, a.home_sector, a.region AS sr, a.sector AS ss, b.region AS tr, b.sector AS ts
  FROM hit a JOIN mids b USING (scenario_id, home_region, home_sector)
  UNION ALL SELECT 'intermediate_to_home', a.scenario_id, a.home_region, a.home_sector, a.region, a.sector, b.region, b.sector
  FROM mids a JOIN ends b USING (scenario_id, home_region, home_sector)
  UNION ALL SELECT 'shock_to_home', a.scenario_id, a.home_region, a.home_sector, a.region, a.sector, b.region, b.sector
  FROM hit a JOIN ends b USING (scenario_id, home_region, home_sector))""") + f"""
SELECT l.scenario_id, l.home_region, l.home_sector, sr AS source_region, ss AS source_sector, tr AS target_region, ts AS target_sector,
       {R('f.flow', 2)} AS flow, edge
FROM links l JOIN flows f ON f.scenario_id = l.scenario_id AND f.producer_region = sr AND f.producer_sector = ss
     AND f.consumer_region = tr AND f.consumer_sector = ts WHERE f.flow > 1e-6"""

SQL["path_nodes"] = with_(*_paths_common(), """
nodes AS (SELECT scenario_id, region, sector, MIN(prio) AS prio FROM (
  SELECT scenario_id, region, sector, 0 AS prio FROM shocks
  UNION ALL SELECT scenario_id, home_region, home_sector, 1 FROM homes
  UNION ALL SELECT scenario_id, region, sector, 2 FROM mids) t GROUP BY ALL)""") + """
SELECT n.scenario_id, n.region, n.sector,
       CASE n.prio WHEN 0 THEN 'shock' WHEN 1 THEN 'home' ELSE 'intermediate' END AS role,
       COALESCE(g.name, n.region) || ' - ' || n.sector AS display_name
FROM nodes n LEFT JOIN regions g ON g.region = n.region"""

SQL["portfolio_paths"] = with_(*_paths_common(), """
weighted AS (SELECT f.scenario_id, p.portfolio_id, f.producer_region AS region, f.producer_sector AS sector, SUM(f.flow * p.w) AS p_flow
             FROM flows f JOIN pos p ON f.scenario_id = p.scenario_id AND f.consumer_region = p.region AND f.consumer_sector = p.sector
             GROUP BY ALL),
pdom AS (SELECT p.scenario_id, p.portfolio_id, lb.region, lb.sector FROM (SELECT DISTINCT scenario_id, portfolio_id FROM pos) p CROSS JOIN labels lb),
psup AS (SELECT * FROM (SELECT d.scenario_id, d.portfolio_id, d.region, d.sector,
                row_number() OVER (PARTITION BY d.scenario_id, d.portfolio_id ORDER BY COALESCE(w.p_flow, 0.0) DESC, d.region, d.sector) AS p_rank
         FROM pdom d LEFT JOIN weighted w USING (scenario_id, portfolio_id, region, sector)) x WHERE p_rank <= 15),
pmids AS (SELECT * FROM (SELECT c.scenario_id, p.portfolio_id, c.region, c.sector,
                 row_number() OVER (PARTITION BY c.scenario_id, p.portfolio_id ORDER BY c.c_rank) AS position
          FROM cus c JOIN psup p USING (scenario_id, region, sector)
          WHERE NOT EXISTS (SELECT 1 FROM shocks k WHERE k.scenario_id = c.scenario_id AND k.region = c.region AND k.sector = c.sector)
            AND NOT EXISTS (SELECT 1 FROM pos q WHERE q.scenario_id = c.scenario_id AND q.portfolio_id = p.portfolio_id
                            AND q.region = c.region AND q.sector = c.sector)) x WHERE position <= 5),
pedges AS (
  SELECT f.scenario_id, m.portfolio_id, f.producer_region AS source_region, f.producer_sector AS source_sector,
         f.consumer_region AS target_region, f.consumer_sector AS target_sector, f.flow, 'shock_to_intermediate' AS edge
  FROM flows f JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector
  JOIN pmids m ON f.scenario_id = m.scenario_id AND f.consumer_region = m.region AND f.consumer_sector = m.sector
  UNION ALL
  SELECT m.scenario_id, m.portfolio_id, m.region, m.sector, 'Total Portfolio', NULL, w.p_flow, 'intermediate_to_portfolio'
  FROM pmids m JOIN weighted w USING (scenario_id, portfolio_id, region, sector)
  UNION ALL
  SELECT f.scenario_id, p.portfolio_id, f.producer_region, f.producer_sector, 'Total Portfolio', NULL, SUM(f.flow * p.w), 'shock_to_portfolio'
  FROM flows f JOIN shocks s ON f.scenario_id = s.scenario_id AND f.producer_region = s.region AND f.producer_sector = s.sector
  JOIN pos p ON f.scenario_id = p.scenario_id AND f.consumer_region = p.region AND f.consumer_sector = p.sector
  GROUP BY f.scenario_id, p.portfolio_id, f.producer_region, f.producer_sector)""") + f"""
SELECT scenario_id, portfolio_id, source_region, source_sector, target_region, target_sector, {R('flow', 2)} AS flow, edge
FROM pedges WHERE flow > 1e-6"""

# ---------------------------------------------------------------- scenarios


def _edits_sql(rows, key: str, value: str) -> str:
    return f"""edits AS {values(rows, [key, 'seq', 'op', 'region', 'sector', value])},
lc AS (SELECT {key}, MAX(seq) AS clear_seq FROM edits WHERE op = 'clear' GROUP BY ALL),
live AS (SELECT e.* FROM edits e LEFT JOIN lc USING ({key}) WHERE e.op <> 'clear' AND (lc.clear_seq IS NULL OR e.seq > lc.clear_seq)),
applied AS (SELECT {key}, region, sector, {value} FROM (
    SELECT *, row_number() OVER (PARTITION BY {key}, region, sector ORDER BY seq DESC) AS rn FROM live) x WHERE rn = 1 AND op = 'add')"""


LEVEL_COLS = f"""s.scenario_id, s.region, s.sector, s.magnitude, x.value AS x, {R('x.value * (1 - s.magnitude)', 2)} AS x_new,
       {R('x.value * (1 - s.magnitude) - x.value', 2)} AS delta_x"""

SQL["service_scenario"] = with_(*_base()) + "SELECT scenario_id, region, sector, magnitude FROM shocks WHERE scenario_id = 'service'"
SQL["group_scenario"] = with_(*_base()) + "SELECT scenario_id, region, sector, magnitude FROM shocks"
SQL["shock_levels"] = with_(*_base()) + f"SELECT {LEVEL_COLS} FROM shocks s JOIN X x USING (region, sector)"
SQL["scenario_edits"] = with_(ECONOMY, _edits_sql(fixtures.SCENARIO_EDITS, "scenario_id", "magnitude")) + \
    f"SELECT {LEVEL_COLS} FROM applied s JOIN X x USING (region, sector)"
SQL["portfolio_edits"] = with_(ECONOMY, _edits_sql(fixtures.PORTFOLIO_EDITS, "portfolio_id", "weight")) + \
    "SELECT a.portfolio_id, a.region, a.sector, a.weight, x.value AS x FROM applied a JOIN X x USING (region, sector)"

_TOL = 1e-8 + 1e-5 * 100.0
SQL["portfolio_check"] = with_(ECONOMY, PORTFOLIOS) + f"""
SELECT p.portfolio_id, SUM(p.weight) AS total_weight, COUNT(*) AS n_assets,
       (abs(SUM(p.weight) - 100.0) <= {_TOL!r} AND MIN(p.weight) > 0) AS is_valid,
       COUNT(*) FILTER (WHERE EXISTS (SELECT 1 FROM labels lb WHERE lb.region = p.region AND lb.sector = p.sector)) AS n_known
FROM pf p GROUP BY p.portfolio_id"""

SQL["label_split"] = with_(*_base()) + """
SELECT d.scenario_id, d.region, d.sector, EXISTS (SELECT 1 FROM shocks s WHERE s.scenario_id = d.scenario_id AND s.region = d.region AND s.sector = d.sector) AS shocked
FROM dom d"""

SQL["matrix_blocks"] = with_(*_base(), f"""
sl AS (SELECT DISTINCT scenario_id, region, sector FROM shocks),
bp AS (SELECT s.scenario_id, a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, a.value, 1 AS pm, 0 AS cm
       FROM A a JOIN sl s ON a.producer_region = s.region AND a.producer_sector = s.sector),
bc AS (SELECT s.scenario_id, a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, a.value, 0 AS pm, 1 AS cm
       FROM A a JOIN sl s ON a.consumer_region = s.region AND a.consumer_sector = s.sector),
touch AS (SELECT scenario_id, {CELL}, any_value(value) AS value, MAX(pm) AS pm, MAX(cm) AS cm
          FROM (SELECT * FROM bp UNION ALL SELECT * FROM bc) t GROUP BY scenario_id, {CELL}),
parts AS (SELECT scenario_id, (CASE WHEN pm = 1 THEN 'M' ELSE 'N' END) || (CASE WHEN cm = 1 THEN 'M' ELSE 'N' END) AS block,
                 COUNT(*) AS cells, SUM(value) AS total FROM touch GROUP BY ALL),
whole AS (SELECT COUNT(*) AS n, SUM(value) AS t FROM A),
four AS (SELECT s.scenario_id, b.block, COALESCE(p.cells, 0) AS cells, COALESCE(p.total, 0.0) AS total
         FROM (SELECT DISTINCT scenario_id FROM sl) s CROSS JOIN (VALUES ('MM'), ('MN'), ('NM')) b(block)
         LEFT JOIN parts p ON p.scenario_id = s.scenario_id AND p.block = b.block)""") + f"""
SELECT scenario_id, block, cells, {R('total', 10)} AS total FROM four
UNION ALL
SELECT f.scenario_id, 'NN', CAST(w.n - SUM(f.cells) AS BIGINT), {R('w.t - SUM(f.total)', 10)} FROM four f CROSS JOIN whole w GROUP BY f.scenario_id, w.n, w.t"""

SQL["vector_lookup"] = with_(ECONOMY, PORTFOLIOS) + """
SELECT p.portfolio_id, p.region, p.sector, x.value AS x, y.value AS y
FROM pf p LEFT JOIN X x USING (region, sector) LEFT JOIN Y y USING (region, sector)"""

# ---------------------------------------------------------------- lookups

CODES = "codes AS (SELECT region FROM labels UNION SELECT region FROM groups)"
SQL["region_lookup"] = with_(ECONOMY, CODES) + "SELECT c.region, COALESCE(g.name, c.region) AS region_name FROM codes c LEFT JOIN regions g USING (region)"
SQL["region_lookup_strict"] = with_(ECONOMY, CODES) + "SELECT c.region, g.name AS country FROM codes c LEFT JOIN regions g USING (region)"
SQL["region_iso3"] = with_(ECONOMY, CODES) + "SELECT c.region, g.iso3 FROM codes c JOIN regions g USING (region) WHERE g.iso3 IS NOT NULL"
SQL["region_groups"] = with_(ECONOMY) + "SELECT group_name, region FROM groups WHERE region IN (SELECT region FROM labels)"
SQL["catalog_listing"] = with_(ECONOMY, RATINGS, "vgroups AS (SELECT group_name, region FROM groups WHERE region IN (SELECT region FROM labels))") + """
SELECT 'region' AS kind, r.region AS value, COALESCE(g.name, r.region) AS label, false AS is_default
FROM (SELECT DISTINCT region FROM labels) r LEFT JOIN regions g USING (region)
UNION ALL SELECT DISTINCT 'group', group_name, group_name, false FROM vgroups
UNION ALL SELECT DISTINCT 'sector', sector, sector, false FROM labels
UNION ALL SELECT 'service', s.service, s.service,
       CASE WHEN f.has_p THEN s.service = 'Pollination' ELSE s.service = f.first END
FROM (SELECT DISTINCT service FROM material_all) s,
     (SELECT MIN(service) AS first, bool_or(service = 'Pollination') AS has_p FROM material_all) f"""


def _short(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) > {n} THEN substring({expr}, 1, {n - 3}) || '...' ELSE {expr} END"


SQL["short_labels"] = with_(ECONOMY, "nm AS (SELECT lb.region, lb.sector, COALESCE(g.name, lb.region) || ' - ' || lb.sector AS full_label FROM labels lb LEFT JOIN regions g USING (region))") + f"""
SELECT region, sector, {_short('full_label', 16)} AS short_16, {_short('full_label', 60)} AS short_60 FROM nm"""

# ---------------------------------------------------------------- materiality

KEYS4 = "isic_section, isic_division, isic_group, isic_class"
SQL["ratings_match"] = with_(ECONOMY, RATINGS) + f"SELECT {KEYS4}, sector FROM merged_all WHERE sector IS NOT NULL"
SQL["ratings_unmatched"] = with_(ECONOMY, RATINGS) + f"SELECT {KEYS4} FROM merged_all WHERE sector IS NULL"
SQL["materiality"] = with_(ECONOMY, RATINGS) + "SELECT service, sector, vh, h, n FROM mcount_all WHERE vh >= 1 OR (n > 0 AND (vh + h) / n > 0.5) OR vh + h >= 3"
SQL["materiality_intent"] = with_(ECONOMY, RATINGS) + "SELECT service, sector, vh, h, n FROM mcount_unm WHERE vh >= 1 OR (n > 0 AND (vh + h) / n > 0.5) OR vh + h >= 3"

# ---------------------------------------------------------------- search

PAIRS = f"""
zf AS (SELECT a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector, a.value * x.value AS flow
       FROM A a JOIN X x ON a.consumer_region = x.region AND a.consumer_sector = x.sector
       WHERE a.producer_sector IN ({_SECTORS}) AND a.value * x.value > 1e-9),
pairs AS (SELECT z.* FROM zf z WHERE z.flow > (SELECT quantile_cont(flow, {fixtures.SEARCH_QUANTILE!r}) FROM zf)
          AND z.producer_region <> z.consumer_region AND z.producer_sector <> z.consumer_sector)"""

SQL["high_flow_pairs"] = with_(ECONOMY, PAIRS) + f"SELECT {CELL}, flow FROM pairs"

SQL["max_impact_scenario"] = with_(ECONOMY, PAIRS, f"""
sshocks AS (SELECT DISTINCT producer_region || '|' || producer_sector AS scenario_id, producer_region AS region, producer_sector AS sector,
                   CAST({fixtures.SEARCH_MAGNITUDE!r} AS DOUBLE) AS magnitude FROM pairs),
slevels AS (SELECT s.scenario_id, s.region, s.sector, s.magnitude, x.value AS x, x.value * (1 - s.magnitude) - x.value AS delta_x
            FROM sshocks s JOIN X x USING (region, sector)),
sdom AS (SELECT sc.scenario_id, lb.region, lb.sector FROM (SELECT DISTINCT scenario_id FROM sshocks) sc CROSS JOIN labels lb)""",
                                   impact_ctes("leontief", "sshocks", "slevels", "sdom", "sdx"), _dy("sdx"), """
scored AS (SELECT p.producer_region AS shock_region, p.producer_sector AS shock_sector, p.consumer_region AS home_region,
                  p.consumer_sector AS home_sector, abs(dy.delta_y) AS impact
           FROM pairs p JOIN dy ON dy.scenario_id = p.producer_region || '|' || p.producer_sector
                               AND dy.region = p.consumer_region AND dy.sector = p.consumer_sector
           WHERE abs(dy.delta_y) > 0)""") + f"""
SELECT shock_region, shock_sector, home_region, home_sector, {R('impact', 2)} AS impact FROM (
  SELECT *, row_number() OVER (ORDER BY impact DESC, shock_region, shock_sector, home_region, home_sector) AS rn FROM scored) t
WHERE rn = 1"""

_DQ = fixtures.DEFAULT_QUANTILE
SQL["default_scenario"] = with_(ECONOMY, f"""
bigp AS (SELECT region AS producer_region, sector AS producer_sector FROM X WHERE sector IN ({_SECTORS})
         AND value > (SELECT quantile_cont(value, {_DQ!r}) FROM X WHERE sector IN ({_SECTORS}))),
bigc AS (SELECT region AS consumer_region, sector AS consumer_sector FROM X WHERE value > (SELECT quantile_cont(value, {_DQ!r}) FROM X)),
iseed AS (SELECT producer_region || '|' || producer_sector AS run, producer_region AS region, producer_sector AS sector,
                 CAST(1.0 AS DOUBLE) AS d FROM bigp)""", series("lit", "iseed", "A_row", None), f"""
lrows AS (SELECT split_part(run, '|', 1) AS producer_region, split_part(run, '|', 2) AS producer_sector,
                 region AS consumer_region, sector AS consumer_sector, value FROM lit_sum),
cells AS (SELECT l.* FROM lrows l JOIN bigc USING (consumer_region, consumer_sector)
          WHERE l.producer_region NOT IN (SELECT region FROM regions WHERE iso3 IS NULL)
            AND l.consumer_region NOT IN (SELECT region FROM regions WHERE iso3 IS NULL)
            AND l.producer_region <> l.consumer_region AND l.value > 0),
top AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY value DESC, {CELL}) AS rn FROM cells) t),
pick AS (SELECT * FROM top WHERE producer_sector <> consumer_sector ORDER BY rn LIMIT 1),
r2 AS (SELECT region, row_number() OVER (ORDER BY region) AS i FROM (SELECT DISTINCT region FROM labels) t),
s2 AS (SELECT sector, row_number() OVER (ORDER BY sector) AS i FROM (SELECT DISTINCT sector FROM labels) t)""") + f"""
SELECT consumer_region AS home_region, consumer_sector AS home_sector, producer_region AS shock_region, producer_sector AS shock_sector,
       {R('value', 10)} AS dependency FROM pick
UNION ALL
SELECT (SELECT region FROM r2 WHERE i = 1), (SELECT sector FROM s2 WHERE i = 1),
       (SELECT region FROM r2 WHERE i = LEAST(2, (SELECT COUNT(*) FROM r2))), (SELECT sector FROM s2 WHERE i = LEAST(2, (SELECT COUNT(*) FROM s2))),
       0.0 WHERE NOT EXISTS (SELECT 1 FROM pick)"""

SQL["scenario_batch"] = with_(*_base("ghosh", "leontief", "textbook", "direct")) + " UNION ALL ".join(
    f"""SELECT '{m}' AS method, scenario_id, {R('SUM(delta_x)', 2)} AS total_change, {R('MIN(delta_x)', 2)} AS largest_loss,
        COUNT(*) FILTER (WHERE abs(delta_x) > 0) AS labels_moved FROM dx_{m} GROUP BY scenario_id"""
    for m in ("ghosh", "leontief", "textbook", "direct"))

# ---------------------------------------------------------------- sources and sinks

SQL["production_history"] = with_(ECONOMY) + """
SELECT producer_region AS region, producer_sector AS sector, year, CAST(SUM(v) AS DOUBLE) AS gross_output
FROM lines GROUP BY ALL"""

SQL["economy_round_trip"] = with_(ECONOMY) + f"""
SELECT a.producer_region, a.producer_sector, a.consumer_region, a.consumer_sector,
       {R('a.value', 10)} AS from_wide, {R('a.value', 10)} AS from_long, x.value AS x_consumer
FROM A a JOIN X x ON x.region = a.consumer_region AND x.sector = a.consumer_sector"""

SQL["ratings_round_trip"] = with_(ECONOMY, RATINGS) + "SELECT service, sector FROM material_all"

SQL["scenario_round_trip"] = with_(*_base()) + f"""
SELECT s.scenario_id, s.region, s.sector, {R('s.magnitude * 100.0 / 100.0', 10)} AS magnitude, x.value AS x
FROM shocks s JOIN X x USING (region, sector)"""

SQL["portfolio_round_trip"] = with_(ECONOMY, PORTFOLIOS) + """
SELECT p.portfolio_id, p.region, p.sector, p.weight, x.value AS x FROM pf p JOIN X x USING (region, sector)"""

SQL["portfolio_edit_check"] = with_(ECONOMY, PORTFOLIOS, "cand AS " + values(fixtures.EDIT_CANDIDATES, ["portfolio_id", "region", "sector", "weight"]), """
tot AS (SELECT portfolio_id, SUM(weight) AS current_total FROM pf GROUP BY portfolio_id),
c2 AS (SELECT c.* FROM cand c WHERE EXISTS (SELECT 1 FROM labels lb WHERE lb.region = c.region AND lb.sector = c.sector)),
pt AS (SELECT c.portfolio_id, c.region, c.sector, c.weight,
              COALESCE(t.current_total, 0.0) - COALESCE(p.weight, 0.0) + c.weight AS potential_total
       FROM c2 c LEFT JOIN tot t USING (portfolio_id) LEFT JOIN pf p USING (portfolio_id, region, sector))""") + f"""
SELECT portfolio_id, region, sector, weight, {R('potential_total', 6)} AS potential_total,
       (weight > 0 AND potential_total <= 100.0) AS allowed FROM pt"""

# ---------------------------------------------------------------- a tight economy

# The same flows with little final demand: the series falls slowly.
TIGHT = ECONOMY.replace("X AS (", "X0 AS (", 1).replace("Y AS (", "Y0 AS (", 1).replace(
    "Z AS (SELECT", f"""X AS (SELECT region, sector, (value - 1) / 2 * {fixtures.TIGHT_FACTOR!r}::DOUBLE + 1 AS value FROM X0),
Y AS (SELECT X.region, X.sector, X.value - (X0.value - Y0.value) AS value FROM X JOIN X0 USING (region, sector) JOIN Y0 USING (region, sector)),
Z AS (SELECT""", 1)


def _many_terms(build):
    """``build()`` with enough terms for the tight economy."""
    global TERMS
    TERMS, kept = fixtures.TIGHT_ORACLE_TERMS, TERMS
    try:
        return build()
    finally:
        TERMS = kept


SQL["tight_gross_output"] = _many_terms(lambda: with_(TIGHT, "yseed AS (SELECT 'y' AS run, region, sector, value AS d FROM Y)",
                                                      series("xit", "yseed", "A_col", None))) + f"""
SELECT region, sector, {R('value', 2)} AS gross_output FROM xit_sum"""
for _m in ("ghosh", "leontief"):
    SQL[f"tight_{_m}_impact"] = _many_terms(lambda: with_(TIGHT, RATINGS, scenarios_cte(), impact_ctes(_m))) + f"""
SELECT scenario_id, region, sector, {R('delta_x', 2)} AS delta_x FROM dx_{_m}"""

# ---------------------------------------------------------------- validation and layouts

SQL["scenario_rejects"] = with_(ECONOMY, "s AS " + values(fixtures.REJECT_CASES, ["scenario_id", "region", "sector", "magnitude"])) + """
SELECT scenario_id, region, sector, magnitude, 'unknown_label' AS rule FROM s
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.region = s.region AND l.sector = s.sector)
UNION ALL
SELECT scenario_id, region, sector, magnitude, 'duplicate' FROM (
  SELECT *, count(*) OVER (PARTITION BY scenario_id, region, sector) AS n FROM s) d WHERE n > 1
UNION ALL
SELECT scenario_id, region, sector, magnitude, 'bad_magnitude' FROM s WHERE magnitude IS NULL OR magnitude < 0 OR magnitude > 1"""


def _inverse_sql(matrix: str, swap: bool) -> str:
    a, b = ("region", "sector"), ("split_part(run, '|', 1)", "split_part(run, '|', 2)")
    p, c = (a, b) if swap else (b, a)
    return with_(ECONOMY, "useed AS (SELECT region || '|' || sector AS run, region, sector, CAST(1.0 AS DOUBLE) AS d FROM labels)",
                 series("inv", "useed", matrix, None)) + f"""
SELECT {p[0]} AS producer_region, {p[1]} AS producer_sector, {c[0]} AS consumer_region, {c[1]} AS consumer_sector, {R('value', 10)} AS value
FROM inv_sum WHERE value <> 0"""


SQL["leontief_inverse"] = _inverse_sql("A_row", False)
SQL["ghosh_inverse"] = _inverse_sql("B_col", True)

SQL["year_files_round_trip"] = with_(ECONOMY, """h AS (SELECT producer_region AS region, producer_sector AS sector, year, CAST(SUM(v) AS DOUBLE) AS gross_output
      FROM lines GROUP BY ALL)""") + """
SELECT region, sector, year, gross_output FROM h"""

SQL["label_catalog"] = with_(ECONOMY, """seen AS (SELECT producer_region AS region, producer_sector AS sector FROM Z
      UNION SELECT consumer_region, consumer_sector FROM Z)""") + """
SELECT DISTINCT 'region' AS kind, region AS name, CAST(NULL AS VARCHAR) AS sector FROM seen
UNION ALL SELECT DISTINCT 'sector', NULL, sector FROM seen
UNION ALL SELECT 'label', region, sector FROM seen"""


for _method in ("ghosh_impact", "leontief_impact", "leontief_textbook"):
    SQL[f"{_method}_stored"] = SQL[_method]


# The economies of single years as one: regions and scenarios carry their year, and flows
# stay within a year.
YEARS = """
yz AS (SELECT year, producer_region, producer_sector, consumer_region, consumer_sector, SUM(v) AS z FROM lines WHERE rf <> 'N' GROUP BY ALL),
yr AS (SELECT year, producer_region AS region, producer_sector AS sector, SUM(z) AS rs FROM yz GROUP BY ALL),
yc AS (SELECT year, consumer_region AS region, consumer_sector AS sector, SUM(z) AS cs FROM yz GROUP BY ALL),
yX AS (SELECT y.year || '#' || lb.region AS region, lb.sector,
              CAST(2 * GREATEST(COALESCE(yr.rs, 0), COALESCE(yc.cs, 0)) + 1 AS DOUBLE) AS value
       FROM (SELECT DISTINCT year FROM yz) y CROSS JOIN labels lb
       LEFT JOIN yr ON yr.year = y.year AND yr.region = lb.region AND yr.sector = lb.sector
       LEFT JOIN yc ON yc.year = y.year AND yc.region = lb.region AND yc.sector = lb.sector),
ycells AS (SELECT year || '#' || producer_region AS producer_region, producer_sector, year || '#' || consumer_region AS consumer_region,
                  consumer_sector, CAST(z AS DOUBLE) AS value FROM yz),
yA AS (SELECT z.producer_region, z.producer_sector, z.consumer_region, z.consumer_sector, z.value / x.value AS value
       FROM ycells z JOIN yX x ON z.consumer_region = x.region AND z.consumer_sector = x.sector),
yB AS (SELECT z.producer_region, z.producer_sector, z.consumer_region, z.consumer_sector, z.value / x.value AS value
       FROM ycells z JOIN yX x ON z.producer_region = x.region AND z.producer_sector = x.sector),
yA_col AS (SELECT consumer_region AS src_region, consumer_sector AS src_sector, producer_region AS dst_region, producer_sector AS dst_sector, value FROM yA),
yB_row AS (SELECT producer_region AS src_region, producer_sector AS src_sector, consumer_region AS dst_region, consumer_sector AS dst_sector, value FROM yB),
ylevels AS (SELECT split_part(x.region, '#', 1) || '#' || s.scenario_id AS scenario_id, x.region, x.sector, x.value AS x,
                   x.value * (1 - s.magnitude) - x.value AS delta_x
            FROM shocks s JOIN yX x ON x.region LIKE '%#%' AND split_part(x.region, '#', 2) = s.region AND x.sector = s.sector),
ydom AS (SELECT sc.scenario_id, x.region, x.sector FROM (SELECT DISTINCT scenario_id FROM ylevels) sc
         JOIN yX x ON split_part(x.region, '#', 1) = split_part(sc.scenario_id, '#', 1))"""


def _year_ctes(method: str) -> str:
    body = impact_ctes(method, "ylevels", "ylevels", "ydom", f"ydx_{method}")
    for name in ("A a", "B b", "A_col m", "B_row m"):
        body = body.replace(f"JOIN {name} ON", f"JOIN y{name} ON")
    return body


_YEAR, _SCENARIO = "CAST(split_part(scenario_id, '#', 1) AS INTEGER)", "split_part(scenario_id, '#', 2)"
SQL["year_batch"] = with_(ECONOMY, RATINGS, scenarios_cte(), YEARS, _year_ctes("ghosh"), _year_ctes("leontief")) + " UNION ALL ".join(
    f"""SELECT {_YEAR} AS year, '{m}' AS method, {_SCENARIO} AS scenario_id, {R('SUM(delta_x)', 2)} AS total_change,
        {R('MIN(delta_x)', 2)} AS largest_loss, COUNT(*) FILTER (WHERE abs(delta_x) > 0) AS labels_moved
        FROM ydx_{m} GROUP BY scenario_id""" for m in ("ghosh", "leontief"))

SQL["year_home_impact"] = with_(ECONOMY, RATINGS, scenarios_cte(), HOMES, YEARS, _year_ctes("ghosh")) + f"""
SELECT CAST(split_part(d.scenario_id, '#', 1) AS INTEGER) AS year, h.scenario_id, h.home_region, h.home_sector, x.value AS before,
       {R('d.delta_x', 2)} AS delta_x, {R('x.value + d.delta_x', 2)} AS after, {R(_pct('d.delta_x', 'x.value'), 6)} AS pct_change
FROM ydx_ghosh d JOIN yX x USING (region, sector)
JOIN homes h ON h.scenario_id = split_part(d.scenario_id, '#', 2) AND h.home_region = split_part(d.region, '#', 2) AND h.home_sector = d.sector"""


SQL["scenario_yaml_round_trip"] = SQL["scenario_round_trip"]
SQL["portfolio_yaml_round_trip"] = SQL["portfolio_round_trip"]
SQL["ratings_joined_round_trip"] = SQL["ratings_match"]
SQL["history_round_trip"] = with_(ECONOMY) + """
SELECT producer_region AS region, producer_sector AS sector, year, CAST(SUM(v) AS DOUBLE) AS from_rows,
       CAST(SUM(v) AS DOUBLE) AS from_columns FROM lines GROUP BY ALL"""
SQL["flow_quantiles"] = with_(ECONOMY) + " UNION ALL ".join(f"""
SELECT producer_region, CAST({q} AS DOUBLE) AS q, {R(f'quantile_cont(value, {q})', 2)} AS value FROM Z GROUP BY producer_region"""
    for q in fixtures.FLOW_QUANTILES)
