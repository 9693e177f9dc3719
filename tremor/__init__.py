"""tremor: Spark-native input-output shock analytics (see README.md).

Typical use::

    from tremor import build_session, Economy, impact, attribute, top_impacts
    spark = build_session()
    dx = impact(economy, shocks, method="ghosh")      # (scenario_id, region, sector, delta_x)
"""

from .operators.attribution import attribute, attribute_portfolio, influence
from .operators.economy import Economy
from .operators.propagate import (direct_impact, ghosh_impact, impact, impacts, leontief_impact,
                                  required_demand)
from .operators.reports import home_impact, impact_paths, portfolio_impact, top_impacts
from .session import build_session, ensure_checkpoint_dir

__all__ = [
    "Economy", "attribute", "attribute_portfolio", "build_session", "direct_impact",
    "ensure_checkpoint_dir", "ghosh_impact", "home_impact", "impact", "impact_paths", "impacts",
    "influence", "leontief_impact", "portfolio_impact", "required_demand", "top_impacts",
]
