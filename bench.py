"""Benchmark: every driver query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line. ``value`` is the end-to-end wall time of the whole query set
in one session (the economy, the batched propagation of every scenario × method
and the inverses are built once and shared, as a user running the reports would);
``queries`` has each query's own time in run order (the first query that needs a
shared table pays for it), ``stages`` the time of the shared tables alone, and ``cold``
what headline queries take with the shared stages they need.
Each query is executed in full with the ``noop`` sink (no driver collection).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tremor.plans import catalog, store  # noqa: E402
from tremor.session import build_session  # noqa: E402


# Shared stages a headline query needs when it is the only one that runs.
HEADLINE = {"flow_table": ["economy"], "top_impacts_pct": ["economy", "scenarios", "propagation_batch"],
            "ghosh_impact": ["economy", "scenarios", "propagation_batch"],
            "home_attribution_leontief": ["economy", "scenarios", "propagation_batch"],
            "leontief_inverse_top": ["economy", "leontief_inverse"]}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus)
    stages: dict[str, float] = {}
    t_all = time.time()
    for name, build in [("economy", lambda: store.economy(spark, sf_dir)),
                        ("scenarios", lambda: store.scenarios(spark, sf_dir)),
                        ("propagation_batch", lambda: store.impacts(spark, sf_dir)),
                        ("leontief_inverse", lambda: store.leontief_inverse(spark, sf_dir)),
                        ("ghosh_inverse", lambda: store.ghosh_inverse(spark, sf_dir))]:
        t = time.time()
        build()
        stages[name] = round(time.time() - t, 3)
    times: dict[str, float] = {}
    for name, q in catalog.QUERIES.items():
        t = time.time()
        run(q(spark, sf_dir))
        times[name] = round(time.time() - t, 3)
    total = time.time() - t_all
    cold = {name: round(sum(stages[x] for x in needs) + times[name], 3) for name, needs in HEADLINE.items()}
    sf = Path(sf_dir).name.replace("sf", "")
    print(json.dumps({"metric": "all_driver_queries_wall", "value": round(total, 3), "unit": "sec",
                      "queries": times, "stages": stages, "cold": cold, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "n_queries": len(times)}))
    spark.stop()


if __name__ == "__main__":
    main()
