"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once on the next smaller tables to warm up, and once timed; a run materialises all
rows of the result through the no-op sink, so nothing is collected on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitsignal.bindings import registry  # noqa: E402
from pitsignal.session import build_session  # noqa: E402

HEADLINE = (
    "C01_episode_frame",
    "C02_walk_forward_verdict",
    "C03_exit_horizon_study",
    "C04_threshold_boundary_study",
    "C05_quote_surface_stress",
    "C06_decision_reproducibility",
    "C07_live_feature",
    "C08_gate_funnel",
    "C09_research_run",
    "C10_episode_audit_view",
    "K01_bars_from_ticks",
    "A01_return_summary",
    "D16_reality_check",
    "J01_asof_backward",
    "T01_best_vertical",
    "P21_risk_gates",
    "F06_secret_scan",
    "S13_order_update",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = tuple(sys.argv[1:]) or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    smaller = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    warm_dir = smaller if os.path.isdir(smaller) else sf_dir
    for name in names:
        for at in (warm_dir, sf_dir):
            started = time.perf_counter()
            registry.QUERIES[name](spark, at).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
