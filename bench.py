"""Wall time of the headline queries, each after one untimed run; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import QUERIES  # noqa: E402
from pricetrail.session import build_session  # noqa: E402

HEADLINE = (
    "q1_runs_grid", "q2_runs_tree", "q3_snapshots_grid", "q4_products_grid", "q5_product_details",
    "q6_product_history", "q7_product_analytics", "q8_product_analysis", "q8_history_pages",
    "q10_chart_summary", "q12_coverage_calendar", "w4_change_points", "w5_latest_snapshot",
    "t2_plan_batches", "t3_5_transitions", "t8_queue_stats", "t9_observation_store",
    "t19_page_cards", "t21_breaker_report", "s5_sitemap_locs",
    "q9_live_comparison_all", "q10_chart_series", "q12_missing_spans", "t16_sitemap_walk",
    "t17_category_walk", "t20_legacy_products",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
         "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for timed in (False, True):
        for name in HEADLINE:
            began = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - began, 3)
    scale = Path(root).name.removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
