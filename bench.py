"""Times the headline queries and prints one JSON line.

Every query starts without stored tables, so its time includes all that it needs:
scan, cleaning, customer table and, where it has them, stored intermediates.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from merchantry.plans import shared
from merchantry.plans.registry import queries
from merchantry.session import local_session

HEADLINE = [
    "c12_clean_orders", "b2_critical_fields", "d12_data_overview", "e1_revenue_trend", "e4_new_vs_returning",
    "e5_top_products_lines", "e6_geo_breakdown", "e9_quartile_summary", "e13_smoothing_forecast", "f4_rfm_summary",
    "g2_customer_totals", "g15_segment_summary", "h9_ranked_recommendations", "h16_action_groups", "i13_insights",
    "j2_action_customers", "a5_save_snapshot", "l3_revenue_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "12g")
    known = queries()

    def run(name: str, tables: str) -> float:
        shared.reset()
        start = time.perf_counter()
        known[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    # One pass over the smallest tables starts the executors and compiles the code.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for name in names:
            run(name, small)
    times = {name: run(name, folder) for name in names}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale),
    }))


if __name__ == "__main__":
    main()
