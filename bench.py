"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pitscape.plans import load_all
from pitscape.plans.registry import QUERIES
from pitscape.session import local_session

HEADLINE = (
    "asof_order_per_shipment",
    "robust_group_statistics",
    "average_rank_in_cohort",
    "prediction_metrics",
    "clustered_slope",
    "compound_exit_returns",
    "rolling_market_controls",
    "firm_month_panel",
    "point_in_time_peer_score",
    "motion",
    "drift_summary",
    "forward_targets",
    "nearest_embeddings_any_label",
    "state_transitions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
