"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cellarium.plans import queries as plans
from cellarium.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "scan_latest", "scan_versions3", "scan_time_range", "scan_key_range", "get_row", "batch_get", "deletes_all", "ttl_scan", "counter_merge", "append_merge", "compact_then_read", "filter_nested", "filter_forall", "kv_latest",
    "split_key", "tablet_loads", "table_diff", "series_gap_fill", "percentile", "txn_snapshot_read", "txn_commit_batch", "cas", "notify_dispatch", "stock_level", "order_status", "delivery", "payment", "new_order", "view_join_cube", "as_of_join",
)


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: plans.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    run(HEADLINES[0])  # starts the session's threads and compiles the first plan
    seconds = {}
    for name in HEADLINES:
        began = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - began, 3)
    entries = spark.read.parquet(f"{SF}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF.rstrip("/")),
        "log_entries": entries, "entries_resolved_per_s": round(entries / seconds["deletes_all"]), "point_get_s": seconds["get_row"], "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
