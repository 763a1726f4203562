"""Time the headline jobs on the tables in ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

ROOT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "q0_panel_label",
    "q1_build_features",
    "j3_spatial_lag",
    "q3_score_latest",
    "q4_backtest_days",
    "q7_cells_near",
    "q8_area_report",
    "q9_cluster_report",
    "q10_evac_plan",
    "q11_threshold_study",
    "a11_top_triggers",
    "a16_roc_auc",
    "m4_train_gbt",
    "w11_latest_k",
)


def main() -> None:
    from hexrisk.catalog import store
    from hexrisk.catalog.queries import QUERIES
    from hexrisk.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=str(2 * int(CPUS)),
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    start = time.time()
    # Stored tables the read queries start from.
    store.history(spark, ROOT)
    store.scores(spark, ROOT)
    seconds["stored_tables"] = round(time.time() - start, 3)
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, ROOT).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    sf = os.path.basename(ROOT.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
