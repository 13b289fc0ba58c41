"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from panelwright.plans.catalog import QUERIES
from panelwright.session import build_session

HEADLINE = [
    "d01_point_in_polygon",
    "e01_weekly_counts",
    "e01_weekly_counts_by_rules",
    "d08_densify",
    "f02_shifted_rolling",
    "f06_abnormal_label",
    "e28_target_balance",
    "e10_weekly_measures",
    "e24_poi_diversity",
    "e18_parcel_statistics",
    "e24_landuse_diversity",
    "q03_quality_flags",
    "e31_numeric_profile",
    "h12_zscore",
    "h18_rank_metrics",
    "h20_threshold_grid",
    "h23_category_thresholds",
    "h24_method_metrics",
    "f12_lift_at_k",
    "h01_stratified_sample",
    "h33_global_importance",
    "h05_logistic_regression",
    "h06_boosted_trees",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
