"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pairloom.plans.catalog import QUERIES
from pairloom.session import local_session

HEADLINE = (
    "A2_pair_capacity", "J3_band_join", "J4_cross_frame_pairs", "P14_kind_by_scale", "W2_retained_candidates", "W3_balanced_quota_sample",
    "A13_balance_report", "F8_camera_system_features", "M4_frozen_scoring", "A18_auroc", "A20_operating_point_rates", "A24_stratified_metrics",
    "A28_bootstrap_intervals", "A29_paired_auroc_interval", "A10_depth_summary", "A11_robust_shape", "F13_world_points", "A17_camera_motion",
    "F21_noisy_summaries", "T5_balanced_split", "P19_diagnosis_by_method", "S8_table_fingerprint",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["S8_table_fingerprint"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
