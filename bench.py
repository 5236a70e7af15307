"""Benchmark: seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ocuspark.plans.catalog import QUERIES  # noqa: E402
from ocuspark.session import local_session  # noqa: E402

HEADLINE = [
    "gaze_fixation_summary",
    "gaze_event_labels",
    "gaze_fixations_full_chain",
    "study_image_load_means",
    "study_sensitivity_lookup",
    "study_hypothesis_report",
    "norms_exact",
    "scoring_compare_to_norms",
    "scoring_predictions",
    "layout_overlap_suppression",
    "layout_whitespace",
    "layout_occupancy_grid",
    "layout_screen_consistency",
    "layout_readability_report",
    "map_agreement",
    "map_auc_judd",
    "map_saliency_features",
    "pixel_batch_summary",
    "search_layout_summary",
    "search_attention_priority",
    "search_glance_metrics",
    "ml_cross_validation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session("bench", cores=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    QUERIES["study_load_means"](spark, sf_dir).collect()  # start-up is not measured
    took = {}
    for name in names:
        start = time.time()
        # The noop sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
