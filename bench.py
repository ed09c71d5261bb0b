"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motionlake import catalog
from motionlake.session import local_session

HEADLINE = (
    "s04_dense_joints",
    "t13_largest_person",
    "w08_analysis_window",
    "w19_motion_score",
    "j11_nearest_frame",
    "w16_normalize_pose",
    "w11_resample",
    "w12_phase_align",
    "a08_correction_distance",
    "a09_keypoint_components",
    "c08_grade_criteria",
    "c03_match_expert",
    "c09_fit_calibration",
    "a14_cohort_summary",
    "c13_compare_sources",
    "w28_detection_carry_forward",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "motionlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    entries = catalog.entries()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
