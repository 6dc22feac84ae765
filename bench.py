"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up (JIT, file listing) and then timed; the time covers building the plan and
writing the whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from petrichor.catalog import load  # noqa: E402
from petrichor.session import local_session  # noqa: E402

HEADLINE = [
    "quality_masks", "clean_bands", "spectral_indices", "resample_5d_median", "dense_5d_grid", "interpolate_context",
    "persistence_baseline", "lee_speckle_filter", "radar_clip_values", "global_climate_percentiles", "robust_climate_scaling",
    "nearest_time_join", "step_metrics", "cube_metrics", "landcover_cube_metrics", "validation_macro", "gradient_errors",
    "cut_tiles", "stitch_tiles", "score_patches", "space_time_folds", "cv_summary", "paired_contrasts", "event_tertiles",
    "accept_processed_cubes", "nearest_grid_point",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry, seconds = load(), {}
    for name in HEADLINE:
        fn = registry[name][0]
        times = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()  # a run must not profit from tables the previous one kept
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
