"""Headline queries, timed; one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data
and cores. Each query runs whole into Spark's no-op sink, once to warm up the code
caches and once timed; queries that train or write are timed on their only run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldmosaic import registry  # noqa: E402
from fieldmosaic.session import local_session  # noqa: E402

WARMED = (
    "clean_samples", "cast_all_int", "select_small", "label_type", "label_from_table", "class_counts",
    "balanced_weights", "weighted_samples", "split_hash", "folds", "accuracy", "prf_support",
    "confusion", "tile_links_all", "zone_groups", "zone_mosaic", "mosaic_pixels", "reproject",
    "regrid", "warp_zones", "combine_zones", "overview_pyramid", "window_sources", "window_pixels",
)
ONCE = ("read_csv", "publish", "staged_resume", "listed_mosaic", "train_score", "train_boosted")


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "fieldmosaic-bench")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in (*WARMED, *ONCE):
        if name in WARMED:
            run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
