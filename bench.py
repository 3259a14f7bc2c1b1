"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from girthkit.plans import registry
from girthkit.session import local_session

HEADLINE = ("flagship", "c4_count", "c4_enumerate", "cycle8_paths", "cycle_count_L", "cascade_score", "c4_geometry", "common_neighbors", "mut_two_switch", "elite_topk", "wl_hash", "graph6_decode")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), "12g")
    registry.load()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1]}))


if __name__ == "__main__":
    main()
