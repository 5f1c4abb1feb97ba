"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each is run once after a warm-up session."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scenetab.functions.session import local_session  # noqa: E402
from scenetab.plans import catalog  # noqa: E402

HEADLINE = [
    "points_per_camera", "visibility_count", "color_points", "knn_spacing", "build_tracks", "reweight_tracks", "match_descriptors",
    "erode_frames", "gaussian_blur", "apply_warp", "stabilize_depth", "three_layer_scores_new", "layer_alphas", "pack_ldi",
    "composite_rays", "importance_depths", "spawn_splats", "encode_splats", "interpolate_keyframes", "moving_average",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
