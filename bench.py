"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from terraloom.plans import QUERIES  # noqa: E402
from terraloom.session import session  # noqa: E402

HEADLINE = [
    "diversity_by_cell", "cell_summary", "chao1_by_cell", "temporal_turnover", "spearman_trend", "priority_index", "connectivity",
    "survey_gaps", "weekly_si", "block_uniformity", "reference_et0", "interpolate_linear", "zonal_mean", "slope", "focal_circle",
    "normalize_percentile", "extract_patches", "evaluate", "points_in_polygons", "count_within", "nearest_point", "heatmap",
    "lines_cross", "nearest_scene", "service_area", "class_breaks_quantile", "quantity_per_flavour", "master_layers", "grid_analyses",
    "validation_tables",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("terraloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    QUERIES["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's workers
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
