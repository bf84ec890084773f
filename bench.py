"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from filmroll.catalog import load
from filmroll.catalog.tables import frame_meta, pixels

HEADLINE = [
    "plan_print_frames", "px_positive", "px_srgb8", "agg_density_range", "agg_linear_scale", "agg_auto_frame",
    "agg_roll_median", "agg_wedge", "agg_block_mean", "px_patch", "win_snap", "win_agreement", "win_worst",
    "join_near_duplicate", "agg_scan_report", "win_frame_flags", "src_xmp_state", "src_profiles", "win_frame_number",
    "join_skip_existing", "agg_summary", "agg_warning_groups", "agg_overall", "st_run_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("filmroll-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    started = time.perf_counter()
    pixel_count = pixels(spark, sf_dir).count()
    frame_meta(spark, sf_dir)
    times["ingest"] = round(time.perf_counter() - started, 3)
    queries = load().QUERIES
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "pixels": pixel_count,
        "printed_pixels_per_sec": round(pixel_count / times["plan_print_frames"])}))
    spark.stop()


if __name__ == "__main__":
    main()
