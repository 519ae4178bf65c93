"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS say over what and on how many cores."""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from cadenza.plans import alignment, fixtures, registry

HEADLINE = [
    "leaderboard", "align_steps", "boundary_errors", "per_type", "common_matched_mae", "boundary_detection", "nearest_gold_boundary", "word_error_rates", "bootstrap_ci", "pool_summary", "tail_percentiles",
    "calibration", "segment_native", "segment_pauses", "interval_violations", "strip_oov", "canonicalize_labels", "mix_sources", "foreground_draws", "mix_waveforms",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, times = registry.queries(), {}
    made["pool_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is no query's time
    for name in HEADLINE:
        began = time.perf_counter()
        made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    cells = len(fixtures.SYSTEMS) * len(fixtures.CONDITIONS)
    pairs = fixtures.gold(spark, sf_dir).select("utt_id").distinct().count() * cells
    rates = {"pairs_aligned": pairs, "pairs_per_sec": round(pairs / times["align_steps"], 1), "replicates_per_sec": round(alignment.REPLICATES * cells / times["bootstrap_ci"], 1)}  # with all that comes before them
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
