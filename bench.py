"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pulseframe.queries import queries

HEADLINE = (
    "signal_fs_gaps", "saturation_runs", "scale_p95_normalise", "gate_bin_median", "hysteresis_episodes", "detector_mad", "window_coverage_gap_qc", "window_td_features", "interp_align",
    "coactivation_trapz", "kpi_multi_stats", "kpi_task_medians", "spearman_pairs", "descriptives_grouping_sets", "mwu_u_effect", "wilcoxon_w_effect", "friedman_chi2", "bh_fdr_families",
    "gap_closure", "auc_rank", "bayes_grid_posterior", "lmm_random_intercept", "filtfilt_bandpass", "loso_models",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every, took = queries(), {}
    every[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts workers, compiles code
    for name in HEADLINE:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
