"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads. Each query runs once
to warm up and then BENCH_RUNS times; the median counts. A run includes building the DataFrame and
writing all rows to a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid.queries import load_all  # noqa: E402
from pulsegrid.session import build_session  # noqa: E402

HEADLINE = [
    "stratified_folds", "grouped_metrics", "patient_votes", "line_condition_summary",
    "balanced_resample", "augmented_rows", "proportion_sample", "sample_positions", "filled_gaps",
    "abs_max_normalised", "k_peak_normalised", "overlapping_windows", "window_peak_medians",
    "spikes_removed", "kernel_convolution", "four_band_split", "resampled_up", "band_passed",
    "zero_phase_low", "ecg_chain", "cycle_intervals", "white_noise", "augmented_batch",
    "log_mel_features", "harmonic_percussive_masks", "contrastive_scores", "best_features",
    "fractional_steps", "decoded_wavs", "streamed_windows",
    # Chains, jobs and record-level forms.
    "pcg_chain", "notched", "built_fragments", "recorded_noise", "heart_noise_from_blocks", "augmented_pcg_records", "resampled_mixed",
    "schedule_stage_sets", "radix_medians", "svm_metrics",
]
#: Seconds after which queries are timed once only.
PATIENCE = 120


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(f"local[{cpus}]", "pulsegrid-bench", **{
        "spark__sql__shuffle__partitions": cpus, "spark__ui__enabled": "false",
        "spark__ui__showConsoleProgress": "false", "spark__driver__memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry, times = load_all(), {}

    def once(name: str) -> float:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    began = time.perf_counter()
    for name in names:
        once(name)
        repeats = runs if time.perf_counter() - began < PATIENCE else 1
        times[name] = round(statistics.median(once(name) for _ in range(repeats)), 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
