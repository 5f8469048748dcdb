"""Headline plans at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each plan is run once to warm the JVM's generated code and once for the time. A plan is
executed fully with the no-op sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from diurna.plans import load_all
from diurna.plans.registry import QUERIES
from diurna.session import local_session

HEADLINE = [
    "subject_mean_std", "join_activity_sleep_day", "dedup_longest", "interval_to_minute_grid", "parse_slash_series", "series_numeric_stats",
    "sleep_onset_waso_awakenings", "m10_l5_minute", "cosinor_fit", "subject_rich_stats", "variability_family", "compact_variability",
    "sleep_regularity_index", "interdaily_stability_intradaily_variability", "windows_consecutive", "midrank_percentile", "winsorise",
    "repeated_kfold", "undersample_subject_balanced", "smote", "roc_auc", "threshold_youden", "bootstrap_ci", "permutation_p", "welch_t",
    "random_intercept_test", "bh_fdr", "ks_two_sample", "stability_selection", "fit_logistic", "univariate_effect_table", "smote_tomek", "spectral_peak_ratio",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    spark.range(100_000_000).selectExpr("sum(pmod(xxhash64(id), 1000))").collect()  # the same work every time: how fast the machine is
    calibration = round(time.perf_counter() - t0, 3)
    for name in names:
        for _ in range(2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "calibration": calibration, "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
