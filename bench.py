"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores.  Every query is run to its end into a sink that keeps
nothing, so all rows and columns are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # cleaning and audits
    "dedup_first_key", "duplicate_audit", "text_flags", "missing_census",
    # alignment and windows on the user panel (one row per user and hour)
    "regularize", "lag_features", "rolling_lagged", "seasonal_naive", "sequence_windows", "argmax",
    "standardize_by_series",
    # profiles, correlation, trend
    "seasonal_profile", "boxplot_stats", "corr_matrix", "ols_trend",
    # signal
    "forward_fill", "interpolate_linear", "seasonal_decompose", "acf", "pacf", "adf_test", "kpss_test",
    # models and backtests
    "fit_predict_linear_panel", "quantile_forecast", "ablation_sets", "walk_forward_retrain",
    "rolling_origin_score", "naive_validation",
    # pipelines
    "master_table", "day_ahead_matrix", "intraday_matrix", "error_profile",
]


def main() -> None:
    from chronolith.catalog import QUERIES
    from chronolith.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    # One untimed run so that JVM and Python worker start-up is not charged to the first query.
    QUERIES["pacf"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
