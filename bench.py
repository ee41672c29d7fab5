"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_ML=0 to skip
model training.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "column_profile", "validation_checks", "sample_values", "unique_by_column", "numeric_stats", "categorical_stats",
    "category_by_target", "numeric_histogram", "correlation_matrix", "churn_kpis", "prepare", "train_test_split",
    "impute_median", "score_batch", "explain_rules", "roc_auc", "model_comparison", "history_query",
    "history_with_model", "latest_predictions", "resolve_active", "history_export",
]
ML = ["train_and_compare", "score_customers"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or (
        HEADLINE + (ML if os.environ.get("BENCH_ML", "1") != "0" else []))
    from retainx.plans.registry import QUERIES
    from retainx.session import build_session
    spark = build_session(master=f"local[{cpus}]", app="retainx-bench")
    # warm the JVM (class loading, parquet reader, shuffle path) outside the timings
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    times, rows = {}, {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()     # run the whole plan, keep nothing
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    no_ml = round(sum(v for k, v in times.items() if k not in ML), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "value_without_training": no_ml,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
