"""Headline queries at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_rules",
    "J1_left_equi",
    "J2_star_inner",
    "J13_knn_join",
    "classification_metrics",
    "topk_by_ppv_per_tag",
    "threshold_sweep_metrics",
    "describe",
    "histogram_weighted",
    "auc",
    "roc_points",
    "percentile_rank_cut",
    "create_ratios",
    "primary_weight_features",
    "fold_stratified",
    "resample_random_under",
    "resample_gaussian",
    "resample_smote",
    "resample_nearmiss",
    "resample_tomek",
    "ensemble_and",
    "ensemble_vote",
    "agreement_matrix",
    "impact_tail_sum",
    "shapley_values",
]


def main() -> None:
    from raresight.session import get_session, release_scratch
    from workload.registry import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", cores, int(cores))
    reg = registry()
    keys = sys.argv[1:] or HEADLINE
    # class loading and code generation of the first jobs are not a query
    reg["classification_metrics"][0](spark, "/root/testdata/sf0.001").count()
    times = {}
    for key in keys:
        start = time.perf_counter()
        reg[key][0](spark, sf).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
        release_scratch(spark)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
