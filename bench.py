"""Headline queries, timed. Prints one JSON line.

Each query runs over its whole tables and its result is fully computed into a
no-op sink. The smallest tables, where they lie beside the measured ones, run
each query once before, untimed, so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from visitloom.plans.catalog import QUERIES  # noqa: E402
from visitloom.session import local_session  # noqa: E402

HEADLINE = [
    "M28_training_set",
    "TS02_pair_deltas",
    "TS03_feature_deltas",
    "TS07_large_change_flags",
    "TS09_future_label",
    "F08_visit_sums",
    "F19_pair_products",
    "A13_feature_target_correlation",
    "A14_spearman_matrix",
    "A15_quantiles",
    "A20_pivot",
    "P07_conform_to_contract",
    "W01_stratified_folds",
    "M03_yeo_johnson_lambda",
    "M17_threshold_sweep",
    "M20b_score_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in names if os.path.isdir(small) else []:
        QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
