"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabgauge.plans import catalogue
from tabgauge.session import get_spark

HEADLINE = [
    "incumbent_metric_table",
    "incumbent_results",
    "metric_table",
    "dense_grid",
    "total_walltime_days",
    "walltime_histogram",
    "method_ranks",
    "value_ranks_all_rows",
    "collection_ranks",
    "shuffled_trajectories",
    "ranks_random_sets",
    "kendall_tau_all_rows",
    "signed_rank_sums",
    "hardness_std",
    "binary_label_scores",
    "binary_rank_scores",
    "multiclass_rank_scores",
    "score_table",
    "dataset_properties",
    "remove_missing_values",
    "balance_binarize",
    "stratified_splits",
    "ordinal_encode",
    "median_impute",
    "quantile_uniform",
    "equal_count_bins",
    "use_counts",
    "co_used_sets",
    "collection_metadata",
    "flatten_records",
    "mean_over_splits",
    "nearest_neighbours",
]


def run(spark, call, sf_dir: str) -> float:
    began = time.time()
    call(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("tabgauge-bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    calls = catalogue.callables()
    run(spark, calls["incumbent_metric_table"], sf_dir)  # start-up and first compilation
    seconds = {}
    for name in HEADLINE:
        try:
            seconds[name] = round(run(spark, calls[name], sf_dir), 3)
        except Exception as error:  # noqa: BLE001 - one failure must not hide the rest
            print(f"{name}: {type(error).__name__}: {error}"[:500], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "failed": [n for n in HEADLINE if n not in seconds],
            }
        )
    )


if __name__ == "__main__":
    main()
