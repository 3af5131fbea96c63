"""Time the headline queries on $BENCH_SF_DIR and print one JSON line."""

import json
import os
import sys
import time

from trialspark.plans.registry import QUERIES
from trialspark.session import local_session

HEADLINE = [
    "participant_counts",
    "sdt_measures",
    "excluded_trials",
    "proportion_present",
    "median_nonzero",
    "summary_mean_ci",
    "reproduction_histogram",
    "paired_bayes_factor",
    "signed_rank",
    "hurdle_loglik",
    "predict_expected",
    "predict_sampled",
    "conditional_draws",
    "predicted_effect",
    "rhat_split",
    "rhat_rank",
    "model_evidence",
    "effect_regression",
]


def run(spark, name, sf_dir):
    """Seconds to compute every row of a query; the rows are discarded, not collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start-up, not timed
    # Best of two: the first run of a plan also compiles its code.
    seconds = {name: round(min(run(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
